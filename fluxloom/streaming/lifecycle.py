"""Lifecycle state machine and phase advancement over an event stream (ID K2)."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fluxloom.operators.evidence import PHASES

STATES = ("active", "paused", "stopped", "published", "archived")  # fixed values
LOCKED = ("stopped", "published", "archived")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "target_id long, event_id long, from_state string, to_state string, accepted boolean, problem string"

MOVES = "target_id long, event_id long, event string, from_state string, to_state string, from_phase string, to_phase string, accepted boolean, problem string"
RUN = 100_000  # events of a target that are sorted in memory
SLICE = 10_000  # rows emitted at once


def in_order(frames: Iterator[pd.DataFrame], by: Sequence[str], run: int = RUN) -> Iterator[tuple]:
    """Rows of all frames as named tuples, in the order of ``by``.

    A hot target may bring any number of rows in one batch: every ``run`` rows are sorted and spilled to
    a temporary file of the task, and the sorted runs are merged from there a few rows at a time.
    """
    held, rows, runs = [], 0, []
    spill = None
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= run:
            spill = spill or tempfile.TemporaryFile()
            spill.seek(0, 2)
            whole, places = pd.concat(held).sort_values(list(by), kind="stable"), []
            for at in range(0, len(whole), 500):
                places.append(spill.tell())
                pickle.dump(whole.iloc[at : at + 500], spill)
            runs.append(places)
            held, rows = [], 0
    rest = pd.concat(held).sort_values(list(by), kind="stable") if held else pd.DataFrame()

    def read(places: list[int]) -> Iterator[tuple]:
        for place in places:
            spill.seek(place)
            yield from pickle.load(spill).itertuples(index=False)

    key = lambda row: tuple(getattr(row, c) for c in by)
    yield from heapq.merge(*map(read, runs), rest.itertuples(index=False), key=key) if runs else rest.itertuples(index=False)
    if spill:
        spill.close()


def in_slices(rows: Iterator[tuple], columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Frames of at most ``SLICE`` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == SLICE:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def step(state: str, wanted: str, reason: str | None) -> str | None:
    """Why a transition is refused, or None."""
    if wanted not in STATES:
        return "unknown state"
    if wanted == state:
        return "state unchanged"
    if state in LOCKED and not (isinstance(reason, str) and reason.strip()):
        return "reason required"
    return None


class Lifecycle(StatefulProcessor):
    """Keeps one state per target; a micro-batch is applied in (time, event id) order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.current.get()[0] if self.current.exists() else "active"

        def applied():
            nonlocal state
            for event in in_order(rows, ["at", "event_id"]):
                problem = step(state, event.state, event.reason)
                yield key[0], event.event_id, state, event.state, problem is None, problem
                state = event.state if problem is None else state

        yield from in_slices(applied(), ["target_id", "event_id", "from_state", "to_state", "accepted", "problem"])
        self.current.update((state,))

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """Accepted and refused transitions; columns ``target_id, event_id, at, state, reason``.

    Needs the RocksDB state store. A target's events are sequential by nature; what one key brings to a task
    is sorted in runs that spill, and emitted in slices.
    """
    return events.groupBy("target_id").transformWithStateInPandas(Lifecycle(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def advance(state: str, phase: str, gates: dict[str, str]) -> str | None:
    """Why a target may not leave its phase, or None. ``gates`` holds each phase's latest errors, empty if it passed."""
    if state == "stopped":
        return "lifecycle is stopped"
    if phase not in gates:
        return "no gate snapshot"
    if gates[phase]:
        return gates[phase]
    if phase == PHASES[-1] and state in ("published", "archived"):
        return f"lifecycle is already locked: {state}"
    return None


class Progress(StatefulProcessor):
    """Keeps a target's state, phase and latest gate snapshots; applies state changes and advances in time order.

    An advance out of the last phase locks the lifecycle: the state becomes published and the phase stays.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "state string, phase string")
        self.gates = handle.getMapState("gates", "phase string", "errors string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, phase = self.current.get() if self.current.exists() else ("active", PHASES[0])
        gates = {k[0]: v[0] for k, v in self.gates.iterator()}
        known = dict(gates)

        def applied():
            nonlocal state, phase
            for event in in_order(rows, ["at", "rank", "event_id"]):
                if event.kind == "gate":
                    gates[event.phase] = event.errors or ""
                    continue
                before = state, phase
                if event.kind == "advance":
                    problem = advance(state, phase, gates)
                    if problem is None and phase == PHASES[-1]:
                        state = "published"
                    elif problem is None:
                        phase = PHASES[PHASES.index(phase) + 1]
                else:
                    problem = step(state, event.state, event.reason)
                    state = event.state if problem is None else state
                yield key[0], event.event_id, event.kind, before[0], state, before[1], phase, problem is None, problem

        yield from in_slices(applied(), ["target_id", "event_id", "event", "from_state", "to_state", "from_phase", "to_phase", "accepted", "problem"])
        self.current.update((state, phase))
        for name, errors in gates.items():
            if known.get(name) != errors:
                self.gates.updateValue((name,), (errors,))

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, gates: DataFrame) -> DataFrame:
    """State changes and phase advances of every target, accepted or refused, as rows of ``MOVES``.

    ``events`` has ``target_id, event_id, at, kind`` (``state`` or ``advance``), ``state, reason``; ``gates``, the second
    input, has ``target_id, event_id, at, phase, errors`` (null or empty: passed). An advance sees the latest
    snapshot of its phase; snapshots count before events of the same time. What arrives in a later batch is
    applied after what came before, whatever its time. Needs the RocksDB state store.
    """
    told = events.select("target_id", "event_id", "at", "kind", F.lit(1).alias("rank"), "state", "reason")
    seen = gates.select("target_id", "event_id", "at", F.lit("gate").alias("kind"), F.lit(0).alias("rank"), "phase", "errors")
    both = told.unionByName(seen, allowMissingColumns=True)
    return both.groupBy("target_id").transformWithStateInPandas(Progress(), outputStructType=MOVES, outputMode="Append", timeMode="None")


def run_to_table(stream: DataFrame, sink: str, checkpoint: str):
    return stream.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

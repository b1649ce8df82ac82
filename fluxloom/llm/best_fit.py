"""Best-fit packing of token sequences with a swap-based local search.

Tokenising yields one narrow row per piece; those rows are dealt out evenly in groups of
bounded size and each group is packed on its own: best fit in decreasing order, then
exchanges between underfull bins that raise the sum of squared fills until bins empty.
A group of ``GROUP`` pieces ends at most about one bin above its own lower bound, so more
groups, and so more machines, cost next to nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.tokens import byte_bpe, default_path
from fluxloom.session import settle

GROUP = 50_000  # pieces packed together
FIELDS = "piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` (and ``ids`` as bytes, 4 each).

    Only documents of more than ``capacity`` ids, the end id included, are cut; all pieces but
    the first are full. A null text is empty and yields the end id alone. Repeated rows
    yield their pieces each. Other columns are ignored; no rows give no rows.
    """
    path = path or default_path()
    kind = docs.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, out = [], ([], [], [], [], [])
            for k, text in enumerate(batch.column(1)):
                ids = bpe.ids(text.as_py()) + end
                n = len(ids) // 4
                at = [0, *range(n % capacity or capacity, n, capacity), n]
                for piece, (start, stop) in enumerate(zip(at, at[1:], strict=False)):
                    own = ids[4 * start : 4 * stop]
                    rows.append(k)
                    for column, value in zip(out, (piece, start, stop - start, zlib.crc32(own), own), strict=True):
                        column.append(value)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:4])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(out[4], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = f"doc_id {kind.simpleString()}, {FIELDS}" + (", ids binary" if with_ids else "")
    return docs.select(id_col, text_col).mapInArrow(cut, fields)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Place every piece: the columns of ``pieces`` with ``sequence_id`` and ``offset``.

    ``pieces`` has a ``length`` from 1 to ``capacity``. It must be cheap to read twice.
    """
    n = pieces.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, rows = TaskContext.get().partitionId() << 40, [], 0

        def packed():
            nonlocal first
            table = pa.Table.from_batches(held)
            bins, offsets = fill(table.column("length").to_numpy(), capacity)
            ids = pa.array(bins + first)
            first += int(bins.max()) + 1
            yield from table.append_column("sequence_id", ids).append_column("offset", pa.array(offsets)).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= GROUP:
                yield from packed()
                held, rows = [], 0
        if held:
            yield from packed()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.repartition(max(1, -(-n // GROUP))).mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: ``cut_pieces`` and ``pack``."""
    return pack(settle(cut_pieces(docs, capacity, end_id, path, id_col, text_col)), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id, length, ids`` from placed pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def fill(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Full items take a bin each."""
    bins = np.zeros(len(sizes), np.int64)
    full = sizes >= capacity
    bins[full] = np.arange(full.sum())
    rest = np.flatnonzero(~full)
    if len(rest):
        bins[rest] = int(full.sum()) + _search(sizes[rest].tolist(), capacity)
    order = np.lexsort((np.arange(len(sizes)), bins))
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    new = np.r_[True, np.diff(bins[order]) != 0]
    offsets = np.empty(len(sizes), np.int64)
    offsets[order] = starts - starts[new][np.cumsum(new) - 1]
    return bins, offsets


def _best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Largest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for item in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[item]
        over = rooms >> size
        if over:
            room = size + (over & -over).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        if left := room - size:
            with_room[left].append(b)
            rooms |= 1 << left
    return bins


def _search(sizes: list[int], capacity: int) -> np.ndarray:
    """Local search over underfull bins: each step takes the fullest bin ``a`` and fills its gap
    from an emptier bin ``b`` by a move, a one-for-one or a two-for-one exchange.

    A step that adds ``d`` tokens to ``a`` raises the squared fills if fill(a) + d > fill(b).
    """
    bins = _best_fit(sizes, capacity)
    fills = [sum(sizes[i] for i in own) for own in bins]
    least = -(-sum(sizes) // capacity)
    home = [0] * len(sizes)
    for b, own in enumerate(bins):
        for i in own:
            home[i] = b

    def shift(a: int, give: tuple, b: int, take: tuple) -> None:
        for i in give:
            bins[a].remove(i)
            bins[b].append(i)
            home[i] = b
        for i in take:
            bins[b].remove(i)
            bins[a].append(i)
            home[i] = a
        d = sum(sizes[i] for i in take) - sum(sizes[i] for i in give)
        fills[a] += d
        fills[b] -= d

    def kinds(b: int) -> list[tuple[int, list[int]]]:
        """A bin's items by size. The capacity bounds the number of different sizes by its root."""
        own: dict[int, list[int]] = {}
        for i in bins[b]:
            own.setdefault(sizes[i], []).append(i)
        return list(own.items())

    def pairs(own: list[tuple[int, list[int]]]):
        """One pair of items for each two sizes of a bin."""
        for k, (s, items) in enumerate(own):
            if len(items) > 1:
                yield 2 * s, (items[0], items[1])
            for t, others in own[:k]:
                yield s + t, (items[0], others[0])

    gained = True
    while gained:
        used = [b for b, f in enumerate(fills) if f]
        if len(used) <= least:
            break
        gained = False
        loose = sorted((b for b in used if fills[b] < capacity), key=fills.__getitem__)  # emptiest first
        singles, twos = _Index(capacity), _Index(capacity)
        for b in reversed(loose):  # what the emptiest bins hold comes last, to be found first
            own = kinds(b)
            for s, items in own:
                for i in items:
                    singles.add(s, (i,))
            for s, two in pairs(own):
                twos.add(s, two)

        def found(index: _Index, low: int, high: int, a: int):
            """Items of a size in (low, high], as large as can be, out of one bin that is emptier than ``a`` becomes."""
            for s in index.sizes_down(low, high):
                own = index.by_size[s]
                while own and (fills[home[own[-1][0]]] >= capacity or home[own[-1][0]] != home[own[-1][-1]]):
                    own.pop()  # that bin is full by now, or the pair was parted
                if not own:
                    index.drop(s)
                elif home[own[-1][0]] != a and fills[a] + s - low > fills[home[own[-1][0]]]:
                    return s - low, own[-1]
            return None

        for a in reversed(loose):
            again = True
            while again and 0 < fills[a] < capacity:
                again, gap, best, own = False, capacity - fills[a], None, kinds(a)
                ones = [(0, ()), *((s, (items[0],)) for s, items in own)]
                for low, give in [*ones, *pairs(own)]:  # move, one for one, two for one
                    if (hit := found(singles, low, min(capacity, low + gap), a)) and (best is None or hit[0] > best[0]):
                        best = (hit[0], give, hit[1])
                        if best[0] == gap:
                            break
                if best is None or best[0] < gap:  # one for two
                    for low, give in ones[1:]:
                        if (hit := found(twos, low, min(capacity, low + gap), a)) and (best is None or hit[0] > best[0]):
                            best = (hit[0], give, hit[1])
                            if best[0] == gap:
                                break
                if best:
                    shift(a, best[1], home[best[2][0]], best[2])
                    gained = again = True
    number, where = 0, np.zeros(len(sizes), np.int64)
    for own in bins:
        if own:
            where[own] = number
            number += 1
    return where


class _Index:
    """Items, or pairs of one bin, by size; a bit per size that has any."""

    def __init__(self, capacity: int):
        self.by_size: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        self.present = 0

    def add(self, size: int, items: tuple) -> None:
        if size < len(self.by_size):
            self.by_size[size].append(items)
            self.present |= 1 << size

    def drop(self, size: int) -> None:
        self.present &= ~(1 << size)

    def sizes_down(self, low: int, high: int) -> Iterator[int]:
        window = self.present & ((1 << (high + 1)) - 1)
        while (s := window.bit_length() - 1) > low:
            yield s
            window &= (1 << s) - 1

"""License scans with ordered signature rules.

Every whole text is read as UTF-8 with A-Z lower-cased. A keyword automaton decides which of the
rules can match at all; it reads a copy in which each run of characters that are neither a-z nor digits is
one blank, as in the keywords. The rules' regular expressions then run on the text itself. Among
the matches, one that lies inside another of the same or a higher priority is dropped.
One task holds one text at a time, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fluxloom.llm.license_rules import rules

# The phrases that are counted at every place, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_IN_WORD = np.zeros(256, np.uint8)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_BASE = re.compile(b"|".join(rb"(?<![0-9a-z\x80-\xff])(?P<%s>%s)(?![0-9a-z\x80-\xff])" % (label.encode(), rb"[^0-9a-z\x80-\xff]+".join(phrase.encode().split())) for phrase, label in PHRASES.items()))

FIELDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,rule:int,priority:int,start:int,stop:int>>"
_DETECTION = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])


_SPACED = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for c in range(256))


def _spaced(raw: bytes) -> str:
    """``raw`` with one blank for each run of bytes that are neither a-z nor digits."""
    return b" ".join(raw.translate(_SPACED).split()).decode("ascii")


@lru_cache(maxsize=1)
def _gate():
    import ahocorasick

    automaton, by_keyword = ahocorasick.Automaton(), {}
    for rule in rules():
        for keyword in rule.keyword.split(" or "):
            by_keyword.setdefault(_spaced(keyword.encode()), []).append(rule)
    for keyword, own in by_keyword.items():
        automaton.add_word(keyword, (keyword, own))
    automaton.make_automaton()
    return automaton


def detect(text: str) -> list[tuple[str, int, int, int, int]]:
    """``label, rule, priority, start, stop`` of the matches that remain, by place; A-Z of ``text`` are lower case already."""
    tried, found = {}, []
    for own in dict(hit for _, hit in _gate().iter(_spaced(text.encode("utf-8", "surrogatepass")))).values():
        tried.update((rule.number, rule) for rule in own)
    for rule in tried.values():
        found += [(rule.label, rule.number, rule.priority, *m.span()) for m in rule.matches(text)]
    return _outermost(found)


def _outermost(found: list[tuple]) -> list[tuple]:
    """Without the matches inside another of the same or a higher priority; of equal ones the first rule stays."""
    kept: list[tuple] = []
    for priority in sorted({d[2] for d in found}, reverse=True):
        level = [(d[3], -d[4], d[2] == priority, d[1], d) for d in (*kept, *(d for d in found if d[2] == priority))]
        reach, kept = -1, []
        for _, _, new, _, d in sorted(level):
            if not new or d[4] > reach:
                kept.append(d)
            reach = max(reach, d[4])
    return kept


def scan_text(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() knows A-Z only
    inside = _IN_WORD[np.frombuffer(raw, np.uint8)]
    starts = np.flatnonzero(inside & ~np.r_[np.zeros(1, np.uint8), inside[:-1]] & 1) if raw else np.zeros(0, np.int64)
    base = [(m.lastgroup, int(np.searchsorted(starts, m.start()))) for m in _BASE.finditer(raw)] if b"license" in raw else []
    found = detect(raw.decode("utf-8", "surrogatepass"))
    base_labels = sorted({label for label, _ in base})
    labels = sorted({*base_labels, *(d[0] for d in found)})
    score = max([0.9] * bool(base) + [d[2] / 10 for d in found], default=0.0)
    places = [word for _, word in base]
    return len(starts), len(base), min(places, default=None), max(places, default=None), ",".join(base_labels), ",".join(labels), score, [dict(zip(("label", "rule", "priority", "start", "stop"), d, strict=True)) for d in found]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, word and phrase counts, labels, score and the detections.

    ``n_base`` counts the places where a base phrase's words stand next to each other,
    ``first_word`` and ``last_word`` are their smallest and largest first word (null if there
    is none). ``labels`` adds the rules' labels; no label gives an empty string and score 0.
    ``score`` is a tenth of the strongest priority, 0.9 for a base phrase. A null text
    counts as empty; repeated rows are scanned each; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(_DETECTION)]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        for batch in batches:
            rows = [scan_text(text) for text in batch.column(1).to_pylist()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(scan, f"doc_id {kind}, {FIELDS}")

"""Spelling variant grouping by dynamic programming over sorted lists.

Words that differ by one edit agree before it and behind it. The shorter word of a pair is cut into segments; for each
segment the words that agree in all else form a group, and a pair is found in the group of the segment
that its first difference falls into, and in no other. A group that is still large is cut into finer segments until
only the alphabet bounds it. In a group the sorted words are scanned for each word: rows of the
banded edit matrix are kept for the prefix that a word shares with the one before it, and all words behind
a prefix that already needs more than one edit are skipped at once.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.session import settle

SHORTEST = 5  # code points of a word
LEAST = 3  # occurrences of a word
FACTOR = 2  # how many times as frequent a word's form is at least
SEGMENTS = 4  # segments at first
GROUP = 5_000  # words of a group that is cut into finer segments
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % SHORTEST)


def doc_words(identifier: str, text: str) -> Counter:
    """Words of at least ``SHORTEST`` code points of one text as Latin-1 bytes, with the seeded deletions."""
    runs = Counter(_RUN.findall(text.encode("latin-1", "replace").lower()))  # bytes.lower() knows A-Z only
    base, out = zlib.crc32(f"{identifier}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), base)
        if h % 97 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the words with at least ``least`` occurrences in all texts together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for identifier, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.update(doc_words(identifier, text.as_py()))
            if len(held) > 300_000:
                yield from rows()
        yield from rows()

    identifier = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.where(F.col(text_col).isNotNull()).select(identifier, text_col).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _cut(rows: DataFrame, segments: int) -> DataFrame:
    """Rows ``word, n, m, lo, hi`` with the segment [lo, hi) of the shorter word's ``m`` code points cut further.

    ``m`` is the length of the shorter word of a pair, so a word belongs to ``m`` and ``m - 1``.
    """
    width = F.col("hi") - F.col("lo")
    parts = F.least(F.lit(segments), width)
    step = rows.withColumn("_s", F.explode(F.sequence(F.lit(0), parts - 1)))
    ends = {"_lo": F.col("lo") + F.floor(F.col("_s") * width / parts), "_hi": F.col("lo") + F.floor((F.col("_s") + 1) * width / parts)}
    step = step.withColumns({k: v.cast("int") for k, v in ends.items()}).drop("lo", "hi", "_s").withColumnsRenamed({"_lo": "lo", "_hi": "hi"})
    tail = F.col("m") - F.col("hi")
    return step.withColumn("rest", F.concat(F.expr("left(word, lo)"), F.lit(" "), F.when(tail > 0, F.expr("right(word, m - hi)")).otherwise("")))


def grouped(words: DataFrame, segments: int = SEGMENTS, group: int = GROUP) -> DataFrame:
    """Rows of groups ``m, lo, hi, rest`` of words that may be near, each of at most ``group`` words if finer segments can do it."""
    key = ["m", "lo", "hi", "rest"]
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).withColumns({"lo": F.lit(0), "hi": F.col("m")})
    rows, done = _cut(rows, segments), []
    while True:
        rows = settle(rows)
        large = settle(rows.groupBy(*key).count().where((F.col("count") > group) & (F.col("hi") - F.col("lo") > 1)).select(*key))
        if large.isEmpty():
            break
        done.append(rows.join(large, key, "left_anti").select(*key, "word", "n"))
        rows = _cut(rows.join(large, key, "left_semi").drop("rest"), 2)
    out = rows.select(*key, "word", "n")
    for part in done:
        out = out.unionByName(part)
    return out


def near_in(words: list[str], m: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs of places of words one edit apart in a sorted list, whose shorter word has ``m`` code points
    and whose first difference lies in [lo, hi); one at the shorter word's end counts to its last place.

    Row r of the edit matrix compares the first r code points of a listed word with the query's; only its band
    of three cells can hold a distance of at most one. ``rows[r]`` stays valid as long as the prefix does.
    """
    shared = [0] * len(words)
    for k in range(1, len(words)):
        a, b, n = words[k - 1], words[k], 0
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        shared[k] = n
    for q, query in enumerate(words):
        size = len(query)
        rows = [(9, 0, 1)] + [(9, 9, 9)] * (m + 1)  # cells r - 1, r, r + 1 of row r
        k, valid = q + 1, 0  # rows up to ``valid`` fit the word at k
        while k < len(words):
            word, r, dead = words[k], valid, 0
            while r < len(word):
                low, mid, high = rows[r]  # cells r - 1, r, r + 1 of the row above
                c, r = word[r], r + 1
                # cells r - 1, r, r + 1 of the new row
                a = min(mid + 1, (low + (query[r - 2] != c)) if 2 <= r <= size + 1 else 9) if r - 1 <= size else 9
                b = min(high + 1, mid + (query[r - 1] != c), a + 1) if r <= size else 9
                e = min(high + (query[r] != c), b + 1) if r + 1 <= size else 9
                rows[r] = (a, b, e)
                if a > 1 and b > 1 and e > 1:
                    dead = r
                    break
            if dead:
                k = bisect_left(words, word[:dead] + "\U0010ffff", k)
                valid = shared[k] if k < len(words) else 0
                valid = min(valid, dead - 1)
                continue
            short, long_ = (query, word) if size <= len(word) else (word, query)
            at = len(word) - size + 1  # the band's cell at the query's end: 0, 1 or 2 from its right
            if len(short) == m and 0 <= at <= 2 and rows[len(word)][2 - at] == 1:
                first = 0
                while first < m and short[first] == long_[first]:
                    first += 1
                if lo <= min(first, m - 1) < hi:
                    yield q, k
            k += 1
            valid = min(shared[k], len(word)) if k < len(words) else 0


def near_pairs(words: DataFrame, segments: int = SEGMENTS, group: int = GROUP) -> DataFrame:
    """Each pair of ``words(word, n)`` one edit apart, in both directions: ``word, n, other, other_n``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, counts = None, [], []
        out: tuple[list, list, list, list] = ([], [], [], [])

        def search():
            m, lo, hi = map(int, key.split(" ", 3)[:3])
            for a, b in near_in(names, m, lo, hi):
                for column, both in zip(out, ((names[a], names[b]), (counts[a], counts[b]), (names[b], names[a]), (counts[b], counts[a])), strict=True):
                    column.extend(both)

        def found():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k % 2 else pa.string()) for k, x in enumerate(out)], names=["word", "n", "other", "other_n"])
            for column in out:
                column.clear()

        for batch in batches:
            for k, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(names) > 1:
                        search()
                    key, names, counts = k, [], []
                names.append(word)
                counts.append(n)
            if len(out[0]) > 100_000:
                yield from found()
        if len(names) > 1:
            search()
        yield from found()

    rows = grouped(words, segments, group).select(F.concat_ws(" ", "m", "lo", "hi", "rest").alias("key"), "word", "n")
    return rows.repartition("key").sortWithinPartitions("key", "word").mapInArrow(scan, "word string, n bigint, other string, other_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``: forms followed to the last by doubling; each form is more frequent, so there is no cycle."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = settle(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST, factor: int = FACTOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word with its form: ``word, form, root, n, n_near, form_n``.

    Words are the runs of Latin letters of all texts, A-Z in lower case, after the seeded deletions, with at least
    ``least`` occurrences. ``form`` is the most frequent word one edit away (ties: the first in code-point order) if it is
    ``factor`` times as frequent, else null. A null text has no words; a null identifier is empty in the seed; repeated
    rows count each; other columns are ignored; no rows give no rows.
    """
    words = settle(word_counts(docs, least, id_col, text_col))
    near = near_pairs(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w"))).alias("best"))
    enough = -F.col("best.n") >= F.lit(factor) * F.col("n")
    near = settle(near.select("word", "n_near", F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")))
    last = roots(near.where(F.col("form").isNotNull()).select("word", "form"))
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")

"""Similarity join on word n-grams with Bayesian pruning of MinHash comparisons.

1. Every whole text becomes the set of its hashed word n-grams; texts with the same set are one
   class, so exact copies never meet again. A class has 128 MinHash values.
2. Bands of four values deal the classes to buckets. Buckets with the same members are the
   same bucket. In a bucket, MinHash values are compared a few at a time, and a pair is dropped
   as soon as the probability that it reaches the threshold, given the matches so far, falls below
   the tolerance. What remains is passed on as a spanning forest, never as all pairs.
3. In each component of these forests the pairs are pruned likewise and the rest is verified
   on the sets themselves. Large buckets and components are cut into blocks, and pairs of blocks are
   compared in tasks of bounded size. Only counts of links and a forest leave a task.

A link is missed with a probability of about 1e-6 (bands: 5e-8 at a similarity of 0.8).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.llm.components import components
from fluxloom.session import settle

WORDS = 5
THRESHOLD = 0.8
HASHES = 128
BAND = 4
STEP = 16  # MinHash values compared before a pair may be dropped
TOLERANCE = 1e-6
BLOCK = 512  # classes of a bucket or component in one block
BLOCK_BYTES = 8_000_000  # bytes of n-gram sets in one block
WORD_TABLE = 300_000  # words whose hash a worker remembers


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= WORD_TABLE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _words() -> _WordHashes:
    return _WordHashes()


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229).integers(0, 2**63, (2, HASHES), np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def grams(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; words are what blanks separate, in lower case.

    A text of fewer words is one n-gram of all of them; one without words has none.
    """
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def min_hashes(own: np.ndarray) -> np.ndarray:
    a, b = _factors()
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(own), 2048):
        best = np.minimum(best, ((own[at : at + 2048, None] * a + b) >> np.uint64(32)).min(0).astype(np.uint32))
    return best


@lru_cache(maxsize=4)
def fewest(threshold: float) -> list[int]:
    """After each step, the fewest matches with which a pair stays.

    Of each value one byte is compared, which matches by chance once in 256. With a uniform prior,
    P(similar | m of s match) is the binomial probability of at most m successes in s + 1 draws.
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for s in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while (total := total + math.comb(s + 1, m) * p**m * (1 - p) ** (s + 1 - m)) < TOLERANCE:
            m += 1
        out.append(m)
    return out


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, with_sets: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, bands, low, sets = [], [], [], [], []
            for text in batch.column(2):
                own = grams(text.as_py(), size)
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                values = min_hashes(own)
                low.append((values & 0xFF).astype(np.uint8).tobytes())
                n.append(len(own))
                if with_sets:
                    sets.append(own.tobytes())
                else:
                    bands.append(values.tobytes())
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            columns = [batch.column(0), batch.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(n, pa.int32()), pa.array(low, pa.binary()), pa.array(sets if with_sets else bands, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "k1", "k2", "n", "low", "bytes"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, f"doc_id {kind}, th bigint, k1 bigint, k2 bigint, n int, low binary, bytes binary")


def _blocked(rows: DataFrame, blocks) -> DataFrame:
    """Deal the rows of each ``key`` to pairs of blocks ``(i, j)``; a row is in as many pairs as its key has blocks."""
    rows = rows.withColumn("nb", blocks.cast("int")).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumns({"i": F.least("blk", "x"), "j": F.greatest("blk", "x")}).drop("x", "nb")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of (key, i, j) and where each group starts, from sorted batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        starts = _starts(table)
        last = int(starts[-1])
        rest = table.slice(last)
        if last:
            yield table.slice(0, last), starts[:-1]
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def _starts(table: pa.Table) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for name in ("key", "i", "j"):
        own = table.column(name).to_numpy()
        change[1:] |= own[1:] != own[:-1]
    return np.flatnonzero(change)


def _matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, HASHES)


def _alike(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Row by row: do the MinHash values leave the pair a chance? Dropped rows are not compared further."""
    live, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for step, need in enumerate(fewest(threshold)):
        part = slice(step * STEP, (step + 1) * STEP)
        matches += (left[live, part] == right[live, part]).sum(1)
        stay = matches >= need
        live, matches = live[stay], matches[stay]
    out = np.zeros(len(left), bool)
    out[live] = True
    return out


class _Forest:
    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, a: int, others: np.ndarray) -> None:
        for mark in np.unique(self.label[others]):
            if mark != self.label[a]:
                self.edges.append((a, int(others[self.label[others] == mark][0])))
                self.label[self.label == mark] = self.label[a]


def _bucket_edges(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs that survive in each bucket."""
    for table, starts in _groups(batches):
        nodes, low = table.column("node").to_numpy(), _matrix(table)
        sizes = np.diff(np.r_[starts, table.num_rows])
        hub = np.repeat(starts, sizes)
        near = _alike(low, low[hub], threshold)
        linked = np.flatnonzero(near & (hub != np.arange(len(hub))))
        out = [(nodes[linked], nodes[hub[linked]])]
        open_ = np.add.reduceat(~near, starts)  # members that the bucket's first does not reach
        for g in np.flatnonzero((open_ > 0) & (sizes > 2)):
            at = slice(starts[g], starts[g] + sizes[g])
            forest = _Forest(sizes[g])
            forest.label[near[at]] = 0
            for a in np.flatnonzero(~near[at]):
                others = np.flatnonzero(forest.label != forest.label[a])
                own = low[at]
                forest.join(a, others[_alike(np.broadcast_to(own[a], (len(others), HASHES)), own[others], threshold)])
            if forest.edges:
                ends = np.array(forest.edges)
                out.append((nodes[at][ends[:, 0]], nodes[at][ends[:, 1]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])


def _overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of rows x columns, as products of blocks of the incidence matrix."""
    ids, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    owner, place = owner[keep], shared[inverse[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(rows), len(columns)), np.float64)
    width = max(256, 4_000_000 // max(len(sets), 1))
    for at in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
        lo, hi = np.searchsorted(place, [at, at + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[lo:hi], place[lo:hi] - at] = 1
        total += block[rows] @ block[columns].T
    return total


def _links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of each class within a pair of blocks, counted in documents and classes, and a spanning forest."""
    for table, starts in _groups(batches):
        low = _matrix(table)
        nodes, weights, blocks = (table.column(c).to_numpy() for c in ("node", "size", "blk"))
        first, second = table.column("i").to_numpy(), table.column("j").to_numpy()
        out: list[tuple] = []
        raw = table.column("bytes")
        for start, stop in zip(starts, np.r_[starts[1:], table.num_rows], strict=True):
            rows = np.flatnonzero(blocks[start:stop] == first[start])
            columns = np.flatnonzero(blocks[start:stop] == second[start])
            same = first[start] == second[start]
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in raw[start:stop]]
            own, n = low[start:stop], np.array([len(s) for s in sets])
            pairs = []
            for k, a in enumerate(rows):
                others = columns[k + 1 :] if same else columns
                others = others[np.minimum(n[others], n[a]) >= threshold * np.maximum(n[others], n[a]) - 1e-9]
                others = others[_alike(np.broadcast_to(own[a], (len(others), HASHES)), own[others], threshold)]
                pairs.append(np.stack([np.full(len(others), a), others], axis=1))
            pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
            if not len(pairs):
                continue
            if len(pairs) <= 64:
                both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs], np.float64)
            else:
                ra, ia = np.unique(pairs[:, 0], return_inverse=True)
                cb, ib = np.unique(pairs[:, 1], return_inverse=True)
                both = _overlaps(sets, ra, cb)[ia, ib]
            pairs = pairs[both >= threshold * (n[pairs[:, 0]] + n[pairs[:, 1]] - both) - 1e-9]
            w, m = weights[start:stop], len(sets)
            docs = np.bincount(pairs[:, 0], w[pairs[:, 1]], m) + np.bincount(pairs[:, 1], w[pairs[:, 0]], m)
            kinds = np.bincount(pairs.ravel(), minlength=m)
            forest = _Forest(m)
            for a in np.unique(pairs[:, 0]):
                forest.join(int(a), pairs[pairs[:, 0] == a, 1])
            here = nodes[start:stop]
            out += [(here[k], here[k], int(docs[k]), int(kinds[k])) for k in np.flatnonzero(kinds)]
            out += [(here[a], here[b], 0, 0) for a, b in forest.edges]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], names=["a", "b", "links", "classes"])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, n_linked_texts, copy_id, n_copies, kept, th``.

    ``class_id`` is the smallest identifier that links lead to; ``n_links`` counts the other rows with a
    Jaccard similarity of word n-grams of at least ``threshold``, copies with the same n-grams
    included, and ``n_linked_texts`` the linked sets that differ. ``copy_id`` is the smallest identifier with the same
    n-grams. ``kept`` marks the one row of each class that stays (of identical rows, all; ``keep_one`` leaves one).
    Null and empty texts are copies of each other and linked to nothing else. A null identifier
    loses to any other. No rows give no rows; other columns are ignored.
    """
    rows = settle(_sets(docs, id_col, text_col, words, False))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")
    classes = settle(rows.groupBy("k1", "k2").agg(rep, F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("bytes").alias("bytes")).withColumn("node", F.xxhash64("k1", "k2")))

    # buckets of two classes or more, one for each distinct set of members
    keys = F.array(*[F.xxhash64(F.substring("bytes", 1 + 4 * BAND * b, 4 * BAND), F.lit(b)) for b in range(HASHES // BAND)])
    bands = classes.where("n > 0").select("node", F.explode(keys).alias("key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("f")).where("m > 1")
    distinct = buckets.groupBy("m", "lo", "hi", "f").agg(F.min("key").alias("key")).select("key", "m")
    members = bands.join(distinct, "key").join(classes.select("node", "low"), "node")
    blocked = _blocked(members, F.ceil(F.col("m") / BLOCK)).select("key", "i", "j", "node", "low")
    roots = components(blocked.mapInArrow(lambda batches: _bucket_edges(batches, threshold), "a bigint, b bigint"))

    # exact verification inside the components of what survived
    nodes = roots.select("node", F.col("root").alias("key")).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("key")).distinct())
    wanted = settle(nodes.join(classes.select("node", "k1", "k2", "rep", "size", "n"), "node"))
    extent = wanted.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    reps = wanted.select(F.col("rep.doc_id").alias("r_id"), F.col("rep.none").alias("r_none"), F.col("rep.th").alias("r_th"))
    mine = docs.select(F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)).alias("r_id"), F.col(id_col).isNull().alias("r_none"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("r_th"), F.col(text_col).alias("text"))
    texts = mine.join(reps.withColumn("r_id", F.coalesce("r_id", F.lit(0).cast(docs.schema[id_col].dataType))), ["r_id", "r_none", "r_th"], "left_semi")
    sets = _sets(texts, "r_id", "text", words, True).select("k1", "k2", "low", "bytes").dropDuplicates(["k1", "k2"])
    work = wanted.join(sets, ["k1", "k2"]).join(extent, "key")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") * 8 / BLOCK_BYTES))
    exact = settle(_blocked(work, blocks).select("key", "i", "j", "node", "blk", "size", "low", "bytes").mapInArrow(lambda batches: _links(batches, threshold), "a bigint, b bigint, links bigint, classes bigint"))

    found = components(exact.where("a <> b").select("a", "b"))
    linked = exact.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"), F.sum("classes").alias("classes"))
    labelled = classes.select("k1", "k2", "node", "rep", "size").join(found, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = labelled.where("links IS NOT NULL").groupBy("root").agg(F.min("rep").alias("first"))
    info = labelled.join(first, "root", "left").select("k1", "k2", "rep", "size", F.coalesce("first", "rep").alias("first"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("classes", F.lit(0)).alias("classes"))
    return rows.select("doc_id", "th", "k1", "k2").join(info, ["k1", "k2"]).select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        (F.col("size") - 1 + F.col("links")).alias("n_links"),
        F.col("classes").alias("n_linked_texts"),
        F.col("rep.doc_id").alias("copy_id"),
        F.col("size").alias("n_copies"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))).alias("kept"),
        "th",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with their own columns."""
    kind = docs.schema[id_col].dataType
    kept = near_groups(docs, id_col, text_col, words, threshold).where("kept")
    keys = lambda c, th: (F.coalesce(c, F.lit(0).cast(kind)).alias("k_id"), c.isNull().alias("k_none"), th.alias("k_th"))
    rows = docs.select(F.struct("*").alias("row"), *keys(docs[id_col], F.xxhash64(F.coalesce(docs[text_col], F.lit("")))))
    names = ["k_id", "k_none", "k_th"]
    once = F.row_number().over(Window.partitionBy(*names).orderBy(*names))
    return rows.join(kept.select(*keys(F.col("doc_id"), F.col("th"))), names, "left_semi").withColumn("n", once).where("n = 1").select("row.*")

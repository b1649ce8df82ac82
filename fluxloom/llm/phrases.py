"""Phrase collocation mining with counting quotient filters.

A phrase of word ids is packed into one to three 64-bit columns and sent through an invertible permutation.
The top bits of the first column choose a block, the next bits are the quotient, everything else is kept as
the remainder, so an entry names its phrase without loss. Every task counts what it reads into filters of
its own, one per block; the filters of a block are sorted alike and are merged across tasks. A phrase
that stands in every row adds one entry per filter, so no task sees more of it than of any other.

A phrase cannot be more frequent than a part of it, hence only words of the least count take ids, and longer
phrases are counted only where each pair of neighbours may be frequent (a bitmap of fixed size answers that).
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.operators.spread import attach
from fluxloom.session import settle

LONGEST = 5  # words of a phrase
LEAST = 100  # occurrences of a candidate
COVERED = 100  # percent of a phrase's occurrences inside a longer one that drop it
TOP = 2000
VOCABULARY = 400_000  # most frequent words that are sent to every task; more of them are joined
FLUSH = 3_000_000  # phrases counted before a task hands its filters on
BLOCK = 1 << 21  # phrases a block is meant to hold
BITMAP = 26  # bits of a place in the bitmap of pairs: 8 MB
UNKNOWN = "und"
SALTS = 16

_ODD, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_ROUNDS = 3
_TOKEN = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r", b" " + b"\n" * 10)
BREAK = b","  # stands for every separator once words are cut


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case, with ``BREAK`` where a piece ends."""
    return text.lower().translate(_TOKEN).replace(b"\n", b" , ").split()


# --- packed phrases and their permutation


class Layout:
    """Columns that hold phrases of up to ``words`` ids of ``bits`` bits each; a missing word is 0."""

    def __init__(self, words: int, bits: int):
        if bits > 32:
            raise ValueError("word ids have at most 32 bits")
        per = min(words, 64 // bits)
        self.words, self.bits = words, bits
        self.fields = [range(at, min(at + per, words)) for at in range(0, words, per)]
        self.widths = [len(own) * bits for own in self.fields]

    def pack(self, ids: np.ndarray) -> list[np.ndarray]:
        """Permuted columns of phrases, one row of ``ids`` each."""
        columns = []
        for own in self.fields:
            x = np.zeros(len(ids), np.uint64)
            for k in own:
                x = (x << np.uint64(self.bits)) | ids[:, k].astype(np.uint64)
            columns.append(x)
        for _ in range(_ROUNDS):
            for k, width in enumerate(self.widths):
                x = columns[k] ^ self._others(columns, k)
                x = (x * np.uint64(_ODD)) & self._mask(width)
                columns[k] = x ^ (x >> np.uint64((width + 1) // 2))
        return columns

    def unpack(self, columns: list[np.ndarray]) -> np.ndarray:
        """The ids again: ``pack`` undone."""
        columns = list(columns)
        for _ in range(_ROUNDS):
            for k in reversed(range(len(columns))):
                width = self.widths[k]
                x = columns[k] ^ (columns[k] >> np.uint64((width + 1) // 2))
                columns[k] = ((x * np.uint64(_INVERSE)) & self._mask(width)) ^ self._others(columns, k)
        ids = np.zeros((len(columns[0]), self.words), np.int64)
        for own, x in zip(self.fields, columns, strict=True):
            for place, k in enumerate(reversed(own)):
                ids[:, k] = (x >> np.uint64(place * self.bits)) & self._mask(self.bits)
        return ids

    def _mask(self, width: int) -> np.uint64:
        return np.uint64((1 << width) - 1)

    def _others(self, columns: list[np.ndarray], k: int) -> np.ndarray:
        """What the other columns add to column ``k``."""
        total = np.zeros(len(columns[k]), np.uint64)
        for other, x in enumerate(columns):
            if other != k:
                x = (x + np.uint64(other + 1)) * np.uint64(_ODD)
                total ^= x ^ (x >> np.uint64(29))
        return total & self._mask(self.widths[k])


# --- counting quotient filters


def counted(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct entries in order of the first column, then the others, with the sums of their counts."""
    if not len(counts):
        return columns, counts
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns = [x[order] for x in columns]
    new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns])]
    at = np.flatnonzero(new)
    return [x[at] for x in columns], np.add.reduceat(counts[order], at)


def to_filter(columns: list[np.ndarray], counts: np.ndarray, widths: list[int], block_bits: int) -> bytes:
    """Sorted entries of one block: entries per quotient, remainders in whole bytes, counters of one byte with an escape."""
    n, rest = len(counts), widths[0] - block_bits
    quotient_bits = min(rest, max(0, n.bit_length() - 1))
    left = rest - quotient_bits
    low = columns[0] & np.uint64((1 << rest) - 1)
    runs = np.bincount((low >> np.uint64(left)).astype(np.int64) if left < 64 else np.zeros(n, np.int64), minlength=1 << quotient_bits)
    kind = "u1" if runs.max(initial=0) < 256 else "<u4"
    remainders = [(low & np.uint64((1 << left) - 1), left), *zip(columns[1:], widths[1:], strict=True)]
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-width // 8)]).tobytes() for x, width in remainders]
    large = counts >= 255
    small = np.where(large, 255, counts).astype(np.uint8)
    return struct.pack("<IBB", n, quotient_bits, kind == "<u4") + runs.astype(kind).tobytes() + b"".join(planes) + small.tobytes() + counts[large].astype("<i8").tobytes()


def from_filter(raw: bytes, widths: list[int], block_bits: int, block: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The entries of a filter, as ``to_filter`` got them."""
    n, quotient_bits, wide = struct.unpack_from("<IBB", raw)
    at, rest = 6, widths[0] - block_bits
    runs = np.frombuffer(raw, "<u4" if wide else "u1", 1 << quotient_bits, at)
    at += runs.nbytes
    left, columns = rest - quotient_bits, []
    for width in [left, *widths[1:]]:
        size = -(-width // 8)
        plane = np.zeros((n, 8), np.uint8)
        plane[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
        columns.append(plane.view("<u8").reshape(n))
        at += n * size
    quotients = np.repeat(np.arange(1 << quotient_bits, dtype=np.uint64), runs)
    columns[0] = columns[0] | (quotients << np.uint64(left) if left < 64 else np.uint64(0)) | (np.uint64(block) << np.uint64(rest) if rest < 64 else np.uint64(0))
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    large = counts == 255
    counts[large] = np.frombuffer(raw, "<i8", int(large.sum()), at + n)
    return columns, counts


# --- jobs


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, word, f`` of every word; a null text has none, a null language is ``UNKNOWN``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows():
            for lang, own in held.items():
                own.pop(BREAK, None)
                words = pa.array(list(own), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), words, pa.array(list(own.values()), pa.int64())], names=["lang", "word", "f"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, Counter()).update(tokens(text.as_py()))
            if sum(map(len, held.values())) > 300_000:
                yield from rows()
        yield from rows()

    rows = _texts(docs, text_col, lang_col).mapInArrow(count, "lang string, word binary, f bigint")
    return rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang")
    return docs.where(F.col(text_col).isNotNull()).select(lang, F.col(text_col).cast("binary").alias("text"))


def numbered(words: DataFrame) -> DataFrame:
    """``words`` (settled) with a gapless ``id`` from 1; only the sizes of the partitions are gathered for it."""
    place = F.monotonically_increasing_id()
    rows = words.withColumns({"_part": F.shiftright(place, 33), "_row": place.bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(before, "_part").withColumn("id", F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def coded(docs: DataFrame, vocabulary: DataFrame, size: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``codes`` of every text that is not null: 4 bytes a word, 0 for a rare word or a separator.

    Up to ``VOCABULARY`` words go to every task; a larger vocabulary is joined with the words of each text.
    """
    texts = _texts(docs, text_col, lang_col)
    if size > VOCABULARY:
        return _coded_by_join(texts, vocabulary)
    ids: dict[str, dict[bytes, int]] = {}
    for row in vocabulary.select("lang", "word", "id").toLocalIterator():
        ids.setdefault(row.lang, {})[bytes(row.word)] = row.id
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                known = shared.value.get(lang, {})
                out.append(np.array(list(map(known.get, tokens(text.as_py()), repeat(0))), "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["codes"])

    return texts.mapInArrow(code, "codes binary")


def _coded_by_join(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The words of each text as rows, joined with the vocabulary over salted keys and gathered per text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = tokens(raw.as_py())
                for at in range(0, len(words), 100_000):
                    own = words[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([text] * len(own), pa.int64()), pa.array(range(at, at + len(own)), pa.int64()), pa.array([lang] * len(own), pa.string()), pa.array(own, pa.binary())], names=["row", "place", "lang", "word"])

    # the number of a text must not change between the two shuffles, so the words are settled
    words = settle(texts.select(F.monotonically_increasing_id().alias("row"), "lang", "text").mapInArrow(split, "row bigint, place bigint, lang string, word binary"))
    known = attach(words, vocabulary.select("lang", "word", "id"), ["lang", "word"], "left", SALTS, ["row"])
    by_text = known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("id", F.lit(0)).alias("id")))).alias("w"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.array(x, "<u4").tobytes() for x in batch.column(0).to_pylist()], pa.binary())], names=["codes"])

    return by_text.select("w.id").mapInArrow(joined, "codes binary")


def frequent(codes: DataFrame, lengths: range, bits: int, total: int, least: int, pairs=None) -> DataFrame:
    """``ids, f, place`` of the phrases of the given lengths with ``least`` occurrences.

    ``total`` is the number of known words, which sets the number of blocks. With ``pairs``, a broadcast bitmap,
    phrases with a pair of neighbours outside of it are not counted. ``place`` is a phrase's place in such a bitmap.
    """
    layout = Layout(max(lengths), bits)
    block_bits = min(layout.widths[0], max(0, (total * len(lengths) // BLOCK).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def filters():
            columns, counts = counted([np.concatenate(x) for x in zip(*held, strict=True)], np.ones(size, np.int64))
            block = (columns[0] >> np.uint64(layout.widths[0] - block_bits)).astype(np.int64) if block_bits else np.zeros(len(counts), np.int64)
            at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for low, high in zip(at.tolist(), [*at[1:].tolist(), len(block)], strict=True):
                raw = to_filter([x[low:high] for x in columns], counts[low:high], layout.widths, block_bits)
                yield pa.RecordBatch.from_arrays([pa.array([block[low]], pa.int64()), pa.array([raw], pa.binary())], names=["block", "filter"])

        for batch in batches:
            for raw in batch.column(0):
                text = np.frombuffer(raw.as_py(), "<u4")
                for at in range(0, len(text), FLUSH // 4):  # a long text in slices that share a phrase's length
                    for ids in _phrases(text[at : at + FLUSH // 4 + max(lengths) - 1], lengths, FLUSH // 4, layout, pairs and pairs.value):
                        held.append(layout.pack(ids))
                        size += len(ids)
                    if size > FLUSH:
                        yield from filters()
                        held, size = [], 0
        if size:
            yield from filters()

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], np.ndarray] | None = None
        waiting, size = [], 0

        def together():
            every = [*([held] if held else []), *waiting]
            return counted([np.concatenate(x) for x in zip(*(c for c, _ in every), strict=True)], np.concatenate([n for _, n in every]))

        for part in parts:
            for raw in part.column("filter"):
                waiting.append(from_filter(raw.as_py(), layout.widths, block_bits, key[0].as_py()))
                size += len(waiting[-1][1])
                if size > BLOCK:
                    held, waiting, size = together(), [], 0
        columns, counts = together()
        often = counts >= least
        columns, counts = [x[often] for x in columns], counts[often]
        ids = [[i for i in own if i] for own in layout.unpack(columns).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(counts), pa.array((columns[0] & np.uint64((1 << BITMAP) - 1)).astype(np.int64))], names=["ids", "f", "place"])

    shards = codes.mapInArrow(build, "block bigint, filter binary")
    return shards.groupBy("block").applyInArrow(merge, "ids array<bigint>, f bigint, place bigint")


def _phrases(text: np.ndarray, lengths: range, starts: int, layout: Layout, bitmap: np.ndarray | None) -> Iterator[np.ndarray]:
    """Ids of the phrases that start at one of the first ``starts`` places, one array per length."""
    known = text > 0
    joined = known[:-1] & known[1:]  # place k and k + 1 belong together
    if bitmap is not None:
        at = np.flatnonzero(joined)
        place = Layout(2, layout.bits).pack(np.stack([text[at], text[at + 1]], axis=1))[0] & np.uint64((1 << BITMAP) - 1)
        joined[at] = (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    own = joined
    for length in range(2, max(lengths) + 1):
        if length > 2:
            own = own[:-1] & joined[length - 2 :] if len(own) else own
        at = np.flatnonzero(own[:starts])
        if length in lengths and len(at):
            ids = np.zeros((len(at), layout.words), np.uint32)
            for k in range(length):
                ids[:, k] = text[at + k]
            yield ids


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """Places of the frequent pairs as one bitmap of fixed size."""
    parts = pairs.groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(32767)).alias("bits"))
    out = np.zeros((1 << BITMAP) // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words ``lang, word, f, id``, frequent phrases ``ids, f``, and all words per language ``lang, n``; all settled."""
    words = settle(word_counts(docs, text_col, lang_col))
    sizes = settle(words.groupBy("lang").agg(F.sum("f").alias("n")))
    vocabulary = settle(numbered(settle(words.where(F.col("f") >= least))))
    size, total = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    bits = max(1, int(size).bit_length())
    codes = settle(coded(docs, vocabulary, size, text_col, lang_col))
    pairs = settle(frequent(codes, range(2, 3), bits, total, least))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(pairs))
    longer = settle(frequent(codes, range(3, LONGEST + 1), bits, total, least, bitmap))
    return vocabulary, pairs.unionByName(longer).select("ids", "f"), sizes


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, covered: int = COVERED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The strongest phrases of each language: ``lang, rank, phrase, a, l, r, n, score`` and ``cut``, the words of the first part.

    ``score`` is floor(1000 a n / (l r)) at the lowest-scoring cut (ties: the smallest first part), exact while 1000 a
    and n stay below 10^18. Phrases that lie in a longer candidate with at least ``covered`` percent of their
    occurrences are dropped. Equal scores go by count, then by phrase in the order of UTF-8 bytes. Null texts are
    empty, a null language is ``und``; repeated rows count each; other columns are ignored; no rows give no rows.
    """
    vocabulary, phrases, sizes = phrase_counts(docs, least, text_col, lang_col)
    single = vocabulary.select(F.array("id").alias("ids"), "f")
    counts = phrases.unionByName(single)
    ids, size = F.col("ids"), F.size("ids")

    # every contiguous part of two or more words of a longer candidate, with the most frequent one around it
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda k: F.slice(ids, k, m))))
    around = phrases.where(size > 2).select(F.explode(parts).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("_around"))
    open_ = phrases.join(around, "ids", "left").where(F.coalesce(F.lit(100) * F.col("_around") < F.lit(covered) * F.col("f"), F.lit(True))).select("ids", F.col("f").alias("a"))

    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"_first": F.slice(ids, F.lit(1), F.col("k")), "_rest": F.slice(ids, F.col("k") + 1, size - F.col("k"))})
    for part, name in (("_first", "l"), ("_rest", "r")):
        cuts = attach(cuts, counts.select(F.col("ids").alias(part), F.col("f").alias(name)), [part], "inner", SALTS, ["ids"])
    head = vocabulary.select(F.col("id").alias("_head"), "lang")
    langs = attach(cuts.withColumn("_head", F.element_at("ids", 1)), head, ["_head"], "inner", SALTS, ["ids"]).join(sizes, "lang")
    wide = "decimal(18,0)"
    score = F.expr(f"(cast(1000 * a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    best = langs.withColumn("score", score).groupBy("lang", "n", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    words = best.select("lang", "n", "ids", "a", "b", F.posexplode("ids").alias("_at", "id"))
    words = attach(words, vocabulary.select("id", F.col("word").cast("string").alias("word")), ["id"], "inner", SALTS, ["ids"])
    phrase = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]))
    named = words.groupBy("lang", "n", "ids", "a", "b").agg(phrase.alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = named.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"), F.col("b.k").alias("cut"), F.pmod(F.xxhash64("ids"), F.lit(64)).alias("_salt"))
    few = rows.withColumn("_r", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")

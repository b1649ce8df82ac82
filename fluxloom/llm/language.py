"""Language identification with interpolated Kneser-Ney character models.

A text becomes a run of symbols: lower-case letters, and one boundary for each run of anything
else. Four symbols of 16 bits make one 64-bit key, scrambled by an odd factor, so the n-grams of a
language are a sorted array of keys with their probabilities, and every lower order
follows from them. Models are fitted on a bounded sample of labelled rows; every
whole text is scored, and the language of the lowest cross-entropy per symbol wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.session import settle

ORDER = 4  # symbols of an n-gram; 64 bits hold four
SAMPLE = 3000  # labelled documents per language that models are fitted and calibrated on
CODE_POINTS = 20_000_000  # code points of a language's sample
ALL_CODE_POINTS = 400_000_000  # code points of all samples together; many languages share them evenly
FEW_LABELS = 10_000  # labels whose shares are sent to every task; more are joined
MATRIX = 24_000_000  # cells of the table of all seen n-grams and languages; without room for it each language is asked alone
UNKNOWN = "und"
MARGIN = 0.75  # nats per symbol that a text may lie above its language's calibrated range: texts of two languages, names and keys stay
FEW = 20  # calibration rows below which a language has no limit of its own
CHUNK = 2_000_000  # symbols scored at once
SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
UNSCRAMBLE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
FIELDS = "lang_pred string, score double, cross_entropy double, n_symbols bigint, rejected boolean"


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Code point -> symbol: its lower-case letter's low 16 bits, 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint16)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            table[code] = (ord(letter.lower()[0]) & 0xFFFF) or 1
    return table


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each behind ``ORDER - 1`` boundaries and closed by one, and each text's number of symbols."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    raw = _alphabet()[np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = raw != 0
    keep[1:] |= raw[:-1] != 0
    keep[np.cumsum(sizes) - 1] = True  # every text keeps its end
    counts = np.add.reduceat(keep, np.cumsum(sizes) - sizes, dtype=np.int64)
    kept = raw[keep]
    out = np.zeros(len(kept) + (ORDER - 1) * len(texts), np.uint16)
    out[np.arange(len(kept)) + np.repeat(np.arange(1, len(texts) + 1) * (ORDER - 1), counts)] = kept
    return out, counts


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scrambled n-gram of every symbol with its history, and their number per text."""
    run, counts = symbols(texts)
    wide = run.astype(np.uint64)
    grams = wide[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        grams |= wide[ORDER - 1 - back : len(wide) - back] << np.uint64(16 * back)
    ends = np.cumsum(counts + ORDER - 1)
    at = np.arange(len(wide))
    mine = at - np.repeat(ends - counts - ORDER + 1, counts + ORDER - 1) >= ORDER - 1
    return grams[mine[ORDER - 1 :]] * SCRAMBLE, counts


def portions(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``CHUNK`` code points together; a longer text comes alone."""
    own, size = [], 0
    for text in texts:
        if own and size + len(text) > CHUNK:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text) + 1
    if own:
        yield own


class Language:
    """Sorted keys of each order with discounted counts and the weights of the lower order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        self.levels, self.uniform = [], 1.0 / max(alphabet, 1)
        for order in range(ORDER, 0, -1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = float(ones / (ones + 2 * twos)) if ones else 0.5
            contexts, where = np.unique(grams >> np.uint64(16), return_inverse=True)
            totals = np.bincount(where, counts)
            kinds = np.bincount(where)
            self.levels.append((order, grams, np.maximum(counts - discount, 0) / totals[where], contexts, discount * kinds / totals))
            # the next order counts the distinct symbols to the left (continuation counts)
            if order > 1:
                grams, counts = np.unique(grams & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)

    def log(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithm of the interpolated probability of each n-gram's last symbol."""
        total, weight = np.zeros(len(grams)), np.ones(len(grams))
        for order, own, share, contexts, left in self.levels:
            part = grams & np.uint64((1 << 16 * order) - 1) if order < 4 else grams
            total += weight * _look(own, share, part, 0.0)
            weight *= _look(contexts, left, part >> np.uint64(16), 1.0)
        return np.log(total + weight * self.uniform)


def _look(own: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(own):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    return np.where(own[at] == wanted, values[at], default)


class Models:
    """All languages in one sorted hash array of the n-grams that any of them has seen."""

    def __init__(self, names: list[str], languages: list[Language]):
        self.names, self.languages, self.limits = names, languages, np.full(len(names), np.inf)
        union = np.unique(np.concatenate([x.levels[0][1] for x in languages]))
        if len(union) * len(names) > MATRIX:
            self.hashes = None
            return
        hashed = union * SCRAMBLE
        order = np.argsort(hashed)
        self.hashes = hashed[order]
        self.logs = np.stack([x.log(union)[order] for x in languages], axis=1).astype(np.float32)

    def log(self, grams: np.ndarray) -> np.ndarray:
        """Logarithms of scrambled n-grams in each language."""
        if self.hashes is None:
            plain = grams * UNSCRAMBLE
            return np.stack([x.log(plain) for x in self.languages], axis=1).astype(np.float32)
        at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        logs = self.logs[at]
        new = np.flatnonzero(self.hashes[at] != grams)
        if len(new):  # seen in no language: lower orders decide
            kinds, inverse = np.unique(grams[new], return_inverse=True)
            plain = kinds * UNSCRAMBLE
            logs[new] = np.stack([x.log(plain) for x in self.languages], axis=1)[inverse]
        return logs

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol in each language, and the number of symbols of each text."""
        grams, counts = keys(texts)
        starts = np.cumsum(counts) - counts
        return -np.add.reduceat(self.log(grams), starts, axis=0, dtype=np.float64) / counts[:, None], counts

    def long_text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``cross_entropies`` of one text, in slices that hand on their last symbols."""
        total, n, tail, letter = np.zeros(len(self.names)), 0, np.zeros(ORDER - 1, np.uint64), False
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK]
            raw = _alphabet()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
            keep = (raw != 0) | np.r_[letter, raw[:-1] != 0]
            run, letter = np.concatenate([tail, raw[keep]]), raw[-1] != 0
            if at + CHUNK >= len(text):
                run = np.append(run, np.uint64(0))  # the text's end
            grams = run[ORDER - 1 :].copy()
            for back in range(1, ORDER):
                grams |= run[ORDER - 1 - back : len(run) - back] << np.uint64(16 * back)
            tail, n = run[len(run) - ORDER + 1 :], n + len(grams)
            if len(grams):
                total += self.log(grams * SCRAMBLE).sum(0, dtype=np.float64)
        return -total[None] / n, np.array([n])

    def scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``cross_entropies`` of any number of texts of any length, about ``CHUNK`` symbols at a time."""
        entropies, counts = [np.zeros((0, len(self.names)))], [np.zeros(0, np.int64)]
        for own in portions(texts):
            e, n = self.long_text(own[0]) if len(own) == 1 and len(own[0]) > CHUNK else self.cross_entropies(own)
            entropies.append(e)
            counts.append(n)
        return np.concatenate(entropies), np.concatenate(counts)

    def limit(self, best: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Highest accepted cross-entropy; short texts vary more."""
        return self.limits[best] + 3.0 / np.sqrt(counts)


def _sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Labelled training rows ``lang, text, calibration``: of each language about ``SAMPLE`` rows of at most ``CODE_POINTS`` together.

    Every label is learned. A row longer than a language's share of code points is judged, but nothing is learned from it.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~_held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = settle(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text") + 1).alias("points")))
    labels = sizes.count()
    most = min(CODE_POINTS, ALL_CODE_POINTS // max(labels, 1))
    shares = sizes.select("lang", F.least(F.lit(float(SAMPLE)) / F.col("n"), F.lit(float(most)) / F.col("points")).alias("share"))
    chance = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) / 1e6
    drawn = rows.where(F.length("text") <= most).join(F.broadcast(shares) if labels <= FEW_LABELS else shares, "lang").where(chance < F.col("share"))
    return drawn.select("lang", "text", (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(10)) == 0).alias("calibration"))


def _held_out(identifier):
    return F.coalesce(F.crc32(identifier.cast("string")) % 5 == 0, F.lit(False))


def limits(lang: np.ndarray, excess: np.ndarray, n: int) -> np.ndarray:
    """Highest accepted excess of each of ``n`` languages, from the calibration rows that were predicted right.

    The quartiles of a language decide, so a few strange rows move nothing. A language of less than
    ``FEW`` rows takes the limit of all languages' rows together: a small model gives more to unknown
    symbols, which must not let strangers in. Without any row there is nothing to calibrate on and no limit.
    """

    def fence(own: np.ndarray) -> float:
        low, high = np.quantile(own, (0.25, 0.75))
        return high + 3 * (high - low) + MARGIN

    pooled = fence(excess) if len(excess) else np.inf
    own = [excess[lang == k] for k in range(n)]
    return np.array([fence(x) if len(x) >= FEW else pooled for x in own])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models | None:
    """Count the sample's n-grams on the executors, build the models, and set each language's limit.

    Learns only from rows whose crc32 of the identifier is not a multiple of 5; a tenth of the
    sample is kept out of the counts and sets the limits. None if no row is labelled.
    """
    sample = _sampled(docs, id_col, text_col, lang_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for own in portions([t for x, t in zip(langs, texts, strict=True) if x == lang]):
                    grams, n = np.unique(keys(own)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.where("NOT calibration").select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # bounded by the sample
    if not len(table):
        return None
    names = sorted(table["lang"].unique())
    grams = {}
    for name in names:
        own = table[table["lang"] == name]
        plain = own["gram"].to_numpy(np.int64).view(np.uint64) * UNSCRAMBLE
        order = np.argsort(plain)
        grams[name] = plain[order], own["n"].to_numpy(np.float64)[order]
    alphabet = len(np.unique(np.concatenate([g & np.uint64(0xFFFF) for g, _ in grams.values()]))) + 1
    models = Models(names, [Language(*grams[name], alphabet) for name in names])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropies, counts = shared.value.scored(batch.column(1).to_pylist())
            best = entropies.argmin(1)
            right = np.array([shared.value.names[b] for b in best]) == np.array(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(best[right]), pa.array(entropies.min(1)[right] - 3.0 / np.sqrt(counts[right]))], names=["lang", "excess"])

    seen = sample.where("calibration").select("lang", "text").mapInArrow(calibrate, "lang bigint, excess double").toPandas()
    models.limits[:] = limits(seen["lang"].to_numpy(np.int64), seen["excess"].to_numpy(np.float64), len(names))
    return models


def predict(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: ``doc_id, held_out, lang_pred, score, cross_entropy, n_symbols, rejected``.

    ``score`` is the winner's share when the languages' cross-entropies are weighed against
    each other (0 to 1); ties go to the first name. Texts that are null or hold no letter are ``und`` with
    score 0 and rejected, as is all when nothing was learned; other texts are rejected when their
    cross-entropy lies above the limit of their language. Repeated rows are predicted each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if own and texts:
                e, n = own.scored(texts)
                best = e.argmin(1)
                low = e[np.arange(len(e)), best]
                score = 1.0 / np.exp(-20.0 * (e - low[:, None])).sum(1)
                none = n <= 1  # nothing but boundaries
                rejected = none | (low > own.limit(best, n))
                pred = np.where(none, UNKNOWN, np.array(own.names, object)[best])
            else:
                n, low, score = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
                none = rejected = np.ones(len(texts), bool)
                pred = np.full(len(texts), UNKNOWN, object)
            columns = [pa.array(pred, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(low), pa.array(n), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "n_symbols", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, _held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(label, f"doc_id {kind}, held_out boolean, {FIELDS}")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on ``docs`` and predict all of them."""
    return predict(docs, fit(docs))


def keep_identified(docs: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """The rows whose language is recognised, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("boolean")
    def accepted(texts):
        import pandas as pd

        if shared.value is None or not len(texts):
            return pd.Series(np.zeros(len(texts), bool))
        e, n = shared.value.scored([t or "" for t in texts])
        return pd.Series((n > 1) & (e.min(1) <= shared.value.limit(e.argmin(1), n)))

    return docs.where(accepted(F.col(text_col)))

"""URL filters: rules first, then a ratio of two character language models.

Two variable-order Markov models over the bytes of a URL, one for accepted and one for rejected URLs, learn from URLs that
a rule decides. A context counts only if it was seen at least twice, so each place takes the longest history that is
known well enough; Witten-Bell weights blend it with its shorter ones. The difference of the
log-likelihoods, divided by the number of symbols, is held against a limit calibrated on URLs kept out of the counts.

Models of up to ``ENTRIES`` n-grams go to every task. Of larger ones the frequent contexts do; a place whose history goes on in
the others is looked up in the table of the rest, dealt out by the two symbols ahead of the place, on which all its contexts agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.session import settle

ORDER = 6  # bytes of an n-gram, so contexts have up to five
SEEN = 2  # least occurrences of a context that is used
ENTRIES = 2_000_000  # n-grams of both models that go to every task; with more, only those of contexts with twice as many occurrences, and so on
SHORT = 2  # orders that always go to every task; the alphabet bounds them
GRAIN = 1e-4  # the limit is a multiple of it
CHUNK = 500_000  # bytes counted or scored at once
ALPHABET = 257
# The rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``host`` and ``path`` of each URL; both are empty if it is null or has no ``://``."""
    url = F.col(url_col).cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def ruling(rules: Sequence[tuple[str, str, str]] = RULES, host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits as a struct ``rule, verdict``, else null; of equal length the first in order of its text."""
    h, p = F.col(host), F.col(path)
    fitting = [
        F.when(((h == name) | h.endswith(f".{name}")) & p.startswith(start), F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict")))
        for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    ]
    return F.coalesce(*fitting, F.lit(None).cast("struct<rule:string,verdict:string>"))


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Six symbols of 10 bits per place, its own the lowest, and the number of places of each URL.

    A symbol is a byte plus 2; 1 ends a URL and 0 stands before its first byte.
    """
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    raw = np.frombuffer(b"\0".join(urls) + b"\0", np.uint8).astype(np.uint64) + np.uint64(2)
    ends = np.cumsum(sizes)
    raw[ends - 1] = 1
    place = np.arange(len(raw)) - np.repeat(ends - sizes, sizes)
    out = raw.copy()
    for back in range(1, ORDER):
        ok = place >= back
        out[ok] |= raw[np.flatnonzero(ok) - back] << np.uint64(10 * back)
    return out, sizes


class Markov:
    """Sorted n-grams of each order with their probabilities, and the contexts that are known well enough."""

    def __init__(self, own: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.levels = []
        for order in range(1, ORDER + 1) if own is not None else ():
            kinds, where = np.unique(own & np.uint64((1 << 10 * order) - 1), return_inverse=True)
            self.add(order, kinds, np.bincount(where, counts, len(kinds)), SEEN)

    def add(self, order: int, kinds: np.ndarray, n: np.ndarray, seen: int) -> None:
        """The sorted n-grams of the next order; those whose context is not seen so often may be missing."""
        contexts, at = np.unique(kinds >> np.uint64(10), return_inverse=True)
        total, types = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(np.float64)
        used = (total >= seen) | (order == 1)
        self.levels.append((order, kinds, n / (total + types)[at], contexts[used], (types / (total + types))[used]))

    def log(self, own: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each n-gram's last symbol."""
        return np.log(self.blend(own, np.full(len(own), 1.0 / ALPHABET))[0])

    def blend(self, own: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each n-gram's last symbol from that under shorter contexts, and whether its longest context was met."""
        whole = np.zeros(len(own), bool)
        for order, kinds, share, contexts, left in self.levels:
            part = own & np.uint64((1 << 10 * order) - 1)
            context = part >> np.uint64(10)
            at = np.minimum(np.searchsorted(contexts, context), max(len(contexts) - 1, 0))
            known = np.flatnonzero(contexts[at] == context) if len(contexts) else np.zeros(0, np.int64)
            if not len(known):
                continue
            place = np.minimum(np.searchsorted(kinds, part[known]), len(kinds) - 1)
            p[known] = np.where(kinds[place] == part[known], share[place], 0.0) + left[at[known]] * p[known]
            if order == ORDER:
                whole[known] = True
        return p, whole


class UrlFilter:
    """Both models and the limit; ``rest`` has the n-grams that are not in the models at hand, None if all are."""

    def __init__(self, accepted: Markov, rejected: Markov, rest: DataFrame | None = None):
        self.accepted, self.rejected, self.limit, self.rest = accepted, rejected, 0.0, rest

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def places(self, urls: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """N-grams, number of the URL, difference of the log-likelihoods and whether both models know it whole; bounded portions of places."""
        start = 0
        for held in portions(urls):
            own, sizes = grams(held)
            owner = np.repeat(np.arange(start, start + len(held)), sizes)
            for at in range(0, len(own), CHUNK):  # a long URL goes on in the next portion
                part = own[at : at + CHUNK]
                (good, whole), (bad, also) = (m.blend(part, np.full(len(part), 1.0 / ALPHABET)) for m in (self.accepted, self.rejected))
                yield part, owner[at : at + CHUNK], np.log(good) - np.log(bad), whole & also
            start += len(held)

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Difference of the log-likelihoods per symbol by the models at hand; above zero speaks for accepting."""
        total = np.zeros(len(urls))
        for _, owner, score, _ in self.places(urls):
            total += np.bincount(owner, score, len(urls))
        return total / np.array([len(u) + 1 for u in urls])


def spread_scores(rows: DataFrame, model: UrlFilter) -> DataFrame:
    """``id, score`` of settled rows ``id, url`` (binary) by the whole models, also by what only the table ``rest`` holds.

    A place that both models at hand know whole is scored in its task. Of the others each n-gram of a portion is a row
    with the URLs it stands in; different n-grams are scored once, beside the rest of their history.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    shape = pa.schema([("gram", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls = batch.column("id").to_numpy(), [u or b"" for u in batch.column("url").to_pylist()]
            sizes = np.array([len(u) + 1 for u in urls])
            for own, owner, score, whole in shared.value.places(urls):
                here, at = np.unique(owner, return_inverse=True)
                sums = np.bincount(at, np.where(whole, score, 0.0), len(here)) / sizes[here]
                yield pa.RecordBatch.from_pylist([{"gram": None, "ids": ids[here].tolist(), "scores": sums.tolist()}], shape)
                open_ = np.flatnonzero(~whole)
                open_ = open_[np.argsort(own[open_], kind="stable")]
                kinds, first = np.unique(own[open_], return_index=True)
                if len(kinds):
                    ends = np.r_[first, len(open_)].astype(np.int32)
                    lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x[open_]))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), lists(ids[owner]), lists(1.0 / sizes[owner])], schema=shape)

    parts = rows.select("id", "url").mapInArrow(split, "gram bigint, ids array<bigint>, scores array<double>")
    pairs = lambda x: x.select(*[c for c in x.columns if c == "score"], F.explode(F.arrays_zip("ids", "scores")).alias("p"))
    history = (F.shiftright("gram", 10).bitwiseAND((1 << 20) - 1)).alias("history")
    wanted = parts.where("gram IS NOT NULL").select("gram").distinct().select(history, "gram").groupBy("history")
    rest = model.rest.select(F.shiftright("kind", 10).bitwiseAND((1 << 20) - 1).alias("history"), "allow", "size", "kind", "n").groupBy("history")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.column("gram").to_numpy().astype(np.int64).view(np.uint64)
        table = right.to_pandas().sort_values(["size", "kind"])
        logs = []
        for kind, at_hand in ((True, shared.value.accepted), (False, shared.value.rejected)):
            p, _ = at_hand.blend(own, np.full(len(own), 1.0 / ALPHABET))
            logs.append(np.log(markov(table[table["allow"] == kind], SHORT + 1).blend(own, p)[0]))
        return pa.table({"gram": left.column("gram"), "score": logs[0] - logs[1]})

    scored = wanted.cogroup(rest).applyInArrow(look_up, "gram bigint, score double")
    known = pairs(parts.where("gram IS NULL")).select("p.ids", F.col("p.scores").alias("score"))
    found = pairs(parts.where("gram IS NOT NULL").join(scored, "gram")).select("p.ids", (F.col("score") * F.col("p.scores")).alias("score"))
    return known.unionByName(found).groupBy(F.col("ids").alias("id")).agg(F.sum("score").alias("score"))


def markov(own: pd.DataFrame, lowest: int = 1, seen: int = SEEN) -> Markov:
    """Model of the n-grams ``size, kind, n``, sorted, of one class; orders above ``SHORT`` need contexts seen ``seen`` times."""
    model = Markov()
    for order in range(lowest, ORDER + 1):
        part = own[own["size"] == order]
        model.add(order, part["kind"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(np.float64), seen if order > SHORT else SEEN)
    return model


def portions(urls: list[bytes]) -> Iterator[list[bytes]]:
    """The URLs in turn, about ``CHUNK`` bytes at a time."""
    held, size = [], 0
    for url in urls:
        held.append(url)
        size += len(url) + 1
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def best_limit(accepted: np.ndarray, rejected: np.ndarray, times: tuple[np.ndarray, np.ndarray] | None = None, margin: float = 1e-6) -> float:
    """The limit with the fewest wrong shares of both classes together; scores from it on are accepted.

    It lies midway between two scores; of equally good places the one nearest zero counts. 0 if a class has no score.
    A score may stand for several, ``times`` of each class.
    """
    if not len(accepted) or not len(rejected):
        return 0.0
    every = np.unique(np.concatenate([accepted, rejected]))
    cuts = np.r_[every[0] - margin, (every[1:] + every[:-1]) / 2, every[-1] + margin]

    def below(scores: np.ndarray, n: np.ndarray) -> np.ndarray:
        order = np.argsort(scores, kind="stable")
        return np.r_[0, np.cumsum(n[order])][np.searchsorted(scores[order], cuts)] / n.sum()

    good_n, bad_n = times or (np.ones(len(accepted), np.int64), np.ones(len(rejected), np.int64))
    wrong = below(accepted, good_n) + 1 - below(rejected, bad_n)
    good = cuts[wrong <= wrong.min() + 1e-12]
    return float(good[np.abs(good).argmin()])


def fit(judged: DataFrame, url_col: str = "url", verdict_col: str = "verdict") -> UrlFilter | None:
    """Learn from all rows whose ``verdict`` is ``allow`` or ``block``; None if one of them has no row.

    A hash of the URL keeps a fifth of the rows out of the counts; all of these calibrate the limit. Equal URLs fall on
    the same side. Counts and scores are added up by Spark; the driver gets the n-grams of the contexts that are used, if these are more
    than ``ENTRIES`` those of the most frequent ones (the others stay a table that is part of the models), and one row per step of ``GRAIN`` of the scores.
    """
    rows = judged.select(F.col(url_col).alias("url"), F.col(verdict_col).alias("verdict")).where(F.col("verdict").isin("allow", "block") & F.col("url").isNotNull())
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(5)) == 0
    rows = rows.select((F.col("verdict") == "allow").alias("allow"), F.col("url").cast("binary").alias("url"), fold.alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, urls = (c.to_pylist() for c in batch.columns)
            for kind in (True, False):
                for part in portions([u for c, u in zip(classes, urls, strict=True) if c == kind]):
                    kinds, n = np.unique(grams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(kinds)), pa.array(kinds.view(np.int64)), pa.array(n)], names=["allow", "gram", "n"])

    counts = rows.where(~F.col("fold")).select("allow", "url").mapInArrow(count, "allow boolean, gram bigint, n bigint").groupBy("allow", "gram").agg(F.sum("n").alias("n"))
    orders = F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda k: F.struct(k.alias("size"), F.col("gram").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k * 10) - 1).alias("kind")))
    levels = counts.select("allow", "n", F.explode(orders).alias("o")).groupBy("allow", "o.size", "o.kind").agg(F.sum("n").alias("n"))
    context = W.partitionBy("allow", "size", F.shiftright("kind", 10))  # at most one row per symbol
    stands = F.floor(F.log2(F.sum("n").over(context) / SEEN)).cast("int")  # thresholds that its context stands
    doublings = F.when((F.col("size") == 1) | (F.col("size") <= SHORT) & (stands >= 0), 62).otherwise(stands)
    levels = levels.withColumn("doublings", doublings).where("doublings >= 0")
    sizes = {r.doublings: r.n for r in levels.groupBy("doublings").agg(F.count(F.lit(1)).alias("n")).collect()}  # 63 rows at most
    least = next(k for k in range(63) if k == 62 or sum(n for at, n in sizes.items() if at >= k) <= ENTRIES)
    table = levels.where(F.col("doublings") >= least).select("allow", "size", "kind", "n").toPandas().sort_values(["size", "kind"])
    if table["allow"].nunique() < 2:
        return None
    models = (markov(table[table["allow"] == kind], seen=SEEN << least) for kind in (True, False))
    rest = settle(levels.where(F.col("doublings") < least).select("allow", "size", "kind", "n")) if least else None
    model = UrlFilter(*models, rest)
    shared = judged.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.floor(shared.value.scores(batch.column("url").to_pylist()) / GRAIN).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("allow"), pa.array(step)], names=["allow", "step"])

    held = rows.where("fold").select("allow", "url")
    if rest is None:
        steps = held.mapInArrow(calibrate, "allow boolean, step bigint")
    else:
        held = settle(held.withColumn("id", F.monotonically_increasing_id()))
        steps = held.join(spread_scores(held, model), "id").select("allow", F.floor(F.col("score") / GRAIN).alias("step"))
    seen = steps.groupBy("allow", "step").agg(F.count(F.lit(1)).alias("n")).toPandas()
    good, bad = (seen[seen["allow"] == kind] for kind in (True, False))
    middles = ((x["step"].to_numpy(np.float64) + 0.5) * GRAIN for x in (good, bad))
    model.limit = best_limit(*middles, (good["n"].to_numpy(np.int64), bad["n"].to_numpy(np.int64)), GRAIN / 2)
    return model


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, score``.

    A rule's verdict stands; else a URL is allowed if its score reaches the calibrated limit. A null URL is empty; the
    empty URL has a score like any other. Without a model (a class has no labelled URL) all that no rule decides is allowed,
    with a null score. Repeated rows are judged each; other columns are ignored; no rows give no rows.
    """
    rows = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))).withColumn("ruling", ruling(rules))
    rows = rows.select("page_id", "url", "host", "path", "ruling.rule", "ruling.verdict")
    found = fit(rows)
    if found and found.rest is not None:
        rows = settle(rows.withColumns({"id": F.monotonically_increasing_id(), "url": F.coalesce(F.col("url").cast("binary"), F.lit(b""))}))
        verdict = F.coalesce("verdict", F.when(F.col("score") >= found.limit, "allow").otherwise("block")).alias("verdict")
        return rows.join(spread_scores(rows, found), "id").select("page_id", "host", "path", "rule", verdict, "score")
    shared = pages.sparkSession.sparkContext.broadcast(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            verdicts = batch.column("verdict").to_pylist()
            scores = model.scores([u or b"" for u in batch.column("raw").to_pylist()]) if model else None
            if model:
                verdicts = [v or ("allow" if s >= model.limit else "block") for v, s in zip(verdicts, scores, strict=True)]
            else:
                verdicts = [v or "allow" for v in verdicts]
            columns = [batch.column(k) for k in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(verdicts, pa.string()), pa.array(scores if model else [None] * len(verdicts), pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.withColumn("raw", F.col("url").cast("binary")).drop("url").mapInArrow(decide, f"page_id {kind}, host string, path string, rule string, verdict string, score double")

"""Fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a set of words weighted by their counts. For each word and sample k, seeded hashes give
r and c from Gamma(2, 1) and b from U(0, 1); with t = floor(ln(w) / r + b) the sample keeps the word
of the smallest ln(c) - r (t - b) - r, together with t. Two texts agree in a sample with a
probability equal to their generalised Jaccard similarity, sum(min(w)) / sum(max(w)).

Samples are taken in blocks of eight: the words of a text are counted, every count is spread
to the blocks, and eight running minima per text and block are all that is aggregated. The text
table is shuffled once by its identifier; the counting and the minima stay in that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.session import settle

SAMPLES = 32
WIDE = 8  # samples computed in one row
ROW = ["k_some", "k_id", "k_th", "k_copy"]


def _uniform(bits: Column, place: int) -> Column:
    """One of three uniform numbers in (0, 1) out of 63 bits."""
    return (F.shiftrightunsigned(bits, 21 * place).bitwiseAND(F.lit(0x1FFFFF)) + F.lit(0.5)) / F.lit(float(1 << 21))


def _sample(word: Column, log_weight: Column, k: Column) -> Column:
    """The sample's key for a minimum: the quantity to minimise in the upper half, word and t in the lower."""
    one, two = F.xxhash64(word, k, F.lit(1)), F.xxhash64(word, k, F.lit(2))
    r = -F.ln(_uniform(one, 0) * _uniform(one, 1))
    c = -F.ln(_uniform(one, 2) * _uniform(two, 0))
    b = _uniform(two, 1)
    t = F.floor(log_weight / r + b)
    value = F.ln(c) - r * (t - b) - r
    drawn = F.shiftleft(one.bitwiseAND(F.lit(0xFFFFFF)), 8).bitwiseOR(t.bitwiseAND(F.lit(0xFF)))
    return F.shiftleft(((value + 100.0) * float(1 << 24)).cast("bigint"), 32).bitwiseOR(drawn)


def sketch(texts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``prints``: for each row of ``texts`` one array<array<int>> entry per text column.

    ``keys`` identify the rows. Words are what blanks separate; a text without words has the empty word alone. Partitioning by
    some of the keys is kept.
    """
    words = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.split(F.trim(F.col(c)), r"\s+").alias("words")) for k, c in enumerate(columns)]))
    rows = texts.select(*keys, words.alias("x")).select(*keys, F.col("x.which").alias("which"), F.explode("x.words").alias("word"))
    counts = rows.groupBy(*keys, "which", F.xxhash64("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.select(*keys, "which", "word", F.ln("n").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(samples // WIDE - 1))).alias("block"))
    least = [F.min(_sample(F.col("word"), F.col("w"), F.col("block") * WIDE + j)).alias(f"s{j}") for j in range(WIDE)]
    minima = blocks.groupBy(*keys, "which", "block").agg(*least)
    drawn = F.array(*[F.shiftright(F.shiftleft(F.col(f"s{j}"), 32), 32).cast("int") for j in range(WIDE)])
    parts = F.array_sort(F.collect_list(F.struct("which", "block", drawn.alias("drawn"))))
    own = lambda k: F.flatten(F.transform(F.filter(F.col("parts"), lambda p: p["which"] == k), lambda p: p["drawn"]))
    return minima.groupBy(*keys).agg(parts.alias("parts")).select(*keys, F.array(*[own(k) for k in range(len(columns))]).alias("prints"))


def likeness(left: Column, right: Column) -> Column:
    """Share of equal samples."""
    return F.size(F.filter(F.arrays_zip(left.alias("a"), right.alias("b")), lambda x: x["a"] == x["b"])) / F.size(left)


def text_of(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.shiftleft(x.cast("bigint"), 32), 32))), 8, "0")), "")


def _successors(keys: DataFrame) -> DataFrame:
    """Each distinct key with the next one in ascending order, the first one after the last.

    Range partitions are numbered in order, so only the first key of each partition (a row per
    partition) has to be seen together.
    """
    own = F.struct("k_some", "k_id", "k_th")
    ranged = settle(keys.repartitionByRange("k_some", "k_id", "k_th").withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min(own).alias("first"))
    order = Window.orderBy("part")
    following = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("over"))
    inside = F.lead(own).over(Window.partitionBy("part").orderBy("k_some", "k_id", "k_th"))
    joined = ranged.withColumn("inside", inside).join(F.broadcast(following), "part")  # a row per partition
    after = F.coalesce("inside", "over")
    return joined.select("k_some", "k_id", "k_th", "n_chars", *[after[c].alias(f"n{c}") for c in ("k_some", "k_id", "k_th")])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per input row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in ascending identifier; the last is followed by the first, a single one by itself. Rows that share an identifier
    are ordered by a hash of their text, and identical rows count as one when the next is sought. A null
    identifier comes first; a null text is empty. Other columns are ignored; no rows give no rows.
    """
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).isNotNull().alias("k_some"), F.coalesce(F.col(id_col), F.lit(0).cast(kind)).alias("k_id"), F.xxhash64(text).alias("k_th"), text.alias("text"))
    key = ["k_some", "k_id", "k_th"]
    after = _successors(rows.select(*key, F.length("text").alias("n_chars")).distinct())
    after = settle(after)
    numbered = rows.withColumn("k_copy", F.row_number().over(Window.partitionBy(*key).orderBy(*key)))
    wanted = after.select(*[F.col(c).alias(f"o{c}") for c in key], F.floor(F.col("n_chars") / 4).cast("int").alias("take"), *[F.col(f"n{c}").alias(c) for c in key])
    # written so that no limit is pushed below the shuffle, which both sides then share
    once = F.col("k_copy").bitwiseAND(F.lit(-2)) == 0
    heads = numbered.where(once).join(wanted, key).select(*[F.col(f"o{c}").alias(c) for c in key], F.left("text", F.col("take")).alias("head"), "take")
    pairs = numbered.join(heads, key).withColumn("edited", F.concat(F.left("text", F.length("text") - F.col("take")), F.col("head")))
    facts = pairs.select(*ROW, F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    prints = sketch(pairs.select(*ROW, "text", "edited"), ROW, ["text", "edited"], samples)
    done = settle(facts.join(prints, ROW).select(*ROW, "n_chars", "edited_sha256", F.col("prints")[0].alias("own"), F.col("prints")[1].alias("changed")))
    following = done.where("k_copy = 1").select(*[F.col(c).alias(f"n{c}") for c in key], F.col("own").alias("other"))
    linked = after.drop("n_chars").join(following, [f"n{c}" for c in key]).select(*key, "other")
    return done.join(linked, key).select(
        F.when(F.col("k_some"), F.col("k_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        text_of(F.col("own")).alias("fingerprint"),
        text_of(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("other")).alias("near_next"),
    )

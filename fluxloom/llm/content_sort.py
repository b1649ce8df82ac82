"""Exact deduplication by sorting contents.

Rows are range-partitioned by their normalised text (sampled splitters over a short
lead of the text, a digest of the whole and the identifier), sorted within partitions,
and compared in full with their neighbour. The identifier is part of the range key, so
a text shared by a third of all rows is spread over many partitions; the runs on both
sides of a partition border are joined afterwards by comparing their texts in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.session import settle

BLANKS = "[\\x20\\x09-\\x0D]"
LEAD = 32  # characters of the text in the range key; the digest and the full text order the rest


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours; the rows at the partition's ends keep their text.

    One batch is held back, so that the last row of the partition can be marked.
    """
    part = TaskContext.get().partitionId()
    run, before, held = 0, None, None

    def out(batch, runs, edges):
        names = [n for n in batch.schema.names if n != "_norm"]
        columns = [batch.column(n) for n in names]
        columns += [pa.array([part] * batch.num_rows, pa.int32()), pa.array(runs, pa.int64()), pa.array(edges, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "_part", "_run", "_edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        runs, edges = [], [None] * batch.num_rows
        for text in batch.column("_norm").to_pylist():
            if before is None:
                edges[0] = text
            elif text != before:
                run += 1
            before = text
            runs.append(run)
        if held:
            yield out(*held)
        held = (batch, runs, edges)
    if held:
        held[2][-1] = before
        yield out(*held)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal means identical after deleting blanks; the row with the most code points in the
    original text stays, then the smallest identifier. A null text counts as empty, and
    empty texts equal each other. Rows that repeat an identifier are counted each; of
    identical rows with the winning identifier exactly one stays. A null identifier loses to any other.
    Columns other than the two named are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), F.length(text).alias("_len"), normalised(F.col(text_col)).alias("_norm"))
    keyed = keyed.withColumns({"_sha": F.sha2(F.col("_norm").cast("binary"), 256), "_lead": F.left("_norm", F.lit(LEAD))})
    ordered = keyed.repartitionByRange("_lead", "_sha", "_id").sortWithinPartitions("_lead", "_sha", "_norm", F.desc("_len"), F.asc_nulls_last("_id"))
    id_type = docs.schema[id_col].dataType.simpleString()
    scanned = ordered.select("_id", "_len", "_sha", "_norm").mapInArrow(_runs, f"_id {id_type}, _len int, _sha string, _part int, _run bigint, _edge string")
    rows = settle(scanned.withColumn("_row", F.monotonically_increasing_id()))

    # one row per run; the sort leaves the best row of a run first, but a group may span partitions
    best = F.min(F.struct((-F.col("_len")).alias("_neg"), F.col("_id").isNull().alias("_none"), "_id", "_row"))
    runs = rows.groupBy("_part", "_run").agg(best.alias("_best"), F.count(F.lit(1)).alias("_n"))
    # borders: at most two runs per partition; a narrow row of each is numbered, and where neighbours agree
    # in digest and length their texts meet in a join on the border's number
    edges = settle(rows.where(F.col("_edge").isNotNull()).groupBy("_part", "_run").agg(F.min("_edge").alias("_edge"), F.min("_sha").alias("_sha")))
    order = Window.orderBy("_part", "_run")
    ends = edges.select("_part", "_run", "_sha", F.length("_edge").alias("_size"))
    ends = ends.withColumns({c + "0": F.lag(c).over(order) for c in ("_part", "_run", "_sha", "_size")}).withColumn("_no", F.row_number().over(order))
    alike = ends.where((F.col("_sha") == F.col("_sha0")) & (F.col("_size") == F.col("_size0")))
    sides = F.explode(F.array(F.struct("_part", "_run"), F.struct(F.col("_part0").alias("_part"), F.col("_run0").alias("_run"))))
    met = alike.select("_no", sides.alias("_s")).select("_no", "_s.*").join(edges.select("_part", "_run", "_edge"), ["_part", "_run"])
    same = met.groupBy("_no").agg((F.min("_edge") == F.max("_edge")).alias("_same")).where("_same")
    fresh = ends.join(same, "_no", "left").withColumn("_fresh", F.when(F.col("_same"), 0).otherwise(1))
    chains = fresh.select("_part", "_run", F.sum("_fresh").over(order).alias("_chain"))
    linked = runs.join(chains, ["_part", "_run"])
    whole = linked.groupBy("_chain").agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n"))
    spanning = linked.select("_part", "_run", "_chain").join(whole, "_chain").select("_part", "_run", "_best", "_n")
    inner = runs.join(chains, ["_part", "_run"], "left_anti")
    groups = inner.unionByName(spanning)
    return rows.join(groups, ["_part", "_run"]).select(
        F.col("_id").alias("doc_id"),
        F.col("_best._id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Rows that share identifier and normalised text collapse to one. The rows travel as
    one struct, so extra columns may have any name.
    """
    kept = mark_copies(docs, id_col, text_col).where("kept").select(*_keys(F.col("doc_id"), docs.schema[id_col].dataType), F.col("text_sha256").alias("k_sha"))
    sha = F.sha2(normalised(docs[text_col]).cast("binary"), 256)
    rows = docs.select(F.struct("*").alias("row"), *_keys(docs[id_col], docs.schema[id_col].dataType), sha.alias("k_sha"))
    keys = ["k_id", "k_none", "k_sha"]
    longest = F.length(F.col("row").getField(text_col))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(longest.desc()))
    return rows.join(kept, keys, "left_semi").withColumn("n", first).where("n = 1").select("row.*")


def _keys(identifier, kind):
    """A null-safe join key as plain columns."""
    return F.coalesce(identifier, F.lit(0).cast(kind)).alias("k_id"), identifier.isNull().alias("k_none")

"""Filters, set operations and reports on records (IDs B5, B7-B11, D10, D17, F4, G1-G4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.operators.spread import fan_out

# Default event-release bounds (minimum, maximum).
TCE_BOUNDS = {"snr": (20.0, None), "period": (1.0, 15.0), "depth_ppm": (200.0, 1500.0), "planet_radius": (1.2, 3.5), "stellar_radius": (None, 1.3), "tmag": (None, 12.5)}


def within_bounds(bounds: Mapping[str, tuple] = TCE_BOUNDS) -> Column:
    """Does a row supply and satisfy every bound? Only a missing magnitude passes."""
    keep = F.lit(True)
    for name, (low, high) in bounds.items():
        ok = F.col(name).isNotNull()
        if low is not None:
            ok = ok & (F.col(name) >= low)
        if high is not None:
            ok = ok & (F.col(name) <= high)
        keep = keep & (F.col(name).isNull() | ok if name == "tmag" else ok)
    return keep


def filter_tce(df: DataFrame, bounds: Mapping[str, tuple] = TCE_BOUNDS) -> DataFrame:
    return df.where(within_bounds(bounds))


def filter_targets(df: DataFrame, tag: str | None = None, phase: str | None = None, mission: str | None = None) -> DataFrame:
    if tag is not None:
        df = df.where(F.array_contains("tags", tag))
    if phase is not None:
        df = df.where(F.col("phase") == phase)
    return df if mission is None else df.where(F.col("mission") == mission)


# Identifier kinds, missions and their text patterns.
IDENTIFIERS = (
    ("toi", "tess", r"(?i)^TOI[\s._-]*(\d{1,7}(?:\.\d{1,2})?)$"), ("tic", "tess", r"(?i)^TIC[\s._:-]*(\d{5,12})$"), ("koi", "kepler", r"(?i)^K[\s_-]*(\d{1,7}\.\d{1,2})$"),
    ("epic", "k2", r"(?i)^EPIC[\s._-]*(\d{6,10})$"), ("pic", "plato", r"(?i)^PIC[\s._-]*(\d{4,10})$"), ("cheops", "cheops", r"(?i)^CHEOPS[\s._-]*([A-Za-z0-9._-]+)$"),
)


def parse_identifiers(df: DataFrame, column: str) -> DataFrame:
    """Kind, mission and value of a catalog identifier; all NULL when no pattern fits."""
    text = F.trim(F.col(column))
    kind = mission = value = F.lit(None).cast("string")
    for k, m, pattern in reversed(IDENTIFIERS):
        hit = text.rlike(pattern)
        kind, mission = F.when(hit, k).otherwise(kind), F.when(hit, m).otherwise(mission)
        value = F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(value)
    return df.withColumns({"kind": kind, "mission": mission, "value": value})


MARKER_KEYS = ("source", "provenance", "origin", "data_source")


def drop_demo(records: DataFrame, collections: Sequence[str] = ()) -> DataFrame:
    """Drop records marked as demonstration or synthetic; keep only the allowed collections."""
    value = lambda k: F.lower(F.coalesce(F.try_element_at("record", F.lit(k)), F.lit("")))
    marked = reduce(lambda a, b: a | b, [value(k).contains(word) for k in MARKER_KEYS for word in ("demo", "synthetic")])
    out = records.where(~marked)
    if collections:
        name = F.upper(F.coalesce(F.try_element_at("record", F.lit("obs_collection")), F.try_element_at("record", F.lit("collection")), F.lit("")))
        out = out.where(name.isin(*collections))
    return out


FPP_KEYS = ("fpp", "FPP", "fpp_value", "fpp_specific", "FPP_specific", "fpp_specific_value")
FPP_THRESHOLD = 0.01


def fpp_flag(reports: DataFrame, payload: str = "report") -> DataFrame:
    """False-positive probability under its usual keys and whether it is below 1 %."""
    value = F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in FPP_KEYS]).try_cast("double")
    return reports.withColumn("fpp", value).withColumn("fpp_below_threshold", F.col("fpp") < FPP_THRESHOLD)


def retrieval_status(df: DataFrame) -> DataFrame:
    """Status from HTTP code, parse error, row count, identity query and format."""
    status = (F.when(F.col("http_code").isin(401, 403), "requires-authentication").when((F.col("http_code") < 200) | (F.col("http_code") >= 300), "unavailable")
              .when(F.col("parse_error").isNotNull(), "unavailable").when(F.col("identity_query") & (F.col("n_rows") > 1), "ambiguous")
              .when((F.col("n_rows") == 0) & F.col("format").isin("json", "csv"), "empty").otherwise("available"))
    return df.withColumn("retrieval_status", status)


def survey_report(targets: DataFrame, candidates: DataFrame, survey_id: str) -> DataFrame:
    """Outcome counts over every registered target, orphaned and invalid records included."""
    known = candidates.select("candidate_id").distinct().withColumn("_known", F.lit(True))
    x = targets.join(known, "candidate_id", "left")
    valid = (F.col("survey_id") == survey_id) & F.col("_known")
    status = F.when(F.col("record_ok") == F.lit(False), "invalid-record").when(~F.coalesce(valid, F.lit(False)), "orphaned-candidate-record").otherwise(F.coalesce("status", F.lit("invalid-record")))
    return x.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("targets"))


CHECKBOX = r"^-\s*\[([ xX])\]\s*(.*)$"


def checklist_progress(lines: DataFrame) -> DataFrame:
    """Checked and mandatory items per document; lines need not be in order."""
    text = F.trim("line")
    item = text.rlike(CHECKBOX)
    x = lines.withColumn("_item", item).withColumn("_done", item & (F.lower(F.regexp_extract(text, CHECKBOX, 1)) == "x")).withColumn(
        "_must", item & F.regexp_extract(text, CHECKBOX, 2).rlike(r"(?i)\[MANDATORY\]"))
    g = x.groupBy("document").agg(F.count_if("_item").alias("total"), F.count_if("_done").alias("checked"), F.count_if("_must").alias("mandatory"),
                                 F.count_if(F.col("_must") & F.col("_done")).alias("mandatory_checked"))
    return g.withColumn("completion", F.when(F.col("total") > 0, F.col("checked") / F.col("total") * 100.0).otherwise(0.0)).withColumn(
        "gate_pass", F.col("mandatory_checked") == F.col("mandatory"))


def limit_harvest(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` outcomes in source order."""
    return df.orderBy("source_row").limit(n)


def common_sectors(light: DataFrame, pixels: DataFrame) -> DataFrame:
    return light.select("target_id", "sector").intersect(pixels.select("target_id", "sector"))


def inventory_diff(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Every difference between declared and found files."""
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("sha256").alias("m_hash"), F.lit(1).alias("_m"))
    f = files.select("path", F.col("size").alias("f_size"), F.col("sha256").alias("f_hash"), F.lit(1).alias("_f"))
    x = m.join(f, "path", "full")
    why = F.when(F.col("_f").isNull(), "missing").when(F.col("_m").isNull(), "undeclared").when(F.col("m_size") != F.col("f_size"), "size").when(F.col("m_hash") != F.col("f_hash"), "hash")
    return x.withColumn("difference", why).where(F.col("difference").isNotNull()).select("path", "difference")


CELL_TASKS = 192  # few enough that the shuffle writes rows as they come instead of sorting them in memory


def grid_completeness(grid: DataFrame, trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells missing from, repeated in or foreign to the reported grid."""
    # all rows meet once in many tasks, neither joined nor gathered ahead of the shuffle; a key with a NULL equals none of the other side
    keys = list(keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    sides = [(grid, F.lit(1), F.lit(0).cast("long")), (trials, F.lit(None).cast("int"), F.lit(1).cast("long"))]
    rows = [df.select(*keys, mark.alias("_g"), count.alias("reported"), F.when(~known, F.lit(i)).alias("_side")) for i, (df, mark, count) in enumerate(sides)]
    x = fan_out(rows[0].unionByName(rows[1]), *keys, least=CELL_TASKS).groupBy(*keys, "_side").agg(F.max("_g").alias("_g"), F.sum("reported").alias("reported")).drop("_side")
    why = F.when(F.col("_g").isNull(), "not declared").when(F.col("reported") == 0, "missing").when(F.col("reported") > 1, "repeated")
    return x.withColumn("problem", why).where(F.col("problem").isNotNull()).drop("_g")


def union_snapshots(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

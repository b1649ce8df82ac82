"""Scans and source contracts (IDs A1-A6, A17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.plans.registry import query
from fluxloom.sources import adapters as A
from fluxloom.sources import cadence as C


@query("a1_read_cadence", f"""WITH {A.raw_sql(A.SERIES16)},
good AS (SELECT *, median(flux) OVER g AS lvl, count(*) OVER g AS n_points FROM raw
  WHERE quality = 0 AND NOT isnan(flux) AND sector IN (1, 2) WINDOW g AS (PARTITION BY target_id, sector))
SELECT event_id, target_id, sector, t, round(flux / lvl, 9) AS flux, n_points FROM good WHERE n_points >= 50""")
def _(spark, folder):
    out = C.clean_cadence(A.raw_cadence(spark, folder, A.SERIES16), sectors=[1, 2], min_points=50)
    return out.select("event_id", "target_id", "sector", "t", F.round("flux", 9).alias("flux"), "n_points")


ROOTED = "CASE WHEN target_id % 3 = 0 AND product = 'p2' THEN 0 ELSE 1 END"


@query("a2_dedupe_products", f"""WITH {A.raw_sql(A.SERIES16)},
r AS (SELECT *, {ROOTED} AS root_rank FROM raw),
sizes AS (SELECT target_id, sector, root_rank, product, count(*) AS c FROM r GROUP BY ALL),
u AS (SELECT *, min(root_rank) OVER (PARTITION BY target_id, product) AS best FROM sizes),
pick AS (SELECT target_id, sector, root_rank, product FROM (
  SELECT *, row_number() OVER (PARTITION BY target_id, sector ORDER BY root_rank, product) AS k
  FROM u WHERE root_rank = best AND c >= 5) WHERE k = 1)
SELECT r.event_id, target_id, sector, product, root_rank FROM r JOIN pick USING (target_id, sector, root_rank, product)""")
def _(spark, folder):
    rows = A.raw_cadence(spark, folder, A.SERIES16).withColumn("root_rank", F.expr(ROOTED))
    return C.dedupe_products(rows, min_points=5).select("event_id", "target_id", "sector", "product", "root_rank")


@query("a3_fill_flux_err", f"""WITH {A.raw_sql()},
c AS (SELECT * FROM raw WHERE NOT isnan(flux)),
m AS (SELECT *, median(flux) OVER (PARTITION BY target_id, sector) AS med FROM c),
d AS (SELECT *, median(abs(flux - med)) OVER g AS mad,
  bool_and(coalesce(flux_err > 0, false)) OVER g AS fine, count(flux_err) OVER g AS reported
  FROM m WINDOW g AS (PARTITION BY target_id, sector))
SELECT event_id, round(CASE WHEN fine THEN flux_err WHEN mad > 0 THEN mad * 1.4826e0 ELSE 1e0 END, 9) AS flux_err,
  CASE WHEN fine THEN 'reported' WHEN reported = 0 THEN 'mad-estimate' ELSE 'mad-estimate-invalid-reported' END AS flux_err_source
FROM d""")
def _(spark, folder):
    rows = A.raw_cadence(spark, folder).where(~F.isnan("flux"))
    return C.fill_flux_err(rows).select("event_id", F.round("flux_err", 9).alias("flux_err"), "flux_err_source")


HEADER = """target_id, sector,
  CASE WHEN target_id % 7 = 1 THEN 'UTC' WHEN target_id % 7 = 2 THEN NULL ELSE ' tdb ' END AS timesys,
  CASE WHEN target_id % 5 = 3 THEN 's' WHEN target_id % 5 = 4 THEN NULL ELSE 'd' END AS timeunit,
  CASE WHEN target_id % 2 = 0 THEN 2457000e0 END AS bjdrefi, CASE WHEN target_id % 2 = 0 THEN 0.25e0 END AS bjdreff,
  CASE WHEN target_id % 3 = 0 THEN 56999e0 END AS mjdrefi, 0.5e0 AS mjdreff,
  CASE WHEN target_id % 11 = 5 THEN 'btjd' WHEN target_id % 11 = 6 THEN 'mjd' END AS time_format,
  CASE WHEN target_id % 7 = 2 AND sector = 1 THEN 'tdb' END AS time_scale"""


@query("a4_to_btjd", f"""WITH {A.raw_sql()},
h AS (SELECT {HEADER} FROM (SELECT DISTINCT target_id, sector FROM raw)),
n AS (SELECT h.*, upper(trim(coalesce(timesys, ''))) AS sc, upper(trim(coalesce(time_scale, ''))) AS de,
  lower(trim(coalesce(timeunit, ''))) AS un, lower(trim(coalesce(time_format, ''))) AS fm,
  bjdrefi + coalesce(bjdreff, 0) AS bjd, mjdrefi + coalesce(mjdreff, 0) AS mjd, mid
  FROM h JOIN (SELECT target_id, sector, median(t) AS mid FROM raw GROUP BY ALL) USING (target_id, sector)),
r AS (SELECT *, CASE WHEN sc <> '' AND sc NOT IN ('TDB', 'BJD_TDB') THEN 'time system is not TDB'
  WHEN de <> '' AND de <> 'TDB' THEN 'declared scale is not TDB'
  WHEN sc = '' AND de <> 'TDB' THEN 'time scale undeclared'
  WHEN un <> '' AND un NOT IN ('d', 'day', 'days') THEN 'time unit is not days'
  WHEN un = '' AND fm NOT IN ('btjd', 'mjd', 'jd') THEN 'time unit undeclared'
  WHEN NOT (fm = 'mjd' OR (mjd IS NOT NULL AND bjd IS NULL)) AND mid <= 2e6 AND bjd IS NULL AND fm <> 'btjd'
  THEN 'time origin undeclared' END AS reason,
  CASE WHEN fm = 'mjd' OR (mjd IS NOT NULL AND bjd IS NULL) THEN coalesce(mjd, 0) + 2400000.5e0 - 2457000e0
  WHEN mid > 2e6 THEN -2457000e0 WHEN bjd IS NOT NULL THEN bjd - 2457000e0 ELSE 0e0 END AS shift FROM n)
SELECT event_id, reason, CASE WHEN reason IS NULL THEN t + shift END AS t_btjd
FROM raw JOIN r USING (target_id, sector)""")
def _(spark, folder):
    rows = A.raw_cadence(spark, folder).drop("product")
    header = rows.select("target_id", "sector").distinct().selectExpr(*[p.strip() for p in split_columns(HEADER)])
    return C.to_btjd(rows, header).select("event_id", "reason", "t_btjd")


def split_columns(text: str) -> list[str]:
    """Split a select list at commas outside parentheses."""
    parts, depth, now = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts, now = [*parts, now], ""
        else:
            now += ch
    return [*parts, now]


@query("a5_median_bin", f"""WITH {A.cadence_sql(A.SERIES16)},
r AS (SELECT *, row_number() OVER (PARTITION BY target_id, sector ORDER BY t) AS rn,
  count(*) OVER (PARTITION BY target_id, sector) AS n FROM lc)
SELECT target_id, sector, CAST(CASE WHEN n <= 60 THEN rn - 1 ELSE (rn * 60 - 1) // n END AS BIGINT) AS bin,
  round(avg(t), 9) AS t, round(median(flux), 9) AS flux, round(median(flux_err), 9) AS flux_err, count(*) AS n_in_bin
FROM r GROUP BY 1, 2, 3""")
def _(spark, folder):
    out = C.median_bin(A.cadence(spark, folder, A.SERIES16), n_bins=60)
    return out.select("target_id", "sector", "bin", *[F.round(c, 9).alias(c) for c in ("t", "flux", "flux_err")], "n_in_bin")


ONE = "0 * user_id"  # all cadences as one series, so that the default number of bins is exceeded


@query("a5_median_bin_default", f"""WITH {A.cadence_sql(ONE)},
r AS (SELECT *, row_number() OVER (PARTITION BY target_id, sector ORDER BY t) AS rn,
  count(*) OVER (PARTITION BY target_id, sector) AS n FROM (SELECT * REPLACE (1 AS sector) FROM lc))
SELECT target_id, sector, CAST(CASE WHEN n <= 4000 THEN rn - 1 ELSE (rn * 4000 - 1) // n END AS BIGINT) AS bin,
  round(avg(t), 9) AS t, round(median(flux), 9) AS flux, round(median(flux_err), 9) AS flux_err, count(*) AS n_in_bin
FROM r GROUP BY 1, 2, 3""")
def _(spark, folder):
    out = C.median_bin(A.cadence(spark, folder, ONE).withColumn("sector", F.lit(1)), n_bins=4000)
    return out.select("target_id", "sector", "bin", *[F.round(c, 9).alias(c) for c in ("t", "flux", "flux_err")], "n_in_bin")


@query("a6_read_pixels", """SELECT vec_id AS cadence, label AS sector, CAST((i - 1) % 8 AS INTEGER) AS x,
  CAST((i - 1) // 8 AS INTEGER) AS y, CAST(embedding[i] AS DOUBLE) AS flux
FROM embeddings, range(1, 65) AS r(i)""")
def _(spark, folder):
    stamps = A.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("cadence"), F.col("label").alias("sector"), F.col("embedding").alias("stamp"))
    return C.read_pixels(stamps)


LABEL = "CASE WHEN l_orderkey % 3 = 0 THEN concat('TESS Sector ', CAST(l_linenumber AS {s})) ELSE 'TESS' END"
NAME = ("CASE WHEN l_orderkey % 3 = 1 THEN concat('tess2024_s00', CAST(l_linenumber AS {s}), '-lc.fits') "
        "ELSE concat('lc', CAST(l_linenumber AS {s}), '.fits') END")


@query("a17_observed_sectors", f"""WITH p AS (SELECT l_partkey AS target_id, {LABEL.format(s='VARCHAR')} AS label,
  {NAME.format(s='VARCHAR')} AS file_name FROM lineitem),
s AS (SELECT target_id, coalesce(TRY_CAST(nullif(regexp_extract(label, '(?i)sector\\s*(\\d+)', 1), '') AS INTEGER),
  TRY_CAST(nullif(regexp_extract(file_name, '(?i)(?:^|[_-])s(\\d{{1,4}})[_.-]', 1), '') AS INTEGER)) AS sector FROM p)
SELECT target_id, array_to_string(list_sort(list(DISTINCT sector)), ',') AS sectors FROM s WHERE sector > 0 GROUP BY 1""")
def _(spark, folder):
    items = A.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("target_id"), F.expr(LABEL.format(s="STRING")).alias("label"),
        F.expr(NAME.format(s="STRING")).alias("file_name"))
    return C.observed_sectors(items).select("target_id", F.array_join(F.transform("sectors", lambda s: s.cast("string")), ",").alias("sectors"))

"""Pixel queries (IDs B6, C13, D12-D16, H29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import pixels as P
from fluxloom.plans.folds import label_sql
from fluxloom.plans.registry import query
from fluxloom.sources import adapters as A
from fluxloom.sources.cadence import read_pixels

DIP = ("CASE WHEN abs(((vec_id * 0.043e0 + 0.5e0) - floor(vec_id * 0.043e0 + 0.5e0) - 0.5e0) * 24e0) < 3e0 THEN 6e0 * exp(((x - 4.3e0) * (x - 4.3e0) + (y - 3.8e0) * (y - 3.8e0)) / -3e0) ELSE 0e0 END")
PX = f"""px0 AS (SELECT vec_id, label AS sector, vec_id * 0.043e0 AS t, CASE WHEN vec_id % 10 = 7 THEN 64 WHEN vec_id % 10 = 3 THEN 256 ELSE 0 END AS quality,
  CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, CASE WHEN vec_id % 31 = 5 AND i = 9 THEN 'nan'::DOUBLE ELSE CAST(embedding[i] AS DOUBLE) * 10 END AS f
  FROM embeddings, range(1, 65) AS r(i)),
px AS (SELECT 1 AS target_id, sector, t, quality, x, y, 100e0 + f - {DIP} AS flux FROM px0),
bad AS (SELECT DISTINCT t FROM px WHERE isnan(flux) AND quality & 24319 = 0),
hq AS (SELECT * FROM px WHERE quality & 24319 = 0 AND t NOT IN (SELECT t FROM bad)),
ep AS (SELECT 1 AS target_id, 1e0 AS period, 0e0 AS epoch, 6e0 AS duration_hours)"""
BITS = "CASE WHEN sector % 4 = 3 THEN 1 WHEN x BETWEEN 3 AND 5 AND y BETWEEN 2 AND 5 THEN 3 ELSE 1 END"
AP = f"""ap AS (SELECT DISTINCT target_id, sector, x, y, {BITS} AS bits FROM px),
ce AS (SELECT target_id, sector, coalesce(avg(x) FILTER (WHERE bits & 2 <> 0), avg(x)) AS cx, coalesce(avg(y) FILTER (WHERE bits & 2 <> 0), avg(y)) AS cy, bool_or(bits & 2 <> 0) AS has FROM ap GROUP BY 1, 2),
mb AS (SELECT target_id, sector, x, y, a.aperture FROM ap JOIN ce USING (target_id, sector), (VALUES ('box_3x3', 1), ('box_5x5', 2), ('box_7x7', 3), ('pipeline', 0)) AS a(aperture, h)
  WHERE CASE WHEN h = 0 THEN bits & 2 <> 0 OR NOT has ELSE abs(x - cx) <= h AND abs(y - cy) <= h END)"""
AF = "af AS (SELECT target_id, sector, t, aperture, sum(flux) AS flux, count(*) AS n_pixels FROM hq JOIN mb USING (target_id, sector, x, y) GROUP BY ALL)"


def pixels(spark, folder):
    e = A.table(spark, folder, "embeddings")
    stamps = e.select("vec_id", F.lit(1).alias("target_id"), F.col("label").alias("sector"), (F.col("vec_id") * 0.043).alias("t"),
                      F.expr("CASE WHEN vec_id % 10 = 7 THEN 64 WHEN vec_id % 10 = 3 THEN 256 ELSE 0 END").alias("quality"), F.col("embedding").alias("stamp"))
    px = read_pixels(stamps)
    f = F.when((F.col("vec_id") % 31 == 5) & (F.col("x") == 0) & (F.col("y") == 1), F.lit(float("nan"))).otherwise(F.col("flux") * 10)
    return px.withColumn("flux", 100.0 + f - F.expr(DIP)).drop("vec_id")


def eph(spark):
    return spark.range(1).select(F.lit(1).alias("target_id"), F.lit(1.0).alias("period"), F.lit(0.0).alias("epoch"), F.lit(6.0).alias("duration_hours"))


def aperture(px):
    return px.select("target_id", "sector", "x", "y").distinct().withColumn("bits", F.expr(BITS))


@query("b6_hard_quality", f"WITH {PX} SELECT sector, t, x, y FROM hq")
def _(spark, folder):
    return P.hard_quality(pixels(spark, folder)).select("sector", "t", "x", "y")


@query("c13_aperture_pixels", f"WITH {PX}, {AP} SELECT target_id, sector, x, y, aperture FROM mb")
def _(spark, folder):
    return P.aperture_pixels(aperture(pixels(spark, folder)))


def fluxes(spark, folder):
    px = pixels(spark, folder)
    return P.aperture_flux(P.hard_quality(px), aperture(px))


@query("d12_aperture_flux", f"WITH {PX}, {AP}, {AF} SELECT sector, t, aperture, round(flux, 7) AS flux, n_pixels FROM af")
def _(spark, folder):
    return fluxes(spark, folder).select("sector", "t", "aperture", F.round("flux", 7).alias("flux"), "n_pixels")


DEPTHS = f"""lv AS (SELECT target_id, sector, aperture, median(flux) AS m FROM af GROUP BY ALL HAVING count(*) >= 20),
lb AS (SELECT target_id, sector, aperture, flux / m AS flux, {label_sql(A.phase_sql() + ' * 24e0')} AS w FROM af JOIN lv USING (target_id, sector, aperture) JOIN ep USING (target_id)),
dd AS (SELECT target_id, sector, aperture, round((median(flux) FILTER (WHERE w = 'baseline') - median(flux) FILTER (WHERE w = 'in')) * 1e6, 2) AS d FROM lb WHERE w IS NOT NULL GROUP BY ALL),
ok AS (SELECT * FROM dd WHERE d IS NOT NULL)"""


@query("d13_depth_stability", f"""WITH {PX}, {AP}, {AF}, {DEPTHS} SELECT target_id, count(*) AS n, min(d) AS min_ppm, max(d) AS max_ppm, round(median(d), 3) AS median_ppm,
  round((max(d) - min(d)) / greatest(median(d), 1e-9), 6) AS variation, CASE WHEN (max(d) - min(d)) / greatest(median(d), 1e-9) < 0.3 THEN 'stable' ELSE 'aperture-sensitive' END AS verdict FROM ok GROUP BY 1""")
def _(spark, folder):
    out = P.depth_stability(P.aperture_depths(fluxes(spark, folder), eph(spark), 20))
    return out.select("target_id", "n", "min_ppm", "max_ppm", F.round("median_ppm", 3).alias("median_ppm"), F.round("variation", 6).alias("variation"), "verdict")


@query("d13_aperture_summary", f"""WITH {PX}, {AP}, {AF}, {DEPTHS} SELECT target_id, aperture, count(*) AS n_sectors, round(median(d), 3) AS median_ppm, min(d) AS min_ppm, max(d) AS max_ppm FROM ok GROUP BY 1, 2""")
def _(spark, folder):
    out = P.aperture_summary(P.aperture_depths(fluxes(spark, folder), eph(spark), 20))
    return out.withColumn("median_ppm", F.round("median_ppm", 3))


IMG = f"""lp AS (SELECT target_id, sector, x, y, flux, {label_sql(A.phase_sql() + ' * 24e0')} AS w FROM hq JOIN ep USING (target_id)),
im AS (SELECT target_id, sector, x, y, median(flux) FILTER (WHERE w = 'baseline') - median(flux) FILTER (WHERE w = 'in') AS difference,
  count(*) FILTER (WHERE w = 'in') AS n_in, count(*) FILTER (WHERE w = 'baseline') AS n_out FROM lp GROUP BY 1, 2, 3, 4
  HAVING count(*) FILTER (WHERE w = 'in') >= 10 AND count(*) FILTER (WHERE w = 'baseline') >= 10)"""


def image(spark, folder):
    return P.difference_image(P.hard_quality(pixels(spark, folder)), eph(spark))


@query("d14_difference_image", f"WITH {PX}, {IMG} SELECT target_id, sector, x, y, round(difference, 9) AS difference, n_in, n_out FROM im")
def _(spark, folder):
    return image(spark, folder).withColumn("difference", F.round("difference", 9))


CENT = f"""pk AS (SELECT *, max(difference) OVER (PARTITION BY target_id, sector) AS peak, count(*) OVER (PARTITION BY target_id, sector) AS n FROM im),
cs AS (SELECT target_id, sector, count(*) FILTER (WHERE c) AS n_core, sum(difference * x) FILTER (WHERE c) / sum(difference) FILTER (WHERE c) AS cx,
  sum(difference * y) FILTER (WHERE c) / sum(difference) FILTER (WHERE c) AS cy FROM (SELECT *, peak > 0 AND n >= 3 AND difference >= peak * 0.2e0 AS c FROM pk) GROUP BY 1, 2),
ct AS (SELECT target_id, sector, n_core, CASE WHEN n_core >= 3 THEN (cx - 4.1e0) * 21 * 0.9e0 END AS ra_offset, CASE WHEN n_core >= 3 THEN (cy - 3.9e0) * 21 END AS dec_offset FROM cs)"""


def centroids(spark, folder):
    at = spark.range(1).select(F.lit(1).alias("target_id"), F.lit(4.1).alias("target_x"), F.lit(3.9).alias("target_y"), F.lit(0.9).alias("cos_dec"))
    return P.difference_centroid(image(spark, folder), at)


@query("d15_difference_centroid", f"""WITH {PX}, {IMG}, {CENT} SELECT target_id, sector, n_core, round(ra_offset, 6) AS ra_offset, round(dec_offset, 6) AS dec_offset,
  round(sqrt(ra_offset * ra_offset + dec_offset * dec_offset), 6) AS offset FROM ct""")
def _(spark, folder):
    return centroids(spark, folder).select("target_id", "sector", "n_core", *[F.round(c, 6).alias(c) for c in ("ra_offset", "dec_offset", "offset")])


@query("d16_localization_summary", f"""WITH {PX}, {IMG}, {CENT} SELECT target_id, count(*) AS n_sectors, count(*) FILTER (WHERE n_core < 3) AS n_unresolved,
  round(median(sqrt(ra_offset * ra_offset + dec_offset * dec_offset)), 6) AS median_offset,
  CASE WHEN count(*) FILTER (WHERE n_core < 3) > 0 THEN 'inconclusive_insufficient_difference_core' ELSE 'inconclusive_uncalibrated_prf' END AS status FROM ct GROUP BY 1""")
def _(spark, folder):
    return P.localization_summary(centroids(spark, folder)).withColumn("median_offset", F.round("median_offset", 6))


@query("h29_source_amplitudes")
def _(spark, folder):
    img = image(spark, folder)
    src = spark.range(3).select(F.lit(1).alias("target_id"), F.col("id").alias("source_index"), (4.3 - F.col("id") * 1.6).alias("x_pix"),
                                (3.8 + F.col("id") * 0.9).alias("y_pix"), (F.col("id") == 0).alias("is_target"))
    return P.source_amplitudes(img, src).withColumn("amplitude", F.round("amplitude", 6))

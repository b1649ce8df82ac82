"""Sky positions, cone search, cross-match and known signals (IDs C1-C9, C12-C15, D11, D18-D20, F3)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.functions.fold import floored_mod
from fluxloom.operators.spread import attach, fan_out, row_salt

MAS = 3600.0 * 1000.0


def separation_arcsec(ra1, dec1, ra2, dec2) -> Column:
    """Small-angle separation; the RA difference wraps and uses the second declination."""
    d_ra = floored_mod(ra1 - ra2 + 180.0, F.lit(360.0)) - 180.0
    return F.hypot(d_ra * F.cos(F.radians(dec2)) * 3600.0, (dec1 - dec2) * 3600.0)


def sky_zone(dec: Column, radius_deg: float) -> Column:
    return F.floor((dec + 90.0) / radius_deg)


def cells_in_zone(zone: Column, radius_deg: float) -> Column:
    """Number of RA cells such that one cell is never narrower than the radius on the sky."""
    low, high = zone * radius_deg - 90.0, (zone + 1) * radius_deg - 90.0
    edge = F.least(F.greatest(F.abs(low), F.abs(high)) + 2 * radius_deg, F.lit(90.0))
    return F.greatest(F.floor(F.cos(F.radians(edge)) * 360.0 / radius_deg), F.lit(1)).cast("long")


def cone_search(targets: DataFrame, sources: DataFrame, radius_arcsec: float = 60.0) -> DataFrame:
    """All sources within the radius of each target.

    Sources fall in one sky cell, targets look into the 3 x 3 cells around theirs;
    the cell join is salted, so a crowded cell is shared by several tasks.
    Targets have ``target_id, t_ra, t_dec`` and sources ``source_id, ra, dec``.
    """
    r = radius_arcsec / 3600.0
    s = sources.withColumn("_zone", sky_zone(F.col("dec"), r))
    s = s.withColumn("_cell", F.least(F.floor(F.col("ra") / 360.0 * cells_in_zone(F.col("_zone"), r)), cells_in_zone(F.col("_zone"), r) - 1))
    z = sky_zone(F.col("t_dec"), r)
    t = targets.withColumn("_zone", F.explode(F.sequence(z - 1, z + 1)))
    n = cells_in_zone(F.col("_zone"), r)
    home = F.floor(F.col("t_ra") / 360.0 * n)
    t = t.withColumn("_cell", F.explode(F.array_distinct(F.array(*[F.pmod(home + d, n) for d in (-1, 0, 1)]))))
    # both sides are dealt out by number: the pairs outgrow the rows by whose size adaptive execution would join tasks
    cell = ["_zone", "_cell", "_salt"]
    s = fan_out(s.withColumn("_salt", row_salt(s, ["_zone", "_cell"], 8, ["source_id"])), *cell)
    t = fan_out(t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(7)))), *cell)
    pairs = s.join(t, cell).drop("_salt")
    sep = separation_arcsec(F.col("ra"), F.col("dec"), F.col("t_ra"), F.col("t_dec"))
    return pairs.withColumn("separation_arcsec", sep).where(F.col("separation_arcsec") <= radius_arcsec).drop("_zone", "_cell")


def moved(df: DataFrame, epoch: Column, prefix: str = "", out: str = "p_") -> DataFrame:
    """Position and 1-sigma uncertainty (mas) moved by proper motion to ``epoch``; NULL if not possible."""
    c = lambda name: F.col(prefix + name)
    years = epoch - c("ref_epoch")
    cos = F.cos(F.radians(c("dec")))
    usable = c("ref_epoch").isNotNull() & (F.abs(cos) >= 1e-12) & c("ra_error").isNotNull() & c("dec_error").isNotNull()
    pm = lambda name: F.coalesce(c(name), F.lit(0.0))
    ra = floored_mod(c("ra") + pm("pmra") * years / (MAS * cos), F.lit(360.0))
    dec = c("dec") + pm("pmdec") * years / MAS
    square = lambda x: x * x
    sigma = F.sqrt(square(c("ra_error")) + square(c("dec_error")) + square(pm("pmra_error") * years) + square(pm("pmdec_error") * years))
    return df.withColumns({out + "ra": F.when(usable, ra), out + "dec": F.when(usable, dec), out + "sigma": F.when(usable, sigma)})


def propagate(df: DataFrame, epoch: float) -> DataFrame:
    return moved(df, F.lit(float(epoch)))


def cross_match(pairs: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """Plausible records of each target at the target's own epoch; all are kept.

    ``pairs`` holds the records retrieved for each target next to its ``t_`` astrometry.
    """
    x = moved(moved(pairs, F.col("t_ref_epoch"), "t_", "tp_"), F.col("t_ref_epoch"))
    sep = separation_arcsec(F.col("tp_ra"), F.col("tp_dec"), F.col("p_ra"), F.col("p_dec")) * 1000.0
    both = F.hypot("tp_sigma", "p_sigma")
    return x.withColumn("separation_mas", sep).withColumn("combined_mas", both).withColumn(
        "plausible", (F.col("combined_mas") > 0) & (F.col("separation_mas") <= F.col("combined_mas") * sigmas))


def cross_match_status(targets: DataFrame, matches: DataFrame) -> DataFrame:
    s = matches.groupBy("target_id").agg(
        F.count_if("plausible").alias("n_plausible"), F.bool_or(F.col("p_ra").isNull()).alias("_incomplete"), F.bool_and(F.col("tp_ra").isNull()).alias("_lost"))
    x = targets.select("target_id").join(s, "target_id", "left").fillna(0, ["n_plausible"])
    return x.select("target_id", "n_plausible", F.when(F.col("_lost"), "insufficient-astrometry").when(F.col("n_plausible") > 1, "ambiguous")
                    .when(F.col("n_plausible") == 1, "matched").when(F.col("_incomplete"), "insufficient-astrometry")
                    .otherwise("no-plausible-match").alias("status"))


def identify_target(cone: DataFrame, limit_arcsec: float = 2.0) -> DataFrame:
    """The source that is the target: native position first, else moved to J2000; nearest wins."""
    cos = F.cos(F.radians("dec"))
    years = F.lit(2000.0) - F.col("ref_epoch")
    usable = F.col("pmra").isNotNull() & F.col("pmdec").isNotNull() & F.col("ref_epoch").isNotNull() & (F.abs(cos) >= 1e-8)
    ra = floored_mod(F.col("ra") + F.col("pmra") * years / (MAS * cos), F.lit(360.0))
    j2000 = F.when(usable, separation_arcsec(ra, F.col("dec") + F.col("pmdec") * years / MAS, F.col("t_ra"), F.col("t_dec")))
    native = F.col("separation_arcsec") <= limit_arcsec
    x = cone.withColumn("method", F.when(native, "native").when(j2000 <= limit_arcsec, "j2000"))
    x = x.withColumn("match_arcsec", F.when(native, F.col("separation_arcsec")).when(j2000 <= limit_arcsec, j2000)).where(F.col("method").isNotNull())
    rank = F.struct(F.when(F.col("method") == "native", 0).otherwise(1), F.col("match_arcsec"), F.col("source_id"))
    return x.groupBy("target_id").agg(F.min_by(F.struct("source_id", "method", "match_arcsec"), rank).alias("b")).select("target_id", "b.*")


# Harmonic factors and matching tolerances of the known-signal comparison.
HARMONICS = (0.5, 1.0, 2.0, 3.0)
PERIOD_TOLERANCE = 0.001
DURATION_TOLERANCE = 0.5


def nearest_of(x: Column, values: Sequence[float]) -> Column:
    """The value closest to ``x``; the first one wins a tie."""
    options = F.array(*[F.struct(F.abs(x - v).alias("d"), F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)])
    return F.array_min(options)["v"]


def match_known_signals(eph: DataFrame, catalog: DataFrame) -> DataFrame:
    """Compare each target's ephemeris with its catalog rows on period harmonics, epoch and duration.

    Epochs are compared only when the row declares BJD_TDB.
    """
    x = attach(catalog.where(F.col("known_period") > 0), eph, ["target_id"])
    declared = F.regexp_replace(F.upper(F.trim(F.coalesce("time_scale", F.lit("")))), " ", "_") == "BJD_TDB"
    ratio = F.col("known_period") / F.col("period")
    x = x.withColumn("ratio", ratio).withColumn("harmonic", nearest_of(ratio, HARMONICS))
    x = x.withColumn("period_difference", F.abs(F.col("ratio") - F.col("harmonic")) / F.col("harmonic"))
    x = x.withColumn("period_match", F.col("period_difference") <= PERIOD_TOLERANCE)
    delta = F.abs(floored_mod(F.col("known_epoch_bjd") - 2457000.0 - F.col("epoch") + F.col("period") * 0.5, F.col("period")) - F.col("period") * 0.5)
    x = x.withColumn("epoch_delta", F.when(declared, delta))
    tolerance = F.greatest(F.col("duration_hours"), F.coalesce("known_duration_hours", F.lit(0.0))) / 24.0
    x = x.withColumn("epoch_match", F.col("epoch_delta") <= tolerance)
    x = x.withColumn("duration_compatible", F.abs(F.col("known_duration_hours") / F.col("duration_hours") - 1.0) <= DURATION_TOLERANCE)
    return x.withColumn("review_required", F.col("period_match") & F.coalesce("epoch_match", F.lit(True)))


def match_status(targets: DataFrame, matches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Full match > unresolved harmonic > no match > no evidence, for every target."""
    m = matches.groupBy("target_id").agg(F.bool_or(F.col("period_match") & F.coalesce("epoch_match", F.lit(False))).alias("_full"),
                                        F.bool_or(F.col("period_match") & F.col("epoch_match").isNull()).alias("_open"))
    s = snapshots.select("target_id").distinct().withColumn("_seen", F.lit(True))
    x = targets.select("target_id").join(m, "target_id", "left").join(s, "target_id", "left")
    return x.select("target_id", F.when(F.col("_full"), "review-required-known-signal-match").when(F.col("_open"), "review-required-period-harmonic")
                    .when(F.col("_seen"), "no-match-in-current-catalogs").otherwise("insufficient-current-evidence").alias("match_status"))


def latest_fresh(retrievals: DataFrame, now: str) -> DataFrame:
    """Mark the newest usable retrieval per (target, provider); the others carry a reason."""
    at = F.lit(now).cast("timestamp")
    bad = (F.when(F.col("status") != "available", "retrieval-not-available")
           .when(F.col("retrieved_at").isNull() | F.col("expires_at").isNull() | (F.col("expires_at") <= at)
                 | (F.col("expires_at") <= F.col("retrieved_at")) | (F.col("retrieved_at") > at), "retrieval-stale-or-invalid-time"))
    x = retrievals.withColumn("reason", bad)
    newest = x.where(F.col("reason").isNull()).groupBy("target_id", "provider").agg(
        F.max_by("retrieval_id", F.struct("retrieved_at", "retrieval_id")).alias("_best"))
    y = attach(x, newest, ["target_id", "provider"], "left", spread=["retrieval_id"])
    return y.withColumn("reason", F.coalesce("reason", F.when(F.col("retrieval_id") != F.col("_best"), F.lit("superseded")))).withColumn(
        "selected", F.col("reason").isNull()).drop("_best")


def novelty(targets: DataFrame, registries: dict[str, DataFrame], availability: DataFrame) -> DataFrame:
    """Eligible only if every registry answered and none lists the target."""
    x = targets.select("target_id").distinct()
    hits, up = [], []
    for name, rows in registries.items():
        listed = rows.select("target_id").distinct().withColumn(f"_{name}", F.lit(True))
        state = availability.where(F.col("provider") == name).groupBy("target_id").agg(F.bool_or("available").alias(f"_up_{name}"))
        x = x.join(listed, "target_id", "left").join(state, "target_id", "left")
        hits.append(F.coalesce(F.col(f"_{name}"), F.lit(False)) & F.coalesce(F.col(f"_up_{name}"), F.lit(False)))
        up.append(F.coalesce(F.col(f"_up_{name}"), F.lit(False)))
    status = F.lit("eligible")
    for hit, ready in reversed(list(zip(hits, up))):  # registries are asked in order; the first hit or outage decides
        status = F.when(~ready, "unavailable").when(hit, "ineligible").otherwise(status)
    return x.select("target_id", status.alias("novelty"))


def new_targets(tce: DataFrame, targets: DataFrame) -> DataFrame:
    return tce.join(targets.select("target_id").distinct(), "target_id", "left_anti")


def resolve_ephemeris(configs: DataFrame, fields: Sequence[str] = ("period", "epoch", "duration_hours")) -> DataFrame:
    """First finite value of each field by priority, with its source and a completeness label."""
    aggs = []
    for f in fields:
        ok = F.col(f).isNotNull() & ~F.isnan(f) & ((F.col(f) > 0) if f != "epoch" else F.lit(True))
        aggs.append(F.min_by(F.struct(F.col(f).alias("v"), F.col("source").alias("s")), F.when(ok, F.col("priority"))).alias(f"_{f}"))
    x = configs.groupBy("target_id").agg(*aggs)
    values = [F.col(f"_{f}")["v"].alias(f) for f in fields] + [F.col(f"_{f}")["s"].alias(f"{f}_source") for f in fields]
    complete = F.col(f"_{fields[0]}").isNotNull()
    some = complete
    for f in fields[1:]:
        complete, some = complete & F.col(f"_{f}").isNotNull(), some | F.col(f"_{f}").isNotNull()
    return x.select("target_id", *values, F.when(complete, "complete").when(some, "partial").otherwise("none").alias("completeness"))


def contamination(cone: DataFrame, radius_arcsec: float = 60.0) -> DataFrame:
    """Summed neighbour-to-target flux ratio inside the radius, the target itself excluded."""
    by_mag = F.pow(F.lit(10.0), (F.col("g_mag") - F.col("target_g_mag")) * -0.4)
    ratio = F.coalesce("flux_ratio", by_mag)
    use = (F.col("separation_arcsec") <= radius_arcsec) & ~F.col("is_target") & (ratio >= 0)
    return cone.groupBy("target_id").agg(F.coalesce(F.sum(F.when(use, ratio)), F.lit(0.0)).alias("contamination"), F.count_if(use).alias("n_neighbours"))


def cone_assessment(cone: DataFrame, radius_arcsec: float, crowding_radius: float = 21.0, ruwe_limit: float = 1.4) -> DataFrame:
    """Crowding and RUWE flags; NULL where the cone cannot tell."""
    ruwe = F.max(F.when(F.col("is_target"), F.col("ruwe")))
    crowded = F.count(F.lit(1)) > 1 if radius_arcsec >= crowding_radius else F.lit(None).cast("boolean")
    return cone.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_sources"), crowded.alias("crowded"),
                                         F.when(ruwe > 0, ruwe > ruwe_limit).alias("suspected_binary"))


def brightest(cone: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` brightest neighbours of each target.

    A first top-k per salt bounds what one task sees before the final ranking.
    """
    order = ["g_mag", "source_id"]
    x = cone.where(~F.col("is_target") & F.col("g_mag").isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("source_id"), F.lit(16)))
    part = x.withColumn("_r", F.row_number().over(W.partitionBy("target_id", "_salt").orderBy(*order))).where(F.col("_r") <= k)
    return part.withColumn("rank", F.row_number().over(W.partitionBy("target_id").orderBy(*order))).where(F.col("rank") <= k).drop("_salt", "_r")


def split_cone(cone: DataFrame, limit_arcsec: float = 2.0) -> DataFrame:
    """Role of each source: the recorded target, else the closest within the limit; rest neighbours."""
    recorded = F.col("source_id") == F.col("recorded_id")
    close = F.col("separation_arcsec") <= F.coalesce(F.when(F.col("match_max_arcsec") > 0, F.col("match_max_arcsec")), F.lit(limit_arcsec))
    rank = F.struct(F.when(recorded, 0).otherwise(1), F.when(recorded, 0.0).otherwise(F.col("separation_arcsec")), F.col("source_id"))
    usable = F.col("validated") & (F.coalesce(recorded, F.lit(False)) | close)
    best = cone.where(usable).groupBy("target_id").agg(F.min_by("source_id", rank).alias("_best"))
    x = attach(cone, best, ["target_id"], "left", spread=["source_id"])
    return x.withColumn("role", F.when(F.col("_best").isNull(), "unavailable").when(F.col("source_id") == F.col("_best"), "target")
                        .otherwise("neighbour")).drop("_best")


def usable_evidence(evidence: DataFrame, artifacts: DataFrame, now: str) -> DataFrame:
    """Recorded evidence that is fresh and whose raw artifact still has the recorded hash."""
    a = artifacts.select(F.col("path").alias("raw_path"), F.col("sha256").alias("_now"))
    at = F.lit(now).cast("timestamp")
    x = evidence.join(a, "raw_path", "left")
    reason = (F.when(F.col("retrieved_at").isNull() | F.col("expires_at").isNull() | (F.col("expires_at") <= at), "record-invalid-or-stale")
              .when(F.col("_now").isNull(), "raw-artifact-missing").when(F.col("_now") != F.col("sha256"), "raw-artifact-hash-mismatch")
              .when(~(F.col("period") > 0) | F.col("period").isNull() | F.col("epoch").isNull() | ~(F.col("duration_hours") > 0)
                    | F.col("duration_hours").isNull(), "ephemeris-invalid"))
    return x.withColumn("reason", reason).drop("_now")


FOLLOWUP_SCHEMA = ("imaging array<map<string,string>>, high_res_imaging array<map<string,string>>, spectroscopy array<map<string,string>>, "
                   "high_res_spectroscopy array<map<string,string>>, spectra array<map<string,string>>")
IMAGING_KEYS = ("itype", "type", "technique", "iinst", "instrument")
SPECTRUM_KEYS = ("stype", "type", "technique", "sinst", "instrument", "observation_type")


def followup_inventory(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Counts and distinct technique types per payload; an absent key stays unknown."""
    x = payloads.withColumn("_j", F.from_json(payload, FOLLOWUP_SCHEMA))
    first = lambda keys: lambda rec: F.trim(F.coalesce(*[F.when(rec[k] != "", rec[k]) for k in keys]))
    # an empty list falls through to the next key name, as an absent one does
    pick = lambda *names: F.coalesce(*[F.when(F.size(F.col("_j")[n]) > 0, F.col("_j")[n]) for n in names])
    there = lambda *names: F.coalesce(*[F.col("_j")[n] for n in names]).isNotNull()
    imaging, spectra = pick("imaging", "high_res_imaging"), pick("spectroscopy", "high_res_spectroscopy", "spectra")
    has_i, has_s = there("imaging", "high_res_imaging"), there("spectroscopy", "high_res_spectroscopy", "spectra")
    count = lambda rows: F.coalesce(F.size(rows), F.lit(0))
    types = lambda rows, keys: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(rows, first(keys)), lambda v: v.isNotNull()))), ",")
    return x.select(
        "target_id", count(imaging).alias("n_imaging"), F.coalesce(types(imaging, IMAGING_KEYS), F.lit("")).alias("imaging_types"),
        F.when(has_i, count(imaging) > 0).alias("has_imaging"), count(spectra).alias("n_spectra"),
        F.coalesce(types(spectra, SPECTRUM_KEYS), F.lit("")).alias("spectrum_types"), F.when(has_s, count(spectra) > 0).alias("has_spectra"),
        F.when(F.col("_j").isNull(), "unavailable").when(has_i | has_s, "ok").otherwise("incomplete").alias("query_status"))


def add_tags(targets: DataFrame, tags: DataFrame) -> DataFrame:
    """Append each target's new tags, without duplicates and in order."""
    x = targets.join(tags.select("target_id", F.col("tags").alias("_new")), "target_id", "left")
    return x.withColumn("tags", F.array_distinct(F.concat("tags", F.coalesce("_new", F.array().cast("array<string>"))))).drop("_new")

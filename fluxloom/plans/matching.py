"""Catalog joins (IDs C1-C9, C12, C14, C15, D11, D18-D20, F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import catalogs as K
from fluxloom.plans.registry import query
from fluxloom.sources import adapters as A


def pos(k: str) -> tuple[str, str]:
    ra = f"(359.5e0 + (({k} * 37) % 5000) * 0.0002e0)"
    return f"({ra} - 360e0 * floor({ra} / 360e0))", f"(-5e0 + (({k} * 91) % 5000) * 0.0002e0)"


T_RA, T_DEC = pos("s_suppkey")
TARGET = [("target_id", "s_suppkey"), ("t_ra", T_RA), ("t_dec", T_DEC), ("t_ref_epoch", "CASE WHEN s_suppkey % 17 = 5 THEN NULL ELSE 2015.5e0 END"),
          ("t_pmra", "(s_suppkey % 9 - 4) * 10e0"), ("t_pmdec", "(s_suppkey % 7 - 3) * 10e0"), ("t_ra_error", "100e0 + s_suppkey % 5"), ("t_dec_error", "120e0"),
          ("t_pmra_error", "0.5e0"), ("t_pmdec_error", "0.4e0"), ("target_g_mag", "8e0 + s_acctbal / 2000e0")]
B_RA, B_DEC = pos("(c_custkey // 15)")
O_RA, O_DEC = pos("(c_custkey * 3 + 11)")
NEAR_RA = f"({B_RA} + (c_custkey % 7 - 3) * 0.0001e0)"
S_RA = f"CASE WHEN c_custkey % 15 = 0 THEN {NEAR_RA} - 360e0 * floor({NEAR_RA} / 360e0) ELSE {O_RA} END"
S_DEC = f"CASE WHEN c_custkey % 15 = 0 THEN {B_DEC} + (c_custkey % 11 - 5) * 0.0001e0 ELSE {O_DEC} END"
SOURCE = [("source_id", "c_custkey"), ("ra", S_RA), ("dec", S_DEC), ("ref_epoch", "CASE WHEN c_custkey % 13 = 6 THEN NULL ELSE 2016e0 END"),
          ("pmra", "(c_custkey % 21 - 10) * 20e0"), ("pmdec", "(c_custkey % 19 - 9) * 20e0"), ("ra_error", "50e0 + c_custkey % 40"), ("dec_error", "60e0"),
          ("pmra_error", "1e0"), ("pmdec_error", "1e0"), ("g_mag", "9e0 + c_acctbal / 1000e0"), ("ruwe", "0.8e0 + (c_custkey % 10) * 0.1e0"),
          ("flux_ratio", "CASE WHEN c_custkey % 4 = 0 THEN 0.01e0 END")]


def sel(cols):
    return ", ".join(f"{e} AS {n}" for n, e in cols)


def spark_text(e: str) -> str:
    return e.replace("c_custkey // 15", "CAST(floor(c_custkey / 15) AS BIGINT)")


def targets(spark, folder):
    return A.table(spark, folder, "supplier").selectExpr(*[f"{spark_text(e)} AS {n}" for n, e in TARGET])


def sources(spark, folder):
    return A.table(spark, folder, "customer").selectExpr(*[f"{spark_text(e)} AS {n}" for n, e in SOURCE])


SEP = ("sqrt(pow(({a} - {c} + 180e0 - 360e0 * floor(({a} - {c} + 180e0) / 360e0) - 180e0) * cos(radians({d})) * 3600e0, 2) + pow(({b} - {d}) * 3600e0, 2))")
CONE = f"""tg AS (SELECT {sel(TARGET)} FROM supplier), sr AS (SELECT {sel(SOURCE)} FROM customer),
cn AS (SELECT * FROM (SELECT *, {SEP.format(a='ra', b='dec', c='t_ra', d='t_dec')} AS separation_arcsec FROM tg, sr) WHERE separation_arcsec <= 60)"""


def cone(spark, folder):
    return K.cone_search(targets(spark, folder), sources(spark, folder), 60.0)


@query("c1_cone_search", f"WITH {CONE} SELECT target_id, source_id, round(separation_arcsec, 6) AS separation_arcsec FROM cn")
def _(spark, folder):
    return cone(spark, folder).select("target_id", "source_id", F.round("separation_arcsec", 6).alias("separation_arcsec"))


def moved_sql(epoch: str, prefix: str, out: str) -> str:
    c = lambda n: prefix + n
    ok = f"({c('ref_epoch')} IS NOT NULL)"
    y = f"({epoch} - {c('ref_epoch')})"
    ra = f"({c('ra')} + {c('pmra')} * {y} / (3600e0 * 1000e0 * cos(radians({c('dec')}))))"
    return f"""CASE WHEN {ok} THEN {ra} - 360e0 * floor({ra} / 360e0) END AS {out}ra, CASE WHEN {ok} THEN {c('dec')} + {c('pmdec')} * {y} / (3600e0 * 1000e0) END AS {out}dec,
  CASE WHEN {ok} THEN sqrt(pow({c('ra_error')}, 2) + pow({c('dec_error')}, 2) + pow({c('pmra_error')} * {y}, 2) + pow({c('pmdec_error')} * {y}, 2)) END AS {out}sigma"""


@query("c2_propagate", f"""WITH sr AS (SELECT {sel(SOURCE)} FROM customer), m AS (SELECT source_id, {moved_sql('2020e0', '', 'p_')} FROM sr)
SELECT source_id, round(p_ra, 9) AS p_ra, round(p_dec, 9) AS p_dec, round(p_sigma, 6) AS p_sigma FROM m""")
def _(spark, folder):
    out = K.propagate(sources(spark, folder), 2020.0)
    return out.select("source_id", F.round("p_ra", 9).alias("p_ra"), F.round("p_dec", 9).alias("p_dec"), F.round("p_sigma", 6).alias("p_sigma"))


XM = f"""{CONE}, mv AS (SELECT *, {moved_sql('t_ref_epoch', 't_', 'tp_')}, {moved_sql('t_ref_epoch', '', 'p_')} FROM cn),
xm AS (SELECT *, {SEP.format(a='tp_ra', b='tp_dec', c='p_ra', d='p_dec')} * 1000 AS separation_mas, sqrt(tp_sigma * tp_sigma + p_sigma * p_sigma) AS combined_mas FROM mv),
xp AS (SELECT *, combined_mas > 0 AND separation_mas <= combined_mas * 5 AS plausible FROM xm)"""


@query("c3_cross_match", f"""WITH {XM} SELECT target_id, source_id, round(separation_mas, 3) AS separation_mas, round(combined_mas, 6) AS combined_mas FROM xp WHERE plausible""")
def _(spark, folder):
    out = K.cross_match(cone(spark, folder)).where("plausible")
    return out.select("target_id", "source_id", F.round("separation_mas", 3).alias("separation_mas"), F.round("combined_mas", 6).alias("combined_mas"))


@query("c3_cross_match_status", f"""WITH {XM}, s AS (SELECT target_id, count(*) FILTER (WHERE plausible) AS k, bool_or(p_ra IS NULL) AS inc, bool_and(tp_ra IS NULL) AS lost FROM xp GROUP BY 1)
SELECT target_id, coalesce(k, 0) AS n_plausible, CASE WHEN lost THEN 'insufficient-astrometry' WHEN k > 1 THEN 'ambiguous' WHEN k = 1 THEN 'matched'
  WHEN inc THEN 'insufficient-astrometry' ELSE 'no-plausible-match' END AS status FROM tg LEFT JOIN s USING (target_id)""")
def _(spark, folder):
    return K.cross_match_status(targets(spark, folder), K.cross_match(cone(spark, folder)))


@query("c4_identify_target", f"""WITH {CONE}, j AS (SELECT *, 2000e0 - ref_epoch AS y FROM cn),
p AS (SELECT *, ra + pmra * y / (3600e0 * 1000e0 * cos(radians(dec))) AS r0, dec + pmdec * y / (3600e0 * 1000e0) AS d0 FROM j),
q AS (SELECT *, {SEP.format(a='(r0 - 360e0 * floor(r0 / 360e0))', b='d0', c='t_ra', d='t_dec')} AS js FROM p),
m AS (SELECT *, CASE WHEN separation_arcsec <= 2 THEN 'native' WHEN js <= 2 THEN 'j2000' END AS method,
  CASE WHEN separation_arcsec <= 2 THEN separation_arcsec WHEN js <= 2 THEN js END AS match_arcsec FROM q)
SELECT target_id, source_id, method, round(match_arcsec, 6) AS match_arcsec FROM (SELECT *, row_number() OVER (PARTITION BY target_id
  ORDER BY CASE WHEN method = 'native' THEN 0 ELSE 1 END, match_arcsec, source_id) AS k FROM m WHERE method IS NOT NULL) WHERE k = 1""")
def _(spark, folder):
    return K.identify_target(cone(spark, folder)).select("target_id", "source_id", "method", F.round("match_arcsec", 6).alias("match_arcsec"))


KNOWN = [("target_id", "p_partkey % 100"), ("record_id", "p_partkey"), ("known_period", "(2.6e0 + 0.1e0 * (p_partkey % 5)) * (CASE p_partkey % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1e0 ELSE 2e0 END) * (1e0 + (p_size - 25) * 0.0001e0)"),
         ("known_epoch_bjd", "2457001.25e0 + (p_partkey % 40) * 0.01e0"), ("time_scale", "CASE p_partkey % 4 WHEN 0 THEN 'BJD TDB' WHEN 1 THEN ' bjd_tdb ' WHEN 2 THEN 'BJD' END"),
         ("known_duration_hours", "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 3e0 + (p_partkey % 9) END")]
MATCH = f"""kn AS (SELECT {sel(KNOWN)} FROM part),
ep AS (SELECT target_id, {A.PERIOD} AS period, 1.25e0 AS epoch, 6e0 AS duration_hours FROM (SELECT DISTINCT user_id AS target_id FROM events)),
r AS (SELECT *, known_period / period AS ratio, upper(trim(coalesce(time_scale, ''))) AS ts FROM kn JOIN ep USING (target_id)),
h AS (SELECT *, CASE WHEN least(abs(ratio - 0.5e0), abs(ratio - 1), abs(ratio - 2), abs(ratio - 3)) = abs(ratio - 0.5e0) THEN 0.5e0
  WHEN least(abs(ratio - 1), abs(ratio - 2), abs(ratio - 3)) = abs(ratio - 1) THEN 1e0 WHEN abs(ratio - 2) <= abs(ratio - 3) THEN 2e0 ELSE 3e0 END AS harmonic FROM r),
g AS (SELECT *, abs(ratio - harmonic) / harmonic AS period_difference,
  CASE WHEN replace(ts, ' ', '_') = 'BJD_TDB' THEN abs((known_epoch_bjd - 2457000e0 - epoch + period * 0.5e0) - period * floor((known_epoch_bjd - 2457000e0 - epoch + period * 0.5e0) / period) - period * 0.5e0) END AS epoch_delta FROM h),
mt AS (SELECT *, period_difference <= 0.001e0 AS period_match, epoch_delta <= greatest(duration_hours, coalesce(known_duration_hours, 0)) / 24 AS epoch_match,
  abs(known_duration_hours / duration_hours - 1) <= 0.5e0 AS duration_compatible FROM g)"""


def known(spark, folder):
    return A.table(spark, folder, "part").selectExpr(*[f"{e} AS {n}" for n, e in KNOWN])


@query("c5_match_known_signals", f"""WITH {MATCH} SELECT target_id, record_id, harmonic, round(period_difference, 9) AS period_difference, round(epoch_delta, 9) AS epoch_delta,
  period_match, epoch_match, duration_compatible, period_match AND coalesce(epoch_match, true) AS review_required FROM mt""")
def _(spark, folder):
    out = K.match_known_signals(A.ephemeris(spark, folder), known(spark, folder))
    return out.select("target_id", "record_id", "harmonic", F.round("period_difference", 9).alias("period_difference"), F.round("epoch_delta", 9).alias("epoch_delta"),
                      "period_match", "epoch_match", "duration_compatible", "review_required")


@query("c6_match_status", f"""WITH {MATCH}, s AS (SELECT target_id, bool_or(period_match AND coalesce(epoch_match, false)) AS f, bool_or(period_match AND epoch_match IS NULL) AS o FROM mt GROUP BY 1),
n AS (SELECT DISTINCT target_id, true AS seen FROM kn)
SELECT target_id, CASE WHEN f THEN 'review-required-known-signal-match' WHEN o THEN 'review-required-period-harmonic' WHEN seen THEN 'no-match-in-current-catalogs'
  ELSE 'insufficient-current-evidence' END AS match_status FROM ep LEFT JOIN s USING (target_id) LEFT JOIN n USING (target_id)""")
def _(spark, folder):
    eph, rows = A.ephemeris(spark, folder), known(spark, folder)
    return K.match_status(eph, K.match_known_signals(eph, rows), rows)


RETRIEVAL = [("retrieval_id", "o_orderkey"), ("target_id", "o_custkey % 100"), ("provider", "CASE o_orderpriority WHEN '1-URGENT' THEN 'alpha' WHEN '2-HIGH' THEN 'beta' ELSE 'gamma' END"),
             ("status", "CASE WHEN o_orderstatus = 'P' THEN 'unavailable' ELSE 'available' END"), ("retrieved_at", "CAST(o_orderdate AS TIMESTAMP)"),
             ("expires_at", "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL '180' DAY END")]
NOW = "1998-01-01 00:00:00"
FRESH = f"""rt AS (SELECT {sel(RETRIEVAL)} FROM orders), rs AS (SELECT *, CASE WHEN status <> 'available' THEN 'retrieval-not-available'
  WHEN expires_at IS NULL OR expires_at <= TIMESTAMP '{NOW}' OR retrieved_at > TIMESTAMP '{NOW}' THEN 'retrieval-stale-or-invalid-time' END AS why FROM rt),
rk AS (SELECT *, row_number() OVER (PARTITION BY target_id, provider, why IS NULL ORDER BY retrieved_at DESC, retrieval_id DESC) AS k FROM rs),
fr AS (SELECT retrieval_id, target_id, provider, status, retrieved_at, expires_at, coalesce(why, CASE WHEN k > 1 THEN 'superseded' END) AS reason FROM rk)"""


def retrievals(spark, folder):
    return A.table(spark, folder, "orders").selectExpr(*[f"{e} AS {n}" for n, e in RETRIEVAL])


@query("c7_latest_fresh", f"WITH {FRESH} SELECT retrieval_id, target_id, provider, reason, reason IS NULL AS selected FROM fr")
def _(spark, folder):
    return K.latest_fresh(retrievals(spark, folder), NOW).select("retrieval_id", "target_id", "provider", "reason", "selected")


NAMES = ("alpha", "beta", "gamma")


def novelty_inputs(spark, folder):
    part = A.table(spark, folder, "part").select(F.col("p_partkey").alias("target_id"), "p_size", "p_brand")
    regs = {n: part.where((F.col("p_size") + i) % 9 == 0) for i, n in enumerate(NAMES)}
    state = part.select("target_id", "p_size", F.explode(F.array(*[F.lit(n) for n in NAMES])).alias("provider"))
    return part, regs, state.withColumn("available", ~((F.col("provider") == "beta") & (F.col("p_size") % 13 == 0)))


@query("c8_novelty", """SELECT p_partkey AS target_id, CASE WHEN p_size % 9 = 0 THEN 'ineligible' WHEN p_size % 13 = 0 THEN 'unavailable'
  WHEN (p_size + 1) % 9 = 0 OR (p_size + 2) % 9 = 0 THEN 'ineligible' ELSE 'eligible' END AS novelty FROM part""")
def _(spark, folder):
    return K.novelty(*novelty_inputs(spark, folder))


@query("c9_new_targets", "SELECT p_partkey AS target_id, p_name FROM part WHERE p_partkey NOT IN (SELECT 2 * l_partkey FROM lineitem)")
def _(spark, folder):
    tce = A.table(spark, folder, "part").select(F.col("p_partkey").alias("target_id"), "p_name")
    return K.new_targets(tce, A.table(spark, folder, "lineitem").select((F.col("l_partkey") * 2).alias("target_id")))




@query("c12_resolve_ephemeris", """WITH c AS (SELECT l_partkey AS target_id, CAST(sum(l_quantity) AS BIGINT) AS q, l_orderkey * 8 + l_linenumber AS priority, concat('cfg-', CAST(l_linenumber AS VARCHAR)) AS source FROM lineitem GROUP BY 1, 3, 4),
v AS (SELECT *, CASE WHEN q % 3 = 0 THEN NULL WHEN q % 7 = 0 THEN -1e0 ELSE q / 10e0 END AS period, CASE WHEN q % 2 = 0 THEN q * 1e0 END AS epoch, CASE WHEN q % 5 = 0 THEN 0e0 ELSE q / 20e0 END AS duration_hours FROM c),
a AS (SELECT target_id, arg_min(period, priority) FILTER (WHERE period > 0) AS period, arg_min(epoch, priority) FILTER (WHERE epoch IS NOT NULL) AS epoch,
  arg_min(duration_hours, priority) FILTER (WHERE duration_hours > 0) AS duration_hours, arg_min(source, priority) FILTER (WHERE period > 0) AS period_source,
  arg_min(source, priority) FILTER (WHERE epoch IS NOT NULL) AS epoch_source, arg_min(source, priority) FILTER (WHERE duration_hours > 0) AS duration_hours_source FROM v GROUP BY 1)
SELECT *, CASE WHEN period IS NOT NULL AND epoch IS NOT NULL AND duration_hours IS NOT NULL THEN 'complete'
  WHEN period IS NOT NULL OR epoch IS NOT NULL OR duration_hours IS NOT NULL THEN 'partial' ELSE 'none' END AS completeness FROM a""")
def _(spark, folder):
    c = A.table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("target_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("priority"),
        F.concat(F.lit("cfg-"), F.col("l_linenumber").cast("string")).alias("source")).agg(F.sum("l_quantity").cast("long").alias("q"))
    v = c.selectExpr("target_id", "priority", "source", "CASE WHEN q % 3 = 0 THEN NULL WHEN q % 7 = 0 THEN -1e0 ELSE q / 10e0 END AS period",
                     "CASE WHEN q % 2 = 0 THEN q * 1e0 END AS epoch", "CASE WHEN q % 5 = 0 THEN 0e0 ELSE q / 20e0 END AS duration_hours")
    return K.resolve_ephemeris(v)


ROLE = "CASE WHEN source_id % 15 = 0 AND source_id // 15 = target_id THEN true ELSE false END"


def roled(spark, folder):
    return cone(spark, folder).withColumn("is_target", (F.col("source_id") % 15 == 0) & (F.floor(F.col("source_id") / 15) == F.col("target_id")))


RC = f"{CONE}, rc AS (SELECT *, {ROLE} AS is_target FROM cn)"


@query("d11_contamination", f"""WITH {RC}, r AS (SELECT *, coalesce(flux_ratio, pow(10e0, (g_mag - target_g_mag) * -0.4e0)) AS ratio FROM rc)
SELECT target_id, round(coalesce(sum(ratio) FILTER (WHERE NOT is_target), 0), 8) AS contamination, count(*) FILTER (WHERE NOT is_target) AS n_neighbours FROM r GROUP BY 1""")
def _(spark, folder):
    return K.contamination(roled(spark, folder)).select("target_id", F.round("contamination", 8).alias("contamination"), "n_neighbours")


@query("d19_cone_assessment", f"""WITH {RC} SELECT target_id, count(*) AS n_sources, count(*) > 1 AS crowded, max(ruwe) FILTER (WHERE is_target) > 1.4e0 AS suspected_binary FROM rc GROUP BY 1""")
def _(spark, folder):
    return K.cone_assessment(roled(spark, folder), 60.0)


@query("f3_brightest", f"""WITH {RC} SELECT target_id, source_id, g_mag, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY g_mag, source_id) AS k FROM rc WHERE NOT is_target) WHERE k <= 5""")
def _(spark, folder):
    return K.brightest(roled(spark, folder), 5).select("target_id", "source_id", "g_mag", "rank")


SPLIT = [("recorded_id", "CASE WHEN target_id % 3 = 0 THEN target_id * 15 END"), ("validated", "target_id % 8 <> 1"), ("match_max_arcsec", "CASE WHEN target_id % 5 = 0 THEN 1e0 END")]


@query("c15_split_cone", f"""WITH {CONE}, v AS (SELECT *, {sel(SPLIT)} FROM cn), b AS (SELECT target_id, source_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY target_id
  ORDER BY CASE WHEN source_id = recorded_id THEN 0 ELSE 1 END, separation_arcsec, source_id) AS k FROM v WHERE validated AND (source_id = recorded_id OR separation_arcsec <= coalesce(match_max_arcsec, 2))) WHERE k = 1)
SELECT target_id, source_id, CASE WHEN best IS NULL THEN 'unavailable' WHEN source_id = best THEN 'target' ELSE 'neighbour' END AS role FROM v LEFT JOIN b USING (target_id)""")
def _(spark, folder):
    v = cone(spark, folder).selectExpr("*", *[f"{e} AS {n}" for n, e in SPLIT])
    return K.split_cone(v).select("target_id", "source_id", "role")


EVID = [("evidence_id", "o_orderkey"), ("raw_path", "concat('raw/', CAST(o_custkey AS {s}))"), ("sha256", "sha256(CAST(o_custkey % 200 AS {s}))"),
        ("retrieved_at", "CAST(o_orderdate AS TIMESTAMP)"), ("expires_at", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL '900' DAY"),
        ("period", "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 1000e0 END"), ("epoch", "1e0"), ("duration_hours", "(o_orderkey % 11) * 1e0")]


@query("c14_usable_evidence", f"""WITH e AS (SELECT {sel([(n, x.format(s='VARCHAR')) for n, x in EVID])} FROM orders),
a AS (SELECT concat('raw/', CAST(c_custkey AS VARCHAR)) AS raw_path, sha256(CAST(c_custkey AS VARCHAR)) AS h FROM customer WHERE c_custkey % 6 <> 0)
SELECT evidence_id, CASE WHEN expires_at <= TIMESTAMP '{NOW}' THEN 'record-invalid-or-stale' WHEN h IS NULL THEN 'raw-artifact-missing' WHEN h <> sha256 THEN 'raw-artifact-hash-mismatch'
  WHEN period IS NULL OR NOT period > 0 OR NOT duration_hours > 0 THEN 'ephemeris-invalid' END AS reason FROM e LEFT JOIN a USING (raw_path)""")
def _(spark, folder):
    e = A.table(spark, folder, "orders").selectExpr(*[f"{x.format(s='STRING').replace('sha256(', 'sha2(').replace('AS STRING))', 'AS STRING), 256)') if n == 'sha256' else x.format(s='STRING')} AS {n}" for n, x in EVID])
    a = A.table(spark, folder, "customer").where("c_custkey % 6 <> 0").selectExpr("concat('raw/', CAST(c_custkey AS STRING)) AS path", "sha2(CAST(c_custkey AS STRING), 256) AS sha256")
    return K.usable_evidence(e, a, NOW).select("evidence_id", "reason")


@query("d18_add_tags", """WITH t AS (SELECT p_partkey AS target_id, concat_ws(',', p_type, concat('size-', CAST(p_size % 4 AS VARCHAR))) AS tags,
  CASE WHEN p_partkey % 3 = 0 THEN ['survey', p_type, 'hot'] WHEN p_partkey % 3 = 1 THEN ['hot'] ELSE []::VARCHAR[] END AS more, p_type, p_size FROM part)
SELECT target_id, CASE WHEN len(more) = 3 THEN tags || ',survey,hot' WHEN len(more) = 1 THEN tags || ',hot' ELSE tags END AS tags FROM t""")
def _(spark, folder):
    part = A.table(spark, folder, "part")
    t = part.select(F.col("p_partkey").alias("target_id"), F.array("p_type", F.concat(F.lit("size-"), (F.col("p_size") % 4).cast("string"))).alias("tags"))
    new = part.where("p_partkey % 3 < 2").select(F.col("p_partkey").alias("target_id"),
        F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("survey"), F.col("p_type"), F.lit("hot"))).otherwise(F.array(F.lit("hot"))).alias("tags"))
    return K.add_tags(t, new).select("target_id", F.array_join("tags", ",").alias("tags"))


FOLLOW = """CASE p_partkey % 5 WHEN 0 THEN concat('{"imaging":[{"itype":"', p_brand, '"},{"technique":" AO "}],"spectra":[{"sinst":"', p_type, '"}]}')
  WHEN 1 THEN concat('{"imaging":[],"high_res_spectroscopy":[{"type":"', p_type, '"},{"type":"', p_type, '"}]}') WHEN 2 THEN '{"notes":"x"}' WHEN 3 THEN 'broken' ELSE '{"spectroscopy":[]}' END"""


@query("d20_followup_inventory", """SELECT p_partkey AS target_id, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS n_imaging,
  CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN 'AO' < p_brand THEN concat('AO,', p_brand) ELSE concat(p_brand, ',AO') END ELSE '' END AS imaging_types,
  CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS has_imaging, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_spectra,
  CASE WHEN p_partkey % 5 < 2 THEN p_type ELSE '' END AS spectrum_types, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 4 THEN false END AS has_spectra,
  CASE p_partkey % 5 WHEN 2 THEN 'incomplete' WHEN 3 THEN 'unavailable' ELSE 'ok' END AS query_status FROM part""")
def _(spark, folder):
    rows = A.table(spark, folder, "part").selectExpr("p_partkey AS target_id", f"{FOLLOW} AS payload")
    rows = rows.withColumn("payload", F.when(F.col("payload").startswith("{"), F.col("payload")))
    return K.followup_inventory(rows)

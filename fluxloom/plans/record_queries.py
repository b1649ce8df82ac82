"""Record queries (IDs A7-A16, B5, B7-B11, D10, D17, F4, G1-G4)."""

from __future__ import annotations


from pyspark.sql import functions as F

from fluxloom.operators import records as R
from fluxloom.operators.spread import fan_out
from fluxloom.plans.registry import query
from fluxloom.session import scratch_path
from fluxloom.sources import adapters as A
from fluxloom.sources import records as S

TCE = [("source_row", "p_partkey"), ("`TIC_ID`", "concat('TIC ', CAST(p_partkey AS {s}))"), ("mes", "CASE WHEN p_size % 10 = 0 THEN 'nan' ELSE CAST(p_size AS {s}) END"), ("tce_snr", "CASE WHEN p_size % 7 = 0 THEN 'x' ELSE CAST(p_size * 2 AS {s}) END"),
       ("tce_period", "CAST(p_size / 2e0 AS {s})"), ("depth", "CAST(p_retailprice AS {s})"), ("prad", "CAST(p_size / 10e0 AS {s})"), ("rstar", "CAST(p_size / 30e0 AS {s})"), ("tmag", "CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size / 3e0 AS {s}) END")]
TCE_SQL = """tc AS (SELECT p_partkey AS source_row, CASE WHEN p_partkey > 0 THEN CAST(p_partkey AS VARCHAR) END AS tic, coalesce(CASE WHEN p_size % 7 <> 0 THEN p_size * 2e0 END, CASE WHEN p_size % 10 <> 0 THEN p_size * 1e0 END) AS snr,
  p_size / 2e0 AS period, p_retailprice AS depth_ppm, p_size / 10e0 AS planet_radius, p_size / 30e0 AS stellar_radius, CASE WHEN p_size % 3 <> 0 THEN p_size / 3e0 END AS tmag FROM part)"""


def tce(spark, folder):
    raw = A.table(spark, folder, "part").selectExpr(*[f"{e.format(s='STRING')} AS {n}" for n, e in TCE])
    return S.normalize_tce(raw, ["source_row"])


@query("a7_normalize_tce", f"WITH {TCE_SQL} SELECT * FROM tc")
def _(spark, folder):
    return tce(spark, folder)


@query("b5_filter_tce", f"WITH {TCE_SQL} SELECT source_row, tic FROM tc WHERE snr >= 20 AND period BETWEEN 1 AND 15 AND depth_ppm BETWEEN 200 AND 1500 AND planet_radius BETWEEN 1.2e0 AND 3.5e0 AND stellar_radius <= 1.3e0 AND (tmag IS NULL OR tmag <= 12.5e0)")
def _(spark, folder):
    return R.filter_tce(tce(spark, folder)).select("source_row", "tic")


@query("f4_limit_harvest", f"WITH {TCE_SQL} SELECT source_row, tic FROM tc WHERE snr >= 20 AND period BETWEEN 1 AND 15 AND depth_ppm BETWEEN 200 AND 1500 AND planet_radius BETWEEN 1.2e0 AND 3.5e0 AND stellar_radius <= 1.3e0 AND (tmag IS NULL OR tmag <= 12.5e0) ORDER BY source_row LIMIT 25")
def _(spark, folder):
    return R.limit_harvest(R.filter_tce(tce(spark, folder)).select("source_row", "tic"), 25)


PAY = """CASE o_orderkey % 6 WHEN 0 THEN concat('{"data":[{"toi":"', CAST(o_custkey AS STRING), '"},{"toi":"x"}]}') WHEN 1 THEN concat('[{"tid":', CAST(o_custkey AS STRING), '}]')
  WHEN 2 THEN '{"rows":[{"pl_orbper": NaN}]}' WHEN 3 THEN '{"results":[]}' WHEN 4 THEN 'oops' ELSE '{"data": [' END"""


@query("a8_parse_catalog_json", """WITH p AS (SELECT o_orderkey AS retrieval_id, o_orderkey % 6 AS k, CAST(o_custkey AS VARCHAR) AS v FROM orders)
SELECT retrieval_id, CASE k WHEN 2 THEN 'non-finite number' WHEN 4 THEN 'neither an object nor an array' WHEN 5 THEN 'malformed JSON' END AS parse_error,
  CASE WHEN k < 2 THEN i END AS record_index, CASE WHEN k = 0 AND i = 0 THEN v WHEN k = 0 THEN 'x' END AS toi, CASE WHEN k = 1 THEN v END AS tid
FROM p, (VALUES (0), (1)) AS x(i) WHERE i = 0 OR k = 0""")
def _(spark, folder):
    p = A.table(spark, folder, "orders").selectExpr("o_orderkey AS retrieval_id", f"{PAY} AS payload")
    return S.parse_catalog_json(p).select("retrieval_id", "parse_error", "record_index", F.try_element_at("record", F.lit("toi")).alias("toi"), F.try_element_at("record", F.lit("tid")).alias("tid"))


@query("a9_check_contract", """WITH r AS (SELECT o_orderkey AS retrieval_id, CASE o_orderkey % 3 WHEN 0 THEN 'nasa-exoplanet-archive' WHEN 1 THEN 'nasa-exoplanet-archive-toi' ELSE 'other' END AS provider, o_orderkey % 3 AS k, o_custkey % 2 AS c FROM orders)
SELECT retrieval_id, provider, CASE WHEN k = 0 AND c = 0 THEN 'pl_tranmid_systemref' WHEN k = 1 THEN 'toi, tid, pl_trandurh' ELSE '' END AS missing,
  CASE WHEN (k = 0 AND c = 0) OR k = 1 THEN 'unavailable' ELSE 'ok' END AS contract_status FROM r""")
def _(spark, folder):
    o = A.table(spark, folder, "orders")
    base = F.map_from_arrays(F.array(*[F.lit(c) for c in ("PL_ORBPER", "pl_tranmid", "Pl_TranDur")]), F.array(*[F.lit("1")] * 3))
    rec = F.when(F.col("o_custkey") % 2 == 1, F.map_concat(base, F.create_map(F.lit("pl_tranmid_systemref"), F.lit("BJD")))).otherwise(base)
    provider = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'nasa-exoplanet-archive' WHEN 1 THEN 'nasa-exoplanet-archive-toi' ELSE 'other' END")
    return S.check_contract(o.select(F.col("o_orderkey").alias("retrieval_id"), provider.alias("provider"), F.lit(0).alias("record_index"), rec.alias("record")))


TOI = [("target_id", "l_partkey"), ("row_number", "l_orderkey * 8 + l_linenumber"), ("toi", "CASE WHEN l_linenumber = 7 THEN 'bad' ELSE concat(CAST(l_partkey AS {s}), '.0', CAST(l_linenumber AS {s})) END"),
       ("period", "CASE WHEN l_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(l_quantity - 2 AS {s}) END"), ("epoch", "CAST(CASE WHEN l_orderkey % 2 = 0 THEN 2458000e0 + l_linenumber ELSE l_quantity END AS {s})"), ("depth", "CAST(l_tax AS {s})"), ("duration", "CAST(l_discount AS {s})")]


@query("a10_normalize_priors", """WITH t AS (SELECT l_partkey AS target_id, l_orderkey * 8 + l_linenumber AS row_number, CASE WHEN l_linenumber = 7 THEN '.01' ELSE concat('.0', CAST(l_linenumber AS VARCHAR)) END AS signal_suffix, l_quantity - 2 AS period,
  CASE WHEN l_orderkey % 2 = 0 THEN 1000e0 + l_linenumber ELSE l_quantity END AS epoch, l_tax, l_discount, CASE WHEN l_orderkey % 11 = 0 THEN 'non-numeric transit field' WHEN l_quantity - 2 <= 0 THEN 'non-positive orbital period' END AS bad FROM lineitem),
r AS (SELECT *, min(CASE WHEN bad IS NULL THEN row_number END) OVER (PARTITION BY target_id, signal_suffix) AS first FROM t), q AS (SELECT *, coalesce(bad, CASE WHEN row_number <> first THEN 'duplicate signal suffix' END) AS reason FROM r)
SELECT target_id, row_number, signal_suffix, CASE WHEN reason IS NULL THEN round(period, 6) END AS period_days, CASE WHEN reason IS NULL THEN round(epoch, 5) END AS epoch_btjd, CASE WHEN reason IS NULL THEN round(l_tax, 2) END AS depth_ppm,
  CASE WHEN reason IS NULL THEN round(l_discount, 2) END AS duration_hours, reason FROM q""")
def _(spark, folder):
    return S.normalize_priors(A.table(spark, folder, "lineitem").selectExpr(*[f"{e.format(s='STRING')} AS {n}" for n, e in TOI]))


@query("a11_read_stars", """WITH s AS (SELECT c_custkey AS target_id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 2 = 0 THEN 5000e0 + c_custkey END) AS teff_k, CASE WHEN c_custkey % 7 <> 0 THEN 4.4e0 END AS logg_cgs,
  CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey * 0.01e0 END AS feh, CASE WHEN c_custkey % 4 <> 1 THEN 1.5e0 END AS radius_solar, CASE WHEN c_custkey % 5 <> 2 THEN c_nationkey * 1e0 END AS mass_solar FROM customer)
SELECT *, CASE WHEN teff_k IS NOT NULL AND radius_solar IS NOT NULL AND mass_solar IS NOT NULL AND feh IS NOT NULL THEN 'candidate-data' WHEN coalesce(teff_k, radius_solar, mass_solar, feh) IS NOT NULL THEN 'partial-candidate-data' ELSE 'none' END AS completeness FROM s""")
def _(spark, folder):
    s = A.table(spark, folder, "customer").selectExpr("c_custkey AS target_id", "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_acctbal AS STRING) ELSE 'inf' END AS Teff", "CASE WHEN c_custkey % 2 = 0 THEN 5000e0 + c_custkey END AS temperature_k",
        "CASE WHEN c_custkey % 7 <> 0 THEN '4.4' ELSE '-' END AS log_g", "CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey * 0.01e0 END AS metallicity", "CASE WHEN c_custkey % 4 <> 1 THEN '1.5' END AS radius", "CASE WHEN c_custkey % 5 <> 2 THEN c_nationkey END AS mass_solar")
    return S.read_stars(s).select("target_id", "teff_k", "logg_cgs", "feh", "radius_solar", "mass_solar", "completeness")


@query("a12_explode_photometry", """SELECT s_suppkey AS target_id, catalog, band, mag, err, round(sqrt(err * err + 0.05e0 * 0.05e0), 9) AS total_err FROM (SELECT s_suppkey, x.catalog, x.band, CASE x.band WHEN 'J' THEN round(s_acctbal, 2) WHEN 'H' THEN 7.5e0 ELSE 6e0 END AS mag,
  CASE WHEN x.band = 'W1' AND s_suppkey % 3 = 0 THEN NULL ELSE x.e END AS err FROM supplier, (VALUES ('2MASS', 'J', 0.02e0), ('2MASS', 'H', 0.03e0), ('WISE', 'W1', 0.1e0)) AS x(catalog, band, e)) WHERE err IS NOT NULL""")
def _(spark, folder):
    s = A.table(spark, folder, "supplier").selectExpr("s_suppkey AS target_id", """concat('{"2MASS":{"J":{"mag":', CAST(round(s_acctbal, 2) AS STRING), ',"error":0.02},"H":{"mag":7.5,"error":0.03}},"WISE":{"W1":{"mag":6',
        CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ',"error":0.1' END, '}}}') AS photometry""")
    return S.explode_photometry(s).withColumn("total_err", F.round("total_err", 9))


RV = """WITH o AS (SELECT event_id, user_id AS target_id, event_type AS instrument, floor(event_id / 2) AS t, value AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
x AS (SELECT *, CASE WHEN k % 10 = 3 THEN 'unsupported unit' WHEN k % 10 = 4 THEN 'non-finite value' WHEN k % 10 = 5 THEN 'non-positive uncertainty' END AS why FROM o),
y AS (SELECT *, coalesce(why, CASE WHEN count(*) FILTER (WHERE why IS NULL) OVER (PARTITION BY target_id, instrument, t) > 1 AND why IS NULL THEN 'duplicate observation' END) AS reason FROM x)"""


def rv(spark, folder):
    e = A.events(spark, folder)
    unit = lambda v, u: F.struct(v.alias("value"), u.alias("unit"))
    k = F.col("k") % 10
    return e.select("event_id", "target_id", F.col("event_type").alias("instrument"), unit(F.floor(F.col("event_id") / 2).cast("double"), F.lit("BJD_TDB")).alias("observation_time"),
                    unit(F.when(k == 4, F.lit(float("nan"))).otherwise(F.col("value")), F.when(k == 3, "km/s").otherwise("m/s")).alias("velocity"),
                    unit(F.when(k == 5, 0.0).otherwise(1.0 + k), F.lit("m/s")).alias("uncertainty"),
                    unit(F.when(F.col("target_id") % 2 == 0, F.col("value") * 2), F.when(F.col("target_id") % 4 == 0, F.lit("dex")).otherwise(F.concat(F.lit("u"), (F.col("event_id") % 2).cast("string")))).alias("activity"))


@query("a13_read_rv", RV + """ SELECT target_id, instrument, CAST(t AS DOUBLE) AS t, v AS velocity, 1e0 + k % 10 AS sigma, CASE WHEN target_id % 4 = 0 THEN v * 2 END AS activity,
  CASE WHEN target_id % 4 = 0 THEN 'used' WHEN target_id % 2 = 0 THEN 'incomplete' ELSE 'absent' END AS activity_status FROM y WHERE reason IS NULL""")
def _(spark, folder):
    return S.read_rv(rv(spark, folder))[0]


@query("a13_rejected_rv", RV + " SELECT event_id, reason FROM y WHERE reason IS NOT NULL")
def _(spark, folder):
    return S.read_rv(rv(spark, folder))[1].select("event_id", "reason")


@query("a14_append_run", """SELECT o_orderkey AS retrieval_id, o_orderpriority AS provider FROM orders WHERE o_orderstatus <> 'F'""")
def _(spark, folder):
    """Two runs over one table: the second appends only what the first did not store."""
    path = scratch_path(spark, "runs")
    rows = A.table(spark, folder, "orders").select(F.col("o_orderkey").alias("retrieval_id"), F.col("o_orderpriority").alias("provider"), "o_orderstatus")
    S.append_run(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), path, "r1", ["retrieval_id"])
    return S.append_run(rows.drop("o_orderstatus"), path, "r2", ["retrieval_id"]).select("retrieval_id", "provider")


@query("a15_event_log", """SELECT event_type AS event, CAST(user_id AS VARCHAR) AS target_id, 'active' AS state, CAST(event_id AS VARCHAR) AS reason FROM events""")
def _(spark, folder):
    path = scratch_path(spark, "log")
    e = A.events(spark, folder).select(F.col("event_type").alias("event"), F.col("target_id").cast("string").alias("target_id"), F.lit("active").alias("state"), F.col("event_id").cast("string").alias("reason"))
    S.append_events(e.where("event = 'view'"), path)
    S.append_events(e.where("event <> 'view'"), path)
    return S.read_events(spark, path).select("event", "target_id", "state", "reason")


NOW = "2000-01-01 00:00:00"
EV = [("row_number", "o_orderkey"), ("target_id", "o_custkey % 50"), ("record_id", "CASE WHEN o_orderkey % 13 = 0 THEN ' bad id' ELSE concat(' Rec-', CAST(o_totalprice AS {s})) END"),
      ("source_kind", "CASE o_orderkey % 5 WHEN 0 THEN 'exofop' WHEN 1 THEN 'literature' WHEN 2 THEN 'variable-star-catalog' WHEN 3 THEN 'eclipsing-binary-catalog' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'rumour' ELSE 'exofop' END END"),
      ("source_name", "CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE 'cat' END"), ("source_uri", "CASE WHEN o_orderkey % 19 = 0 THEN 'http://a' ELSE 'https://a' END"), ("period", "CASE WHEN o_orderkey % 23 = 0 THEN 0e0 ELSE 3e0 END"), ("epoch", "1e0"), ("duration_hours", "2e0"),
      ("retrieved_at", "CAST(o_orderdate AS TIMESTAMP)"), ("expires_at", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL '30' DAY")]
EV_SQL = f"""e AS (SELECT {', '.join(f"{x.format(s='VARCHAR')} AS {n}" for n, x in EV)} FROM orders), n AS (SELECT *, lower(trim(record_id)) AS rid FROM e),
w AS (SELECT *, CASE WHEN NOT regexp_matches(rid, '^[a-z0-9][a-z0-9._-]*$') THEN 'invalid record id' WHEN source_kind = 'rumour' THEN 'unsupported source kind' WHEN trim(source_name) = '' THEN 'empty source name'
  WHEN source_uri = 'http://a' THEN 'source must use HTTPS' WHEN period <= 0 THEN 'values must be finite and positive' WHEN retrieved_at > TIMESTAMP '{NOW}' THEN 'timestamps not ordered' END AS why FROM n),
k AS (SELECT DISTINCT target_id, rid, true AS known FROM n WHERE row_number % 29 = 0), f AS (SELECT *, min(CASE WHEN why IS NULL THEN row_number END) OVER (PARTITION BY target_id, rid) AS first FROM w LEFT JOIN k USING (target_id, rid)),
q AS (SELECT *, coalesce(why, CASE WHEN known OR row_number <> first THEN 'record id already exists' END) AS reason FROM f)"""


def evidence(spark, folder):
    e = A.table(spark, folder, "orders").selectExpr(*[f"{x.format(s='STRING')} AS {n}" for n, x in EV])
    return S.append_evidence(e, e.where("row_number % 29 = 0").withColumn("record_id", F.lower(F.trim("record_id"))), NOW)


@query("a16_append_evidence", f"WITH {EV_SQL} SELECT row_number, target_id, rid AS record_id FROM q WHERE reason IS NULL")
def _(spark, folder):
    return evidence(spark, folder)[0].select("row_number", "target_id", "record_id")


@query("a16_rejected_evidence", f"WITH {EV_SQL} SELECT row_number, reason FROM q WHERE reason IS NOT NULL")
def _(spark, folder):
    return evidence(spark, folder)[1].select("row_number", "reason")


@query("b7_filter_targets", "SELECT p_partkey AS target_id FROM part WHERE p_type = 'SMALL' AND p_size % 7 = 3 AND p_partkey % 5 = 2")
def _(spark, folder):
    t = A.table(spark, folder, "part").select(F.col("p_partkey").alias("target_id"), F.array("p_type", "p_brand").alias("tags"), F.concat(F.lit("phase-"), (F.col("p_size") % 7).cast("string")).alias("phase"),
                                             F.concat(F.lit("m"), (F.col("p_partkey") % 5).cast("string")).alias("mission"))
    return R.filter_targets(t, "SMALL", "phase-3", "m2").select("target_id")


IDENT = """CASE c_custkey % 8 WHEN 0 THEN concat('TOI-', CAST(c_custkey AS {s}), '.01') WHEN 1 THEN concat(' tic ', CAST(c_custkey + 10000 AS {s})) WHEN 2 THEN concat('K', CAST(c_custkey AS {s}), '.02') WHEN 3 THEN concat('EPIC_', CAST(c_custkey + 1000000 AS {s}))
  WHEN 4 THEN concat('pic.', CAST(c_custkey + 1000 AS {s})) WHEN 5 THEN concat('CHEOPS-', c_mktsegment) WHEN 6 THEN 'HD 1' ELSE concat('TIC', CAST(c_custkey % 9 AS {s})) END"""


@query("b8_parse_identifiers", """WITH k AS (SELECT c_custkey, c_custkey % 8 AS m, c_mktsegment FROM customer) SELECT c_custkey, CASE m WHEN 0 THEN 'toi' WHEN 1 THEN 'tic' WHEN 2 THEN 'koi' WHEN 3 THEN 'epic' WHEN 4 THEN 'pic' WHEN 5 THEN 'cheops' END AS kind,
  CASE m WHEN 0 THEN 'tess' WHEN 1 THEN 'tess' WHEN 2 THEN 'kepler' WHEN 3 THEN 'k2' WHEN 4 THEN 'plato' WHEN 5 THEN 'cheops' END AS mission,
  CASE m WHEN 0 THEN concat(CAST(c_custkey AS VARCHAR), '.01') WHEN 1 THEN CAST(c_custkey + 10000 AS VARCHAR) WHEN 2 THEN concat(CAST(c_custkey AS VARCHAR), '.02') WHEN 3 THEN CAST(c_custkey + 1000000 AS VARCHAR) WHEN 4 THEN CAST(c_custkey + 1000 AS VARCHAR) WHEN 5 THEN c_mktsegment END AS value FROM k""")
def _(spark, folder):
    c = A.table(spark, folder, "customer").selectExpr("c_custkey", f"{IDENT.format(s='STRING')} AS identifier")
    return R.parse_identifiers(c, "identifier").select("c_custkey", "kind", "mission", "value")


@query("b9_drop_demo", "SELECT p_partkey AS record_index FROM part WHERE p_partkey % 6 NOT IN (0, 1) AND p_type IN ('SMALL', 'ECONOMY')")
def _(spark, folder):
    p = A.table(spark, folder, "part")
    rec = F.map_from_arrays(F.array(F.when(F.col("p_partkey") % 6 == 0, "origin").otherwise("source"), F.when(F.col("p_partkey") % 2 == 0, "obs_collection").otherwise("collection")),
                            F.array(F.when(F.col("p_partkey") % 6 == 0, "a Demo set").when(F.col("p_partkey") % 6 == 1, "SYNTHETIC").otherwise("real"), F.lower("p_type")))
    return R.drop_demo(p.select(F.col("p_partkey").alias("record_index"), rec.alias("record")), ("SMALL", "ECONOMY")).select("record_index")


@query("b10_fpp_flag", """SELECT p_partkey AS target_id, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_size / 1000e0 END AS fpp, CASE WHEN p_partkey % 5 <> 4 THEN p_size / 1000e0 < 0.01e0 END AS fpp_below_threshold FROM part""")
def _(spark, folder):
    keys = F.element_at(F.array(*[F.lit(k) for k in ("fpp", "FPP", "fpp_value", "FPP_specific", "other")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    r = A.table(spark, folder, "part").select(F.col("p_partkey").alias("target_id"), F.concat(F.lit('{"'), keys, F.lit('":'), (F.col("p_size") / 1000.0).cast("string"), F.lit("}")).alias("report"))
    return R.fpp_flag(r).drop("report")


@query("b11_retrieval_status", """SELECT o_orderkey AS retrieval_id, CASE WHEN c IN (401, 403) THEN 'requires-authentication' WHEN c < 200 OR c >= 300 THEN 'unavailable' WHEN o_orderstatus = 'P' THEN 'unavailable' WHEN o_custkey % 2 = 0 AND o_custkey % 4 > 1 THEN 'ambiguous'
  WHEN o_custkey % 4 = 0 AND o_orderpriority < '4' THEN 'empty' ELSE 'available' END AS retrieval_status FROM (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN 301 ELSE 200 END AS c FROM orders)""")
def _(spark, folder):
    r = A.table(spark, folder, "orders").selectExpr("o_orderkey AS retrieval_id", "CASE o_orderkey % 7 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN 301 ELSE 200 END AS http_code",
        "CASE WHEN o_orderstatus = 'P' THEN 'bad' END AS parse_error", "o_custkey % 2 = 0 AS identity_query", "o_custkey % 4 AS n_rows", "CASE WHEN o_orderpriority < '2' THEN 'json' WHEN o_orderpriority < '4' THEN 'csv' ELSE 'votable' END AS format")
    return R.retrieval_status(r).select("retrieval_id", "retrieval_status")


@query("d10_survey_report", """WITH t AS (SELECT CASE WHEN o_orderkey % 40 = 0 THEN 'invalid-record' WHEN o_orderkey % 30 = 0 OR o_custkey % 10 = 3 THEN 'orphaned-candidate-record' ELSE o_orderpriority END AS status FROM orders) SELECT status, count(*) AS targets FROM t GROUP BY 1""")
def _(spark, folder):
    t = A.table(spark, folder, "orders").selectExpr("o_custkey AS candidate_id", "CASE WHEN o_orderkey % 30 = 0 THEN 's2' ELSE 's1' END AS survey_id", "o_orderkey % 40 <> 0 AS record_ok", "o_orderpriority AS status")
    return R.survey_report(t, A.table(spark, folder, "orders").where("o_custkey % 10 <> 3").select(F.col("o_custkey").alias("candidate_id")), "s1")


@query("d17_checklist_progress", r"""WITH l AS (SELECT l_partkey AS document, l_returnflag = 'R' AS done, l_linenumber % 3 = 0 AS must, l_linestatus = 'O' AS item FROM lineitem)
SELECT document, count(*) FILTER (WHERE item) AS total, count(*) FILTER (WHERE item AND done) AS checked, count(*) FILTER (WHERE item AND must) AS mandatory, count(*) FILTER (WHERE item AND must AND done) AS mandatory_checked,
  round(CASE WHEN count(*) FILTER (WHERE item) > 0 THEN count(*) FILTER (WHERE item AND done) / count(*) FILTER (WHERE item) * 100e0 ELSE 0 END, 9) AS completion,
  count(*) FILTER (WHERE item AND must AND done) = count(*) FILTER (WHERE item AND must) AS gate_pass FROM l GROUP BY 1""")
def _(spark, folder):
    l = A.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("document"), F.concat(
        F.when(F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "R", "  - [x] ").otherwise("- [ ] ")).otherwise("note [x] "), F.lit("step "),
        F.when(F.col("l_linenumber") % 3 == 0, "[Mandatory]").otherwise("later")).alias("line"))
    return R.checklist_progress(l).withColumn("completion", F.round("completion", 9))


@query("g1_common_sectors", "SELECT l_partkey AS target_id, l_linenumber AS sector FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O'")
def _(spark, folder):
    l = A.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("target_id"), F.col("l_linenumber").alias("sector"), "l_returnflag", "l_linestatus")
    return R.common_sectors(l.where("l_returnflag = 'R'"), l.where("l_linestatus = 'O'"))


@query("g2_inventory_diff", """SELECT concat('f/', CAST(o_orderkey AS VARCHAR)) AS path, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 11 = 0 THEN 'undeclared' WHEN o_orderkey % 12 = 0 THEN 'size' ELSE 'hash' END AS difference
FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 11 <> 0 OR o_orderkey % 11 = 0 AND o_orderkey % 10 <> 0 OR (o_orderkey % 10 <> 0 AND o_orderkey % 11 <> 0 AND (o_orderkey % 12 = 0 OR o_orderkey % 13 = 0))""")
def _(spark, folder):
    o = A.table(spark, folder, "orders")
    m = o.where("o_orderkey % 11 <> 0").selectExpr("concat('f/', CAST(o_orderkey AS STRING)) AS path", "o_orderkey AS size", "'a' AS sha256")
    f = o.where("o_orderkey % 10 <> 0").selectExpr("concat('f/', CAST(o_orderkey AS STRING)) AS path", "CASE WHEN o_orderkey % 12 = 0 THEN 0 ELSE o_orderkey END AS size", "CASE WHEN o_orderkey % 13 = 0 THEN 'b' ELSE 'a' END AS sha256")
    return R.inventory_diff(m, f)


@query("g3_grid_completeness", """WITH g AS (SELECT p_partkey AS target_id, i AS cell FROM part, range(1, 22) AS x(i)), u AS (SELECT l_partkey AS target_id, CAST(CASE WHEN l_linenumber = 7 THEN 29 ELSE l_linenumber + CASE l_returnflag WHEN 'R' THEN 7 WHEN 'A' THEN 14 ELSE 0 END END AS BIGINT) AS cell, count(*) AS reported FROM lineitem GROUP BY 1, 2)
SELECT target_id, cell, coalesce(reported, 0) AS reported, CASE WHEN g.target_id IS NULL THEN 'not declared' WHEN reported IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM (SELECT target_id, cell, 1 AS one FROM g) g FULL JOIN u USING (target_id, cell)
WHERE g.one IS NULL OR reported IS NULL OR reported > 1""".replace("CASE WHEN g.target_id IS NULL", "CASE WHEN g.one IS NULL"))
def _(spark, folder):
    parts = fan_out(A.table(spark, folder, "part").select("p_partkey"), "p_partkey", least=R.CELL_TASKS)  # a row becomes 21
    g = parts.select(F.col("p_partkey").alias("target_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(21).cast("long"))).alias("cell"))
    t = A.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("target_id"), F.expr("CAST(CASE WHEN l_linenumber = 7 THEN 29 ELSE l_linenumber + CASE l_returnflag WHEN 'R' THEN 7 WHEN 'A' THEN 14 ELSE 0 END END AS BIGINT)").alias("cell"))
    return R.grid_completeness(g, t, ["target_id", "cell"])


@query("g4_union_snapshots", """SELECT p_partkey AS target_id, 'a' AS provider, p_size * 1e0 AS period, NULL::VARCHAR AS name FROM part UNION ALL SELECT s_suppkey, 'b', NULL, s_name FROM supplier""")
def _(spark, folder):
    a = A.table(spark, folder, "part").selectExpr("p_partkey AS target_id", "'a' AS provider", "p_size * 1e0 AS period")
    return R.union_snapshots([a, A.table(spark, folder, "supplier").selectExpr("s_suppkey AS target_id", "'b' AS provider", "s_name AS name")])

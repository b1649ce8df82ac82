"""Evidence and audit queries (IDs J1-J22)."""

from __future__ import annotations


from pyspark.sql import functions as F

from fluxloom.operators import evidence as J
from fluxloom.operators.folding import screen
from fluxloom.plans.folds import screen_sql
from fluxloom.plans.matching import FRESH, retrievals
from fluxloom.plans.registry import query
from fluxloom.sources import adapters as A


def rows(spark, folder, name, cols):
    return A.table(spark, folder, name).selectExpr(*[f"{e} AS {n}" for n, e in cols])


def cols_sql(cols):
    return ", ".join(f"{e} AS {n}" for n, e in cols)


@query("j1_evidence_screening", f"""WITH {screen_sql(A.SERIES16)} SELECT target_id, 'screening' AS diagnostic, CASE WHEN target_id % 5 = 4 OR NOT coalesce(primary_status = 'measured' AND half_phase_status = 'measured' AND double_primary_status = 'measured'
  AND double_alternating_status = 'measured' AND primary_depth_ppm > 0 AND primary_sigma > 0 AND odd_even_z IS NOT NULL, false) THEN 'blocked'
  WHEN odd_even_z >= 3 OR abs(half_phase_sigma) >= 3 OR abs(double_alternating_sigma) >= 3 THEN 'review-required' ELSE 'pass' END AS status, round(odd_even_z, 6) AS score FROM wide""")
def _(spark, folder):
    eph = A.ephemeris(spark, folder, A.SERIES16)
    s = screen(A.cadence(spark, folder, A.SERIES16), eph).join(eph, "target_id")
    det = eph.withColumn("epoch", F.when(F.col("target_id") % 5 == 4, F.col("epoch") + 1e-6).otherwise(F.col("epoch")))
    return J.evidence_screening(s, det).withColumn("score", F.round("score", 6))


CONE = [("target_id", "c_custkey"), ("validated", "c_custkey % 9 <> 0"), ("query_status", "CASE WHEN c_custkey % 11 = 0 THEN 'down' ELSE 'ok' END"), ("ruwe", "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 0.9e0 + c_nationkey * 0.05e0 END"),
        ("binary_ruwe", "0.9e0 + c_nationkey * 0.05e0"), ("binary_answer", "c_nationkey > 10"), ("suspected_binary", "c_nationkey > CASE WHEN c_custkey % 17 = 0 THEN 5 ELSE 10 END"), ("n_sources", "c_custkey % 3"),
        ("radius_arcsec", "CASE WHEN c_custkey % 7 = 0 THEN 20e0 ELSE 60e0 END"), ("crowding_radius", "CASE WHEN c_custkey % 7 = 0 THEN 20e0 ELSE 60e0 END"), ("crowded", "c_custkey % 3 > 1")]


@query("j2_evidence_archive", """SELECT c_custkey AS target_id, 'archive' AS diagnostic, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR (c_custkey % 17 = 0 AND c_nationkey BETWEEN 6 AND 10) OR c_custkey % 3 = 0 OR c_custkey % 7 = 0 THEN 'blocked'
  WHEN c_nationkey > 10 OR c_custkey % 3 > 1 THEN 'review-required' ELSE 'pass' END AS status, CASE WHEN c_custkey % 13 <> 0 THEN 0.9e0 + c_nationkey * 0.05e0 END AS score FROM customer""")
def _(spark, folder):
    return J.evidence_archive(rows(spark, folder, "customer", CONE))


@query("j3_evidence_localization", """SELECT c_custkey AS target_id, 'localization' AS diagnostic, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 THEN 'review-required' ELSE 'blocked' END AS status, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS score FROM customer""")
def _(spark, folder):
    return J.evidence_localization(rows(spark, folder, "customer", [("target_id", "c_custkey"), ("source", "CASE WHEN c_custkey % 4 <> 0 THEN 'candidate-data' END"),
        ("calibration_status", "CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE 'uncalibrated' END"), ("difference_ratio", "CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END")]))


@query("j4_evidence_activity", """WITH x AS (SELECT c_custkey AS t, CASE WHEN c_custkey % 8 <> 0 THEN 1e0 + (c_custkey % 40) * 0.25e0 END AS r, 2e0 + c_nationkey * 0.5e0 AS p FROM customer)
SELECT t AS target_id, 'activity' AS diagnostic, CASE WHEN r IS NULL THEN 'blocked' ELSE 'review-required' END AS status, r AS score,
  coalesce(abs(r - 0.5e0 * p) <= greatest(abs(r), 0.5e0 * p) * 0.02e0 OR abs(r - p) <= greatest(abs(r), p) * 0.02e0 OR abs(r - 2 * p) <= greatest(abs(r), 2 * p) * 0.02e0, false) AS transit_alias FROM x""")
def _(spark, folder):
    act = rows(spark, folder, "customer", [("target_id", "c_custkey"), ("source", "'candidate-data'"), ("rotation_period", "CASE WHEN c_custkey % 8 <> 0 THEN 1e0 + (c_custkey % 40) * 0.25e0 END")])
    return J.evidence_activity(act, rows(spark, folder, "customer", [("target_id", "c_custkey"), ("period", "2e0 + c_nationkey * 0.5e0")]))


@query("j5_evidence_dilution", """SELECT c_custkey AS target_id, 'dilution' AS diagnostic, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 3 = 2 THEN 'blocked' WHEN c_custkey % 3 = 0 THEN 'pass' ELSE 'review-required' END AS status,
  CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey * 0.01e0 END AS score FROM customer""")
def _(spark, folder):
    return J.evidence_dilution(rows(spark, folder, "customer", [("target_id", "c_custkey"), ("source", "'candidate-data'"), ("availability", "CASE WHEN c_custkey % 5 = 0 THEN 'unavailable' ELSE 'available' END"),
        ("contamination", "CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey * 0.01e0 END"), ("variation", "0.1e0"), ("verdict", "CASE c_custkey % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'aperture-sensitive' ELSE 'odd' END")]))


@query("j6_triage", """WITH e AS (SELECT CASE WHEN l_quantity > 44 THEN 2 * l_partkey ELSE l_partkey END AS t, l_linenumber % 5 AS d, max(CASE WHEN l_quantity > 48 THEN 2 WHEN l_quantity < 4 THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1, 2),
s AS (SELECT t, count(*) AS n, max(r) AS w FROM e GROUP BY 1)
SELECT p_partkey AS target_id, coalesce(n, 0) AS diagnostics, CASE WHEN coalesce(n, 0) < 5 OR w = 2 THEN 'blocked' WHEN w = 1 THEN 'review-required' ELSE 'pass' END AS triage FROM part LEFT JOIN s ON t = p_partkey""")
def _(spark, folder):
    names = F.array(*[F.lit(d) for d in J.DIAGNOSTICS])
    e = A.table(spark, folder, "lineitem").select(F.expr("CASE WHEN l_quantity > 44 THEN 2 * l_partkey ELSE l_partkey END").alias("target_id"), F.element_at(names, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("diagnostic"),
        F.expr("CASE WHEN l_quantity > 48 THEN 'blocked' WHEN l_quantity < 4 THEN 'review-required' ELSE 'pass' END").alias("status"))
    return J.triage(A.table(spark, folder, "part").select(F.col("p_partkey").alias("target_id")), e)


ROLES = J.REQUIRED_OUTPUTS
ROLE_AT = "l_linenumber + CASE WHEN l_quantity > 25 THEN 5 ELSE 0 END"


@query("j7_readiness", f"""WITH r(i, role) AS (VALUES {', '.join(f"({i + 1}, '{r}')" for i, r in enumerate(ROLES))}),
h AS (SELECT DISTINCT l_partkey AS t, {ROLE_AT} AS i FROM lineitem),
m AS (SELECT p_partkey AS t, string_agg(role, ',' ORDER BY r.i) AS missing, CAST(count(*) AS INTEGER) AS n FROM part, r WHERE (p_partkey, r.i) NOT IN (SELECT t, i FROM h) GROUP BY 1)
SELECT p_partkey AS target_id, coalesce(missing, '') AS missing, coalesce(n, 0) AS n_missing, CASE WHEN p_size % 10 = 0 THEN 'decisive-rejection' WHEN n > 0 THEN 'missing-prerequisites' WHEN p_partkey % 3 = 0 THEN 'no-bound-detection' ELSE 'ready' END AS readiness FROM part LEFT JOIN m ON t = p_partkey""")
def _(spark, folder):
    part = A.table(spark, folder, "part")
    art = A.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("target_id"), F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.expr(ROLE_AT)).alias("role"))
    return J.readiness(part.selectExpr("p_partkey AS target_id", "p_partkey % 3 <> 0 AS detection_bound"), art, part.where("p_size % 10 = 0").select(F.col("p_partkey").alias("target_id")), ROLES)


@query("j8_route_survey", """SELECT p_partkey AS target_id, CASE WHEN p_size % 10 = 0 THEN 'excluded-before-search' WHEN p_size % 3 = 0 OR p_size % 7 = 0 THEN 'blocked-novelty' WHEN p_retailprice >= 950 AND p_partkey % 2 = 0 THEN 'alert-for-human-review' ELSE 'searched-no-alert' END AS outcome FROM part""")
def _(spark, folder):
    part = A.table(spark, folder, "part").withColumnRenamed("p_partkey", "target_id")
    nov = part.where("p_size % 7 <> 0").selectExpr("target_id", "CASE WHEN p_size % 3 = 0 THEN 'ineligible' ELSE 'eligible' END AS novelty")
    return J.route_survey(part, nov, part.selectExpr("target_id", "p_retailprice AS snr", "target_id % 2 = 0 AS passed"), part.where("p_size % 10 = 0"), 950.0)


REG = """SELECT p_partkey AS target_id, CASE WHEN p_partkey % 4 = 0 THEN 'mission mismatch' WHEN p_partkey % 5 = 0 THEN 'missing identifier' WHEN p_partkey % 7 = 0 THEN 'known signal' WHEN p_size % 6 = 0 THEN 'already registered' END AS reason FROM part"""


def registration(spark, folder):
    part = A.table(spark, folder, "part")
    t = part.selectExpr("p_partkey AS target_id", "CASE WHEN p_partkey % 4 <> 0 THEN 'tess' ELSE 'k2' END AS mission", "CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey AS STRING) ELSE ' ' END AS tic", "CASE WHEN p_partkey % 7 = 0 THEN '1.01' END AS toi")
    return J.register_targets(part.where("p_size % 6 = 0").select(F.col("p_partkey").alias("target_id")), t, "tess")


@query("j9_registered_targets", f"WITH r AS ({REG}) SELECT target_id FROM r WHERE reason IS NULL")
def _(spark, folder):
    return registration(spark, folder)[0].select("target_id")


@query("j9_rejected_targets", f"WITH r AS ({REG}) SELECT target_id, reason FROM r WHERE reason IS NOT NULL")
def _(spark, folder):
    return registration(spark, folder)[1].select("target_id", "reason")


def digests(spark, folder):
    """One content hash per document: what ``hash_files`` gives for files."""
    return A.table(spark, folder, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"), "doc_id", "text", "source")


DIG = "fs AS (SELECT doc_id, concat('doc/', CAST(doc_id AS VARCHAR)) AS path, n_chars AS size, sha256(text) AS sha256 FROM documents)"


@query("j10_verify_provenance", f"""WITH {DIG} SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'missing-file' WHEN doc_id % 5 = 0 THEN 'missing-sidecar' WHEN doc_id % 6 = 1 THEN 'invalid-sidecar' WHEN doc_id % 4 = 0 THEN 'hash-mismatch' ELSE 'ok' END AS provenance FROM fs WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0""")
def _(spark, folder):
    d = digests(spark, folder)
    side = d.where("doc_id % 5 <> 0").select("path", F.expr("CASE WHEN doc_id % 6 = 1 THEN 'zz' WHEN doc_id % 4 = 0 THEN sha2(path, 256) ELSE sha256 END").alias("sha256"), F.lit("https://a").alias("source_uri"), F.lit("2024").alias("downloaded_at"))
    return J.verify_provenance(d.where("doc_id % 7 <> 0"), side)


@query("j11_verify_release", f"""WITH {DIG}, m AS (SELECT *, CASE WHEN doc_id % 11 = 3 THEN concat('../', path) ELSE path END AS mp FROM fs WHERE doc_id % 8 <> 0)
SELECT mp AS path, CASE WHEN doc_id % 11 = 3 THEN 'unsafe path' WHEN doc_id % 9 = 4 THEN 'repeated path' WHEN doc_id % 7 = 0 THEN 'missing file' WHEN doc_id % 6 = 1 THEN 'size mismatch' ELSE 'hash mismatch' END AS problem FROM m
WHERE doc_id % 11 = 3 OR doc_id % 9 = 4 OR doc_id % 7 = 0 OR doc_id % 6 = 1 OR doc_id % 10 = 2
UNION ALL SELECT path, 'undeclared file' FROM fs WHERE doc_id % 7 <> 0 AND (doc_id % 8 = 0 OR doc_id % 11 = 3)""")
def _(spark, folder):
    d = digests(spark, folder)
    m = d.where("doc_id % 8 <> 0").selectExpr("CASE WHEN doc_id % 11 = 3 THEN concat('../', path) ELSE path END AS path", "CASE WHEN doc_id % 6 = 1 THEN -1 ELSE size END AS size", "CASE WHEN doc_id % 10 = 2 THEN 'x' ELSE sha256 END AS sha256", "doc_id")
    return J.verify_release(m.unionByName(m.where("doc_id % 9 = 4")), d.where("doc_id % 7 <> 0"))


RULES = ({"field": "state", "required": True, "enum": ("O", "F")}, {"field": "id", "required": True, "pattern": "^[0-9]+$"}, {"field": "price", "minimum": 1000.0, "maximum": 300000.0})


@query("j12_validate_records", """WITH o AS (SELECT o_orderkey AS record_id, o_orderkey % 19 = 0 AS broken, o_orderstatus AS s, o_orderkey % 7 = 0 AS noid, o_orderkey % 5 = 0 AS oddid, o_totalprice AS p, o_orderkey % 3 = 0 AS nostate FROM orders)
SELECT record_id, '$' AS field, 'malformed' AS rule FROM o WHERE broken UNION ALL SELECT record_id, 'state', 'required' FROM o WHERE NOT broken AND nostate UNION ALL SELECT record_id, 'state', 'enum' FROM o WHERE NOT broken AND NOT nostate AND s = 'P'
UNION ALL SELECT record_id, 'id', 'required' FROM o WHERE NOT broken AND noid UNION ALL SELECT record_id, 'id', 'pattern' FROM o WHERE NOT broken AND NOT noid AND oddid
UNION ALL SELECT record_id, 'price', 'minimum' FROM o WHERE NOT broken AND p < 1000 UNION ALL SELECT record_id, 'price', 'maximum' FROM o WHERE NOT broken AND p > 300000""")
def _(spark, folder):
    o = A.table(spark, folder, "orders").selectExpr("o_orderkey AS record_id", """CASE WHEN o_orderkey % 19 = 0 THEN '{"a":' ELSE concat('{', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('"state":"', o_orderstatus, '",') END,
        CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('"id":"', CASE WHEN o_orderkey % 5 = 0 THEN 'k' ELSE '' END, CAST(o_orderkey AS STRING), '",') END, '"price":', CAST(o_totalprice AS STRING), '}') END AS payload""")
    return J.validate_records(o, RULES)


@query("j13_validate_references", """SELECT l_orderkey * 8 + l_linenumber AS record_id, 'order' AS rule FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT l_orderkey * 8 + l_linenumber, 'supply' FROM lineitem WHERE (l_suppkey, l_partkey % 25) NOT IN (SELECT s_suppkey, s_nationkey FROM supplier)""")
def _(spark, folder):
    l = A.table(spark, folder, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record_id"), "l_orderkey", "l_suppkey", (F.col("l_partkey") % 25).alias("nation"))
    o = A.table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    s = A.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("nation"))
    return J.validate_references({"order": (l, o, ["l_orderkey"]), "supply": (l, s, ["l_suppkey", "nation"])})


LINES = """ln AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 AND i = 1 THEN concat(l, ' TIC 1234567') WHEN doc_id % 10 = 4 AND i = 1 THEN concat('toi-700.01 ', l) ELSE l END AS line, CAST(i - 1 AS INTEGER) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""


@query("j14_scan_text", f"""WITH {LINES}, a0 AS (SELECT DISTINCT list_filter(regexp_split_to_array(lower(array_to_string(string_split(text, ' ')[1:2], ' ')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark),
a AS (SELECT w FROM a0 WHERE length(array_to_string(w, '')) >= 4 UNION SELECT [array_to_string(w, '')] FROM a0 WHERE length(array_to_string(w, '')) >= 4),
tk AS (SELECT doc_id, n, list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM ln),
g AS (SELECT DISTINCT doc_id, n, t[i:i + k - 1] AS w FROM tk, range(1, 6) AS r(k), range(1, len(t) - k + 2) AS s(i)),
h AS (SELECT doc_id, n, 'target-id' AS finding FROM ln WHERE regexp_matches(line, '(?i)(^|[^A-Za-z0-9])(TOI[\\s._-]*\\d{{1,7}}(\\.\\d{{1,2}})?|TIC[\\s._:-]*\\d{{5,12}}|(TOI|TIC)\\d{{4,}})([^A-Za-z0-9]|$)')
UNION ALL SELECT DISTINCT doc_id, n, 'alias' FROM g WHERE w IN (SELECT w FROM a))
SELECT doc_id AS path, n AS line_number, finding FROM h WHERE NOT (doc_id % 20 = 3 AND n = 0 AND finding = 'target-id')""")
def _(spark, folder):
    d = A.table(spark, folder, "documents")
    l = d.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_number", "l"))
    line = F.when((F.col("path") % 10 == 3) & (F.col("line_number") == 0), F.concat("l", F.lit(" TIC 1234567"))).when((F.col("path") % 10 == 4) & (F.col("line_number") == 0), F.concat(F.lit("toi-700.01 "), "l")).otherwise(F.col("l"))
    ex = d.where("doc_id % 10 = 3").select(F.col("doc_id").alias("path"), F.lit(0).alias("line_number"), F.lit("target-id").alias("finding"), F.expr("CASE WHEN doc_id % 20 = 3 THEN date'2030-01-01' ELSE date'2020-01-01' END").alias("expires"))
    return J.scan_text(l.select("path", "line_number", line.alias("line")), A.table(spark, folder, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("alias")), ex, "2024-06-01")


@query("j15_gate_errors", """WITH t AS (SELECT p_partkey AS t, p_size % 7 AS ph, p_partkey % 4 AS c, p_partkey % 3 AS n, p_partkey % 5 AS f, p_partkey % 11 AS s, p_size % 7 NOT IN (2, 5) AS doc FROM part)
SELECT t AS target_id, 'lifecycle stopped' AS error FROM t WHERE s = 1 UNION ALL SELECT t, 'missing gate document' FROM t WHERE doc AND c = 0 UNION ALL SELECT t, 'no mandatory items' FROM t WHERE doc AND c = 1
UNION ALL SELECT t, 'unchecked mandatory item: second' FROM t WHERE doc AND c = 2 UNION ALL SELECT t, 'unchecked mandatory item: first' FROM t WHERE doc AND t % 8 = 2 UNION ALL SELECT t, 'no valid novelty audit' FROM t WHERE ph IN (1, 6) AND n <> 0 UNION ALL SELECT t, 'provenance not verified' FROM t WHERE ph = 2 AND f IN (0, 1)
UNION ALL SELECT t, 'no calibrated false-positive claim' FROM t WHERE ph = 5 UNION ALL SELECT t, 'already locked' FROM t WHERE ph = 6 AND s = 2""")
def _(spark, folder):
    p = A.table(spark, folder, "part").withColumn("target_id", F.col("p_partkey"))
    p = p.withColumn("phase", F.element_at(F.array(*[F.lit(x) for x in J.PHASES]), (F.col("p_size") % 7 + 1).cast("int")))
    t = p.select("target_id", "phase", F.expr("CASE target_id % 11 WHEN 1 THEN 'stopped' WHEN 2 THEN 'published' ELSE 'active' END").alias("state"))
    lists = p.where("target_id % 4 <> 0").selectExpr("target_id", "phase", "CASE WHEN target_id % 4 = 1 THEN 0 ELSE 3 END AS mandatory", "CASE WHEN target_id % 8 = 2 THEN array('first', 'second') WHEN target_id % 4 = 2 THEN array('second') ELSE cast(array() AS array<string>) END AS unchecked")
    files = p.where("target_id % 5 <> 0").selectExpr("target_id", "CASE WHEN target_id % 5 = 1 THEN 'hash-mismatch' ELSE 'ok' END AS provenance")
    return J.gate_errors(t, lists, p.selectExpr("target_id", "target_id % 3 = 0 AS valid"), files)


@query("j16_semantic_hash", """SELECT o_orderkey, sha256(concat('{"o_custkey":', CAST(o_custkey AS VARCHAR), ',"o_orderpriority":"', o_orderpriority, '","o_orderstatus":"', o_orderstatus,
  '","o_totalprice":', CAST(o_totalprice AS VARCHAR), '}')) AS fingerprint FROM orders""")
def _(spark, folder):
    return J.semantic_hash(A.table(spark, folder, "orders"), ["o_orderdate"], ["o_orderkey"])


@query("j17_incremental_hash", f"""WITH {DIG} SELECT path, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN 'cached' ELSE sha256 END AS sha256, doc_id % 3 = 0 AND doc_id % 4 <> 0 AS reused FROM fs""")
def _(spark, folder):
    d = digests(spark, folder).withColumn("mtime", F.col("doc_id"))
    cache = d.where("doc_id % 3 = 0").selectExpr("path", "size", "CASE WHEN doc_id % 4 = 0 THEN -1 ELSE mtime END AS mtime", "'cached' AS sha256")
    return J.incremental_hash(d, cache, d.select("path", F.col("text").alias("content")))


@query("j18_to_refresh", f"""WITH {FRESH}, n AS (SELECT *, row_number() OVER (PARTITION BY target_id, provider ORDER BY retrieved_at DESC, retrieval_id DESC) AS k FROM rt)
SELECT target_id, provider, retrieval_id, CASE WHEN expires_at IS NULL THEN 'invalid expiry' ELSE 'expired' END AS reason FROM n WHERE k = 1 AND (expires_at IS NULL OR expires_at <= TIMESTAMP '2001-12-15 00:00:00')""")
def _(spark, folder):
    return J.to_refresh(retrievals(spark, folder), "2001-12-15 00:00:00")


@query("j19_bound_detections", """SELECT o_orderkey AS result_id, o_custkey AS target_id, CASE WHEN o_orderkey % 31 = 0 THEN 'manifest missing' WHEN o_orderkey % 29 = 0 THEN 'owner mismatch' WHEN o_orderkey % 23 = 0 THEN 'result hash mismatch' WHEN o_orderkey % 19 = 0 THEN 'configuration mismatch'
  WHEN o_custkey % 17 = 0 OR (o_custkey + 1) % 17 = 0 THEN 'input hash mismatch' WHEN o_orderstatus = 'P' OR o_totalprice / 10000 < 7.1e0 OR o_orderkey % 5 < 2 THEN 'below thresholds' WHEN o_orderkey % 13 = 0 THEN 'ephemeris mismatch' END AS reason,
  NOT (o_orderkey % 31 = 0 OR o_orderkey % 29 = 0 OR o_orderkey % 23 = 0 OR o_orderkey % 19 = 0 OR o_custkey % 17 = 0 OR (o_custkey + 1) % 17 = 0 OR o_orderstatus = 'P' OR o_totalprice / 10000 < 7.1e0 OR o_orderkey % 5 < 2 OR o_orderkey % 13 = 0) AS bound FROM orders""")
def _(spark, folder):
    o = A.table(spark, folder, "orders")
    res = o.selectExpr("o_orderkey AS result_id", "o_custkey AS target_id", "'h' AS sha256", "'bls' AS engine", "0.5e0 AS period_min", "CASE WHEN o_orderstatus = 'P' THEN 'no-detection' ELSE 'detected' END AS status", "o_totalprice / 10000 AS snr", "o_orderkey % 5 AS n_events",
                       "2e0 + CASE WHEN o_orderkey % 13 = 0 THEN 1e-9 ELSE 0e0 END AS period", "1e0 AS epoch")
    man = o.where("o_orderkey % 31 <> 0").selectExpr("o_orderkey AS result_id", "CASE WHEN o_orderkey % 29 = 0 THEN -1 ELSE o_custkey END AS target_id", "CASE WHEN o_orderkey % 23 = 0 THEN 'g' ELSE 'h' END AS result_sha256", "CASE WHEN o_orderkey % 19 = 0 THEN 0.6e0 ELSE 0.5e0 END AS period_min", "'bls' AS engine",
                                                     "array(named_struct('path', CAST(o_custkey AS STRING), 'sha256', 'a'), named_struct('path', CAST(o_custkey + 1 AS STRING), 'sha256', 'a')) AS inputs")
    c = A.table(spark, folder, "customer").selectExpr("c_custkey AS k").union(A.table(spark, folder, "customer").selectExpr("max(c_custkey) + 1"))
    art = c.selectExpr("CAST(k AS STRING) AS path", "CASE WHEN k % 17 = 0 THEN 'b' ELSE 'a' END AS sha256")
    return J.bound_detections(res, man, art, A.table(spark, folder, "customer").selectExpr("c_custkey AS target_id", "2e0 AS period", "1e0 AS epoch"))


@query("j20_novelty_valid", """SELECT o_orderkey AS audit_id, o_custkey AS target_id, reason, reason IS NULL AS valid FROM (SELECT *, CASE WHEN o_orderkey % 31 = 0 THEN 'owner mismatch' WHEN o_orderstatus = 'P' THEN 'status not eligible' WHEN o_orderkey % 29 = 0 THEN 'invalid timestamp'
  WHEN CAST(o_orderdate AS TIMESTAMP) > TIMESTAMP '2001-01-01 00:00:00' THEN 'retrieval in the future' WHEN o_orderkey % 23 = 0 THEN 'expiry before retrieval' WHEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '900' DAY <= TIMESTAMP '2001-01-01 00:00:00' THEN 'stale' WHEN o_orderkey % 19 = 0 THEN 'schema version'
  WHEN o_orderkey % 17 = 0 THEN 'needs one response per registry' WHEN o_orderkey % 13 = 0 THEN 'not the canonical query' WHEN o_orderkey % 11 = 0 THEN 'response missing or changed' WHEN o_orderkey % 7 = 0 THEN 'retrieval time mismatch' WHEN o_orderkey % 5 = 0 THEN 'responses not from one retrieval' END AS reason FROM orders)""")
def _(spark, folder):
    o = A.table(spark, folder, "orders")
    aud = o.selectExpr("o_orderkey AS audit_id", "o_custkey AS target_id", "CASE WHEN o_orderkey % 31 = 0 THEN -1 ELSE o_custkey END AS owner_id", "CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 2 END AS schema_version", "CASE WHEN o_orderstatus = 'P' THEN 'no' ELSE 'eligible' END AS status",
                       "CAST(o_orderdate AS TIMESTAMP) AS retrieved_at", "CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN CAST(o_orderdate AS TIMESTAMP) ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL '900' DAY END AS expires_at")
    ev = o.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("NOT (o_orderkey % 17 = 0 AND i = 2)").selectExpr("o_orderkey AS audit_id", "element_at(array('a', 'b', 'c'), i + 1) AS provider", "CASE WHEN o_orderkey % 13 = 0 AND i = 1 THEN 'y' ELSE 'x' END AS source_uri", "'x' AS expected_uri",
        "concat(CAST(o_orderkey AS STRING), '/', CAST(i AS STRING)) AS path", "'h' AS sha256", "CASE WHEN o_orderkey % 5 = 0 AND i = 0 THEN 'r2' ELSE 'r1' END AS retrieval_id", "CASE WHEN o_orderkey % 7 = 0 AND i = 2 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS retrieved_at")
    art = ev.selectExpr("path", "CASE WHEN audit_id % 11 = 0 THEN 'changed' ELSE 'h' END AS sha256")
    return J.novelty_valid(aud, ev, art, ("a", "b", "c"), "2001-01-01 00:00:00")


def runs(spark, folder):
    return A.table(spark, folder, "orders").selectExpr("o_orderkey AS run_id", "o_orderpriority AS engine", "CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status", "sequence(1, CAST(o_orderkey % 4 + 1 AS INT)) AS inputs",
        "array(named_struct('path', CAST(o_custkey AS STRING), 'sha256', CAST(o_orderkey % 3 AS STRING)), named_struct('path', CAST(o_custkey + 1 AS STRING), 'sha256', 'z')) AS outputs")


@query("j21_run_report", "SELECT o_orderkey AS run_id, o_orderpriority AS engine, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status, CAST(o_orderkey % 4 + 1 AS INTEGER) AS n_inputs, 2 AS n_outputs FROM orders")
def _(spark, folder):
    return J.run_report(runs(spark, folder))


@query("j21_lineage", """WITH o AS (SELECT o_orderkey AS r, CAST(o_custkey AS VARCHAR) AS path, CAST(o_orderkey % 3 AS VARCHAR) AS sha256 FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, CAST(o_custkey + 1 AS VARCHAR), 'z' FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT path, sha256, min(r) AS run_id FROM o GROUP BY 1, 2), a AS (SELECT CAST(c_custkey AS VARCHAR) AS path, CASE c_custkey % 5 WHEN 3 THEN 'z' WHEN 4 THEN 'q' ELSE CAST(c_custkey % 5 AS VARCHAR) END AS sha256 FROM customer)
SELECT path, sha256, run_id FROM a LEFT JOIN f USING (path, sha256)""")
def _(spark, folder):
    art = A.table(spark, folder, "customer").selectExpr("CAST(c_custkey AS STRING) AS path", "CASE c_custkey % 5 WHEN 3 THEN 'z' WHEN 4 THEN 'q' ELSE CAST(c_custkey % 5 AS STRING) END AS sha256")
    return J.lineage(art, runs(spark, folder))


LAY = """concat(CASE p_partkey % 6 WHEN 0 THEN 'archive/' WHEN 1 THEN 'candidate/' WHEN 2 THEN 'src/' WHEN 3 THEN '.git/' WHEN 4 THEN '' ELSE 'docs/deep/' END, 'f', CAST(p_partkey AS {s}), CASE p_size % 4 WHEN 0 THEN '.FITS' WHEN 1 THEN '.py' WHEN 2 THEN '.csv' ELSE '' END)"""


@query("j22_scan_layout", f"""WITH f AS (SELECT {LAY.format(s='VARCHAR')} AS path, p_partkey % 6 AS d, p_size % 4 AS e, p_partkey FROM part) SELECT path, CASE WHEN d = 0 THEN 'forbidden-directory' ELSE 'payload-outside-tree' END AS finding FROM f
WHERE d NOT IN (1, 3) AND (d = 0 OR e IN (0, 2)) AND p_partkey % 9 <> 0""")
def _(spark, folder):
    f = A.table(spark, folder, "part").selectExpr(f"{LAY.format(s='STRING')} AS path", "p_partkey")
    return J.scan_layout(f, f.where("p_partkey % 9 = 0"))

"""Structured Streaming queries (IDs K1-K3), each checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.plans.matching import novelty_inputs
from fluxloom.plans.record_queries import TCE, TCE_SQL
from fluxloom.plans.registry import query
from fluxloom.session import scratch_path
from fluxloom.sources import adapters as A
from fluxloom.streaming import harvest as H
from fluxloom.streaming import lifecycle as L


def finish(handle) -> None:
    handle.awaitTermination()
    if handle.exception():
        raise handle.exception()


@query("k1_harvest_stream", f"""WITH {TCE_SQL}, f AS (SELECT source_row FROM tc WHERE snr >= 20 AND period BETWEEN 1 AND 15 AND depth_ppm BETWEEN 200 AND 1500 AND planet_radius BETWEEN 1.2e0 AND 3.5e0 AND stellar_radius <= 1.3e0 AND (tmag IS NULL OR tmag <= 12.5e0))
SELECT CASE WHEN p_partkey > 0 THEN p_partkey END AS target_id, CASE WHEN source_row IS NULL THEN 'out-of-bounds' WHEN p_partkey = 0 THEN 'invalid-identifier' WHEN p_size % 9 = 0 THEN 'ineligible' WHEN p_size % 13 = 0 THEN 'unavailable' WHEN (p_size + 1) % 9 = 0 OR (p_size + 2) % 9 = 0 THEN 'ineligible' ELSE 'registered' END AS outcome FROM part LEFT JOIN f ON p_partkey = source_row""")
def _(spark, folder):
    """The release arrives as CSV files; outcomes are read back from the sink table."""
    names = [n.strip("`") for n, _ in TCE[1:]]
    source, sink = scratch_path(spark, "release"), scratch_path(spark, "harvest")
    A.table(spark, folder, "part").selectExpr(*[f"{e.format(s='STRING')} AS {n}" for n, e in TCE[1:]]).write.option("header", "true").csv(source)
    _, registries, availability = novelty_inputs(spark, folder)
    stream = H.release_stream(spark, source, names)
    finish(H.harvest_stream(stream, registries, availability, sink, scratch_path(spark, "harvest-state")))
    return spark.read.schema(H.OUTCOMES).parquet(sink).select("target_id", "outcome")


STATE = "CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'paused' WHEN 'error' THEN 'stopped' WHEN 'purchase' THEN 'published' ELSE 'archived' END"


@query("k2_lifecycle_stream", f"""WITH RECURSIVE e AS (SELECT user_id AS target_id, event_id, {STATE} AS s, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 > 0 THEN 'why' END AS why,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT target_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS from_state, NULL::VARCHAR AS to_state, NULL::VARCHAR AS problem, 'active' AS cur FROM (SELECT DISTINCT target_id FROM e)
  UNION ALL SELECT e.target_id, e.rn, e.event_id, r.cur, e.s, CASE WHEN e.s = r.cur THEN 'state unchanged' WHEN r.cur IN ('stopped', 'published', 'archived') AND e.why IS NULL THEN 'reason required' END,
  CASE WHEN e.s = r.cur OR (r.cur IN ('stopped', 'published', 'archived') AND e.why IS NULL) THEN r.cur ELSE e.s END FROM r JOIN e ON e.target_id = r.target_id AND e.rn = r.rn + 1)
SELECT target_id, event_id, from_state, to_state, problem IS NULL AS accepted, problem FROM r WHERE rn > 0""")
def _(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    schema = A.table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")
    events = raw.select(F.col("user_id").alias("target_id"), "event_id", F.col("ts").alias("at"), F.expr(STATE).alias("state"),
                        F.when(F.get_json_object("props", "$.k").cast("int") % 3 > 0, "why").alias("reason"))
    sink = scratch_path(spark, "lifecycle")
    finish(L.run_to_table(L.lifecycle_stream(events), sink, scratch_path(spark, "lifecycle-state")))
    return spark.read.schema(L.OUTPUT).parquet(sink)


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("k2_advance_stream", f"""WITH RECURSIVE e0 AS (SELECT user_id AS target_id, event_id, ts, CASE event_type WHEN 'view' THEN 'gate' WHEN 'click' THEN 'advance' ELSE 'state' END AS kind,
  CASE event_type WHEN 'error' THEN 'stopped' WHEN 'purchase' THEN 'paused' ELSE 'active' END AS s, CASE WHEN {K} % 3 > 0 THEN 'why' END AS why, {K} % 7 + 1 AS ph, CASE WHEN {K} % 5 = 0 THEN 1 ELSE 0 END AS bad FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY ts, kind <> 'gate', event_id) AS rn FROM e0),
g AS (SELECT *, [{", ".join(f"max(CASE WHEN kind = 'gate' AND ph = {i} THEN rn * 2 + bad END) OVER w" for i in range(1, 8))}] AS snap FROM e WINDOW w AS (PARTITION BY target_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ev AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY rn) AS m FROM g WHERE kind <> 'gate'),
r AS (SELECT target_id, 0::BIGINT AS m, NULL::BIGINT AS event_id, NULL::VARCHAR AS event, NULL::VARCHAR AS s0, 0 AS p0, NULL::VARCHAR AS problem, 'active' AS cur, 1 AS phase FROM (SELECT DISTINCT target_id FROM ev)
  UNION ALL SELECT target_id, m, event_id, kind, cur, phase, problem, CASE WHEN problem IS NOT NULL THEN cur WHEN kind = 'state' THEN s WHEN phase = 7 THEN 'published' ELSE cur END, CASE WHEN problem IS NULL AND kind = 'advance' AND phase < 7 THEN phase + 1 ELSE phase END
  FROM (SELECT ev.*, r.cur, r.phase, CASE WHEN kind = 'state' THEN CASE WHEN s = cur THEN 'state unchanged' WHEN cur IN ('stopped', 'published', 'archived') AND why IS NULL THEN 'reason required' END
    WHEN cur = 'stopped' THEN 'lifecycle is stopped' WHEN snap[phase] IS NULL THEN 'no gate snapshot' WHEN snap[phase] % 2 = 1 THEN 'evidence missing'
    WHEN phase = 7 AND cur IN ('published', 'archived') THEN 'lifecycle is already locked: ' || cur END AS problem FROM r JOIN ev ON ev.target_id = r.target_id AND ev.m = r.m + 1)),
n AS (SELECT {list(L.PHASES)} AS names)
SELECT target_id, event_id, event, s0 AS from_state, cur AS to_state, names[p0] AS from_phase, names[phase] AS to_phase, problem IS NULL AS accepted, problem FROM r, n WHERE m > 0""")
def _(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    schema = A.table(spark, folder, "events").schema
    k = F.get_json_object("props", "$.k").cast("int")

    def arrived():
        return spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet").withColumnsRenamed({"user_id": "target_id", "ts": "at"})

    kind = F.when(F.col("event_type") == "click", "advance").otherwise("state")
    state = F.when(F.col("event_type") == "error", "stopped").when(F.col("event_type") == "purchase", "paused").otherwise("active")
    events = arrived().where("event_type <> 'view'").select("target_id", "event_id", "at", kind.alias("kind"), state.alias("state"), F.when(k % 3 > 0, "why").alias("reason"))
    gates = arrived().where("event_type = 'view'").select("target_id", "event_id", "at", F.element_at(F.array(*map(F.lit, L.PHASES)), k % 7 + 1).alias("phase"), F.when(k % 5 == 0, "evidence missing").alias("errors"))
    sink = scratch_path(spark, "progress")
    finish(L.run_to_table(L.progress_stream(events, gates), sink, scratch_path(spark, "progress-state")))
    return spark.read.schema(L.MOVES).parquet(sink)


@query("k3_outcome_counts", "SELECT o_orderstatus AS outcome, count(*) AS targets FROM orders GROUP BY 1")
def _(spark, folder):
    schema = A.table(spark, folder, "orders").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/orders*.parquet").select(F.col("o_orderstatus").alias("outcome"))
    sink = scratch_path(spark, "counts")
    finish(H.outcome_counts(stream, sink, scratch_path(spark, "counts-state")))
    return H.latest_counts(spark, sink)

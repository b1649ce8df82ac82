"""Evidence, audit and state tables (IDs J1-J22).

Missing evidence is never a pass: every diagnostic defaults to ``blocked``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators.spread import attach

BLOCKED, REVIEW, PASS = "blocked", "review-required", "pass"
DIAGNOSTICS = ("screening", "archive", "localization", "activity", "dilution")


def yes(c: Column) -> Column:
    """Three-valued condition with unknown as false."""
    return F.coalesce(c, F.lit(False))


def close(a: Column, b: Column, rel: float, floor: float = 0.0) -> Column:
    return yes(F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel, F.lit(floor)))


def evidence_row(df: DataFrame, name: str, status: Column, score: Column) -> DataFrame:
    return df.select("target_id", F.lit(name).alias("diagnostic"), status.alias("status"), score.cast("double").alias("score"))


def evidence_screening(screen: DataFrame, det: DataFrame, threshold: float = 3.0) -> DataFrame:
    """All six controls measured on the detected ephemeris; strong secondary signals need review."""
    d = det.select("target_id", F.col("period").alias("d_period"), F.col("epoch").alias("d_epoch"), F.col("duration_hours").alias("d_duration"))
    x = screen.join(d, "target_id", "left")
    same = reduce(lambda a, b: a & b, [close(F.col(a), F.col(b), 1e-12, 1e-12) for a, b in (("period", "d_period"), ("epoch", "d_epoch"), ("duration_hours", "d_duration"))])
    measured = reduce(lambda a, b: a & b, [yes(F.col(f"{t}_status") == "measured") for t in ("primary", "half_phase", "double_primary", "double_alternating")])
    complete = measured & yes(F.col("primary_depth_ppm") > 0) & yes(F.col("primary_sigma") > 0) & F.col("odd_even_z").isNotNull()
    doubtful = (F.col("odd_even_z") >= threshold) | (F.abs("half_phase_sigma") >= threshold) | (F.abs("double_alternating_sigma") >= threshold)
    return evidence_row(x, "screening", F.when(~same | ~complete, BLOCKED).when(yes(doubtful), REVIEW).otherwise(PASS), F.col("odd_even_z"))


def evidence_archive(cone: DataFrame, min_radius: float = 21.0) -> DataFrame:
    """Consistent RUWE and crowding answers from a validated cone, else blocked; warnings need review."""
    c = F.col
    sound = (yes(c("validated")) & yes(c("query_status") == "ok") & yes(c("ruwe") > 0) & close(c("binary_ruwe"), c("ruwe"), 1e-9, 1e-12)
             & yes(c("binary_answer") == c("suspected_binary")) & yes(c("n_sources") >= 1) & yes(c("radius_arcsec") >= min_radius)
             & close(c("crowding_radius"), c("radius_arcsec"), 1e-9, 1e-12) & yes(c("crowded") == (c("n_sources") > 1)))
    return evidence_row(cone, "archive", F.when(~sound, BLOCKED).when(yes(c("binary_answer")) | yes(c("crowded")), REVIEW).otherwise(PASS), c("ruwe"))


def evidence_localization(loc: DataFrame) -> DataFrame:
    """Blocked without candidate data or with an unknown calibration label; never better than review."""
    usable = yes(F.col("source") == "candidate-data") & yes(F.col("calibration_status") == "uncalibrated")
    return evidence_row(loc, "localization", F.when(usable, REVIEW).otherwise(BLOCKED), F.col("difference_ratio"))


def evidence_activity(act: DataFrame, eph: DataFrame) -> DataFrame:
    """Rotation against half, one and two event periods; always reviewed, with the alias noted."""
    x = act.join(eph.select("target_id", "period"), "target_id", "left")
    factors = F.array(*[F.lit(v) for v in (0.5, 1.0, 2.0)])
    alias = yes(F.exists(factors, lambda v: F.abs(F.col("rotation_period") - v * F.col("period")) <= F.greatest(F.abs("rotation_period"), F.abs(v * F.col("period"))) * 0.02))
    usable = yes(F.col("source") == "candidate-data") & F.col("rotation_period").isNotNull()
    out = evidence_row(x.withColumn("_alias", alias), "activity", F.when(usable, REVIEW).otherwise(BLOCKED), F.col("rotation_period"))
    return out.join(x.select("target_id", (alias & usable).alias("transit_alias")), "target_id")


def evidence_dilution(dil: DataFrame) -> DataFrame:
    c = F.col
    sound = (yes(c("source") == "candidate-data") & yes(c("availability") == "available") & yes(c("contamination") >= 0) & yes(c("variation") >= 0)
             & yes(c("verdict").isin("stable", "aperture-sensitive")))
    return evidence_row(dil, "dilution", F.when(~sound, BLOCKED).when(c("verdict") == "stable", PASS).otherwise(REVIEW), c("contamination"))


def triage(targets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Worst status over the five diagnostics of every target; a missing one blocks."""
    rank = F.when(F.col("status") == PASS, 0).when(F.col("status") == REVIEW, 1).otherwise(2)
    s = evidence.where(F.col("diagnostic").isin(*DIAGNOSTICS)).groupBy("target_id").agg(F.max(rank).alias("_worst"), F.countDistinct("diagnostic").alias("_n"))
    x = targets.select("target_id").distinct().join(s, "target_id", "left")
    worst = F.when(F.coalesce(F.col("_n"), F.lit(0)) < len(DIAGNOSTICS), 2).otherwise(F.col("_worst"))
    return x.select("target_id", F.coalesce(F.col("_n"), F.lit(0)).alias("diagnostics"), F.element_at(F.array(F.lit(PASS), F.lit(REVIEW), F.lit(BLOCKED)), (worst + 1).cast("int")).alias("triage"))


# Outputs that must exist before the false-positive run.
REQUIRED_OUTPUTS = ("search", "search manifest", "screen", "archive", "localization", "activity", "asteroseismology", "SED", "dilution", "transit fit", "timing", "phase curve")


def readiness(targets: DataFrame, artifacts: DataFrame, rejections: DataFrame, required: Sequence[str] = REQUIRED_OUTPUTS) -> DataFrame:
    """Missing required outputs per target; a bound detection and no decisive rejection are needed too."""
    have = artifacts.where(F.col("role").isin(*required)).groupBy("target_id").agg(F.collect_set("role").alias("_have"))  # at most len(required) roles
    no = rejections.select("target_id").distinct().withColumn("_no", F.lit(True))
    x = targets.select("target_id", "detection_bound").join(have, "target_id", "left").join(no, "target_id", "left")
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce("_have", F.array().cast("array<string>")))
    status = F.when(yes(F.col("_no")), "decisive-rejection").when(F.size(missing) > 0, "missing-prerequisites").when(~yes(F.col("detection_bound")), "no-bound-detection").otherwise("ready")
    return x.select("target_id", F.array_join(missing, ",").alias("missing"), F.size(missing).alias("n_missing"), status.alias("readiness"))


def route_survey(targets: DataFrame, novelty: DataFrame, verdicts: DataFrame, exclusions: DataFrame, review_snr: float) -> DataFrame:
    """One outcome for every registered target."""
    out = exclusions.select("target_id").distinct().withColumn("_out", F.lit(True))
    x = targets.select("target_id").distinct().join(out, "target_id", "left").join(novelty.select("target_id", "novelty"), "target_id", "left").join(
        verdicts.select("target_id", "snr", "passed"), "target_id", "left")
    alert = yes(F.col("snr") >= review_snr) & yes(F.col("passed"))
    return x.select("target_id", F.when(yes(F.col("_out")), "excluded-before-search").when(~yes(F.col("novelty") == "eligible"), "blocked-novelty").when(alert, "alert-for-human-review")
                    .otherwise("searched-no-alert").alias("outcome"))


def register_targets(survey: DataFrame, targets: DataFrame, mission: str) -> tuple[DataFrame, DataFrame]:
    """Accept targets of the mission with an id, no known signal and not yet registered."""
    there = survey.select("target_id").distinct().withColumn("_there", F.lit(True))
    x = targets.join(there, "target_id", "left")
    reason = (F.when(~yes(F.col("mission") == mission), "mission mismatch").when(F.coalesce(F.trim("tic"), F.lit("")) == "", "missing identifier")
              .when(F.coalesce(F.trim("toi"), F.lit("")) != "", "known signal").when(yes(F.col("_there")), "already registered"))
    x = x.withColumn("reason", reason).drop("_there")
    return x.where(F.col("reason").isNull()).drop("reason"), x.where(F.col("reason").isNotNull())


def hash_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size, modification time and SHA-256 of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))


def verify_provenance(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Compare content hashes with sidecars: ok, missing file or sidecar, invalid or stale sidecar."""
    s = sidecars.select("path", F.col("sha256").alias("recorded"), "source_uri", "downloaded_at", F.lit(True).alias("_s"))
    x = files.select("path", "sha256", F.lit(True).alias("_f")).join(s, "path", "full")
    valid = yes(F.col("recorded").rlike("^[0-9a-f]{64}$")) & yes(F.length(F.trim("source_uri")) > 0) & F.col("downloaded_at").isNotNull()
    return x.select("path", F.when(F.col("_f").isNull(), "missing-file").when(F.col("_s").isNull(), "missing-sidecar").when(~valid, "invalid-sidecar")
                    .when(F.col("recorded") != F.col("sha256"), "hash-mismatch").otherwise("ok").alias("provenance"))


def verify_release(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Problems of a release inventory: unsafe or repeated paths, missing files, size or hash differences."""
    m = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("_c"), F.min("size").alias("m_size"), F.min("sha256").alias("m_hash"))
    f = files.select("path", F.col("size").alias("f_size"), F.col("sha256").alias("f_hash"), F.lit(True).alias("_f"))
    x = m.join(f, "path", "full")
    unsafe = F.col("path").startswith("/") | F.col("path").contains("\\") | F.exists(F.split("path", "/"), lambda p: p.isin("..", ".", ""))
    why = (F.when(unsafe, "unsafe path").when(F.col("_c") > 1, "repeated path").when(F.col("_f").isNull(), "missing file").when(F.col("_c").isNull(), "undeclared file")
           .when(F.col("m_size") != F.col("f_size"), "size mismatch").when(F.col("m_hash") != F.col("f_hash"), "hash mismatch"))
    return x.withColumn("problem", why).where(F.col("problem").isNotNull()).select("path", "problem")


def validate_records(df: DataFrame, rules: Sequence[Mapping], payload: str = "payload") -> DataFrame:
    """Violations of declared rules, one row per (record, rule).

    A rule has ``field`` and any of ``required``, ``enum``, ``pattern``, ``minimum``, ``maximum``.
    """
    text = {r["field"]: F.get_json_object(payload, f"$.{r['field']}") for r in rules}
    x = df.withColumn("_ok", F.try_parse_json(payload).isNotNull())
    found = [F.when(~F.col("_ok"), F.struct(F.lit("$").alias("field"), F.lit("malformed").alias("rule")))]
    for r in rules:
        v = text[r["field"]]
        number = v.try_cast("double")
        checks = []
        if r.get("required"):
            checks.append(("required", v.isNull()))
        if "enum" in r:
            checks.append(("enum", ~v.isin(*r["enum"])))
        if "pattern" in r:
            checks.append(("pattern", ~v.rlike(r["pattern"])))
        if "minimum" in r:
            checks.append(("minimum", number.isNull() & v.isNotNull() | (number < r["minimum"])))
        if "maximum" in r:
            checks.append(("maximum", number > r["maximum"]))
        found += [F.when(F.col("_ok") & yes(bad), F.struct(F.lit(r["field"]).alias("field"), F.lit(rule).alias("rule"))) for rule, bad in checks]
    return x.select("record_id", F.explode(F.array_compact(F.array(*found))).alias("v")).select("record_id", "v.*")


def validate_references(checks: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows whose key has no counterpart: name -> (referring rows with ``record_id``, referred rows, keys)."""
    parts = [rows.join(other.select(*keys).distinct(), list(keys), "left_anti").select("record_id", F.lit(name).alias("rule")) for name, (rows, other, keys) in checks.items()]
    return reduce(DataFrame.unionByName, parts)


# Catalog identifiers in running text (no look-behind, so the engine can scan in linear time).
WORD_MAP = 1024  # 64-bit words of the bitmap of alias tokens
ID_PATTERN = r"(?i)(^|[^A-Za-z0-9])(TOI[\s._-]*\d{1,7}(\.\d{1,2})?|TIC[\s._:-]*\d{5,12}|(TOI|TIC)\d{4,})([^A-Za-z0-9]|$)"


def scan_text(lines: DataFrame, aliases: DataFrame, exceptions: DataFrame, today: str) -> DataFrame:
    """Identifier and alias leaks in text lines, minus exceptions that have not expired.

    ``lines`` has ``path, line_number, line``. An alias of at least four letters and digits matches without
    case, as written (token by token, whatever separates them) or in compact form as one token.
    """
    ids = lines.where(F.col("line").rlike(ID_PATTERN)).select("path", "line_number", F.lit("target-id").alias("finding"))
    tokens = lambda c: F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")
    names = aliases.select(tokens("alias").alias("_a")).where((F.size("_a") > 0) & (F.length(F.array_join("_a", "")) >= 4))
    names = names.select(F.explode(F.array("_a", F.array(F.array_join("_a", "")))).alias("_a")).distinct().select(F.col("_a")[0].alias("word"), "_a")
    # a bitmap of the aliases' first two tokens (or the only one) and the longest alias ride along as one value; only
    # tokens that may start an alias become rows, with the few tokens that follow
    place = lambda *w: F.pmod(F.xxhash64(*w), F.lit(64 * WORD_MAP)).cast("int")
    start = F.when(F.size("_a") > 1, place("word", F.get("_a", F.lit(1)))).otherwise(place("word"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), start.bitwiseAND(63))
    parts = names.groupBy(F.shiftright(start, 6).alias("k")).agg(F.bit_or(bit).alias("bits"), F.max(F.size("_a")).alias("longest"))
    entries = parts.agg(F.map_from_entries(F.collect_list(F.struct("k", "bits"))).alias("m"), F.coalesce(F.max("longest"), F.lit(1)).alias("longest"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(WORD_MAP - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    known = entries.select(F.struct(filled.alias("bits"), "longest").alias("known")).scalar()
    texts = lines.select("path", "line_number", tokens("line").alias("_t"), known.alias("_k"))
    hit = lambda p: F.getbit(F.get(F.col("_k.bits"), F.shiftright(p, 6)), p.bitwiseAND(63)) == 1
    starts = F.transform("_t", lambda w, i: F.struct(place(w).alias("one"), place(w, F.get("_t", i + 1)).alias("two")))
    runs = F.transform(starts, lambda p, i: F.when(hit(p["one"]) | hit(p["two"]), F.slice("_t", i + 1, F.col("_k.longest"))))
    # the outer form, as the inner one would have every list computed twice
    words = texts.select("path", "line_number", F.explode_outer(F.array_compact(runs)).alias("_w")).where(F.col("_w").isNotNull()).withColumn("word", F.col("_w")[0])
    named = attach(words, names, ["word"], spread=["path", "line_number"]).where(F.slice("_w", F.lit(1), F.size("_a")) == F.col("_a"))
    hits = ids.unionByName(named.select("path", "line_number", F.lit("alias").alias("finding")).distinct())
    live = exceptions.where(F.col("expires") >= F.lit(today).cast("date")).select("path", "line_number", "finding").distinct()
    return hits.join(live, ["path", "line_number", "finding"], "left_anti").select("path", "line_number", "finding")


PHASES = ("intake", "feasibility", "acquisition", "vetting", "followup", "analysis", "review")  # fixed values from here on
DOCUMENT_PHASES = ("intake", "feasibility", "vetting", "followup", "review")
NOVELTY_PHASES = ("feasibility", "review")


def gate_errors(targets: DataFrame, checklists: DataFrame, novelty: DataFrame, provenance: DataFrame) -> DataFrame:
    """What keeps each target from leaving its phase, one row per error.

    ``targets``: ``target_id, phase, state``; ``checklists``: progress per (target, phase) with the
    names of the ``unchecked`` mandatory items, each of which is an error of its own;
    the analysis phase always stops, because no calibrated false-positive claim exists.
    """
    audit = novelty.where("valid").select("target_id").distinct().withColumn("_novel", F.lit(True))
    files = provenance.groupBy("target_id").agg(F.bool_and(F.col("provenance") == "ok").alias("_files"))
    c = checklists.select("target_id", "phase", "mandatory", "unchecked", F.lit(True).alias("_list"))
    x = targets.join(c, ["target_id", "phase"], "left").join(audit, "target_id", "left").join(files, "target_id", "left")
    phase, listed = F.col("phase"), F.col("phase").isin(*DOCUMENT_PHASES)
    rules = [
        (F.col("state") == "stopped", "lifecycle stopped"), (listed & F.col("_list").isNull(), "missing gate document"),
        (listed & (F.col("mandatory") == 0), "no mandatory items"),
        (phase.isin(*NOVELTY_PHASES) & F.col("_novel").isNull(), "no valid novelty audit"), ((phase == "acquisition") & ~yes(F.col("_files")), "provenance not verified"),
        (phase == "analysis", "no calibrated false-positive claim"), ((phase == "review") & F.col("state").isin("published", "archived"), "already locked")]
    found = F.array_compact(F.array(*[F.when(yes(bad), F.lit(text)) for bad, text in rules]))
    items = F.when(listed & F.col("unchecked").isNotNull(), F.transform("unchecked", lambda i: F.concat(F.lit("unchecked mandatory item: "), i))).otherwise(F.array().cast("array<string>"))
    return x.select("target_id", F.explode(F.concat(found, items)).alias("error"))


def semantic_hash(df: DataFrame, volatile: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Content fingerprint of each row that ignores volatile columns and column order."""
    stable = sorted(c for c in df.columns if c not in volatile and c not in keep)
    return df.select(*keep, F.sha2(F.to_json(F.struct(*stable)), 256).alias("fingerprint"))


def incremental_hash(files: DataFrame, cache: DataFrame, content: DataFrame) -> DataFrame:
    """Reuse the stored digest where size and time match; hash content only for the misses."""
    known = cache.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_t"), F.col("sha256").alias("_h"))
    x = files.select("path", "size", "mtime").join(known, "path", "left")
    hit = yes((F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_t")))
    reused = x.where(hit).select("path", F.col("_h").alias("sha256"), F.lit(True).alias("reused"))
    missed = content.join(x.where(~hit).select("path"), "path", "left_semi").select("path", F.sha2("content", 256).alias("sha256"), F.lit(False).alias("reused"))
    return reused.unionByName(missed)


def to_refresh(retrievals: DataFrame, now: str) -> DataFrame:
    """Providers whose newest retrieval has expired or carries no valid expiry."""
    newest = retrievals.groupBy("target_id", "provider").agg(F.max_by(F.struct("retrieval_id", "expires_at"), F.struct("retrieved_at", "retrieval_id")).alias("b"))
    x = newest.select("target_id", "provider", "b.*")
    reason = F.when(F.col("expires_at").isNull(), "invalid expiry").when(F.col("expires_at") <= F.lit(now).cast("timestamp"), "expired")
    return x.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("target_id", "provider", "retrieval_id", "reason")


def bound_detections(results: DataFrame, manifests: DataFrame, artifacts: DataFrame, eph: DataFrame, min_snr: float = 7.1) -> DataFrame:
    """Results that still agree with their manifest, its input hashes and the derived ephemeris.

    ``manifests`` carries ``inputs array<struct<path, sha256>>``.
    """
    now = artifacts.select("path", F.col("sha256").alias("_now"))
    inputs = manifests.select("result_id", F.explode_outer("inputs").alias("i")).select("result_id", F.col("i.path").alias("path"), F.col("i.sha256").alias("_was"))
    same = inputs.join(now, "path", "left").groupBy("result_id").agg(F.bool_and(yes(F.col("_was") == F.col("_now"))).alias("_inputs"))
    m = manifests.select("result_id", F.col("target_id").alias("m_target"), F.col("result_sha256").alias("m_sha"), F.col("period_min").alias("m_pmin"), F.col("engine").alias("m_engine"))
    e = eph.select("target_id", F.col("period").alias("e_period"), F.col("epoch").alias("e_epoch"))
    x = results.join(m, "result_id", "left").join(same, "result_id", "left").join(e, "target_id", "left")
    reason = (F.when(F.col("m_target").isNull(), "manifest missing").when(F.col("m_target") != F.col("target_id"), "owner mismatch").when(~yes(F.col("m_sha") == F.col("sha256")), "result hash mismatch")
              .when(~yes(F.col("m_engine") == F.col("engine")) | ~close(F.col("m_pmin"), F.col("period_min"), 1e-12), "configuration mismatch").when(~yes(F.col("_inputs")), "input hash mismatch")
              .when(~yes(F.col("status") == "detected") | ~yes(F.col("snr") >= min_snr) | ~yes(F.col("n_events") >= 2), "below thresholds")
              .when(~close(F.col("period"), F.col("e_period"), 1e-12) | ~close(F.col("epoch"), F.col("e_epoch"), 1e-12), "ephemeris mismatch"))
    return x.select("result_id", "target_id", reason.alias("reason"), reason.isNull().alias("bound"))


def novelty_valid(audits: DataFrame, evidence: DataFrame, artifacts: DataFrame, providers: Sequence[str], now: str) -> DataFrame:
    """First reason an audit is not usable; NULL if it is.

    ``audits``: ``audit_id, target_id, owner_id, schema_version, status, retrieved_at, expires_at``;
    ``evidence``: one row per response with ``audit_id, provider, source_uri, expected_uri, path,
    sha256, retrieval_id, retrieved_at``.
    """
    a = artifacts.select("path", F.col("sha256").alias("_now"))
    e = evidence.join(a, "path", "left").join(audits.select("audit_id", F.col("retrieved_at").alias("_at")), "audit_id")
    s = e.groupBy("audit_id").agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct(F.when(F.col("provider").isin(*providers), F.col("provider"))).alias("_p"), F.countDistinct("retrieval_id").alias("_r"), F.countDistinct("path").alias("_d"),
        F.bool_and(yes(F.col("source_uri") == F.col("expected_uri"))).alias("_uri"), F.bool_and(yes(F.col("sha256") == F.col("_now"))).alias("_hash"), F.bool_and(yes(F.col("retrieved_at") == F.col("_at"))).alias("_time"))
    x = audits.join(s, "audit_id", "left")
    at, k = F.lit(now).cast("timestamp"), len(providers)
    reason = (F.when(~yes(F.col("owner_id") == F.col("target_id")), "owner mismatch").when(~yes(F.col("status") == "eligible"), "status not eligible")
              .when(F.col("retrieved_at").isNull() | F.col("expires_at").isNull(), "invalid timestamp").when(F.col("retrieved_at") > at, "retrieval in the future")
              .when(F.col("expires_at") <= F.col("retrieved_at"), "expiry before retrieval").when(F.col("expires_at") <= at, "stale").when(~yes(F.col("schema_version") == 2), "schema version")
              .when(~yes(F.col("_n") == k) | ~yes(F.col("_p") == k), "needs one response per registry").when(~F.col("_uri"), "not the canonical query").when(~F.col("_hash"), "response missing or changed")
              .when(~F.col("_time"), "retrieval time mismatch").when((F.col("_d") != k) | (F.col("_r") != 1), "responses not from one retrieval"))
    return x.select("audit_id", "target_id", reason.alias("reason"), reason.isNull().alias("valid"))


def run_report(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "engine", "status", F.size("inputs").alias("n_inputs"), F.size("outputs").alias("n_outputs"))


def lineage(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """Earliest successful run that recorded each artifact's exact hash."""
    out = runs.where(F.col("status") == "success").select("run_id", F.explode("outputs").alias("o")).select("run_id", F.col("o.path").alias("path"), F.col("o.sha256").alias("sha256"))
    first = out.groupBy("path", "sha256").agg(F.min("run_id").alias("run_id"))
    return artifacts.select("path", "sha256").join(first, ["path", "sha256"], "left")


# Payload file types and the directories that are not audited.
PAYLOAD_TYPES = ("fits", "fit", "fz", "csv", "tsv", "parquet", "npy", "npz", "h5", "hdf5", "pkl", "joblib", "pdf", "tex", "zip", "tar", "gz", "ipynb", "png", "jpg", "jpeg", "log")
SKIPPED = (".git", "__pycache__", ".pytest_cache")


def scan_layout(files: DataFrame, exceptions: DataFrame, allowed: str = "candidate", forbidden: Sequence[str] = ("archive", "data")) -> DataFrame:
    """Forbidden top-level directories and payload files outside the allowed tree."""
    parts = F.split("path", "/")
    top = F.when(F.size(parts) > 1, parts[0])
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    skipped = F.exists(parts, lambda p: p.isin(*SKIPPED))
    finding = F.when(top.isin(*forbidden), "forbidden-directory").when(kind.isin(*PAYLOAD_TYPES), "payload-outside-tree")
    x = files.where(~skipped & ~yes(top == allowed)).select("path", finding.alias("finding")).where(F.col("finding").isNotNull())
    return x.join(exceptions.select("path").distinct(), "path", "left_anti")

"""Record sources, contracts and sinks (IDs A7-A16)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.operators.spread import attach

# Accepted column names per event-release field, first finite value wins.
TCE_ALIASES = {
    "snr": ("snr", "tce_snr", "mes", "tce_mes", "tce_model_snr"),
    "period": ("period", "period_days", "tce_period", "tcet_period"),
    "depth_ppm": ("depth_ppm", "depth", "tce_depth_ppm", "tce_depth", "tcet_depth"),
    "planet_radius": ("planet_radius_earth", "planet_radius", "planet_radius_rearth", "tce_prad", "prad"),
    "stellar_radius": ("stellar_radius_solar", "stellar_radius", "rstar", "tce_sradius", "tce_srad"),
    "tmag": ("tmag", "tessmag", "tess_mag", "tce_tmag"),
}
TIC_ALIASES = ("tic_id", "tic", "ticid", "target_id")


def finite_number(c: Column) -> Column:
    """Text to a finite double, else NULL."""
    v = F.expr("try_cast(NULL AS DOUBLE)") if c is None else F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def by_alias(df: DataFrame, names: Sequence[str]) -> Column:
    """First finite value among the alias columns the table has, names compared without case."""
    have = {c.strip().lower(): c for c in df.columns}
    found = [finite_number(F.col(f"`{have[n]}`")) for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def normalize_tce(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed event rows from a string table with any of the known column names."""
    have = {c.strip().lower(): c for c in df.columns}
    ids = [F.trim(F.regexp_replace(F.trim(F.col(f"`{have[n]}`").cast("string")), "TIC", "")) for n in TIC_ALIASES if n in have]
    tic = F.coalesce(*[F.when(i.rlike("^[1-9][0-9]{0,19}$"), i) for i in ids]) if ids else F.lit(None).cast("string")
    return df.select(*keep, tic.alias("tic"), *[by_alias(df, names).alias(out) for out, names in TCE_ALIASES.items()])


def read_tce(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV release: ``#`` lines and blank lines skipped, every column read as text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return normalize_tce(spark.read.schema(schema).option("header", "true").option("comment", "#").option("enforceSchema", "false").csv(path))


ROWS = "array<map<string,string>>"
ENVELOPE = f"data {ROWS}, rows {ROWS}, results {ROWS}"
NONFINITE = r"[:\[,]\s*-?(NaN|Infinity)\b"


def parse_catalog_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per record of a JSON payload: a list, or ``data`` / ``rows`` / ``results`` of an object."""
    text = F.trim(F.col(payload))
    listed = F.from_json(text, ROWS)
    boxed = F.from_json(text, ENVELOPE)
    rows = F.when(text.startswith("["), listed).otherwise(F.coalesce(boxed["data"], boxed["rows"], boxed["results"]))
    error = (F.when(F.col(payload).isNull() | (text == ""), None).when(text.rlike(NONFINITE), "non-finite number")
             .when(~text.startswith("[") & ~text.startswith("{"), "neither an object nor an array").when(F.try_parse_json(text).isNull(), "malformed JSON"))
    x = df.withColumn("parse_error", error).withColumn("_rows", F.when(F.col("parse_error").isNull(), rows))
    return x.select(*[c for c in df.columns if c != payload], "parse_error", F.posexplode_outer("_rows").alias("record_index", "record"))


def read_catalog(spark: SparkSession, path: str, fmt: str, columns: Sequence[str] = ()) -> DataFrame:
    """Catalog records as string maps from CSV files or whole-file JSON payloads."""
    if fmt == "csv":
        schema = ", ".join(f"`{c}` string" for c in columns)
        rows = spark.read.schema(schema).option("header", "true").csv(path)
        pairs = [v for c in columns for v in (F.lit(c), F.col(f"`{c}`"))]
        return rows.select(F.input_file_name().alias("path"), F.create_map(*pairs).alias("record"))
    if fmt == "json":
        return parse_catalog_json(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload")))
    raise ValueError("fmt must be 'csv' or 'json'")


# Columns a known-signal snapshot must have.
CONTRACTS = {
    "nasa-exoplanet-archive": ("pl_orbper", "pl_tranmid", "pl_trandur", "pl_tranmid_systemref"),
    "nasa-exoplanet-archive-toi": ("toi", "tid", "pl_orbper", "pl_tranmid", "pl_trandurh"),
}


def check_contract(records: DataFrame, contracts: Mapping[str, Sequence[str]] = CONTRACTS) -> DataFrame:
    """Missing required columns of each retrieval's first record; any makes it unavailable."""
    first = records.groupBy("retrieval_id", "provider").agg(F.min_by("record", "record_index").alias("record"))
    need = F.create_map(*[v for p, cols in contracts.items() for v in (F.lit(p), F.array(*[F.lit(c) for c in cols]))])
    have = F.transform(F.map_keys("record"), lambda k: F.lower(k))
    missing = F.array_except(F.coalesce(F.try_element_at(need, F.col("provider")), F.array().cast("array<string>")), have)
    return first.select("retrieval_id", "provider", F.array_join(missing, ", ").alias("missing"),
                        F.when(F.size(missing) > 0, "unavailable").otherwise("ok").alias("contract_status"))


def normalize_priors(toi: DataFrame) -> DataFrame:
    """Typed prior signals; the first row per (target, suffix) wins, the rest keep a reason.

    ``toi`` has ``target_id, row_number, toi, period, epoch, depth, duration`` as text.
    """
    text = F.trim(F.coalesce("toi", F.lit("")))
    tail = F.regexp_extract(text, r"\.(\d+)$", 1)
    suffix = F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(".01")
    number = lambda c: F.trim(F.col(c)).try_cast("double")
    x = toi.withColumn("signal_suffix", suffix).withColumns({f"_{c}": number(c) for c in ("period", "epoch", "depth", "duration")})
    bad = F.when(F.col("_period").isNull() | F.col("_epoch").isNull() | F.col("_depth").isNull() | F.col("_duration").isNull(), "non-numeric transit field").when(
        F.col("_period") <= 0, "non-positive orbital period")
    x = x.withColumn("_bad", bad)
    first = x.where(F.col("_bad").isNull()).groupBy("target_id", "signal_suffix").agg(F.min("row_number").alias("_first"))
    y = attach(x, first, ["target_id", "signal_suffix"], "left", spread=["row_number"])
    reason = F.coalesce("_bad", F.when(F.col("row_number") != F.col("_first"), F.lit("duplicate signal suffix")))
    epoch = F.when(F.col("_epoch") > 2450000.0, F.col("_epoch") - 2457000.0).otherwise(F.col("_epoch"))
    good = lambda v, d: F.when(F.col("reason").isNull(), F.round(v, d))
    return y.withColumn("reason", reason).select(
        "target_id", "row_number", "signal_suffix", good(F.col("_period"), 6).alias("period_days"), good(epoch, 5).alias("epoch_btjd"),
        good(F.col("_depth"), 2).alias("depth_ppm"), good(F.col("_duration"), 2).alias("duration_hours"), "reason")


# Accepted names per stellar parameter.
STAR_ALIASES = {
    "ra_deg": ("ra_deg", "ra", "right_ascension"), "dec_deg": ("dec_deg", "dec", "declination"), "teff_k": ("teff_k", "teff", "temperature_k"),
    "teff_k_err": ("teff_k_err", "teff_err_k", "teff_error_k", "teff_uncertainty_k"), "logg_cgs": ("logg_cgs", "logg", "log_g"), "feh": ("feh", "metallicity"),
    "mass_solar": ("mass_solar", "mass_msun", "mass"), "mass_solar_err": ("mass_solar_err", "mass_msun_err", "mass_err", "mass_error"),
    "radius_solar": ("radius_solar", "radius_rsun", "radius"), "radius_solar_err": ("radius_solar_err", "radius_rsun_err", "radius_err", "radius_error"),
    "parallax_mas": ("parallax_mas", "parallax", "plx"), "parallax_mas_err": ("parallax_mas_err", "parallax_err", "parallax_error", "plx_error"),
}
PHYSICS = ("teff_k", "logg_cgs", "feh", "mass_solar", "radius_solar")  # these decide completeness


def read_stars(df: DataFrame, required: Sequence[str] = PHYSICS) -> DataFrame:
    """Stellar parameters through their aliases and how complete they are."""
    x = df.select("target_id", *[by_alias(df, names).alias(out) for out, names in STAR_ALIASES.items()])
    have = sum((F.col(c).isNotNull().cast("int") for c in required[1:]), F.col(required[0]).isNotNull().cast("int"))
    return x.withColumn("completeness", F.when(have == len(required), "candidate-data").when(have > 0, "partial-candidate-data").otherwise("none"))


def explode_photometry(df: DataFrame, payload: str = "photometry") -> DataFrame:
    """Band rows from nested ``{catalog: {band: {mag, error}}}`` JSON, error in quadrature with 0.05."""
    nested = F.from_json(payload, "map<string,map<string,struct<mag:double,error:double>>>")
    x = df.select("target_id", F.explode(nested).alias("catalog", "_b")).select("target_id", "catalog", F.explode("_b").alias("band", "_m"))
    x = x.select("target_id", "catalog", "band", F.col("_m.mag").alias("mag"), F.col("_m.error").alias("err")).where(F.col("mag").isNotNull() & F.col("err").isNotNull())
    return x.withColumn("total_err", F.sqrt(F.col("err") * F.col("err") + 0.05 * 0.05))


def read_rv(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat valid observations and rejected ones; activity is kept only if the whole set has it in one unit.

    Columns: ``target_id, instrument, observation_time, velocity, uncertainty`` and
    ``activity`` as ``{value, unit}`` structs.
    """
    fine = lambda c: F.col(c)["value"].isNotNull() & ~F.isnan(F.col(c)["value"]) & (F.abs(F.col(c)["value"]) < float("inf"))
    reason = (F.when(F.trim(F.coalesce("instrument", F.lit(""))) == "", "missing instrument")
              .when(~F.coalesce(F.col("observation_time.unit") == "BJD_TDB", F.lit(False)) | ~F.coalesce(F.col("velocity.unit") == "m/s", F.lit(False))
                    | ~F.coalesce(F.col("uncertainty.unit") == "m/s", F.lit(False)), "unsupported unit")
              .when(~(fine("observation_time") & fine("velocity") & fine("uncertainty")), "non-finite value").when(F.col("uncertainty.value") <= 0, "non-positive uncertainty"))
    x = df.withColumn("reason", reason).withColumn("t", F.col("observation_time.value"))
    twice = x.where(F.col("reason").isNull()).groupBy("target_id", "instrument", "t").count().where("count > 1").select("target_id", "instrument", "t", F.lit(True).alias("_twice"))
    x = x.join(twice, ["target_id", "instrument", "t"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_twice"), F.lit("duplicate observation")))).drop("_twice")
    valid = x.where(F.col("reason").isNull())
    act = valid.groupBy("target_id").agg(F.bool_and(fine("activity")).alias("_all"), F.min("activity.unit").alias("_u0"), F.max("activity.unit").alias("_u1"), F.count("activity.value").alias("_c"))
    use = act.select("target_id", (F.coalesce(F.col("_all"), F.lit(False)) & (F.col("_u0") == F.col("_u1"))).alias("_use"), (F.col("_c") > 0).alias("_some"))
    y = attach(valid, use, ["target_id"], spread=["t"])
    out = y.select("target_id", "instrument", "t", F.col("velocity.value").alias("velocity"), F.col("uncertainty.value").alias("sigma"),
                   F.when(F.col("_use"), F.col("activity.value")).alias("activity"), F.when(F.col("_use"), "used").when(F.col("_some"), "incomplete").otherwise("absent").alias("activity_status"))
    return out, x.where(F.col("reason").isNotNull())


def append_run(df: DataFrame, path: str, run_id: str, keys: Sequence[str]) -> DataFrame:
    """Append rows whose key is not stored yet, under a run id; earlier runs are never rewritten.

    Returns the rows that were appended.
    """
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    # of rows with one key the smallest by content stays, whatever partitions they come in
    rest = [c for c in df.columns if c not in keys]
    fresh = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_row")).select(*keys, "_row.*") if rest else df.distinct()
    if exists:
        fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    fresh.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


EVENT_SCHEMA = "event string, target_id string, state string, reason string, at string"


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


EVIDENCE_KINDS = ("eclipsing-binary-catalog", "variable-star-catalog", "exofop", "literature")  # fixed values


def append_evidence(df: DataFrame, registry: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected evidence rows; an id already in the registry or seen earlier is rejected."""
    at = F.lit(now).cast("timestamp")
    x = df.withColumn("record_id", F.lower(F.trim("record_id")))
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    reason = (F.when(~F.coalesce(F.col("record_id").rlike("^[a-z0-9][a-z0-9._-]*$"), F.lit(False)), "invalid record id")
              .when(~F.coalesce(F.col("source_kind").isin(*EVIDENCE_KINDS), F.lit(False)), "unsupported source kind").when(F.trim(F.coalesce("source_name", F.lit(""))) == "", "empty source name")
              .when(~F.coalesce(F.col("source_uri").startswith("https://"), F.lit(False)), "source must use HTTPS")
              .when(~ok("period") | ~ok("epoch") | ~ok("duration_hours") | (F.col("period") <= 0) | (F.col("duration_hours") <= 0), "values must be finite and positive")
              .when(F.col("retrieved_at").isNull() | F.col("expires_at").isNull() | (F.col("retrieved_at") > at) | (F.col("expires_at") <= F.col("retrieved_at")), "timestamps not ordered"))
    x = x.withColumn("reason", reason)
    known = registry.select("target_id", "record_id").distinct().withColumn("_known", F.lit(True))
    first = x.where(F.col("reason").isNull()).groupBy("target_id", "record_id").agg(F.min("row_number").alias("_first"))
    x = x.join(known, ["target_id", "record_id"], "left").join(first, ["target_id", "record_id"], "left")
    x = x.withColumn("reason", F.coalesce("reason", F.when(F.col("_known") | (F.col("row_number") != F.col("_first")), F.lit("record id already exists")))).drop("_known", "_first")
    return x.where(F.col("reason").isNull()).drop("reason"), x.where(F.col("reason").isNotNull())

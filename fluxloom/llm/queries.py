"""Queries over the whole tables, one per operator, and their check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fluxloom.llm import best_fit, chat, content_sort, dropout, fingerprints, language, licenses, ngram_join, phrases, spelling, tokens, training_order, urls, warc
from fluxloom.session import scratch_path, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return wrap


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query(
    "op9_exact_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
    ), r AS (
        SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
        FROM t
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
    """,
)
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return content_sort.mark_copies(_table(spark, folder, "documents"))


@_query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit.pack_documents(_table(spark, folder, "documents"), capacity=1024, end_id=2)


@_query("op10_license_scan")
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents"))


@_query("op2_language_id")
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


@_query(
    "op1_warc",
    r"""
    WITH t AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
    ), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM t)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
    FROM r
    """,
)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_groups(_table(spark, folder, "documents")).drop("th")


@_query("op3_chat_format")
def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("r")
    extra = spark.range(1).select(roles).select(F.lit(-7).alias("conv_id"), "r.turn", "r.role", F.lit("\\### Assistant: </turn> ok").alias("text"))
    extra = extra.select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields])
    return chat.digest(chat.read_windows(chat.format_windows(table.unionByName(extra))))


@_query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint(_table(spark, folder, "documents"))


@_query("op6_merge_dropout")
def op6_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    path = tokens.default_path("piece_bpe_32k.model")
    coded = dropout.encode(_table(spark, folder, "documents"), path, seed=17, drop=0.1)
    decoded = F.sha2(F.col("text").cast("binary"), 256)
    return dropout.decode(coded, path).select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("lossless"))


@_query("op7_training_order")
def op7_training_order(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "training-order")
    training_order.write_shards(_table(spark, folder, "documents"), path)
    return training_order.read_shards(spark, path).select("slot", "doc_id", "piece", "length", F.crc32("ids").alias("ids_crc32"))


@_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


@_query(
    "op11_phrase_mining",
    r"""
    WITH t AS (
        SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    ), p AS (
        SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
    ), w AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
    ), total AS (
        SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang
    ), f AS (
        SELECT lang, ph, count(*) AS f
        FROM (
            SELECT lang, unnest(list_transform(range(1, len(words) - m + 2), lambda k: words[k : k + m - 1])) AS ph
            FROM w, range(1, 6) AS r(m) WHERE len(words) >= m
        )
        GROUP BY lang, ph HAVING count(*) >= 100
    ), c AS (SELECT * FROM f WHERE len(ph) >= 2), around AS (
        SELECT lang, part, max(f) AS f
        FROM (SELECT lang, f, unnest(list_transform(range(1, len(ph) - m + 2), lambda k: ph[k : k + m - 1])) AS part FROM c, range(2, 5) AS r(m) WHERE len(ph) > m)
        GROUP BY lang, part
    ), kept AS (
        SELECT c.* FROM c LEFT JOIN around x ON x.lang = c.lang AND x.part = c.ph WHERE x.f IS NULL OR 100 * x.f < 100 * c.f
    ), cuts AS (
        SELECT kept.lang, kept.ph, kept.f AS a, k, x.f AS l, y.f AS r, n,
               (1000::HUGEINT * kept.f * n) // (x.f::HUGEINT * y.f) AS score
        FROM kept JOIN range(1, 5) AS q(k) ON k < len(ph) JOIN total ON total.lang = kept.lang
        JOIN f x ON x.lang = kept.lang AND x.ph = kept.ph[1 : k] JOIN f y ON y.lang = kept.lang AND y.ph = kept.ph[k + 1 : len(kept.ph)]
    ), best AS (
        SELECT *, array_to_string(ph, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM best QUALIFY rank <= 2000
    """,
)
def op11_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents")).drop("cut")


@_query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


@_query("op13_url_filter")
def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))

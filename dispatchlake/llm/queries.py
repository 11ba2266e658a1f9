"""The driver's queries of the corpus operators: thin calls that derive the digest columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import decontam, dedup, langid, licenses, mpegts, packing, phrases, pii, quality, repair, scoring, sharding, warc

THRESHOLD = 0.3  # of the quality score


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return C.prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_read(spark, sf_dir, "documents")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, back = warc.revisit_archives(_read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = quality.held_out(F.col("doc_id"))
    profiles = langid.learn(docs.filter(~held))
    out = langid.identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.learn(docs, _read(spark, sf_dir, "labels"))
    scored = quality.score(docs, trees).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = C.store(mpegts.texts_to_media(_read(spark, sf_dir, "documents")), "media")
    return mpegts.media_features(media)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return scoring.score(_read(spark, sf_dir, "documents"), held)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    done = repair.repair(repair.damage(rows)).withColumnRenamed("conv_id", "conv")
    met = every.join(done, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    empty = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return met.fillna(empty)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_near_duplicates, op3_pii, op4_warc, op5_decontamination, op6_language_id, op7_licenses, op8_quality, op9_transport_streams, op10_sharding, op11_lm_scoring, op12_conversation_repair, op13_collocations)}
#: SQL for the rows of those operators that DuckDB can compute on whole tables.
ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM d)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 1000 AND page_id < original THEN original END AS refers_to
        FROM m""",
    "op13_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        ws AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] AS w FROM pieces),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM ws GROUP BY lang),
        slots AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
        f AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS p, count(*) AS f FROM slots GROUP BY ALL HAVING count(*) >= 30),
        cuts AS (SELECT lang, k, p, f AS a, unnest(range(1, k)) AS j FROM f WHERE k > 1),
        scored AS (
          SELECT c.lang, c.k, c.p, c.a, c.j, x.f AS l, y.f AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
          FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, c.j) JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, c.j + 1, c.k)),
        least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
        inner_slots AS (SELECT lang, p, f, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE k > m),
        longer AS (SELECT lang, list_slice(p, i, i + m - 1) AS p, max(f) AS most FROM inner_slots GROUP BY ALL),
        kept AS (SELECT s.*, array_to_string(s.p, ' ') AS phrase FROM least s LEFT JOIN longer g ON g.lang = s.lang AND g.p = s.p WHERE g.most IS NULL OR CAST(g.most AS HUGEINT) * 100 < CAST(s.a AS HUGEINT) * 80),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000""",
}

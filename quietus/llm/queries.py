"""The thin queries opN_* over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietus.llm import ann, langid, masked_lm, merkle, mixing, near_vectors, packing, secrets, simhash, spelling, toxicity, warc, wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> dict[str, str]:
    """The public vocabulary op10 packs with; where the installed package lacks it, the path must be given."""
    if importlib.util.find_spec("public_tokenizers") is None:
        raise RuntimeError("public_tokenizers is not installed: call packing.pack with a tokenizer path")
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op7_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("m_tokens").alias("n_tokens"), F.col("m_topic").alias("topic"), F.col("m_probability").alias("probability"), F.round("m_error", 6).alias("margin_error"), F.col("m_kept").alias("kept"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.of_documents(table(spark, sf_dir, "documents")).drop("digest")


def op9b_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.of_pages(table(spark, sf_dir, "pages")).drop("digest").withColumnRenamed("doc_id", "page_id")


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_secret_ownership": op3_secret_ownership,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_masked_pseudo_likelihood": op6_masked_pseudo_likelihood,
    "op7_one_bit_search": op7_one_bit_search,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op9b_language_id_pages": op9b_language_id_pages,
    "op10_harmonic_packing": op10_harmonic_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_html_extraction": op13_html_extraction,
}

#: Embeddings near-duplicates: links by exact cosine, components as the closure of the links.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a), r AS (SELECT a AS vec_id, min(b) AS b FROM c GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN r USING (vec_id)"""

#: WARC round trip: base32 from the hex of SHA-1, twenty bits (five hex digits, four letters) at a time.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last, list_transform(range(8), lambda i: ('0x' || substr(sha1(payload), 5 * i + 1, 5))::BIGINT) AS parts FROM p)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d"""

ORACLE_SQL: dict[str, str] = {"op4_embedding_near_dedup": OP4_SQL, "op5_warc_round_trip": OP5_SQL, "op8_mixing": mixing.oracle(), "op11_merkle_manifest": merkle.oracle(), "op12_spelling_variants": spelling.oracle()}

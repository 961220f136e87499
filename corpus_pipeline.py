"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

All stages take null values in any column, empty and very long texts, repeated rows and ids, empty tables, and further columns of any name, which they leave out; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietus.llm import langid, mixing, packing, queries, secrets, simhash
from quietus.session import scratch

#: Columns of ``documents``, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay, with it in ``lang``; those without letters, or with no clear language, go.

    A null or empty text has no letters and goes. Equal rows have one verdict. Ties between languages go to the more frequent one. Where no row declares a language, all rows stay as they are; an empty table stays empty.
    """
    return langid.keep_identified(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of smallest id: groups by close fingerprints, and by 0.8 or more of five-word shingles in common.

    Null and empty texts are one group. Of rows with equal id and text one stays; a row with a null id stays only if all of its group have none. An empty table stays empty.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; credentials that look live are masked, and n_chars follows.

    A null text stays null, with a null n_chars; equal rows are masked alike; overlapping spans share one mark; an empty table stays empty.
    """
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the calibrated probability of their source, language and topic.

    A null source or language is a value of its own. Texts without words weigh nothing and are dropped where their whole cell has none. Equal rows share their fate; a null id is drawn as an empty one; an empty table stays empty.
    Margins that contradict each other are raked as far as they go, with a warning.
    """
    return mixing.mix(docs).where("m_kept").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of sequences of 2048 ids.

    A null or empty text is its end mark alone; repeated rows are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs, **queries.tokenizer())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mix_sources), ("packing", pack)]

#: Language evidence, fingerprints and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{at}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs

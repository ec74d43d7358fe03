"""The corpus pipeline: language ID, quality rules, near-duplicate removal, PII, packing.

Each stage works on what the one before it kept, written as Parquet and read again. All but the last return the columns
of documents. A document goes if its language is undetermined or uncertain, if a quality rule of the current policy
rejects it, or if it isn't the first of its group of near duplicates; what is left is sanitised and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm import jaccard, langid, packing, pii, quality
from relspark.llm.common import stored
from relspark.llm.queries import tokenizer

#: A text whose words have a smaller mean probability, each of its own best language, is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words' languages are known with a confidence of ``LEAST_SCORE`` or more, in one language or several."""
    found = langid.identify(docs, langid.train(docs), keep=docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("confidence") >= LEAST_SCORE)).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy, whatever their length."""
    return quality.ledger(docs).where(quality.accepted()).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of least id (rows without an id are last), and of least hash of its
    text where ids repeat. Rows that repeat both are one; rows of different texts under one id are told apart."""
    place = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    text = F.when(F.col("text").isNull(), "-").otherwise(F.hex(F.xxhash64("text")))
    keyed = docs.withColumn("__key", F.concat(F.coalesce(place, F.lit("none")), F.lit(":"), text))
    first = jaccard.join(keyed, "__key").where("__key = component_id").select("__key").distinct()
    return keyed.join(first, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced."""
    return pii.sanitise(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=False)


STAGES = [("language", language), ("quality", rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

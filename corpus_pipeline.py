"""The corpus pipeline: toxic documents go, near-duplicates go, repeated passages go, secrets go, the rest is packed.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that the one before has kept.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import packing, secrets, simhash, substring, toxicity
from sievekit.llm.common import save

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents whose id and text are in verdicts (doc_id, digest).

    Rows repeated in id and text become one, that with the smallest language, source and length; texts that share an id are judged each by
    itself; a document without an id can't be judged and stays.
    """
    named = docs.filter("doc_id is not null").select(*COLUMNS, simhash.text_digest().alias("digest"))
    kept = named.join(verdicts.select("doc_id", "digest").distinct(), ["doc_id", "digest"], "left_semi")
    once = kept.groupBy("doc_id", "digest").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"), F.max("text").alias("text"))
    return once.select("doc_id", "text", "rest.*").union(docs.filter("doc_id is null").select(*COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.5 go; the model learns from the labels of the documents that are here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return toxicity.keep(docs, model, 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id."""
    found = simhash.near_duplicates(docs, digest=True)
    return _keep(docs, found.filter("doc_id = component_id"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that start in a document with a smaller id go; a text without such words stays as it is."""
    out = substring.remove_repeats(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    return out.select("doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by the name of its kind in brackets."""
    out = secrets.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, each with its sequence and its place there."""
    return packing.pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", drop_repeats),
    ("secrets", drop_secrets),
    ("packing", pack_sequences),
]

#: No SQL expresses a trained classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

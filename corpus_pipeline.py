"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage gets what its predecessor kept, as written and reread by the caller, and all but the last return the columns of documents.

Defined cases, for every stage: a null or empty text is a document like any other (it isn't toxic, has fingerprint zero, no personal data and no words; the mix takes none of it, so it isn't packed). A null doc_id, lang,
source or n_chars is kept; a null source is a source of its own. Very long texts are worked on whole. Rows that repeat a doc_id are documents each for themselves, until near-duplicates among them go; of
ties the smallest doc_id stays, then the first row. An empty table gives no rows at every stage. Columns beyond those of documents are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshfront.llm import mixing, packing, pii, simhash, toxicity
from meshfront.llm.queries import PII_KEY, public_tokenizer
from meshfront.plans.ship import ship
from meshfront.plans.storage import Scratch, drop_dir, fresh_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut; the classifier learns from the labels of documents that aren't held out."""
    ship(spark)
    return toxicity.reject_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    ship(spark)
    return simhash.keep_first(docs)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get pseudonyms; n_chars follows the new text."""
    out = pii.pseudonymize(docs, PII_KEY, counts=False)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizer())


STAGES = [("toxicity", reject_toxic), ("simhash", drop_near_duplicates), ("pii", pseudonymize), ("mixing", mix), ("packing", pack)]

#: SQL expresses neither the classifier nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. A stage's own files go when its result is written, and its input when the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, f"stage-{name}")
        with Scratch() as own:
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        own.drop()
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop_dir(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: language filter, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twigline.llm.common import scratch_path, stable_key, table
from twigline.llm.langid import predict_language, train_language_model
from twigline.llm.mixing import mixing_rates
from twigline.llm.packing import pack_documents
from twigline.llm.simhash import simhash_survivors, text_hash

#: Factors on the expected tokens of each domain: clean text is kept and slightly repeated, toxic text thinned out.
MIX_GAINS = {"good": 1.05, "low": 1.0, "toxic": 0.25}
#: Words that a packing worker remembers, and text it encodes at once: other stages have left theirs in the memory.
CACHE_WORDS, SLICE_BYTES = 50_000, 1_000_000
#: Only documents that are toxic with at least this probability may be taken less than once: clean ones stay.
MIX_THINNED = {"toxic": 0.9}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject; lang becomes the predicted language.

    Null texts and texts without a letter are rejected; null ids and repeated rows stay with the rest; if no document
    has a language to learn from, or there are none, nothing stays.
    """
    model = train_language_model(docs.filter(F.col("doc_id").isNotNull()))
    out = predict_language(docs, model).filter(~F.col("lang_rejected"))
    return out.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, nulls last, then the smallest text hash.

    Of rows equal in id and text, one stays.  Null and empty texts are one group; an empty table gives no rows.
    """
    # one key without nulls: the join's partitions and order serve the removal of repeats as well
    key = lambda i, h: F.concat_ws(":", F.coalesce(F.col(i).cast("string"), F.lit("")), F.coalesce(h, F.lit("")))
    first = simhash_survivors(docs).select(key("doc_id", F.col("text_hash")).alias("key"))
    rows = docs.select(key("doc_id", text_hash("text")).alias("key"), F.struct(*docs.columns).alias("row"))
    return rows.join(first, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: the whole part, and once more with the rest as probability.

    The rates meet the gains in expectation, or come as near as rates can that thin out surely toxic documents alone.
    Documents without words weigh nothing and have the rate of the labels' shares; equal ids share their draw; null ids
    too; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    rates = mixing_rates(rows, table(spark, sf_dir, "labels"), gains=MIX_GAINS, thinned=MIX_THINNED, keep=["doc_id", "row"])
    chance = F.shiftrightunsigned(stable_key("doc_id"), 11) / float(1 << 53)
    copies = F.floor(F.col("rate") + chance).cast("int")
    out = rates.select("row", copies.alias("copies")).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences of 2048 tokens; an empty text is its end id, no rows give none."""
    return pack_documents(docs, cache_words=CACHE_WORDS, slice_bytes=SLICE_BYTES)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", mixing),
    ("packing", packing),
]

#: The trained classifiers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

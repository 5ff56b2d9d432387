"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all documents it is given. All but the
last return the columns of ``documents``. Empty tables go through; null texts and texts
without a letter end at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import langid, linededup, mixing, neardup, packing
from tabulon.llm.shared import written

#: Least share of the likelihoods that the predicted language must have.
LEAST_SCORE = 0.5
#: Words of a shingle in the near-duplicate stage, as in op1_near_duplicates.
WIDTH = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach, with ``lang`` as predicted. The others go:
    no text, no letter, or no language likelier than all others together."""
    found = langid.identify(docs, langid.train(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those of which nothing but
    white space is left go."""
    found = linededup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | (F.col("n_lines") > F.col("n_removed"))
    return found.filter(left).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id."""
    gone = neardup.near_duplicates(docs, width=WIDTH).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its taken words by its size, rounded."""
    found = mixing.mix(docs)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return found.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), times)).alias("_nth")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near-duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: No SQL expresses the language model, the alignment or the tokens; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""The operators' registered queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import ann, langid, linededup, lm, mixing, neardup, packing, quality, tokenfile, warczip
from tabulon.llm.shared import crc32_of_id, new_dir, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % takes of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text; a third of the documents is never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc32_of_id(F.col("doc_id")) % 3 == 1
    model = langid.train(docs.filter(~held | held.isNull()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every text and whether it stands the rules."""
    return quality.judge(table(spark, sf_dir, "documents"))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens that hold all documents."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates on shingles of two words."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query("op10_line_dedup")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "words_removed", "text")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token-id files, read back."""
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


@query(
    "op6_web_archives",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
           CASE WHEN n >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id < head THEN head END AS refers_to
    FROM g
    """,
)
def op6_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ZIP-packaged WARC records, read back."""
    return warczip.round_trip(table(spark, sf_dir, "pages"), new_dir(spark, "packages"))


@query("op8_nearest_neighbours")
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each hundredth."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query("op5_lm_scores")
def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text; a fifth of the documents is never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", lm.held_out(F.col("doc_id")))
    model = lm.train(docs.filter(~F.col("held_out")))
    return lm.score(docs, model)

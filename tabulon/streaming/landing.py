"""Filings as they land: each accession number is parsed once, as a batch of its own.

The parsing is the batch pipeline; streaming only decides what is new. The checkpoint keeps
which files were seen, the store which documents are there, so a restart repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.functions import scalars as X
from tabulon.sources.store import Store

EVENTS = "accession string, cik long, form string, filing_date date, landed_at timestamp"


def arrivals(spark: SparkSession, path: str, delay: str = "7 days") -> DataFrame:
    """New rows of a folder of JSON lines (EVENTS), each accession number once.

    Spellings of one number are one. State older than ``delay`` behind the newest arrival is
    dropped, and so are rows that late.
    """
    rows = spark.readStream.schema(EVENTS).json(path)
    rows = rows.withColumn("key", X.fold_accession(F.col("accession"))).filter("key is not null")
    return rows.withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(["key"]).drop("key")


def counts(rows: DataFrame, window: str = "1 day") -> DataFrame:
    """Arrivals of each form in each window, when the watermark closes it."""
    return rows.groupBy(F.window("landed_at", window), "form").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "form", "n")


def parse_into(rows: DataFrame, make: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str) -> StreamingQuery:
    """Parse what arrives with ``make`` (filings to accession and document) into the store, once:
    a batch that is run again after a failure finds its documents there."""

    def batch(part: DataFrame, _: int) -> None:
        new = part.join(store.documents().select("accession"), "accession", "left_anti")
        if not new.isEmpty():
            store.put_documents(make(new))

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()

"""Binary files in shared storage: written by Spark's committer, read by ranges.

A task's rows become one file, each row its bytes and one newline byte, so formats written
this way must allow a newline after each of their parts. Spark commits whole files, so a task
that runs again or twice leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blobs(rows: DataFrame, path: str) -> None:
    """Write the binary column ``blob`` of each partition, in its order, as one file."""
    rows.select(F.col("blob").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def list_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, part (its number) and length of the files, by their metadata alone."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").filter("length > 0")
    return found.withColumn("part", F.regexp_extract("path", r"part-(\d+)", 1).cast("long"))


class Ranges:
    """Reads byte ranges of one file, in whatever store its address names."""

    def __init__(self, address: str):
        from pyarrow import fs

        if address.startswith("file:"):
            address = "/" + address[5:].lstrip("/")
            self.file = fs.LocalFileSystem().open_input_file(address)
        else:
            store, path = fs.FileSystem.from_uri(address)
            self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        got = self.file.read_at(length, start)
        if len(got) != length:
            raise ValueError(f"the file ends before {start + length}")
        return got

    def close(self) -> None:
        self.file.close()

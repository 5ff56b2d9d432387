"""Two layers of kept results as Parquet: raw files by address, parsed documents by version.

Writes append a part with a number; the reader takes the latest row of each key. Partition
columns stand for versions, so a new parser never meets an old one's rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import schemas as S

RAW = "url string, content binary, put_at long"
PARSED = "accession string, document string, put_at long, parser_version string, schema_version string"


class Store:
    """``root`` None keeps nothing and finds nothing."""

    def __init__(self, spark: SparkSession, root: str | None, parser_version: str = S.PARSER_VERSION, schema_version: str = S.SCHEMA_VERSION):
        self.spark, self.root = spark, root.rstrip("/") if root else None
        self.versions = {"parser_version": parser_version, "schema_version": schema_version}

    def path(self, layer: str) -> str | None:
        return f"{self.root}/{layer}" if self.root else None

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, layer: str, schema: str) -> DataFrame:
        if self.root:
            p, fs = self._fs(self.path(layer))
            if fs.exists(p):
                return self.spark.read.schema(schema).parquet(self.path(layer))
        return self.spark.createDataFrame([], schema)

    @staticmethod
    def _latest(d: DataFrame, key: str, wanted: DataFrame | None) -> DataFrame:
        """The latest row of each key, of the wanted keys only. Which it is is found from keys and
        numbers alone; contents are moved once, and only those asked for."""
        if wanted is not None:
            d = d.join(wanted.select(key).distinct(), key, "left_semi")
        last = d.groupBy(key).agg(F.max("put_at").alias("put_at"))
        return d.join(last, [key, "put_at"], "left_semi").dropDuplicates([key])

    def raw(self, wanted: DataFrame | None = None) -> DataFrame:
        """url and content, the latest of each address, or of the wanted ones."""
        return self._latest(self._read("raw", RAW), "url", wanted).select("url", "content")

    def put_raw(self, rows: DataFrame) -> None:
        """Add (url, content) rows; they replace earlier ones of their addresses."""
        if self.root:
            rows.select("url", "content", F.lit(time.time_ns()).alias("put_at")).write.mode("append").parquet(self.path("raw"))

    def fetching(self, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """url and content of the wanted addresses: what isn't kept is fetched and kept.

        ``fetch`` takes a DataFrame of urls and returns url and content.
        """
        missing = wanted.select("url").distinct().join(self._read("raw", RAW).select("url"), "url", "left_anti")
        got = fetch(missing)
        if not self.root:
            return got
        self.put_raw(got)
        return self.raw(wanted)

    def documents(self, wanted: DataFrame | None = None) -> DataFrame:
        """accession and document (JSON) of these versions, or those of wanted accessions; what
        isn't JSON is missing."""
        d = self._read("parsed", PARSED)
        for c, v in self.versions.items():
            d = d.filter(F.col(c) == v)
        d = self._latest(d, "accession", wanted).select("accession", "document")
        return d.filter(F.try_parse_json("document").isNotNull())

    def put_documents(self, rows: DataFrame) -> None:
        """Add (accession, document) rows under these versions."""
        if self.root:
            d = rows.select("accession", "document", F.lit(time.time_ns()).alias("put_at"), *[F.lit(v).alias(c) for c, v in self.versions.items()])
            d.write.mode("append").partitionBy(*self.versions).parquet(self.path("parsed"))

    def migrate(self) -> None:
        """Delete parsed documents of other versions: no reader of these versions sees them, and
        raw files stay, so all can be parsed again."""
        if not self.root:
            return
        p, fs = self._fs(self.path("parsed"))
        keep = [f"{c}={v}" for c, v in self.versions.items()]
        for depth in range(1, len(keep) + 1):
            own = "/".join(keep[:depth])
            inside = self._fs(f"{self.path('parsed')}/{'/'.join(keep[: depth - 1])}".rstrip("/"))[0]
            if fs.exists(inside):
                for s in fs.listStatus(inside):
                    if s.isDirectory() and not s.getPath().toString().endswith("/" + own):
                        fs.delete(s.getPath(), True)

    def clear(self) -> None:
        """Delete both layers."""
        if self.root:
            for layer in ("raw", "parsed"):
                p, fs = self._fs(self.path(layer))
                fs.delete(p, True)

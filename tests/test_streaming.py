"""Arrivals are taken once, and a restart repeats nothing."""

import json

from pyspark.sql import functions as F

from tabulon.sources.store import Store
from tabulon.streaming import landing


def test_arrivals(spark, tmp_path):
    src, made = tmp_path / "in", []
    src.mkdir()
    row = lambda acc, at: json.dumps({"accession": acc, "cik": 1, "form": "10-K", "filing_date": "2024-01-01", "landed_at": f"2024-01-{at:02d}T00:00:00"})
    (src / "a.json").write_text("\n".join([row("1-24-1", 1), row("1241", 1), row("1-24-2", 2)]))
    store = Store(spark, str(tmp_path / "store"))

    def make(new):
        made.append(sorted(r["accession"] for r in new.collect()))
        return new.select("accession", F.lit("{}").alias("document"))

    def run():
        landing.parse_into(landing.arrivals(spark, str(src)), make, store, str(tmp_path / "check")).awaitTermination()

    run()
    (src / "b.json").write_text("\n".join([row("1-24-2", 3), row("1-24-3", 3)]))
    run()
    run()
    assert sum(map(len, made)) == 3 and store.documents().count() == 3

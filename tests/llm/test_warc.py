"""Packages read back, by this reader and by others."""

import gzip
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tabulon.llm import warczip as W
from tabulon.llm.blobs import list_blobs
from tabulon.llm.shared import new_dir

PAGES = [(1, "http://a.test/x?q=ü", "<p>" + "z" * 2000), (2, None, "<p>" + "z" * 2000), (3, "http://b.test", "<p>" + "z" * 2000), (4, "u", "small"), (5, "u", "small"), (6, "not a url \r\n", None), (7, "", ""), (None, "n", "<p>" + "z" * 2000), (9, "x", "é" * 600), (10, "y", "é" * 600), (11, "http://[bad", "q" * 3_000_000), (9, "x", "é" * 600)]


def expected(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [p for p, _, x in rows if (x or "") == (h or "") and p is not None]
        head = max(same) if same and len(b) >= 1000 and sum((x or "") == (h or "") for _, _, x in rows) > 1 else None
        later = head is not None and (i is None or i < head)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if later else "response", head if later else None))
    return sorted(out, key=str)


def read(spark, path):
    d = W.read_packages(spark, path)
    return d.select(F.regexp_extract("record_id", r"(-?\d+|null)$", 1).try_cast("long").alias("i"), "payload_bytes", "payload_digest", "record_type", F.regexp_extract("refers_to", r"(-?\d+)$", 1).try_cast("long").alias("r"))


@pytest.mark.parametrize(("big", "many"), [(0xFFFFFFFF, 0xFFFF), (50, 2)])
def test_round_trip(spark, big, many):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    path = new_dir(spark, "t")
    W.write_packages(W.with_types(pages), path, member_bytes=1000, big=big, many=many)
    assert sorted((tuple(r) for r in read(spark, path).collect()), key=str) == expected(PAGES)


def test_other_readers(spark):
    pages = spark.createDataFrame(PAGES[:5], "page_id long, url string, html string").coalesce(1)
    path = new_dir(spark, "t")
    W.write_packages(W.with_types(pages), path)
    blob = open(list_blobs(spark, path).collect()[0]["path"].removeprefix("file:"), "rb").read()
    z = zipfile.ZipFile(io.BytesIO(blob))
    assert z.testzip() is None and {n.split("/")[0] for n in z.namelist()} == {"archive", "indexes", "datapackage.json"}
    raw = gzip.decompress(z.read("archive/data-0.warc.gz"))
    assert raw.count(b"WARC/1.1\r\n") == 5 and raw.count(b"WARC-Type: revisit") == 2


def test_query_and_empty(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("clash"))
    assert sorted((tuple(r) for r in W.round_trip(pages, new_dir(spark, "t")).collect()), key=str) == expected(PAGES)
    assert W.round_trip(pages.limit(0), new_dir(spark, "t")).count() == 0


def test_damage():
    raw = W.record("response", "urn:x-page:1", "http://x", hashlib.sha1(b"abc").digest(), 3, b"abc", None)
    assert W.parse_record(raw)["payload"] == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        W.parse_record(raw.replace(b"abc", b"abd"))

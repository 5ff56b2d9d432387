"""Whole filings, from landed files to documents, comparisons and reports."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tabulon import api
from tabulon.operators.filings import NotFound
from tabulon.plans import render
from tests import filings as Z


@pytest.fixture(scope="module")
def zorb(spark, landed, tmp_path_factory):
    return api.Filings(spark, landed, str(tmp_path_factory.mktemp("store")))


@pytest.fixture(scope="module")
def doc(zorb):
    return zorb.get("zorb").collect()[0]


def test_metadata(doc):
    m = doc["metadata"]
    assert (m["company"], m["cik"], m["ticker"], m["form"], m["accession"], m["filing_date"], m["period_end"], m["period_start"]) == ("Zorb Works", Z.CIK, "ZORB", "10-K", Z.NEW, "2024-02-01", "2023-12-31", None)


def test_sections(doc):
    got = [(s["item"], s["title"], s["kind"]) for s in doc["sections"]]
    assert got == [("1", "Business", "narrative"), ("1A", "Risk Factors", "narrative"), ("8", "Financial Statements and Supplementary Data", "financial")]
    assert doc["sections"][0]["text"] == "Item 1. Business\n\nWe make zorbs & small zorbs.\n\n- round\n\n- flat"
    assert "10-K" not in doc["sections"][0]["text"]
    assert doc["sections"][2]["text"].startswith("Item 8. Financial Statements\n\nNet sales 1,234 1,000\n\nCosts 700 (650)")


def test_statements(doc):
    income, cash = doc["statements"]
    assert income["title"] == "STATEMENTS OF OPERATIONS"
    assert [(c["label"], c["context_ref"], c["instant"]) for c in income["columns"]] == [("2023", "y1", False), ("2022", "y0", False)]
    rows = {r["label"]: (r["type"], r["depth"], r["values"]) for r in income["rows"]}
    assert rows == {"Net sales": ("data", 1, [1234e6, 1000e6]), "Costs": ("data", 1, [700e6, -650e6]), "Gross profit": ("total", 1, [534e6, 350e6]), "Share": ("data", 1, [2.5, 0.0])}
    assert [r["label"] for r in income["rows"]] == list(rows)
    assert income["confidence"]["level"] == "high"
    # a cyclic role has no root, so no rows; the first role that matches is taken all the same
    assert cash["rows"] == [] or cash["title"] == "ConsolidatedStatementsOfCashFlowsTwo"


def test_boundaries(zorb, spark):
    from tabulon.operators import project
    from tabulon.plans import pipeline

    p = pipeline.Parsed(zorb.files(), zorb._chosen("ZORB"))
    rows = p.roles.filter("role_seq = 3").withColumn("statement", F.lit("cash"))
    t = project.tables(rows, p.facts, p.contexts).collect()[0]["table"]
    assert [(c["label"], c["context_ref"]) for c in t["columns"]] == [("2023", "e1"), ("2023", "y1"), ("2022", "e0"), ("2022", "y0"), ("2021", "e00")]
    got = {(r["label"], c["context_ref"]): v for r in t["rows"] for c, v in zip(t["columns"], r["values"], strict=True)}
    assert got["Cash, start", "y1"] == 80e6 and got["Cash, start", "y0"] == 60e6
    assert got["Cash, end", "y1"] == 100e6 and got["Cash, end", "y0"] == 80e6
    assert got["Cash Change", "y0"] == -20e6 and got["Cash Change", "e1"] is None
    # nil facts, facts without context and segments don't count
    assert p.facts.filter("concept = 'q:Other'").count() == 0
    assert p.facts.filter("concept = 'q:Gross' and context_ref = 'y1'").count() == 1


def test_selection(zorb):
    assert zorb.latest("Zorb").collect()[0]["accession"] == Z.NEW
    assert zorb._chosen("ZORB", year=2023).collect()[0]["accession"] == Z.OLD
    assert zorb._chosen("ZORB", accession="000900012324000001").collect()[0]["form"] == "8-K"
    for ask in ({"ticker": "??"}, {"ticker": "NONE"}, {"ticker": "ZORB", "form": "10-K/A"}, {"ticker": "ZORB", "year": 1999}, {"ticker": "ZORB", "accession": "1-2-3"}):
        with pytest.raises(NotFound):
            zorb._chosen(**ask)
    with pytest.raises(ValueError, match="PlainText"):
        zorb.get("ZORB", year=2022)
    assert zorb.fetch("ZORB", n=5).collect()[0]["content"] == b"<html"


def test_stages(zorb):
    c = zorb.detect("ZORB").collect()[0]
    assert (c["format"], c["index_href"]) == ("IXBRL", None)
    lines = [r["line"] for r in zorb.facts("ZORB", concept="SHARE").collect()]
    assert lines == ["q:Share\t2023-01-01..2023-12-31\t2.5\tusd", "q:Share\t2022-01-01..2022-12-31\t0\tusd"]
    assert [r["line"].split("\t")[::3] for r in zorb.sections("ZORB").collect()] == [["Item 1", "4 paragraphs"], ["Item 1A", "3 paragraphs"], ["Item 8", "10 paragraphs"]]
    assert zorb.text("ZORB", "risk").collect()[0]["item"] == "1A"
    assert zorb.table("ZORB").collect()[0]["table"]["role_uri"].endswith("StatementsOfOperations")
    t = zorb.layout_table("ZORB", 1).collect()[0]["table"]
    assert [r["label"] for r in t["rows"]] == ["Net sales", "Costs", "Gross profit", "North sales", "Per share"]
    assert t["rows"][1]["values"] == [700.0, -650.0] and t["rows"][4]["values"] == [2.5, None]
    with pytest.raises(NotFound):
        zorb.layout_table("ZORB", 99)
    with pytest.raises(ValueError):
        zorb.table("ZORB", "nonsense")


def test_get_section(zorb):
    only = zorb.get("ZORB", section="1a").collect()[0]
    assert len(only["sections"]) == 1 and only["statements"] == []
    assert zorb.get("ZORB", section="8").collect()[0]["statements"] != []
    with pytest.raises(NotFound):
        zorb.get("ZORB", section="zzz")


def test_json_is_kept(zorb):
    text = zorb.rendered("ZORB").collect()[0]["text"]
    d = json.loads(text)
    assert text.startswith('{\n  "metadata": {\n    "company": "Zorb Works",\n    "cik": 9000123,') and text.endswith("}\n")
    assert '"values": [\n            1234000000,' in text and "2.5" in text
    assert "period_start" not in d["metadata"] and d["statements"][0]["rows"][0]["depth"] == 1
    assert zorb.store.documents().count() == 1
    assert zorb.rendered("ZORB").collect()[0]["text"] == text


def test_markdown_and_text(zorb):
    md = zorb.rendered("ZORB", "md").collect()[0]["text"]
    assert md.startswith("<!-- tabulon v0.1.0 schema 1.0.0 -->\n\n# Zorb Works (ZORB) 10-K — period ending 2023-12-31\n\n## Item 1 — Business\n\n")
    assert "|  | 2023 | 2022 |\n| --- | ---: | ---: |\n| Net sales | 1234000000 | 1000000000 |\n" in md
    txt = zorb.rendered("ZORB", "txt").collect()[0]["text"]
    lines = txt.split("\n")
    at = next(i for i, x in enumerate(lines) if x.startswith("Net sales ") and "1234000000" in x)
    assert len(lines[at]) == len(lines[at - 1]) == len(lines[at - 2])
    with pytest.raises(ValueError):
        render.renderer("pdf")


def test_long_text_table(spark):
    """A table's widths are found once, so its time grows with its rows and not with their square."""
    began = time.time()
    d = spark.range(1, numPartitions=1).selectExpr("named_struct('title', 'T', 'columns', array(named_struct('label', '2024'), named_struct('label', '2023')), 'rows', transform(sequence(1, 3000), i -> named_struct('label', 'r' || i, 'values', array(i / 4, -i / 1.0D))), 'source', named_struct('extractor', 'x'), 'confidence', named_struct('level', 'high')) AS t")
    lines = d.select(render.text_table(F.col("t")).alias("text")).collect()[0]["text"].split("\n")
    assert lines[:3] == ["T", "         2024   2023", "-" * 20] and lines[3] == "r1       0.25     -1" and lines[3002] == "r3000     750  -3000"
    assert time.time() - began < 60


def test_diff(zorb):
    sets, words = zorb.diff("ZORB", 2023, 2024, layer="lexical")
    d = sets.collect()[0]
    rows = {(s["title"], r["label"]): r for s in d["statements"] for r in s["rows"]}
    sales = rows["STATEMENTS OF OPERATIONS", "Net sales"]
    assert sales["status"] == "unchanged" and sales["cells"][0]["period"] == "2022"
    costs = rows["STATEMENTS OF OPERATIONS", "Costs"]["cells"][0]
    assert (costs["prev"], costs["curr"], costs["abs"]) == (700e6, -650e6, -1350e6)
    share = rows["STATEMENTS OF OPERATIONS", "Share"]["cells"][0]
    assert (share["prev"], share["curr"], share["abs"]) == (2.5, 0.0, -2.5) and share["pct"] == -100.0
    md = render.changes_markdown(sets).collect()[0]["text"]
    assert md.startswith("# Changes — Zorb Works 10-K 2022-12-31 → 2023-12-31\n\n## Financial Statements\n\n### STATEMENTS OF OPERATIONS — 2022\n")
    assert "- − Zorb prices may fall.\n- + Zorb prices may fall by 10 percent.\n" in md
    lex = render.lexical_markdown(sets, words).collect()[0]["text"]
    assert "**Paragraph 1**\n\nZorb prices may [-fall.-][+fall by 10 percent.+]\n" in lex or "[+" in lex
    assert json.loads(render.changes_json(sets).collect()[0]["text"])["prev"]["accession"] == Z.OLD
    with pytest.raises(NotImplementedError):
        zorb.diff("ZORB", 2023, 2024, layer="semantic")
    with pytest.raises(NotImplementedError):
        api.search("zorbs")


def test_corpus(spark, tmp_path):
    """A folder of corpus entries, scored and reported."""
    from tabulon.operators import accuracy

    d = tmp_path / "zorb"
    d.mkdir()
    (d / "z.htm").write_text(Z.page(2023, "1,234", "Risk."))
    (d / "zorb_pre.xml").write_text(Z.presentation())
    (d / "zorb_lab.xml").write_text(Z.label_linkbase())
    (d / "zorb.xsd").write_text(Z.schema())
    (d / "index.json").write_text(json.dumps({"directory": {"item": [{"name": n} for n in ("z.htm", "zorb_pre.xml", "zorb_lab.xml", "zorb.xsd")]}}))
    recent = {"accessionNumber": [Z.NEW], "filingDate": ["2024-02-01"], "reportDate": ["2023-12-31"], "form": ["10-K"], "primaryDocument": ["z.htm"]}
    (d / "submissions.json").write_text(json.dumps({"cik": str(Z.CIK), "name": "Zorb Works", "filings": {"recent": recent}}))
    cells = [{"concept": "q:Sales", "period": "2023", "value": 1234000000.0}, {"concept": "q:Costs", "period": "2022", "value": -650000000.0}, {"concept": "q:Gross", "period": "2023", "value": 1.0}]
    (d / "baseline.json").write_text(json.dumps({"ticker": "ZORB", "form": "10-K", "format": "IXBRL", "confidence": "high", "sections": ["1", "1A", "9"], "statements": [{"role": "", "title": "statements of operations", "cells": cells}]}))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "notes.txt").write_text("no entry")
    s = api.score(spark, str(tmp_path))
    r = s.collect()
    assert len(r) == 1 and (r[0]["matched_cells"], r[0]["total_cells"], r[0]["matched_sections"], r[0]["total_sections"]) == (2, 3, 2, 3)
    assert any("66.7%" in x["line"] for x in accuracy.report(s).collect())


def test_command_line(spark, landed, capsys):
    from tabulon import __main__ as cli
    from tabulon import __version__

    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == __version__
    a = cli.parser().parse_args(["--root", landed, "latest", "ZORB"])
    assert cli.lines(a, spark)[0].split("\t")[:2] == [Z.NEW, "10-K"]
    a = cli.parser().parse_args(["--root", landed, "detect", "ZORB", "--year", "2022"])
    assert cli.lines(a, spark) == ["PlainText"]
    with pytest.raises(NotFound):
        cli.lines(cli.parser().parse_args(["--root", landed, "text", "NONE", "--section", "1"]), spark)


def test_reads_only_its_files(spark, tmp_path):
    """One filing is read though other companies' and filings' files couldn't be."""
    Z.write(tmp_path)
    big = b"x" * 50_000
    other = tmp_path / "archives" / "77" / "000000007724000001"
    other.mkdir(parents=True)
    (other / "z.htm").write_bytes(big)
    (tmp_path / "archives" / str(Z.CIK) / Z.OLD.replace("-", "") / "more.bin").write_bytes(big)
    (tmp_path / "submissions" / "CIK0000000077.json").write_bytes(big)
    key = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(key)
    spark.conf.set(key, 20_000)
    try:
        assert api.Filings(spark, str(tmp_path)).get("ZORB").count() == 1
    finally:
        spark.conf.set(key, before)


def test_unsound_submissions_fail_alone(spark, tmp_path):
    Z.write(tmp_path)
    uneven = {"accessionNumber": ["a", "b"], "filingDate": ["2024-01-01"], "reportDate": [], "form": ["10-K"], "primaryDocument": ["x"]}
    undated = {"accessionNumber": ["a"], "filingDate": ["soon"], "reportDate": [""], "form": ["10-K"], "primaryDocument": ["x"]}
    for cik, recent in ((5, uneven), (6, undated)):
        (tmp_path / "submissions" / f"CIK{cik:010d}.json").write_text(json.dumps({"cik": str(cik), "name": "x", "filings": {"recent": recent}}))
    f = api.Filings(spark, str(tmp_path))
    assert {r["cik"] for r in f.submissions().collect()} == {Z.CIK}
    assert {r["cik"]: r["reason"] for r in f.unsound().collect()} == {5: "arrays of differing lengths", 6: "dates that can't be read"}
    with pytest.raises(ValueError):
        f.get("none")


def test_migrate(spark, tmp_path):
    from tabulon.sources.store import Store

    rows = spark.createDataFrame([("a", "{}")], "accession string, document string")
    old, new = Store(spark, str(tmp_path), schema_version="0"), Store(spark, str(tmp_path))
    other = Store(spark, str(tmp_path), parser_version="9")
    for s in (old, new, other):
        s.put_documents(rows)
    new.put_raw(spark.createDataFrame([("u", bytearray(b"x"))], "url string, content binary"))
    new.migrate()
    assert (old.documents().count(), other.documents().count(), new.documents().count(), new.raw().count()) == (0, 0, 1, 1)
    Store(spark, None).migrate()

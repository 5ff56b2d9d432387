"""Single operators on small inputs, with nulls, ties and empty tables."""

import re

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.operators import accuracy, compare, facts, layout, linkbase, router, sections
from tabulon.sources import shred
from tabulon.sources.fetch import Fetcher, StatusError, submissions_url
from tabulon.sources.store import Store


def nodes(spark, *docs):
    return shred.shred(spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(docs)], "accession string, content string"))


def table_of(spark, html):
    return layout.tables(nodes(spark, html)).collect()[0]["table"]


# shredder

@pytest.mark.parametrize(("html", "text"), [
    ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n\nb\n\n- c\n\nd"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2\n\n3"), ("a<br>b<br/>c", "a\n\nb\n\nc"),
    ("<ix:header>x</ix:header>y<script>z()</script><style>w</style>", "y"), ("<div>a &amp; b\n  c</div>", "a & b c"), ("<b>a</p>b</b>", "a\n\nb"), ("</div>x", "x"), ("", ""), ("<ix:nonFraction/>7", "7"), ("<h1>t</h2>u", "t\n\nu"),
])
def test_rendered(spark, html, text):
    assert shred.element_text(html) == text
    got = sections.render_text(nodes(spark, html)).collect()
    assert [r["text"] for r in got] == ([text] if text else [])


def test_tree():
    rows = {r[-1]: r for r in shred.shred_document("<table><td>a<table><tr><td>b</td></tr></table></td></table><p id=x>q")}
    tables = [r for r in rows.values() if r[1] == "table"]
    assert len(tables) == 2 and tables[1][6] == tables[0][-1]
    for r in rows.values():
        if r[0] == "element" and r[3] is not None:
            up = rows[r[3]]
            assert up[-1] < r[-1] <= r[4] <= up[4]
    assert [r[1] for r in rows.values() if r[0] == "element"] == ["table", "tbody", "tr", "td", "table", "tbody", "tr", "td", "p"]


@settings(max_examples=60, deadline=None)
@example(["<tr>", "<tr>"])
@example(["<td>", "<tr>"])
@example(["</p>", "<tr>", "<tr>"])
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "x", " y ", "<ix:a>", "</ix:a>", "<div>", "</div>", "<br>", "</tr>"]), max_size=40))
def test_any_soup(parts):
    rows = shred.shred_document("".join(parts))
    at = [r[-1] for r in rows]
    assert at == sorted(at) and len(set(at)) == len(at)
    assert "".join(r[13] for r in rows if r[0] == "text") == "".join(p for p in parts if not p.startswith("<"))


def test_long_document_leaves_in_parts():
    """Of a document far longer than a part only open elements and their text are held."""
    one = "<table><tr><td>a<sup>1</sup></td></tr></table>"
    parser, steps = shred._shredder("<html><body>" + one * 20_000 + "</body></html>")
    n = most = 0
    for _ in steps:
        most = max(most, len(parser.rows) + len(parser.text) + len(parser.shown) + sum(len(o.notes) for o in parser.stack))
        n += len(parser.taken())
    assert n == 20_000 * 12 + 2 and most < 2 * shred.ROWS


def test_short_documents_leave_together(spark):
    """A batch holds many documents, and one file's documents are dealt to several tasks."""
    raw = spark.range(2000, numPartitions=1).selectExpr("string(id) AS accession", "concat('<p>', id, '</p>') AS content")
    plan = shred.shred(raw)
    sizes = plan.mapInArrow(lambda batches: (b.slice(0, 1).select(["pos"]) for b in batches if b.num_rows), "pos long")
    assert sizes.count() < 40
    by = plan.select("accession", F.spark_partition_id().alias("task")).distinct()
    assert by.count() == 2000 and by.select("task").distinct().count() > 1


@pytest.mark.parametrize("html", [
    "<p>a &lt; b<a href='#x'>t</a><i id=x>q</i></p>", "<script>if (a<b) c()</script>d<p>e", "<p title=\"a&amp;b\">x</p><!-- <p> --><br/>y", "<td>a<tr><table><td HREF=#q id=q>z", "a<b", "<p>x</p><!-- never ends <p>y", "<title>a<b>c</title>d", "</td >a</ p>b<>c",
])
def test_plain_and_odd_tags_read_alike(html, monkeypatch):
    """What is read as plain tags is what HTMLParser reads, in whatever pieces."""
    rows = shred.shred_document(html)
    monkeypatch.setattr(shred, "_NEXT", re.compile("(?!)"))
    assert shred.shred_document(html) == rows
    monkeypatch.setattr(shred, "_PIECE", 1)
    monkeypatch.setattr(shred.Shredder, "_odd", lambda self, doc, i: (i, False))
    assert shred.shred_document(html) == rows


@pytest.mark.parametrize("kinds", [["element"], ["text", "break"]])
def test_kinds_keep_places(spark, kinds):
    html = "<p>a</p><table><tr><td>b<td>c</table>"
    every = nodes(spark, html)
    some = shred.shred(spark.createDataFrame([("d0", html)], "accession string, content string"), kinds=kinds)
    of = lambda d: sorted((r["pos"], r["end_pos"], r["kind"], r["text"]) for r in d.collect())
    assert of(some) == of(every.filter(every["kind"].isin(kinds)))


def test_contexts_read_nodes_once(spark):
    """Contexts and their parts come of one pass, those within another too; one without an id counts."""
    html = "<ix:header>" + _ctx("a", "<xbrli:instant>2020-12-31</xbrli:instant>") + '<xbrli:context><xbrli:period></xbrli:period></xbrli:context><xbrli:context id="o"><xbrli:entity>' + _ctx("i", "<xbrli:instant>2021-12-31</xbrli:instant>") + "</xbrli:entity></xbrli:context></ix:header>"
    c = facts.contexts(nodes(spark, html))
    assert c._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r["context_ref"], str(r["period_end"]), r["entity_cik"], r["valid"]) for r in c.collect()} == {("a", "2020-12-31", "7", False), (None, "None", None, False), ("o", "None", None, False), ("i", "2021-12-31", "7", False)}


# contexts and facts

def _ctx(i, period, more=""):
    return f'<xbrli:context id="{i}"><xbrli:entity><xbrli:identifier>7</xbrli:identifier>{more}</xbrli:entity><xbrli:period>{period}</xbrli:period></xbrli:context>'


def test_contexts(spark):
    day = "<xbrli:instant> 2024-01-31 </xbrli:instant>"
    x = nodes(spark, _ctx("a", "<xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-01-31</xbrli:endDate>") + _ctx("a", day) + _ctx("t", day, '<xbrldi:typedMember dimension="q:D">z</xbrldi:typedMember>') + _ctx("m", day, '<xbrldi:explicitMember dimension="q:D"> q:M </xbrldi:explicitMember>'),
              _ctx("a", day) + _ctx("b", "<xbrli:instant>2024-02-31</xbrli:instant>") + '<ix:nonFraction name="q:A" contextRef="a">1</ix:nonFraction>', "<p>none</p>")
    c = {(r["accession"], r["context_ref"]): r for r in facts.contexts(x).collect()}
    a = c["d0", "a"]
    assert a["period_start"] == a["period_end"] and str(a["period_end"]) == "2024-01-31" and a["entity_cik"] == "7"
    assert c["d0", "t"]["segments"] == [] and c["d0", "t"]["typed"] and c["d0", "m"]["segments"][0]["member"] == "q:M"
    assert c["d0", "a"]["valid"] and not c["d1", "a"]["valid"]
    assert facts.facts(x, facts.contexts(x)).count() == 0


def test_facts_order_and_nesting(spark):
    day = "<xbrli:instant>2024-01-31</xbrli:instant>"
    x = nodes(spark, _ctx("a", day) + '<ix:nonNumeric name="q:T" contextRef="a">text <ix:nonFraction name="q:A" contextRef="a" unitRef="usd">1</ix:nonFraction></ix:nonNumeric><ix:nonFraction name="q:A" contextRef="a" unitRef="eur">two</ix:nonFraction><ix:nonFraction name="q:A" contextRef="a" xsi:nil="true"></ix:nonFraction>')
    f = facts.facts(x, facts.contexts(x)).orderBy("seq").collect()
    assert [(r["concept"], r["numeric"], r["unparsed"], r["raw"], r["value"]) for r in f] == [("q:A", True, False, "1", 1.0), ("q:A", True, True, "two", None), ("q:T", False, False, "text 1", None)]


# linkbases

def test_tree_walk(spark):
    e = spark.createDataFrame([("k", "a", "b", 2), ("k", "a", "c", 1), ("k", "c", "d", 1), ("k", "d", "a", 1), ("k", "b", "d", 1)], "k string, parent string, child string, rank int")
    roots = spark.createDataFrame([("k", "a", 0)], "k string, node string, rank int")
    got = [(r["node"], r["depth"]) for r in linkbase.walk_tree(e, roots, ["k"]).orderBy("path").collect()]
    assert got == [("a", 0), ("c", 1), ("d", 2), ("b", 1)]
    with pytest.raises(ValueError, match="levels"):
        linkbase.walk_tree(e, roots, ["k"], levels=1)
    assert linkbase.walk_tree(e, roots.limit(0), ["k"]).count() == 0


# layout

def test_layout_header(spark):
    t = table_of(spark, "<table><tr><td><b>Sales by kind</b></td></tr><tr><td></td><td><b>Year</b></td><td><b>Year</b></td></tr><tr><td></td><td>2024</td><td>2023</td></tr><tr><td>Zorbs<sup>(2)</sup></td><td>$</td><td>1,5</td><td>(3)</td></tr><tr><td>Gap (1)</td><td>—</td><td>$ 4</td></tr><tr style='x'><td style='border-top:1px'>Total</td><td>19</td><td>1</td></tr><tr><td>Total b</td><td>1</td></tr><tr><td> </td></tr></table>")
    assert t["title"] == "Sales by kind" and [c["label"] for c in t["columns"]] == ["Year 2024", "Year 2023"]
    assert [(r["label"], r["type"], r["values"]) for r in t["rows"]] == [("Zorbs", "data", [15.0, -3.0]), ("Gap", "data", [None, 4.0]), ("Total", "total", [19.0, 1.0]), ("Total b", "subtotal", [1.0, None])]
    assert t["footnotes"] == {"1": "", "2": ""}
    assert t["confidence"]["untagged_cell_count"] == 2 and t["confidence"]["level"] == "low"


def test_layout_high_is_medium(spark):
    t = table_of(spark, "<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>")
    assert t["confidence"]["level"] == "medium" and t["columns"][0]["label"] == ""
    assert layout.tables(nodes(spark, "<table><tr><td>$</td></tr></table>", "x")).count() == 0


# sections

def test_contents_first(spark):
    toc = '<table><tr><td>Item 1</td><td><a href="#a">Business</a></td></tr><tr><td><a href="#gone">Properties</a></td></tr><tr><td><a href="#b">Legal Proceedings</a></td></tr></table>'
    x = nodes(spark, toc + '<p id="b">Legal</p>late<p><a name="a"></a>Biz</p>end', "<h2>Item 1. Business</h2>x<b>Item 2. Properties</b>y<h2>Item 1. Business</h2>z", "<b>Item 3</b>only", "nothing")
    p = sections.with_text(x, sections.partition(x)).orderBy("accession", "seq").collect()
    assert [(r["accession"], r["item"], r["strategy"], r["level"], r["text"]) for r in p] == [
        ("d0", "3", "toc", "medium", "Legal\n\nlate"), ("d0", "1", "toc", "medium", "Biz\n\nend"), ("d1", "1", "heading", "medium", "Item 1. Business\n\nx"), ("d1", "2", "heading", "medium", "Item 2. Propertiesy\n\nItem 1. Business\n\nz"), ("d2", "3", "heading", "low", "Item 3only"),
    ]
    # an empty target leaves the row of the contents as the heading
    assert p[0]["heading"] == "Legal" and p[1]["heading"] == "Item 1Business"


def test_section_formats(spark):
    x = nodes(spark, "<h1>Item 1. Business</h1><table><tr><td><ix:nonFraction>1</ix:nonFraction></td></tr></table><h1>Item 2. Properties</h1><table><tr><td>1</td></tr></table><h1>Item 3. Legal Proceedings</h1>")
    assert sections.formats(x, sections.partition(x)).collect()[0]["formats"] == {"1": "IXBRL", "2": "PlainHTML"}


# router

NS = "http://www.xbrl.org/2013/inlineXBRL"


@pytest.mark.parametrize(("body", "kind"), [
    (f"<html xmlns:ix='{NS}'><table><tr><td><ix:nonFraction>500</ix:nonFraction></td><td>2024</td></tr></table>", "IXBRL"),
    (f"<html xmlns:ix='{NS}'><table><tr><td><ix:nonFraction>500</ix:nonFraction></td><td>700</td></tr></table>", "PartialIXBRL"),
    (f"<html xmlns:ix='{NS}'><table><tr>{'<td>700</td>' * 11}<td><ix:nonFraction>500</ix:nonFraction></td></tr></table>", "PlainHTML"),
    (f"<html xmlns:ix='{NS}'><p>x", "PlainHTML"), (f"<html xmlns:ix='{NS}'><ix:header></ix:header>", "IXBRL"), ("<HTML><p>x", "PlainHTML"), ("<SEC-DOCUMENT>x", "PlainText"), ("a\f-----", "PlainText"), ("a -----", "Unknown"), ("", "Unknown"),
])
def test_formats(spark, body, kind):
    raw = spark.createDataFrame([("d", body.encode())], "accession string, content binary")
    assert router.classify(raw, shred.shred(raw)).collect()[0]["format"] == kind


def test_index(spark):
    index = b'<html><table summary="Document Format Files"><tr><td><a href="/x/z-index.htm">i</a><a href="/x/Z.HTM">z</a><a href="q.htm">q</a></td></tr></table>'
    raw = spark.createDataFrame([("d", index), ("e", b"<html>"), ("n", None)], "accession string, content binary")
    c = router.classify(raw, shred.shred(raw))
    assert {r["accession"]: r["index_href"] for r in c.collect()} == {"d": "/x/Z.HTM", "e": None, "n": None}
    files = spark.createDataFrame([("d", "Z.HTM", b"<html>led"), ("d", "q.htm", b"no")], "accession string, name string, content binary")
    assert [r["content"] for r in router.resolve(c, files).collect()] == [b"<html>led"]


# comparison

def _lcs(a, b):
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif j == m or i < n and t[i + 1][j] >= t[i][j + 1]:
            out.append(("removed", a[i]))
            i += 1
        else:
            out.append(("added", b[j]))
            j += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_edit_script(a, b):
    assert compare.edit_script(a, b) == _lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", max_size=30), st.text("ab ", max_size=30))
def test_word_markup(a, b):
    import re

    m = compare.word_markup(a, b)
    assert re.sub(r"\[\+.*?\+\]", "", m).replace("[-", "").replace("-]", "") == a
    assert re.sub(r"\[-.*?-\]", "", m).replace("[+", "").replace("+]", "") == b


def _doc(pair, rows, sections_, years=("2023", "2022"), uri="u"):
    cols = [{"label": y, "context_ref": y, "period_start": None, "period_end": None, "instant": False} for y in years]
    table = {"title": "T", "role_uri": uri, "columns": cols, "rows": [{"label": a, "concept": c, "values": v} for a, c, v in rows]}
    return (pair, [table], sections_)


_DOC = "pair string, statements array<struct<title:string,role_uri:string,columns:array<struct<label:string,context_ref:string,period_start:date,period_end:date,instant:boolean>>,rows:array<struct<label:string,concept:string,values:array<double>>>>>, sections array<struct<item:string,title:string,text:string>>"


def test_row_deltas(spark):
    prev = spark.createDataFrame([_doc("p", [("Cash", "c", [1.0, 2.0]), ("Cash end", "c", [3.0, 4.0]), ("Old", "o", [5.0, 6.0]), ("Same", None, [7.0, None])], [], ("2022", "2021"))], _DOC)
    curr = spark.createDataFrame([_doc("p", [("Cash", "c", [9.0, 3.0]), (" same ", "", [8.0, 7.0]), ("New", "n", [1.0, None]), ("Zero", "c", [0.0, 0.0])], [], ("2023", "2022"))], _DOC)
    got = compare.row_deltas(prev, curr).orderBy("n").collect()
    assert [(r["label"], r["status"]) for r in got] == [("Cash", "unchanged"), (" same ", "unchanged"), ("New", "added"), ("Zero", "changed"), ("Old", "removed")]
    assert got[3]["cells"][0].asDict() == {"period": "2022", "prev": 3.0, "curr": 0.0, "abs": -3.0, "pct": -100.0}
    none = compare.row_deltas(prev, curr.withColumn("statements", F.transform("statements", lambda t: t.withField("columns", F.transform(t["columns"], lambda c: c.withField("label", F.lit("x"))))))).collect()
    assert {r["status"] for r in none} == {"unchanged", "added", "removed"} and all(r["cells"] == [] for r in none)
    assert compare.row_deltas(prev.limit(0), curr).count() == 0


def test_section_changes(spark):
    prev = spark.createDataFrame([_doc("p", [], [("1", "A", "x\n\ny"), ("2", "B", "gone"), ("", "C", "q"), ("3", "D", "same")])], _DOC)
    curr = spark.createDataFrame([_doc("p", [], [("3", "D", " same "), ("1", "A", "y\n\nz"), ("4", "E", "new"), ("5", "F", None)])], _DOC)
    c = compare.section_changes(prev, curr)
    assert [(r["item"], [(p["kind"], p["text"]) for p in r["paragraphs"]]) for r in c.orderBy("n").collect()] == [("1", [("removed", "x"), ("added", "z")]), ("4", [("added", "new")]), ("2", [("removed", "gone")])]
    assert [(r["item"], r["paragraphs"]) for r in compare.lexical(c).collect()] == [("1", ["[-x-][+z+]"])]
    with pytest.raises(ValueError):
        compare.compare(None, curr)


# accuracy

def test_accuracy(spark):
    docs = spark.createDataFrame([("n", *_doc("n", [("A", "c", [1.0, None])], [("1", "A", "t")], uri="u")[1:], {"confidence": {"level": "high"}})], "name string, " + _DOC.split(", ", 1)[1] + ", metadata struct<confidence:struct<level:string>>")
    base = spark.createDataFrame([("n", "N", "10-K", "IXBRL", "high", ["1", "2"], [{"role": "u", "title": "", "cells": [{"concept": "c", "period": "2023", "value": 1.4}, {"concept": "c", "period": "2022", "value": None}, {"concept": "c", "period": "1999", "value": None}, {"concept": "zz", "period": "2023", "value": 1.0}]}, {"role": "other", "title": "nope", "cells": [{"concept": "c", "period": "2023", "value": None}]}])], "name string, ticker string, form string, format string, confidence string, sections array<string>, statements array<struct<role:string,title:string,cells:array<struct<concept:string,period:string,value:double>>>>")
    s = accuracy.score(docs, base)
    r = s.collect()[0]
    assert (r["matched_cells"], r["total_cells"], r["matched_sections"], r["total_sections"]) == (3, 5, 1, 2)
    lines = [x["line"] for x in accuracy.report(s).orderBy("seq").collect()]
    assert lines[4] == "overall: statement accuracy 60.0% (3/5), section coverage 50.0% (1/2)" and lines[-1] == "  high   1 filing(s): 60.0% cell accuracy"


# store and fetcher

def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    urls = spark.createDataFrame([("a",), ("b",), ("a",)], "url string")
    asked = []

    def fetch(d):
        asked.append(sorted(r["url"] for r in d.collect()))
        return d.withColumn("content", F.encode("url", "UTF-8"))

    assert s.fetching(urls, fetch).count() == 2 and s.fetching(urls, fetch).count() == 2 and asked == [["a", "b"], []]
    s.put_raw(spark.createDataFrame([("a", b"new")], "url string, content binary"))
    assert {r["url"]: bytes(r["content"]) for r in s.raw().collect()} == {"a": b"new", "b": b"b"}
    docs = spark.createDataFrame([("x", "{}"), ("y", "{broken")], "accession string, document string")
    s.put_documents(docs)
    assert [r["accession"] for r in s.documents().collect()] == ["x"]
    assert Store(spark, str(tmp_path / "s"), schema_version="2").documents().count() == 0
    s.clear()
    assert s.documents().count() == 0 and s.raw().count() == 0
    none = Store(spark, None)
    none.put_documents(docs)
    assert none.documents().count() == 0 and none.fetching(urls, fetch).count() == 2


def test_fetcher(monkeypatch):
    now, calls, answers = [0.0], [], {"u": [(503, b""), (200, b"ok")], "v": [(404, b"")], "w": [(500, b""), (500, b"")]}
    f = Fetcher("me@x.test", lambda url, agent: (calls.append((url, now[0], agent)), answers[url].pop(0) if url in answers else (200, b"y"))[1], lambda s: now.__setitem__(0, now[0] + s), lambda: now[0])
    assert f.get("u") == b"ok"
    for bad in ("v", "w"):
        with pytest.raises(StatusError):
            f.get(bad)
    start = now[0]
    for _ in range(20):
        f.get("z")
    assert now[0] - start >= 1.9 and calls[0][2] == "me@x.test"
    monkeypatch.delenv("TABULON_USER_AGENT", raising=False)
    with pytest.raises(ValueError):
        Fetcher()
    assert submissions_url(7).endswith("CIK0000000007.json")

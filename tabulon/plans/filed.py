"""Queries over filings written from the analytic tables: each row or group of rows becomes a
landed file, and the library reads it as it reads any other."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon import schemas as S
from tabulon.functions import scalars as X
from tabulon.operators import accuracy, compare, facts, layout, linkbase, project, router, sections
from tabulon.plans import pipeline, render
from tabulon.plans.catalog import query
from tabulon.plans.views import table
from tabulon.sources import landing
from tabulon.sources.scratch import folder, written
from tabulon.sources.shred import shred
from tabulon.sources.store import Store


def _c(*parts) -> Column:
    """Texts and columns in a row; a text is itself."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _html(body: Column) -> Column:
    return _c(f'<html xmlns:ix="{S.NAMESPACE}"><body>', body, "</body></html>")


def _listed(d: DataFrame, by: str, order: str, text: Column, name: str) -> DataFrame:
    """The texts of each group in order, as one."""
    one = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return d.groupBy(by).agg(F.array_join(F.transform(one, lambda x: x["t"]), "").alias(name))


def _raw(d: DataFrame, key: str, content: Column) -> DataFrame:
    return d.select(F.col(key).cast("string").alias("accession"), F.encode(content, "UTF-8").alias("content"))


# sections: four kinds of suppliers' filings

_HEADS = {"1": "Item 1. Business", "1A": "Item 1A. Risk Factors", "7": "Item 7. Discussion and Analysis"}


def _supplier_pages(spark, d, word: str = "first") -> DataFrame:
    """accession and content. By number modulo 4: headings of two items; contents of three, one of
    them linked twice; contents of two and a link to nothing; a heading of one item."""
    k = F.col("s_suppkey") % 4
    link = lambda to, text: f'<tr><td><a href="#{to}">{text}</a></td></tr>'
    toc = lambda *rows: "<table>" + "".join(link(*r) for r in rows) + "</table>"
    contents = F.when(k == 1, toc(("i1", _HEADS["1"]), ("i1A", _HEADS["1A"]), ("i7", _HEADS["7"]), ("no", _HEADS["7"]))).when(k == 2, toc(("i1", _HEADS["1"]), ("no", "Item 8. Statements"), ("i7", _HEADS["7"]))).otherwise("")

    def part(item: str) -> Column:
        head = F.when(k.isin(1, 2), f'<div id="i{item}">{_HEADS[item]}</div>').otherwise(f"<h2>{_HEADS[item]}</h2>")
        return _c(head, "<p>", F.col("s_name"), f" in {item}, {word}", "</p><script>no()</script><p>Balance ", F.col("s_acctbal"), "</p>")

    again = F.when(k.isin(0, 3), "<p>then <b>Item 1. Business again</b></p>").otherwise("")
    hidden = f'<ix:header><xbrli:context id="c"><xbrli:entity><xbrli:identifier>1</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:instant>2020-12-31</xbrli:instant></xbrli:period></xbrli:context></ix:header>'  # noqa: F541
    figure = '<table><tr><td><ix:nonFraction name="q:Cash" contextRef="c">1,234</ix:nonFraction></td></tr></table>'
    body = _c(hidden, contents, part("1"), F.when(k == 1, part("1A")).otherwise(""), F.when(k == 3, "").otherwise(part("7")), again, figure)
    return _raw(table(spark, d, "supplier"), "s_suppkey", _html(body))


_PARTS = """w(k, seq, item, head, strategy, level) AS (VALUES
    (0, 0, '1', 'Item 1. Business', 'heading', 'medium'), (0, 1, '7', 'Item 7. Discussion and Analysis', 'heading', 'medium'),
    (1, 0, '1', 'Item 1. Business', 'toc', 'high'), (1, 1, '1A', 'Item 1A. Risk Factors', 'toc', 'high'), (1, 2, '7', 'Item 7. Discussion and Analysis', 'toc', 'high'),
    (2, 0, '1', 'Item 1. Business', 'toc', 'medium'), (2, 1, '7', 'Item 7. Discussion and Analysis', 'toc', 'medium'), (3, 0, '1', 'Item 1. Business', 'heading', 'low')),
    p AS (SELECT s_suppkey AS entity, s_name, s_acctbal, w.*, seq = max(seq) OVER (PARTITION BY s_suppkey) AS final FROM supplier JOIN w ON s_suppkey % 4 = k)"""
_BODY = "head || chr(10) || chr(10) || s_name || ' in ' || item || ', {word}' || chr(10) || chr(10) || 'Balance ' || s_acctbal"
_TEXT = _BODY + " || CASE WHEN final THEN CASE WHEN k IN (0, 3) THEN chr(10) || chr(10) || 'then Item 1. Business again' ELSE '' END || chr(10) || chr(10) || '1,234' ELSE '' END"
_TITLES = "CASE item WHEN '1' THEN 'Business' WHEN '1A' THEN 'Risk Factors' ELSE 'Management''s Discussion and Analysis' END"


def _entity(name: str = "accession") -> Column:
    return F.col(name).cast("long").alias("entity")


@query("sections_found", f"WITH {_PARTS} SELECT entity, CAST(seq AS INTEGER) AS seq, item, {_TITLES} AS title, head AS heading, strategy, level, 'narrative' AS kind FROM p")
def sections_found(spark, d) -> DataFrame:
    """Sections by contents where two items resolve, else by first headings, and their level."""
    s = sections.partition(written(shred(_supplier_pages(spark, d)), "nodes"))
    return s.select(_entity(), "seq", "item", "title", "heading", "strategy", "level", "kind")


@query("contents_links", """WITH w(k, n, item, target) AS (VALUES (1, 1, '1', 'i1'), (1, 2, '1A', 'i1A'), (1, 3, '7', 'i7'), (1, 4, '7', 'no'), (2, 1, '1', 'i1'), (2, 2, '8', 'no'), (2, 3, '7', 'i7'))
    SELECT s_suppkey AS entity, CAST(n AS INTEGER) AS n, item, target FROM supplier JOIN w ON s_suppkey % 4 = k""")
def contents_links(spark, d) -> DataFrame:
    """Links of contents tables whose row names an item, in order."""
    from pyspark.sql import Window

    a = sections.anchors(written(shred(_supplier_pages(spark, d), kinds=["element"]), "nodes"))
    return a.select(_entity(), F.row_number().over(Window.partitionBy("accession").orderBy("pos")).alias("n"), "item", "target")


def _supplier_sections(spark, d, word: str = "first") -> DataFrame:
    nodes = written(shred(_supplier_pages(spark, d, word)), "nodes")
    return sections.with_text(nodes, sections.partition(nodes))


@query("section_whole_texts", f"WITH {_PARTS} SELECT entity, item, {_TEXT.format(word='first')} AS text FROM p")
def section_whole_texts(spark, d) -> DataFrame:
    """The shown text of each section, blocks apart, without scripts and hidden headers."""
    return _supplier_sections(spark, d).select(_entity(), "item", "text")


@query("section_picks", f"""WITH {_PARTS}, q AS (SELECT *, lower({_TITLES}) AS title, lower(head) AS low FROM p),
    n AS (SELECT unnest(['RISK', '7', 'business', 'again', 'discussion and']) AS needle)
    SELECT 'get' AS which, needle, entity, item FROM q, n WHERE lower(item) = lower(needle) OR contains(title, lower(needle)) QUALIFY row_number() OVER (PARTITION BY entity, needle ORDER BY seq) = 1
    UNION ALL SELECT 'text', needle, entity, item FROM q, n WHERE lower(item) = lower(needle) OR contains(title, lower(needle)) OR contains(low, lower(needle))
    QUALIFY row_number() OVER (PARTITION BY entity, needle ORDER BY lower(item) <> lower(needle), seq) = 1""")
def section_picks(spark, d) -> DataFrame:
    """The section that a word names, for documents and for texts."""
    s = written(sections.partition(written(shred(_supplier_pages(spark, d)), "nodes")), "sections")
    out = None
    for needle in ("RISK", "7", "business", "again", "discussion and"):
        for which, pick in (("get", sections.pick_for_get), ("text", sections.pick_for_text)):
            one = pick(s, needle).select(F.lit(which).alias("which"), F.lit(needle).alias("needle"), _entity(), "item")
            out = one if out is None else out.unionByName(one)
    return out


# whole documents and their renderings

def _documents(spark, d, word: str = "first", year: int = 2021) -> DataFrame:
    s = table(spark, d, "supplier")
    accession = F.format_string("%010d-21-%06d", "s_suppkey", "s_suppkey")
    filings = s.select(F.col("s_suppkey").cast("long").alias("cik"), F.col("s_name").alias("company"), _c("S", F.col("s_suppkey")).alias("ticker"), F.lit("10-K").alias("form"), accession.alias("accession"), F.lit(f"{year}-02-03").cast("date").alias("filing_date"), F.lit(f"{year - 1}-12-31").cast("date").alias("report_date"), F.lit("a.htm").alias("primary_document"))
    found = _supplier_pages(spark, d, word).select(F.lit("/x/a.htm").alias("path"), F.lit("a.htm").alias("name"), X.fold_accession(F.format_string("%010d-21-%06d", F.col("accession").cast("long"), F.col("accession").cast("long"))).alias("folder"), F.col("accession").cast("long").alias("cik"), "content")
    return pipeline.documents(pipeline.Parsed(written(found, "landed"), written(filings, "filings")))


_ACC = "printf('%010d-21-%06d', entity, entity)"


@query("document_metadata", f"""WITH {_PARTS} SELECT entity, {_ACC} AS accession, min(s_name) AS company, '10-K' AS form, 'S' || entity AS ticker, '2021-02-03' AS filing_date, '2020-12-31' AS period_end,
    max(level) AS level, count(*) AS n_sections, 0 AS n_statements, '1.0.0' AS schema_version FROM p GROUP BY entity""")
def document_metadata(spark, d) -> DataFrame:
    """What a document says of its filing, its sections and its statements."""
    m = _documents(spark, d)
    return m.select(F.col("metadata.cik").alias("entity"), "accession", "metadata.company", "metadata.form", "metadata.ticker", "metadata.filing_date", "metadata.period_end", F.col("metadata.confidence.level").alias("level"), F.size("sections").cast("long").alias("n_sections"), F.size("statements").alias("n_statements"), "metadata.schema_version")


_MD_SECTION = f"'## Item ' || item || ' — ' || {_TITLES} || chr(10) || chr(10) || {_TEXT.format(word='first')} || chr(10) || chr(10)"


@query("document_markdown", f"""WITH {_PARTS} SELECT {_ACC} AS accession, '<!-- tabulon v0.1.0 schema 1.0.0 -->' || chr(10) || chr(10) || '# ' || min(s_name) || ' (S' || entity || ') 10-K — period ending 2020-12-31' || chr(10) || chr(10)
    || string_agg({_MD_SECTION}, '' ORDER BY seq) || '---' || chr(10) || chr(10) || '_schema 1.0.0 · parser 0.1.0 · confidence: ' || max(level) || '_' || chr(10) AS text FROM p GROUP BY entity""")
def document_markdown(spark, d) -> DataFrame:
    """Whole documents as Markdown."""
    return render.renderer("md")(_documents(spark, d)).select("accession", "text")


_TXT_HEAD = f"upper('Item ' || item || ' — ' || {_TITLES})"


@query("document_text", f"""WITH {_PARTS}, h AS (SELECT *, {_TXT_HEAD} AS top, s_name || ' (S' || entity || ') 10-K — period ending 2020-12-31' AS name FROM p)
    SELECT {_ACC} AS accession, min(name) || chr(10) || repeat('=', length(min(name))) || chr(10) || chr(10)
    || string_agg(top || chr(10) || repeat('-', length(top)) || chr(10) || {_TEXT.format(word='first')} || chr(10) || chr(10), '' ORDER BY seq) || '(schema 1.0.0; parser 0.1.0; confidence: ' || max(level) || ')' || chr(10) AS text FROM h GROUP BY entity""")
def document_text(spark, d) -> DataFrame:
    """Whole documents as plain text."""
    return render.renderer("text")(_documents(spark, d)).select("accession", "text")


@query("document_json", f"""WITH {_PARTS} SELECT {_ACC} AS accession, min(s_name) AS company, max(level) AS level, string_agg(item || ':' || {_TITLES} || ':' || length({_TEXT.format(word='first')}), '|' ORDER BY seq) AS sections, true AS indented FROM p GROUP BY entity""")
def document_json(spark, d) -> DataFrame:
    """Whole documents as JSON, read back."""
    j = render.renderer("json")(_documents(spark, d)).select("accession", "text", F.from_json("text", "metadata struct<company:string, confidence:struct<level:string>>, sections array<struct<item:string,title:string,text:string>>").alias("j"))
    line = F.array_join(F.transform("j.sections", lambda s: _c(s["item"], ":", s["title"], ":", F.length(s["text"]))), "|")
    return j.select("accession", "j.metadata.company", F.col("j.metadata.confidence.level").alias("level"), line.alias("sections"), F.col("text").contains('\n  "metadata"').alias("indented"))


def _changes(spark, d):
    pair = lambda x: x.withColumn("pair", F.col("metadata.ticker"))
    return written(pair(_documents(spark, d)), "before"), written(pair(_documents(spark, d, "second", 2022)), "after")


_CHANGED = f"s_name || ' in ' || item || ', "


@query("change_markdown", f"""WITH {_PARTS} SELECT 'S' || entity AS pair, '# Changes — ' || min(s_name) || ' 10-K 2020-12-31 → 2021-12-31' || chr(10) || chr(10) || '## Sections' || chr(10) || chr(10)
    || string_agg('### Item ' || item || ' — ' || {_TITLES} || chr(10) || chr(10) || '- − ' || {_CHANGED}first' || chr(10) || '- + ' || {_CHANGED}second' || chr(10) || chr(10), '' ORDER BY seq) AS text FROM p GROUP BY entity""")
def change_markdown(spark, d) -> DataFrame:
    """Two years of filings, compared by paragraph, as Markdown."""
    sets, _ = compare.compare(*_changes(spark, d))
    return render.changes_renderer("md")(sets).select("pair", "text")


@query("change_json", f"""WITH {_PARTS} SELECT 'S' || entity AS pair, '2020-12-31' AS before, '2021-12-31' AS after, string_agg(item || '=removed:' || {_CHANGED}first,added:' || {_CHANGED}second', '|' ORDER BY seq) AS changes FROM p GROUP BY entity""")
def change_json(spark, d) -> DataFrame:
    """The same as JSON, read back."""
    sets, _ = compare.compare(*_changes(spark, d))
    j = render.changes_renderer("json")(sets).select("pair", F.from_json("text", "prev struct<period_end:string>, curr struct<period_end:string>, sections array<struct<item:string,paragraphs:array<struct<kind:string,text:string>>>>").alias("j"))
    line = F.array_join(F.transform("j.sections", lambda s: _c(s["item"], "=", F.array_join(F.transform(s["paragraphs"], lambda p: _c(p["kind"], ":", p["text"])), ","))), "|")
    return j.select("pair", F.col("j.prev.period_end").alias("before"), F.col("j.curr.period_end").alias("after"), line.alias("changes"))


@query("change_words", f"""WITH {_PARTS} SELECT 'S' || entity AS pair, '# Lexical diff — ' || min(s_name) || ' 10-K 2020-12-31 → 2021-12-31' || chr(10) || chr(10)
    || string_agg('## Item ' || item || ' — ' || {_TITLES} || chr(10) || chr(10) || '**Paragraph 1**' || chr(10) || chr(10) || {_CHANGED}[-first-][+second+]' || chr(10) || chr(10), '' ORDER BY seq) AS text FROM p GROUP BY entity""")
def change_words(spark, d) -> DataFrame:
    """The lexical report of the same."""
    sets, words = compare.compare(*_changes(spark, d), layer="lexical")
    return render.lexical_markdown(sets, words).select("pair", "text")


# facts: customers' orders as tagged filings

def _order_nodes(spark, d) -> DataFrame:
    """A filing a customer. A context a year, of odd years with a segment; a figure and a note for
    each order, some marked nil, some with a context that isn't there."""
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    k = F.col("o_orderkey")
    ref = F.when(k % 11 == 0, "gone").otherwise(_c("c", F.col("year")))
    nil = F.when(k % 7 == 0, ' xsi:nil="true"').otherwise("")
    note = _c('<p><ix:nonNumeric name="q:Note" contextRef="', ref, '">', F.col("o_orderpriority"), "</ix:nonNumeric></p>")
    figure = _c('<p><ix:nonFraction name="q:Total" contextRef="', ref, '" unitRef="usd" scale="3"', nil, ">", k, "</ix:nonFraction></p>")
    body = _listed(o, "o_custkey", "o_orderkey", F.concat(note, figure), "body")
    years = o.select("o_custkey", "year").distinct()
    segment = F.when(F.col("year") % 2 == 1, '<xbrli:segment><xbrldi:explicitMember dimension="d">m</xbrldi:explicitMember></xbrli:segment>').otherwise("")
    ctx = _c('<xbrli:context id="c', F.col("year"), '"><xbrli:entity><xbrli:identifier>9</xbrli:identifier>', segment, "</xbrli:entity><xbrli:period>", F.when(F.col("year") % 3 == 0, _c("<xbrli:instant>", F.col("year"), "-12-31</xbrli:instant>")).otherwise(_c("<xbrli:startDate>", F.col("year"), "-01-01</xbrli:startDate><xbrli:endDate>", F.col("year"), "-12-31</xbrli:endDate>")), "</xbrli:period></xbrli:context>")
    head = _listed(years, "o_custkey", "year", ctx, "head")
    return shred(_raw(head.join(body, "o_custkey"), "o_custkey", _html(_c("<ix:header>", F.col("head"), "</ix:header>", F.col("body")))), kinds=["element"])


_TAGGED = """o AS (SELECT o_custkey AS entity, o_orderkey AS k, year(o_orderdate) AS y, o_orderpriority AS p FROM orders),
    f AS (SELECT entity, k, y, 0 AS part, 'q:Total' AS concept, CAST(k * 1000 AS DOUBLE) AS value, CAST(k AS VARCHAR) AS raw FROM o WHERE k % 11 <> 0 AND k % 7 <> 0
          UNION ALL SELECT entity, k, y, 1, 'q:Note', NULL, p FROM o WHERE k % 11 <> 0)"""


@query("tagged_facts", f"WITH {_TAGGED} SELECT entity, concept, 'c' || y AS context_ref, value, raw, CAST(row_number() OVER (PARTITION BY entity ORDER BY part, k) AS INTEGER) AS n FROM f")
def tagged_facts(spark, d) -> DataFrame:
    """Figures, then texts, without those marked nil and those without a context."""
    from pyspark.sql import Window

    nodes = written(_order_nodes(spark, d), "nodes")
    f = facts.facts(nodes, facts.contexts(nodes))
    return f.select(_entity(), "concept", "context_ref", "value", "raw", F.row_number().over(Window.partitionBy("accession").orderBy("seq")).alias("n"))


@query("reporting_contexts", """SELECT DISTINCT o_custkey AS entity, 'c' || year(o_orderdate) AS context_ref, year(o_orderdate) % 3 = 0 AS instant, year(o_orderdate) % 2 = 0 AS "primary", make_date(year(o_orderdate), 12, 31) AS period_end FROM orders""")
def reporting_contexts(spark, d) -> DataFrame:
    """Contexts, whether they are an instant's, and whether they have no segment."""
    c = facts.contexts(_order_nodes(spark, d))
    return c.select(_entity(), "context_ref", facts.is_instant().alias("instant"), facts.is_primary().alias("primary"), "period_end")


@query("usable_facts", f"WITH {_TAGGED} SELECT entity, concept, value, make_date(y, CASE WHEN y % 3 = 0 THEN 12 ELSE 1 END, CASE WHEN y % 3 = 0 THEN 31 ELSE 1 END) AS period_start FROM f WHERE part = 0 AND y % 2 = 0")
def usable_facts(spark, d) -> DataFrame:
    """Figures of contexts without segments, with their periods."""
    nodes = written(_order_nodes(spark, d), "nodes")
    c = written(facts.contexts(nodes), "contexts")
    return facts.usable(facts.facts(nodes, c), c).select(_entity(), "concept", "value", "period_start")


@query("dangling_facts", "SELECT o_custkey AS entity, count(*) FILTER (o_orderkey % 11 <> 0) + count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0) AS kept FROM orders GROUP BY ALL HAVING kept > 0")
def dangling_facts(spark, d) -> DataFrame:
    """How many facts of each filing have a context that is there."""
    nodes = written(_order_nodes(spark, d), "nodes")
    return facts.facts(nodes, facts.contexts(nodes)).groupBy("accession").agg(F.count("*").alias("kept")).select(_entity(), "kept")


# landed files

@query("landed_tickers", "SELECT 'T' || (s_suppkey % 7) AS ticker, max(s_suppkey) AS cik, arg_max(s_name, s_suppkey) AS title FROM supplier GROUP BY s_suppkey % 7")
def landed_tickers(spark, d) -> DataFrame:
    """The ticker file: of a ticker that stands twice the last counts."""
    one = F.struct(F.col("s_suppkey").cast("string").alias("k"), F.struct(F.col("s_suppkey").cast("long").alias("cik_str"), _c("t", F.col("s_suppkey") % 7).alias("ticker"), F.col("s_name").alias("title")).alias("v"))
    file = table(spark, d, "supplier").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(one)))).alias("j"))
    return landing.tickers(file.select(F.lit("company_tickers.json").alias("name"), F.encode("j", "UTF-8").alias("content"))).select("ticker", F.col("cik").cast("long").alias("cik"), "title")


_FILES = "CASE l_linenumber % 4 WHEN 0 THEN 'f' || l_linenumber || '_pre.xml' WHEN 1 THEN 'f' || l_linenumber || '.xsd' WHEN 2 THEN 'f' || l_linenumber || '_lab.xml' ELSE 'f.htm' END"


def _directories(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_FILES).alias("name")).distinct()
    items = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.struct("name").alias("i")))), lambda x: x["i"])
    j = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(items.alias("item")).alias("directory"))).alias("j"))
    return j.select(F.col("l_orderkey").cast("string").alias("folder"), F.lit("index.json").alias("name"), F.encode("j", "UTF-8").alias("content"))


@query("landed_directories", f"SELECT CAST(l_orderkey AS VARCHAR) AS folder, name, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS ordinal FROM (SELECT DISTINCT l_orderkey, l_linenumber, {_FILES} AS name FROM lineitem)")
def landed_directories(spark, d) -> DataFrame:
    """What each directory lists, in order."""
    return landing.directory(_directories(spark, d)).select("folder", "name", "ordinal")


@query("linkbase_files", f"""SELECT CAST(l_orderkey AS VARCHAR) AS folder, arg_min(name, l_linenumber) FILTER (name LIKE '%\\_pre.xml' ESCAPE '\\') AS pre, arg_min(name, l_linenumber) FILTER (name LIKE '%\\_lab.xml' ESCAPE '\\') AS lab, arg_min(name, l_linenumber) FILTER (name LIKE '%.xsd') AS xsd
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, {_FILES} AS name FROM lineitem) GROUP BY l_orderkey""")
def linkbase_files(spark, d) -> DataFrame:
    """The first file of each kind that a directory lists."""
    return landing.companions(landing.directory(_directories(spark, d))).select("folder", "pre", "lab", "xsd")


@query("first_bytes", "SELECT doc_id, left(printf('%08d ', doc_id) || repeat('x', CAST(n_chars AS INTEGER)), 200) AS head FROM documents")
def first_bytes(spark, d) -> DataFrame:
    """The first 200 bytes of each landed file."""
    t = table(spark, d, "documents").select("doc_id", F.encode(F.concat(F.format_string("%08d ", "doc_id"), F.repeat(F.lit("x"), F.col("n_chars").cast("int"))), "UTF-8").alias("content"))
    return landing.head(t).select("doc_id", F.decode("content", "UTF-8").alias("head"))


@query("index_addresses", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'https://x.test/a/' || o_orderkey WHEN 1 THEN 'https://www.sec.gov/b/' || o_orderkey ELSE 'https://y.test/' || o_custkey || '/c' || o_orderkey END AS url FROM orders""")
def index_addresses(spark, d) -> DataFrame:
    """Addresses of an index in full: whole ones, those from the root, and names beside it."""
    k = F.col("o_orderkey")
    ref = F.when(k % 3 == 0, _c("https://x.test/a/", k)).when(k % 3 == 1, _c("/b/", k)).otherwise(_c("c", k))
    return table(spark, d, "orders").select("o_orderkey", landing.resolved_url(_c("https://y.test/", F.col("o_custkey"), "/"), ref).alias("url"))


def _index_pages(spark, d) -> DataFrame:
    """A page an order: a filing index, an index without documents, or a tagged document."""
    k = F.col("o_orderkey")
    links = _c('<a href="/x/q-index.htm">i</a><a href="/x/pic.jpg">p</a><a href="/x/d', k, '.htm">d</a><a href="/x/e.htm">e</a>')
    page = F.when(k % 3 == 0, _c('<html><body><table summary="Document Format Files"><tr><td>', links, "</td></tr></table></body></html>"))
    page = page.when(k % 3 == 1, _html(_c('<table><tr><td><ix:nonFraction name="a" contextRef="c">', k + 100, ".5</ix:nonFraction></td></tr></table>"))).otherwise("plain words")
    return _raw(table(spark, d, "orders"), "o_orderkey", page)


@query("index_documents", "SELECT o_orderkey AS entity, '/x/d' || o_orderkey || '.htm' AS href FROM orders WHERE o_orderkey % 3 = 0")
def index_documents(spark, d) -> DataFrame:
    """The first document that a filing index links to."""
    return router.index_reference(shred(_index_pages(spark, d), kinds=["element"])).select(_entity(), "href")


@query("index_resolution", "SELECT o_orderkey AS entity, 'body ' || o_orderkey AS body FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def index_resolution(spark, d) -> DataFrame:
    """What indexes lead to, where it has landed."""
    raw = written(_index_pages(spark, d), "pages")
    classes = router.classify(raw, shred(raw, kinds=["element"]))
    k = F.col("o_orderkey")
    files = table(spark, d, "orders").filter(k % 2 == 0).select(k.cast("string").alias("accession"), _c("d", k, ".htm").alias("name"), F.encode(_c("body ", k), "UTF-8").alias("content"))
    return router.resolve(classes, files).select(_entity(), F.decode("content", "UTF-8").alias("body"))


@query("formats_read", """SELECT o_orderkey AS entity, CASE o_orderkey % 3 WHEN 1 THEN 'IXBRL' ELSE 'Unknown' END AS format, o_orderkey % 3 = 1 AS read FROM orders""")
def formats_read(spark, d) -> DataFrame:
    """Which documents are read, and which are refused."""
    raw = written(_index_pages(spark, d), "pages")
    c = written(router.classify(raw, shred(raw, kinds=["element"])), "classes")
    kept = router.supported(c).select(_entity(), "format", F.lit(True).alias("read"))
    return kept.unionByName(router.refused(c).select(_entity(), "format", F.lit(False).alias("read")))


# linkbases

@query("role_titles", "SELECT CAST(s_nationkey AS VARCHAR) AS accession, 'http://x/role/R' || s_suppkey AS role_uri, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '0' || s_suppkey || ' untitled' END AS title FROM supplier")
def role_titles(spark, d) -> DataFrame:
    """Titles of a schema's roles: what follows the last dash."""
    k = F.col("s_suppkey")
    definition = F.when(k % 2 == 0, _c("00", k, " - Statement - ", F.col("s_name"))).otherwise(_c(" 0", k, " untitled "))
    one = _c('<link:roleType roleURI="http://x/role/R', k, '"><link:definition>', definition, "</link:definition></link:roleType>")
    body = _listed(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", one, "b")
    text = _c('<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:link="http://www.xbrl.org/2003/linkbase"><xsd:annotation><xsd:appinfo>', F.col("b"), "</xsd:appinfo></xsd:annotation></xsd:schema>")
    return linkbase.role_titles(_raw(body, "s_nationkey", text)).select("accession", "role_uri", "title")


# tables by layout

def _brand_pages(spark, d) -> DataFrame:
    """A page a brand: a table a part, with one nested in a cell of its own."""
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, _c("<b>", F.col("p_name"), "</b>")).otherwise(F.col("p_name"))
    mark = F.when(k % 3 == 0, "<sup>a</sup>").when(k % 3 == 1, " (2)").otherwise("")
    rows = _c("<tr><td></td><td><b>Cost</b></td><td><b>Size</b></td></tr><tr><td></td><td><b>in $</b></td><td></td></tr><tr><td>", name, "</td><td>", F.col("p_retailprice"), mark, "</td><td>", F.col("p_size"), "</td></tr>")
    one = _c("<table>", rows, "</table><table><tr><td>outer<table><tr><td>inner ", k, "</td></tr></table></td></tr></table>")
    return _raw(_listed(table(spark, d, "part"), "p_brand", "p_partkey", one, "b"), "p_brand", _c("<html><body>", F.col("b"), "</body></html>"))


@query("page_tables", "SELECT p_brand AS brand, CAST(generate_series AS INTEGER) AS table_seq FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), LATERAL (SELECT unnest(range(0, CAST(3 * n AS BIGINT))) AS generate_series)")
def page_tables(spark, d) -> DataFrame:
    """All tables of a page, nested ones too, by number."""
    return layout.table_numbers(shred(_brand_pages(spark, d), kinds=["element"])).select(F.col("accession").alias("brand"), "table_seq")


@query("marked_cells", """WITH p AS (SELECT p_brand AS brand, p_partkey AS k, p_name, CAST(p_retailprice AS VARCHAR) AS price FROM part)
    SELECT brand, p_name AS text, k % 2 = 0 AS bold, '' AS notes, count(*) AS n FROM p GROUP BY ALL
    UNION ALL SELECT brand, price, false, CASE k % 3 WHEN 0 THEN 'a' WHEN 1 THEN '2' ELSE '' END, count(*) FROM p GROUP BY ALL""")
def marked_cells(spark, d) -> DataFrame:
    """Bold cells and footnote marks of labels and prices."""
    c = layout.cells(written(shred(_brand_pages(spark, d), kinds=["element"]), "nodes"))
    c = c.filter(~F.col("text").startswith("outer") & ~F.col("text").startswith("inner") & ~F.col("text").isin("Cost", "Size", "in $", "") & ~F.col("text").rlike(r"^\d{1,2}$"))
    return c.groupBy(F.col("accession").alias("brand"), "text", "bold", F.array_join("notes", ",").alias("notes")).agg(F.count("*").alias("n"))


@query("nearest_tables", "SELECT p_brand AS brand, count(*) AS tables, CAST(10 * count(*) AS BIGINT) AS own, count(*) AS nested FROM part GROUP BY p_brand")
def nearest_tables(spark, d) -> DataFrame:
    """Cells by the nearest table and row above them: those of tables in a cell aren't the outer's."""
    x = shred(_brand_pages(spark, d), kinds=["element"]).filter("kind = 'element' and tag = 'td'")
    inner = F.coalesce(F.col("text").startswith("inner"), F.lit(False))
    per = x.groupBy("accession", "table_pos").agg(F.count("*").alias("n"), F.bool_or(inner).alias("inner"))
    n = F.sum(F.when(F.col("n") == 9, 1).otherwise(0)).alias("tables")
    return per.groupBy(F.col("accession").alias("brand")).agg(n, F.sum(F.when(~F.col("inner"), F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(F.col("inner"), F.col("n")).otherwise(0)).alias("nested"))


@query("layout_labels", "SELECT p_brand AS brand, p_name AS label, 'Cost in $|Size' AS columns, count(*) AS n FROM part GROUP BY ALL")
def layout_labels(spark, d) -> DataFrame:
    """Columns that two header rows name together, and the label of each table's row."""
    t = layout.tables(written(shred(_brand_pages(spark, d), kinds=["element"]), "nodes")).filter(F.size("table.columns") == 2)
    t = t.select(F.col("accession").alias("brand"), F.explode("table.rows").alias("r"), F.array_join("table.columns.label", "|").alias("columns"))
    return t.groupBy("brand", F.col("r.label").alias("label"), "columns").agg(F.count("*").alias("n"))


# scalars

@query("layout_row_kinds", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'data' WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN 'total' ELSE 'subtotal' END AS type FROM part")
def layout_row_kinds(spark, d) -> DataFrame:
    label = F.when(F.col("p_size") % 2 == 0, _c(" Total ", F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.layout_row_type(label, F.col("p_size") % 3 == 0, F.col("p_size") % 5 == 0).alias("type"))


@query("structural_concepts", "SELECT p_partkey, p_size % 6 < 5 AND p_size % 6 > 0 AS structural FROM part")
def structural_concepts(spark, d) -> DataFrame:
    tails = F.array(*[F.lit(x) for x in ("", "Abstract", "Table", "Axis", "LineItems", "Tables")])
    return table(spark, d, "part").select("p_partkey", X.is_structural(_c("us-gaap:", F.replace("p_name", F.lit(" "), F.lit("")), F.get(tails, F.col("p_size") % 6))).alias("structural"))


@query("markdown_cells", r"SELECT l_orderkey, l_linenumber, l_returnflag || '\|' || l_linestatus || ' ' || l_linenumber AS cell FROM lineitem")
def markdown_cells(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.markdown_cell(_c(F.col("l_returnflag"), "|", F.col("l_linestatus"), "\n", F.col("l_linenumber"))).alias("cell"))


@query("section_titles", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'Item ' || p_size || ' — ' || p_name END AS title FROM part")
def section_titles(spark, d) -> DataFrame:
    item = F.when(F.col("p_size") % 6 == 0, F.lit(None)).when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", X.section_heading(item, F.col("p_name")).alias("title"))


@query("partition_levels", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 5 >= 2 THEN 'high' WHEN o_orderkey % 2 = 0 OR o_orderkey % 5 >= 2 THEN 'medium' ELSE 'low' END AS level FROM orders")
def partition_levels(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", X.partition_level(F.when(k % 2 == 0, "toc").otherwise("heading"), k % 3 == 0, k % 5).alias("level"))


# statements without cells

@query("empty_statements", "SELECT s_suppkey AS entity, CASE WHEN s_suppkey % 2 = 0 THEN 'a,b' ELSE 'a' END AS statements FROM supplier")
def empty_statements(spark, d) -> DataFrame:
    """Statements of structural rows alone are left out."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("accession"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("statement"))
    bare = (F.col("statement") == "b") & (F.col("accession").cast("long") % 2 == 1)
    rows = s.select("accession", "statement", F.lit("http://x/role/S").alias("role_uri"), F.lit("S").alias("title"), F.array(F.lit("x")).alias("path"), F.lit("q:X").alias("name"), F.lit("X").alias("label"), F.lit("").alias("preferred_label"), F.lit(0).alias("depth"), F.lit(False).alias("has_children"), bare.alias("structural"))
    nodes = written(_order_nodes(spark, d), "nodes")
    c = written(facts.contexts(nodes), "contexts")
    t = project.tables(rows, facts.facts(nodes, c), c)
    return t.groupBy("accession").agg(F.array_join(F.sort_array(F.collect_list("statement")), ",").alias("statements")).select(_entity(), "statements")


# kept results

def _store(spark, **versions) -> Store:
    return Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}", **versions)


@query("store_raw", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END || c_custkey AS body FROM customer")
def store_raw(spark, d) -> DataFrame:
    """Raw files by address: the last put stands."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    s = _store(spark)
    s.put_raw(c.select(k.cast("string").alias("url"), F.encode(_c("old", k), "UTF-8").alias("content")))
    s.put_raw(c.filter(k % 3 == 0).select(k.cast("string").alias("url"), F.encode(_c("new", k), "UTF-8").alias("content")))
    return s.raw().select(F.col("url").cast("long").alias("c_custkey"), F.decode("content", "UTF-8").alias("body"))


@query("store_fetching", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'kept' ELSE 'fetched' END || c_custkey AS body FROM customer WHERE c_custkey % 2 = 0")
def store_fetching(spark, d) -> DataFrame:
    """Wanted addresses: what is kept isn't fetched again."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    s = _store(spark)
    s.put_raw(c.filter(k % 3 == 0).select(k.cast("string").alias("url"), F.encode(_c("kept", k), "UTF-8").alias("content")))
    fetch = lambda urls: urls.select("url", F.encode(_c("fetched", F.col("url")), "UTF-8").alias("content"))
    got = s.fetching(c.filter(k % 2 == 0).select(k.cast("string").alias("url")), fetch)
    return got.select(F.col("url").cast("long").alias("c_custkey"), F.decode("content", "UTF-8").alias("body"))


@query("store_documents", "SELECT CAST(c_custkey AS VARCHAR) AS accession, '{\"n\":' || CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END || '}' AS document FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 5 = 0")
def store_documents(spark, d) -> DataFrame:
    """Parsed documents of these versions, the last put of each; what isn't JSON is missing."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    s = _store(spark)
    row = lambda x, text: x.select(k.cast("string").alias("accession"), text.alias("document"))
    s.put_documents(row(c, F.when(k % 4 == 0, F.lit("{n")).otherwise(F.lit('{"n":1}'))))
    s.put_documents(row(c.filter(k % 5 == 0), F.lit('{"n":2}')))
    Store(spark, s.root, schema_version="0").put_documents(row(c, F.lit('{"n":9}')))
    return s.documents().select("accession", "document")


# accuracy

def _scores(spark, d) -> DataFrame:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (k % 3 + 1).cast("int"))
    return s.select(F.format_string("f%04d", "s_suppkey").alias("name"), _c("T", k).alias("ticker"), F.lit("IXBRL").alias("format"), F.lit("high").alias("expected_confidence"), level.alias("got_confidence"), (k % 10).cast("long").alias("matched_cells"), F.lit(10).cast("long").alias("total_cells"), (k % 2).cast("long").alias("matched_sections"), F.lit(2).cast("long").alias("total_sections"))


@query("accuracy_report", """WITH s AS (SELECT *, s_suppkey % 10 AS m, s_suppkey % 2 AS q, s_suppkey % 3 AS g, CASE s_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level FROM supplier)
    SELECT 2 AS part, CAST(row_number() OVER (ORDER BY printf('f%04d', s_suppkey)) AS INTEGER) AS n, printf('%-10s %-7s %-14s %-6s→%-6s %9.1f%% %9.1f%%', printf('f%04d', s_suppkey), 'T' || s_suppkey, 'IXBRL', 'high', level, m * 10.0, q * 50.0) AS line FROM s
    UNION ALL SELECT 4, 0, printf('overall: statement accuracy %.1f%% (%d/%d), section coverage %.1f%% (%d/%d)', 10.0 * sum(m) / count(*), CAST(sum(m) AS BIGINT), 10 * count(*), 50.0 * sum(q) / count(*), CAST(sum(q) AS BIGINT), 2 * count(*)) FROM s
    UNION ALL SELECT 6, CAST(g + 1 AS INTEGER), printf('  %-6s %d filing(s): %.1f%% cell accuracy', level, count(*), 10.0 * sum(m) / count(*)) FROM s GROUP BY g, level""")
def accuracy_report(spark, d) -> DataFrame:
    """The printed report: filings by name, all of them, and each level."""
    r = accuracy.report(_scores(spark, d)).select("seq.part", "seq.n", "line")
    return r.filter("part in (2, 4, 6)")


@query("accuracy_sections", """SELECT printf('f%04d', s_suppkey) AS name, CAST(1 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS matched_sections, 3 AS total_sections FROM supplier""")
def accuracy_sections(spark, d) -> DataFrame:
    """How many of the expected sections each document has."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    name = F.format_string("f%04d", "s_suppkey").alias("name")
    item = lambda *xs: F.array(*[F.struct(F.lit(x).alias("item")) for x in xs])
    docs = s.select(name, F.when(k % 2 == 0, item("1", "7", "9", "9")).otherwise(item("1", "9", "9", "1")).alias("sections"))
    base = s.select(name, F.array(F.lit("1"), F.lit("7"), F.lit("8")).alias("sections"))
    return accuracy.sections(docs, base)


@query("role_statement_rows", """WITH w(seq, statement) AS (VALUES (0, 'income'), (2, 'balance')) SELECT s_suppkey AS entity, statement, CAST(seq AS INTEGER) AS role_seq FROM supplier, w WHERE seq = 0 OR s_suppkey % 2 = 0""")
def role_statement_rows(spark, d) -> DataFrame:
    """The rows of the roles that wanted statements take."""
    role = F.array(F.lit("StatementsOfIncome"), F.lit("StatementsOfIncomeDetails"), F.when(F.col("s_suppkey") % 2 == 0, "Balance-Sheets").otherwise("Other"))
    r = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("accession"), F.posexplode(F.transform(role, lambda x: F.concat(F.lit("http://x/role/"), x))).alias("role_seq", "role_uri"))
    return pipeline.statement_rows(r).select(_entity(), "statement", "role_seq")

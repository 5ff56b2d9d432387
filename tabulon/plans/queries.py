"""Queries of the filing operators over the analytic tables, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon import schemas as S
from tabulon.functions import scalars as X
from tabulon.operators import accuracy, compare, facts, filings, layout, linkbase, project, router, sections
from tabulon.plans import pipeline, render, views
from tabulon.plans.catalog import query
from tabulon.plans.views import FACTS, FILINGS, table
from tabulon.sources import landing
from tabulon.sources.scratch import written
from tabulon.sources.shred import shred

_KEPT = """cov AS (SELECT entity, year, count(*) AS n FROM v GROUP BY ALL),
    kept AS (SELECT entity, year, n, row_number() OVER (PARTITION BY entity ORDER BY year DESC) - 1 AS col_seq
             FROM (SELECT *, max(n) OVER (PARTITION BY entity) AS most FROM cov) WHERE n >= 0.5 * most),
    r AS (SELECT DISTINCT entity, concept FROM v),
    cells AS (SELECT r.entity, r.concept, kept.col_seq, kept.year, v.value FROM r JOIN kept USING (entity)
              LEFT JOIN v ON v.entity = r.entity AND v.concept = r.concept AND v.year = kept.year)"""
_LEVEL = "CASE WHEN {r} >= 0.95 AND {c} >= 0.95 THEN 'high' WHEN {r} >= 0.85 OR {c} BETWEEN 0.80 AND 0.95 THEN 'medium' ELSE 'low' END"
_RATES = """per AS (SELECT entity, concept, count(*) AS n, count(value) AS got FROM cells GROUP BY ALL),
    rates AS (SELECT entity, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_cells, CAST(sum(n - got) AS BIGINT) AS untagged,
              count(*) FILTER (n = got) / count(*) AS row_rate, sum(got) / sum(n) AS cell_rate FROM per GROUP BY entity)"""


def _sales(spark, d):
    v = views.facts(spark, d)
    return project.cells(views.as_rows(v), views.as_facts(v), views.as_contexts(v))


def _entity():
    return F.col("accession").cast("long").alias("entity")


@query("fact_pivot", f"WITH {FACTS}, {_KEPT} SELECT entity, concept, CAST(col_seq AS INTEGER) AS col_seq, value FROM cells")
def fact_pivot(spark, d) -> DataFrame:
    """Facts on the concepts of each entity and the years it presents, null where none is."""
    long, _ = _sales(spark, d)
    return long.select(_entity(), F.col("path")[0].alias("concept"), "col_seq", "value")


@query("fact_pivot_wide", f"WITH {FACTS}, {_KEPT} SELECT entity, concept, {', '.join(f'max(value) FILTER (col_seq = {i}) AS c{i}' for i in range(7))} FROM cells GROUP BY ALL")
def fact_pivot_wide(spark, d) -> DataFrame:
    long, _ = _sales(spark, d)
    return project.wide(long, 7).select(_entity(), F.col("path")[0].alias("concept"), *[F.col(str(i)).alias(f"c{i}") for i in range(7)])


@query("column_coverage", f"WITH {FACTS}, {_KEPT} SELECT entity, CAST(year AS VARCHAR) AS label, CAST(col_seq AS INTEGER) AS col_seq, n AS coverage FROM kept")
def column_coverage(spark, d) -> DataFrame:
    _, cols = _sales(spark, d)
    return cols.select(_entity(), "label", "col_seq", "coverage")


@query("table_confidence", f"WITH {FACTS}, {_KEPT}, {_RATES} SELECT entity, n_rows, n_cells, untagged, round(row_rate, 9) AS row_rate, round(cell_rate, 9) AS cell_rate, {_LEVEL.format(r='row_rate', c='cell_rate')} AS level FROM rates")
def table_confidence(spark, d) -> DataFrame:
    long, _ = _sales(spark, d)
    r = project.rates(long, ["accession"], ["path"])
    return r.select(_entity(), "n_rows", "n_cells", "untagged", F.round("row_rate", 9).alias("row_rate"), F.round("cell_rate", 9).alias("cell_rate"), "level")


@query("document_confidence", f"""WITH {FACTS}, {_KEPT}, {_RATES}, l AS (SELECT *, {_LEVEL.format(r='row_rate', c='cell_rate')} AS level FROM rates)
    SELECT s_nationkey AS nation, CASE WHEN bool_or(level = 'low') THEN 'low' WHEN bool_or(level = 'medium') OR s_nationkey % 3 = 0 THEN 'medium' ELSE 'high' END AS level,
    round(avg(row_rate), 6) AS row_rate, round(avg(cell_rate), 6) AS cell_rate, CAST(sum(untagged) AS BIGINT) AS untagged FROM l JOIN supplier ON entity = s_suppkey GROUP BY s_nationkey""")
def document_confidence(spark, d) -> DataFrame:
    """The suppliers of a nation as the statements of one document."""
    long, _ = _sales(spark, d)
    r = project.rates(long, ["accession"], ["path"])
    nation = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("accession"), F.col("s_nationkey").alias("nation"))
    t = F.struct("accession", project.confidence(F.col("level"), F.col("row_rate"), F.col("cell_rate"), F.col("untagged")).alias("confidence"))
    n = r.join(nation, "accession").groupBy("nation").agg(F.sort_array(F.collect_list(t)).alias("tables"))
    c = pipeline.combined(F.when(F.col("nation") % 3 == 0, "medium"), F.col("tables"))
    return n.select("nation", c["level"].alias("level"), F.round(c["row_match_rate"], 6).alias("row_rate"), F.round(c["cell_resolved_rate"], 6).alias("cell_rate"), c["untagged_cell_count"].alias("untagged"))


@query("last_fact_wins", "SELECT l_suppkey AS entity, l_returnflag AS concept, arg_max(l_extendedprice, l_orderkey * 8 + l_linenumber) AS value FROM lineitem GROUP BY ALL")
def last_fact_wins(spark, d) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("concept"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("value"))
    return facts.last_values(f, "entity", "concept")


_TOTAL = "CASE WHEN p_size % 7 = 0 THEN 'http://www.xbrl.org/2003/role/totalLabel' ELSE '' END"
_LABEL = "CASE WHEN p_size < 5 THEN 'Total ' || p_name ELSE p_name END"


@query("row_types", f"SELECT p_partkey, CASE WHEN {_TOTAL} <> '' OR starts_with(lower({_LABEL}), 'total') THEN 'total' WHEN p_size % 2 = 0 THEN 'subtotal' ELSE 'data' END AS type FROM part")
def row_types(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.row_type(F.expr(_TOTAL), F.expr(_LABEL), F.expr("p_size % 2 = 0")).alias("type"))


_BALANCES = """y AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    b AS (SELECT nation, year, cents / 100 AS flow, sum(cents) OVER (PARTITION BY nation ORDER BY year) / 100 AS balance FROM y)"""


@query("period_boundary_lookup", f"""WITH {_BALANCES},
    c AS (SELECT nation, 'd' || year AS ref, make_date(year, 1, 1) AS s, make_date(year, 12, 31) AS e FROM b UNION ALL SELECT nation, 'i' || year, make_date(year, 12, 31), make_date(year, 12, 31) FROM b),
    i AS (SELECT nation, make_date(year, 12, 31) AS day, balance FROM b)
    SELECT c.nation, c.ref, 'start' AS line, coalesce(x.balance, z.balance) AS value FROM c LEFT JOIN i x ON x.nation = c.nation AND x.day = c.s - INTERVAL 1 DAY LEFT JOIN i z ON z.nation = c.nation AND z.day = c.s
    UNION ALL SELECT c.nation, c.ref, 'flow', b.flow FROM c LEFT JOIN b ON b.nation = c.nation AND c.ref = 'd' || b.year
    UNION ALL SELECT c.nation, c.ref, 'end', i.balance FROM c LEFT JOIN i ON i.nation = c.nation AND i.day = c.e""")
def period_boundary_lookup(spark, d) -> DataFrame:
    """Opening and closing balances beside a flow, at the boundaries of each period."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy(F.col("c_nationkey").cast("string").alias("accession"), F.year("o_orderdate").alias("year")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    from pyspark.sql import Window

    b = y.withColumn("balance", F.sum("cents").over(Window.partitionBy("accession").orderBy("year")) / 100).withColumn("flow", F.col("cents") / 100)
    two = b.select("accession", "year", F.explode(F.array(F.struct(F.lit("flow").alias("concept"), F.concat(F.lit("d"), "year").alias("context_ref"), F.col("flow").alias("value")), F.struct(F.lit("balance").alias("concept"), F.concat(F.lit("i"), "year").alias("context_ref"), F.col("balance").alias("value")))).alias("f")).select("accession", "year", "f.*")
    f = two.select("accession", F.struct(F.lit(0), F.col("year")).alias("seq"), "concept", "context_ref", F.lit(True).alias("numeric"), F.lit(False).alias("unparsed"), "value")
    day = lambda m, n: F.make_date("year", F.lit(m), F.lit(n))
    start = F.when(F.col("concept") == "flow", day(1, 1)).otherwise(day(12, 31))
    ctx = two.select("accession", "context_ref", start.alias("period_start"), day(12, 31).alias("period_end"), F.array().cast("array<struct<dimension:string,member:string>>").alias("segments"), F.lit(True).alias("valid"))
    lines = spark.createDataFrame([("start", "balance", S.PERIOD_START), ("flow", "flow", ""), ("end", "balance", S.PERIOD_END)], "line string, name string, preferred_label string")
    rows = b.select("accession").distinct().crossJoin(F.broadcast(lines)).select("accession", F.lit("cash").alias("statement"), F.lit("").alias("role_uri"), F.lit("").alias("title"), F.array("line").alias("path"), "name", F.col("name").alias("label"), "preferred_label", F.lit(0).alias("depth"), F.lit(False).alias("has_children"), F.lit(False).alias("structural"))
    long, cols = project.cells(rows, f, ctx)
    return long.join(cols.select("accession", "statement", "col_seq", "context_ref"), ["accession", "statement", "col_seq"]).select(F.col("accession").cast("int").alias("nation"), F.col("context_ref").alias("ref"), F.col("path")[0].alias("line"), "value")


@query("latest_filing", f"WITH {FILINGS} SELECT cik, form, accession, filing_date FROM f QUALIFY row_number() OVER (PARTITION BY cik, form ORDER BY filing_date DESC, accession DESC) = 1")
def latest_filing(spark, d) -> DataFrame:
    return filings.latest(views.filings(spark, d), "cik", "form").select("cik", "form", "accession", "filing_date")


@query("filing_for_year", f"WITH {FILINGS} SELECT cik, form, accession, filing_date FROM f WHERE filing_date BETWEEN '1997-01-01' AND '1997-12-31' QUALIFY row_number() OVER (PARTITION BY cik, form ORDER BY filing_date DESC, accession DESC) = 1")
def filing_for_year(spark, d) -> DataFrame:
    return filings.latest(filings.in_year(views.filings(spark, d), 1997), "cik", "form").select("cik", "form", "accession", "filing_date")


@query("filings_in_order", f"WITH {FILINGS} SELECT cik, accession, CAST(row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) AS INTEGER) AS nth FROM f")
def filings_in_order(spark, d) -> DataFrame:
    return filings.in_order(views.filings(spark, d), "cik").select("cik", "accession", "nth")


@query("filing_selection", f"WITH {FILINGS} SELECT cik, accession, filing_date FROM f WHERE form = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) = 1")
def filing_selection(spark, d) -> DataFrame:
    """The latest filing of exactly one form for each company."""
    return filings.select(views.filings(spark, d), "1-URGENT").select("cik", "accession", "filing_date")


@query("filing_by_accession", f"WITH {FILINGS}, n AS (SELECT upper(replace(max(accession), '-', '')) AS needle FROM f) SELECT cik, accession, form FROM f, n WHERE lower(replace(accession, '-', '')) = lower(needle)")
def filing_by_accession(spark, d) -> DataFrame:
    f = views.filings(spark, d)
    needle = f.agg(F.upper(F.replace(F.max("accession"), F.lit("-"), F.lit(""))).alias("n")).collect()[0]["n"]
    return filings.by_accession(f, needle).select("cik", "accession", "form")


_REQUESTS = "q AS (SELECT c_custkey, '  ' || lower(replace(c_mktsegment, 'MACHINERY', 'Nowhere')) || ' ' AS ticker FROM customer)"
_TICKERS = "t AS (SELECT p_brand, 0 AS x FROM part), k AS (SELECT * FROM (VALUES ('AUTOMOBILE', 11), ('BUILDING', 12), ('FURNITURE', 13), ('HOUSEHOLD', 14)) AS v(ticker, cik))"


def _asked(spark, d):
    q = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), F.lower(F.replace("c_mktsegment", F.lit("MACHINERY"), F.lit("Nowhere"))), F.lit(" ")).alias("ticker"))
    k = spark.createDataFrame([("AUTOMOBILE", 11), ("BUILDING", 12), ("FURNITURE", 13), ("HOUSEHOLD", 14)], "ticker string, cik int")
    return filings.with_cik(q, k)


@query("ticker_lookup", f"WITH {_REQUESTS}, {_TICKERS} SELECT c_custkey, k.ticker, k.cik FROM q JOIN k ON upper(trim(q.ticker)) = k.ticker")
def ticker_lookup(spark, d) -> DataFrame:
    return _asked(spark, d)[0].select("c_custkey", "ticker", "cik")


@query("unknown_tickers", f"WITH {_REQUESTS}, {_TICKERS} SELECT c_custkey, upper(trim(q.ticker)) AS ticker FROM q ANTI JOIN k ON upper(trim(q.ticker)) = k.ticker")
def unknown_tickers(spark, d) -> DataFrame:
    return _asked(spark, d)[1].select("c_custkey", "ticker")


_SIDES = """p AS (SELECT entity, concept, max(value) FILTER (year = 1997) AS a97, max(value) FILTER (year = 1998) AS a98 FROM v WHERE year BETWEEN 1995 AND 1998 GROUP BY ALL),
    c AS (SELECT entity, concept, max(value) FILTER (year = 1997) AS b97, max(value) FILTER (year = 1998) AS b98 FROM w WHERE year BETWEEN 1997 AND 2000 GROUP BY ALL),
    j AS (SELECT coalesce(p.entity, c.entity) AS entity, coalesce(p.concept, c.concept) AS concept, p.concept IS NULL AS added, c.concept IS NULL AS removed, a97, a98, b97, b98 FROM p FULL JOIN c ON p.entity = c.entity AND p.concept = c.concept
          WHERE coalesce(p.entity, c.entity) IN (SELECT entity FROM p) AND coalesce(p.entity, c.entity) IN (SELECT entity FROM c)),
    s AS (SELECT *, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN a97 IS DISTINCT FROM b97 OR a98 IS DISTINCT FROM b98 THEN 'changed' ELSE 'unchanged' END AS status FROM j)"""
_RESTATED = "w AS (SELECT entity, concept, year, CASE WHEN year = 1997 AND entity % 3 = 0 THEN value + 100 ELSE value END AS value FROM v WHERE NOT (entity % 5 = 0 AND concept = 'Brand#7'))"


def _pair_sides(spark, d):
    v = written(views.facts(spark, d), "facts")
    w = v.filter(~((F.col("entity") % 5 == 0) & (F.col("concept") == "Brand#7"))).withColumn("value", F.when((F.col("year") == 1997) & (F.col("entity") % 3 == 0), F.col("value") + 100).otherwise(F.col("value")))
    return views.statements(v, (1995, 1998)), views.statements(w, (1997, 2000))


@query("statement_diff", f"""WITH {FACTS}, {_RESTATED}, {_SIDES}, x AS (SELECT entity, concept, status, '1998' AS period, a98 AS prev, b98 AS curr FROM s UNION ALL SELECT entity, concept, status, '1997', a97, b97 FROM s)
    SELECT entity, concept, status, period, prev, curr, round(curr - prev, 2) AS abs, round(CASE WHEN prev <> 0 THEN (curr - prev) / prev * 100 END, 6) AS pct FROM x""")
def statement_diff(spark, d) -> DataFrame:
    """Sales of 1995 to 1998 against restated sales of 1997 to 2000, by brand and common year."""
    r = compare.row_deltas(*_pair_sides(spark, d))
    x = r.select(F.col("pair").alias("entity"), "concept", "status", F.explode("cells").alias("x"))
    return x.select("entity", "concept", "status", "x.period", "x.prev", "x.curr", F.round("x.abs", 2).alias("abs"), F.round("x.pct", 6).alias("pct"))


@query("row_status", f"WITH {FACTS}, {_RESTATED}, {_SIDES} SELECT status, count(*) AS n FROM s GROUP BY status")
def row_status(spark, d) -> DataFrame:
    return compare.row_deltas(*_pair_sides(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("period_overlap", f"WITH {FACTS}, e AS (SELECT entity FROM v WHERE year BETWEEN 1995 AND 1998 INTERSECT SELECT entity FROM v WHERE year BETWEEN 1997 AND 2000) SELECT entity, '1998,1997' AS periods, '0,1' AS prev_at, '2,3' AS curr_at FROM e")
def period_overlap(spark, d) -> DataFrame:
    m = compare.matched_statements(*_pair_sides(spark, d))
    joined = lambda c: F.array_join(F.transform("periods", lambda p: p[c].cast("string")), ",")
    return m.select(F.col("pair").alias("entity"), joined("label").alias("periods"), joined("i").alias("prev_at"), joined("j").alias("curr_at"))


def _talks(spark, d):
    """Consecutive conversations as two filings; a turn is a section, a line a paragraph."""
    c = table(spark, d, "conversations").select((F.col("conv_id") - F.col("conv_id") % 2).alias("pair"), (F.col("conv_id") % 2).alias("side"), "turn", F.struct("turn", F.col("turn").cast("string").alias("item"), F.col("role").alias("title"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("text")).alias("s"))
    g = c.groupBy("pair", "side").agg(F.sort_array(F.collect_list("s")).alias("sections")).filter("pair is not null")
    return g.filter("side = 0").drop("side"), g.filter("side = 1").drop("side")


_TALKS = """n AS (SELECT conv_id - conv_id % 2 AS pair, conv_id % 2 AS side, turn, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10) || chr(160))), lambda x: x <> '') AS ps FROM conversations),
    p AS (SELECT * FROM n WHERE side = 0), c AS (SELECT * FROM n WHERE side = 1)"""


@query("section_diff_join", f"""WITH {_TALKS} SELECT coalesce(p.pair, c.pair) AS pair, CAST(coalesce(p.turn, c.turn) AS VARCHAR) AS item, c.pair IS NULL AS gone FROM p FULL JOIN c ON p.pair = c.pair AND p.turn = c.turn
    WHERE coalesce(p.ps, []) IS DISTINCT FROM coalesce(c.ps, [])""")
def section_diff_join(spark, d) -> DataFrame:
    """Sections that differ between two filings, whether or not both have them."""
    return compare.section_changes(*_talks(spark, d)).select("pair", "item", (F.col("n.gone") == 1).alias("gone"))


@query("paragraph_lcs")
def paragraph_lcs(spark, d) -> DataFrame:
    """The edit script of each changed section, a row a paragraph."""
    c = compare.section_changes(*_talks(spark, d))
    return c.select("pair", "item", F.posexplode("paragraphs").alias("n", "p")).select("pair", "item", "n", "p.kind", "p.text")


@query("paragraph_added_removed", f"""WITH {_TALKS}, a AS (SELECT pair, turn, unnest(ps) AS t, 1 AS k FROM p UNION ALL SELECT pair, turn, unnest(ps), -1 FROM c)
    SELECT pair, CAST(turn AS VARCHAR) AS item, CAST(sum(CASE WHEN b > 0 THEN b ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN b < 0 THEN -b ELSE 0 END) AS BIGINT) AS added
    FROM (SELECT pair, turn, t, sum(k) AS b FROM a GROUP BY ALL) WHERE b <> 0 GROUP BY ALL""")
def paragraph_added_removed(spark, d) -> DataFrame:
    """Paragraphs that one side has more often than the other, whatever their order."""
    p, c = _talks(spark, d)
    return compare.paragraph_balance(p, c)


@query("lexical_markup")
def lexical_markup(spark, d) -> DataFrame:
    """Changed sections word by word."""
    x = compare.lexical(compare.section_changes(*_talks(spark, d)))
    return x.select("pair", "item", F.posexplode("paragraphs").alias("k", "text"))


@query("section_spans", """SELECT conv_id, turn AS pos, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), total) AS end_pos, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq
    FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) + 1 AS total FROM conversations) WHERE role = 'user'""")
def section_spans(spark, d) -> DataFrame:
    """Questions as starts of sections that reach to the next."""
    c = table(spark, d, "conversations")
    starts = c.filter("role = 'user'").select(F.col("conv_id").alias("accession"), F.col("turn").alias("pos"), F.col("turn").alias("seq"))
    total = c.groupBy(F.col("conv_id").alias("accession")).agg((F.max("turn") + 1).alias("total"))
    return sections.spans(starts, total).select(F.col("accession").alias("conv_id"), "pos", "end_pos", "seq")


_BLOCKS = """t AS (SELECT *, coalesce(count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM conversations),
    b AS (SELECT conv_id, {by} block, trim(regexp_replace(string_agg(coalesce(text, ''), '' ORDER BY turn), '\\s+', ' ', 'g')) AS body FROM t GROUP BY ALL)"""


@query("section_text", f"WITH {_BLOCKS.format(by='')} SELECT conv_id, string_agg(body, chr(10) || chr(10) ORDER BY block) AS text FROM b WHERE body <> '' GROUP BY conv_id")
def section_text(spark, d) -> DataFrame:
    """Shown text in blocks that answers end."""
    return sections.render_text(views.turns(spark, d)).select(F.col("accession").cast("long").alias("conv_id"), "text")


@query("section_text_ranges", """WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section, coalesce(count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM conversations),
    b AS (SELECT conv_id, section, block, trim(regexp_replace(string_agg(coalesce(text, ''), '' ORDER BY turn), '\\s+', ' ', 'g')) AS body FROM s WHERE section > 0 GROUP BY ALL)
    SELECT conv_id, CAST(section - 1 AS INTEGER) AS seq, string_agg(body, chr(10) || chr(10) ORDER BY block) AS text FROM b WHERE body <> '' GROUP BY ALL""")
def section_text_ranges(spark, d) -> DataFrame:
    """The same by section: each piece belongs to the last start before it."""
    t = views.turns(spark, d)
    starts = t.filter("kind = 'text' and role = 'user'").select("accession", "pos", F.col("pos").alias("seq"))
    parts = sections.spans(starts, t.groupBy("accession").agg((F.max("pos") + 1).alias("total")))
    return sections.render_text(t, parts).select(F.col("accession").cast("long").alias("conv_id"), "seq", "text")


@query("section_lines", f"""WITH {_BLOCKS.format(by='')}, x AS (SELECT conv_id, string_agg(body, chr(10) || chr(10) ORDER BY block) AS text, count(*) AS n FROM b WHERE body <> '' GROUP BY conv_id)
    SELECT conv_id, 'Item ' || conv_id || chr(9) || 'Talk' || chr(9) || octet_length(encode(text)) || ' chars' || chr(9) || n || ' paragraphs' AS line FROM x""")
def section_lines(spark, d) -> DataFrame:
    t = sections.render_text(views.turns(spark, d)).withColumn("item", F.col("accession")).withColumn("title", F.lit("Talk"))
    return sections.tsv(t).select(F.col("accession").cast("long").alias("conv_id"), "line")


@query("section_formats", """WITH t AS (SELECT l_orderkey AS o, l_linenumber AS pos, l_returnflag = 'R' AS tagged, l_linestatus AS item FROM lineitem),
    s AS (SELECT o, arg_min(item, pos) AS first FROM t GROUP BY o), m AS (SELECT t.o, count(*) AS n FROM t GROUP BY t.o),
    e AS (SELECT o, item, pos, tagged, max(CASE WHEN pos % 3 = 1 THEN pos END) OVER (PARTITION BY o ORDER BY pos) AS start FROM t),
    f AS (SELECT o, start, bool_or(tagged) AS tagged FROM e WHERE start IS NOT NULL GROUP BY ALL)
    SELECT o AS orderkey, string_agg('S' || start || '=' || CASE WHEN tagged THEN 'IXBRL' ELSE 'PlainHTML' END, ',' ORDER BY start) AS formats FROM f GROUP BY o""")
def section_formats(spark, d) -> DataFrame:
    """Whether a section has a table with a tagged figure; lines of orders as tables, every third
    one starts a section."""
    li = table(spark, d, "lineitem")
    nodes = li.select(F.col("l_orderkey").cast("string").alias("accession"), F.lit("element").alias("kind"), F.lit("table").alias("tag"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("n_figures"))
    parts = li.filter("l_linenumber % 3 = 1").select(F.col("l_orderkey").cast("string").alias("accession"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") + 1).alias("end_pos"), F.concat(F.lit("S"), "l_linenumber").alias("item"))
    f = sections.formats(nodes, parts)
    return f.select(F.col("accession").cast("long").alias("orderkey"), F.array_join(F.transform(F.sort_array(F.map_entries("formats")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("formats"))


@query("toc_election", """WITH n AS (SELECT o_custkey AS custkey, CAST(year(o_orderdate) AS INTEGER) AS y, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY ALL)
    SELECT custkey, y AS table_pos, n AS n_items FROM n QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY n DESC, y) = 1 AND n >= 2""")
def toc_election(spark, d) -> DataFrame:
    """The table with most distinct items, the first of equals; years of a customer's orders as tables."""
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("accession"), F.year("o_orderdate").alias("table_pos"), F.col("o_orderpriority").alias("item"))
    return sections.contents_tables(a).select(F.col("accession").alias("custkey"), "table_pos", "n_items")


def _page_nodes(spark, d):
    return shred(table(spark, d, "pages"), "page_id", "html")


@query("render_text")
def render_text(spark, d) -> DataFrame:
    """Every page as text."""
    return sections.render_text(_page_nodes(spark, d)).select(F.col("accession").cast("long").alias("page_id"), "text")


@query("page_anchors", "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n, a AS href FROM (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS a FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages))")
def page_anchors(spark, d) -> DataFrame:
    """The links of every page, in order."""
    from pyspark.sql import Window

    a = _page_nodes(spark, d).filter("kind = 'element' and tag = 'a'")
    return a.select(F.col("accession").cast("long").alias("page_id"), F.row_number().over(Window.partitionBy("accession").orderBy("pos")).cast("long").alias("n"), F.col("attrs")["href"].alias("href"))


@query("page_headings", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6]|b|strong)>')) FROM pages) GROUP BY page_id")
def page_headings(spark, d) -> DataFrame:
    """How many headings every page has."""
    h = _page_nodes(spark, d).filter("kind = 'element'").filter(F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6", "b", "strong") | X.is_bold_style(F.col("attrs")["style"]))
    return h.groupBy(F.col("accession").cast("long").alias("page_id")).agg(F.count("*").alias("n"))


@query("format_classify", """SELECT page_id, CASE WHEN contains(lower(left(html, 65536)), '<html') THEN 'PlainHTML' WHEN contains(lower(html), '<sec-document>') OR contains(lower(html), '<document>') OR contains(lower(html), '<type>') THEN 'PlainText' ELSE 'Unknown' END AS format,
    CAST(0 AS BIGINT) AS numeric FROM pages""")
def format_classify(spark, d) -> DataFrame:
    raw = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("accession"), F.encode("html", "UTF-8").alias("content"))
    return router.classify(raw, shred(raw)).select(F.col("accession").cast("long").alias("page_id"), "format", F.col("numeric").cast("long").alias("numeric"))


_FIGURE = "CASE l_linenumber % 5 WHEN 0 THEN '$ ' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) WHEN 1 THEN '(' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ')' WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) * 50 AS VARCHAR) WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5%' ELSE l_returnflag || '1' END"


@query("tag_density", f"""WITH c AS (SELECT l_suppkey AS supp, {_FIGURE} AS t, l_tax > 0.04 AS tagged FROM lineitem), f AS (SELECT *, regexp_replace(t, '[\\s$,()%]', '', 'g') AS x FROM c),
    g AS (SELECT *, coalesce(CASE WHEN contains(x, '.') THEN TRY_CAST(x AS DOUBLE) IS NOT NULL ELSE abs(TRY_CAST(x AS DOUBLE)) >= 100 AND NOT abs(TRY_CAST(x AS DOUBLE)) BETWEEN 1900 AND 2100 END, false) AS figure FROM f)
    SELECT supp, count(*) FILTER (figure) AS numeric, count(*) FILTER (figure AND tagged) AS tagged FROM g GROUP BY supp""")
def tag_density(spark, d) -> DataFrame:
    """Figures and tagged figures of each supplier's lines as cells."""
    nodes = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("accession"), F.lit("element").alias("kind"), F.lit("td").alias("tag"), F.expr(_FIGURE.replace("VARCHAR", "STRING")).alias("text"), F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("n_ix"))
    return router.density(nodes).select(F.col("accession").cast("long").alias("supp"), "numeric", "tagged")


_RAW = "CASE o_orderkey % 6 WHEN 0 THEN '(' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ')' WHEN 1 THEN '—' WHEN 2 THEN '$ ' || regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') WHEN 3 THEN 'n/a' WHEN 4 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) ELSE '-' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END"


def _raw_figures(spark, d):
    o = table(spark, d, "orders")
    whole = F.floor("o_totalprice").cast("long")
    k = F.col("o_orderkey") % 6
    grouped = F.format_number(whole.cast("decimal(20,0)"), 0)
    raw = F.when(k == 0, F.concat(F.lit("("), grouped, F.lit(")"))).when(k == 1, "—").when(k == 2, F.concat(F.lit("$ "), X.decimal_text(F.col("o_totalprice")))).when(k == 3, "n/a").when(k == 4, grouped).otherwise(F.concat(F.lit("-"), whole.cast("string")))
    return o.select(F.col("o_orderkey").alias("orderkey"), raw.alias("raw"), F.col("o_orderstatus").alias("status"))


_NUM = "TRY_CAST(nullif(regexp_replace(CASE WHEN starts_with(raw, '(') THEN raw[2:-2] ELSE raw END, '[^0-9.+-]', '', 'g'), '') AS DOUBLE)"


@query("fact_numbers", f"""WITH r AS (SELECT o_orderkey AS orderkey, {_RAW} AS raw, o_orderstatus AS status FROM orders)
    SELECT orderkey, CASE WHEN raw = '—' THEN 0.0 WHEN starts_with(raw, '(') OR status = 'F' THEN -{_NUM} * 1000 ELSE {_NUM} * 1000 END AS value FROM r""")
def fact_numbers(spark, d) -> DataFrame:
    """Tagged figures in thousands: parentheses and sign negate, a dash is zero."""
    r = _raw_figures(spark, d)
    return r.select("orderkey", X.fact_value(F.col("raw"), F.lit("3"), F.when(F.col("status") == "F", "-"), F.lit("ixt:num-dot-decimal")).alias("value"))


@query("layout_numbers", f"WITH r AS (SELECT o_orderkey AS orderkey, {_RAW} AS raw FROM orders) SELECT orderkey, CASE WHEN raw = '—' THEN NULL WHEN starts_with(raw, '(') THEN -{_NUM} ELSE {_NUM} END AS value FROM r")
def layout_numbers(spark, d) -> DataFrame:
    """Shown figures: a dash is no value."""
    return _raw_figures(spark, d).select("orderkey", X.layout_value(F.col("raw")).alias("value"))


@query("normalized_numbers", f"WITH r AS (SELECT o_orderkey AS orderkey, {_RAW} AS raw FROM orders) SELECT orderkey, regexp_replace(raw, '[^0-9.+-]', '', 'g') AS plain, replace(regexp_replace(raw, '[^0-9,+-]', '', 'g'), ',', '.') AS comma FROM r")
def normalized_numbers(spark, d) -> DataFrame:
    r = _raw_figures(spark, d)
    return r.select("orderkey", X.normalize_number(F.col("raw")).alias("plain"), X.normalize_number(F.col("raw"), True).alias("comma"))


@query("footnotes", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_name || '(123)' ELSE '(' || (p_size % 10) || ')' END AS text, CASE WHEN p_size % 3 = 0 THEN CAST(p_size % 10 AS VARCHAR) END AS mark FROM part")
def footnotes(spark, d) -> DataFrame:
    """Closing marks off labels; three characters, or nothing before, are no mark."""
    n = (F.col("p_size") % 10).cast("string")
    k = F.col("p_size") % 3
    t = F.when(k == 0, F.concat("p_name", F.lit(" ("), n, F.lit(")"))).when(k == 1, F.concat("p_name", F.lit("(123)"))).otherwise(F.concat(F.lit("("), n, F.lit(")")))
    p = table(spark, d, "part").withColumn("t", t)
    return p.select("p_partkey", X.without_footnote(F.col("t")).alias("text"), X.footnote(F.col("t")).alias("mark"))


@query("collapse_spaces", r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))) AS digest FROM documents")
def collapse_spaces(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(X.collapse_spaces(F.col("text")), "UTF-8")).alias("digest"))


@query("concept_names", """WITH h AS (SELECT p_partkey, 'a.xsd#us_' || replace(initcap_name, ' ', '') AS href FROM (SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS initcap_name FROM part))
    SELECT p_partkey, 'us:' || href[10:] AS concept, trim(regexp_replace(href[10:], '([A-Z])', ' \\1', 'g')) AS words FROM h""")
def concept_names(spark, d) -> DataFrame:
    """Concepts of locators, and their names in words."""
    href = F.concat(F.lit("a.xsd#us_"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))
    c = X.concept_of_href(href)
    return table(spark, d, "part").select("p_partkey", c.alias("concept"), X.humanize(c).alias("words"))


@query("label_fallback", """WITH l AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS t, CASE WHEN p_size % 3 = 0 THEN p_brand END AS s, CASE WHEN p_size % 5 = 0 THEN p_type END AS z FROM part)
    SELECT p_partkey, coalesce(nullif(t, ''), s, z, 'Only Concept') AS label FROM l""")
def label_fallback(spark, d) -> DataFrame:
    """Preferred (total) label, standard label, another role's, else the concept in words."""
    size = F.col("p_size")
    entries = F.array(F.struct(F.lit(S.TOTAL).alias("k"), F.when(size % 2 == 0, F.col("p_name")).otherwise("").alias("v")), F.struct(F.lit(S.LABEL).alias("k"), F.when(size % 3 == 0, F.col("p_brand")).alias("v")), F.struct(F.lit("http://x.test/z").alias("k"), F.when(size % 5 == 0, F.col("p_type")).alias("v")))
    texts = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return table(spark, d, "part").select("p_partkey", linkbase.label_of(texts, F.lit(S.TOTAL), F.lit("us:OnlyConcept")).alias("label"))


@query("role_select", """WITH u AS (SELECT p_brand AS accession, p_partkey AS role_seq, regexp_replace(lower(p_name || p_type || CASE WHEN p_size > 40 THEN 'Details' ELSE '' END), '[^a-z0-9]', '', 'g') AS f FROM part),
    k(statement, keyword) AS (VALUES ('metal', 'bolt'), ('metal', 'gear'), ('round', 'ring'), ('promo', 'widgetpromo'))
    SELECT accession, statement, min(role_seq) AS role_seq FROM u JOIN k ON contains(f, keyword) WHERE NOT regexp_matches(f, 'details|tables|parenthetical|disclosure') GROUP BY ALL""")
def role_select(spark, d) -> DataFrame:
    """The first role of each brand that a statement's keywords name."""
    roles = table(spark, d, "part").select(F.col("p_brand").alias("accession"), F.col("p_partkey").alias("role_seq"), F.concat(F.lit("http://x.test/role/"), "p_name", "p_type", F.when(F.col("p_size") > 40, "Details").otherwise("")).alias("role_uri"))
    return linkbase.select_roles(roles, {"metal": ("bolt", "gear"), "round": ("ring",), "promo": ("widgetpromo",)})


@query("concept_filter", f"WITH {FACTS} SELECT entity, concept, year, value FROM v WHERE contains(lower(concept), 'd#1')")
def concept_filter(spark, d) -> DataFrame:
    return facts.with_concept(views.facts(spark, d), "D#1")


@query("fact_tsv", f"WITH {FACTS} SELECT entity, concept || chr(9) || year || '-01-01..' || year || '-12-31' || chr(9) || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || chr(9) || 'usd' AS line FROM v")
def fact_tsv(spark, d) -> DataFrame:
    v = views.facts(spark, d)
    return facts.tsv(views.as_facts(v), views.as_contexts(v)).select(_entity(), "line")


@query("presentation_tree", """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, n_nationkey AS rank FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer),
    t AS (SELECT 'r' || r_regionkey AS node, 0 AS depth, [CAST(r_regionkey AS BIGINT)] AS path FROM region UNION ALL SELECT e.child, t.depth + 1, list_append(t.path, CAST(e.rank AS BIGINT)) FROM t JOIN e ON e.parent = t.node)
    SELECT node, depth, row_number() OVER (ORDER BY path) AS n FROM t""")
def presentation_tree(spark, d) -> DataFrame:
    """Regions, nations and customers in depth-first order."""
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.col("n_nationkey").cast("long").alias("rank"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"), F.col("c_custkey").alias("rank"))
    roots = table(spark, d, "region").select(F.lit("w").alias("key"), F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_regionkey").cast("long").alias("rank"))
    t = linkbase.walk_tree(n.unionByName(c).withColumn("key", F.lit("w")), roots, ["key"])
    return _numbered(t).select("node", "depth", "n")


def _numbered(t: DataFrame) -> DataFrame:
    """n of each row in order of path, without all rows in one task: ranks within ranges, and
    how many rows the ranges before have."""
    from pyspark.sql import Window

    parted = written(t.repartitionByRange("path").withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parted.join(F.broadcast(before), "_part").withColumn("n", F.row_number().over(Window.partitionBy("_part").orderBy("path")) + F.col("_before"))


@query("json_parallel_arrays", f"WITH {FILINGS} SELECT cik, accession, filing_date, form FROM f")
def json_parallel_arrays(spark, d) -> DataFrame:
    """Parallel arrays of a company's filings, zipped to rows again."""
    f = views.filings(spark, d)
    # a company's filings are one JSON document by nature
    g = f.groupBy("cik").agg(F.collect_list(F.struct("accession", F.date_format("filing_date", "yyyy-MM-dd").alias("day"), "form")).alias("x"))
    of = lambda c: F.transform("x", lambda r: r[c])
    text = F.to_json(F.struct(F.struct(F.struct(of("accession").alias("accessionNumber"), of("day").alias("filingDate"), F.transform("x", lambda _: F.lit("")).alias("reportDate"), of("form").alias("form"), of("accession").alias("primaryDocument")).alias("recent")).alias("filings")))
    s = g.select("cik", F.from_json(text, S.SUBMISSIONS_JSON).alias("s"))
    return landing.from_recent(s.select("cik", F.lit("x").alias("company"), F.col("s.filings.recent").alias("recent"))).select("cik", "accession", "filing_date", "form")


_CELLS = f"""{FACTS}, b AS (SELECT entity, concept, year, CASE WHEN year = 1996 THEN NULL ELSE round(CASE WHEN entity % 4 = 0 THEN value + 0.4 WHEN entity % 4 = 1 THEN value * 2 ELSE value END, 2) END AS expected FROM v),
    g AS (SELECT entity, concept, year, value AS got FROM v WHERE NOT (concept = 'Brand#3' AND year = 1996)),
    m AS (SELECT b.*, g.got, CASE WHEN expected IS NULL OR got IS NULL THEN expected IS NULL AND got IS NULL ELSE abs(expected - got) <= greatest(0.5, abs(expected) * 1e-6) END AS matched FROM b LEFT JOIN g USING (entity, concept, year))"""


def _scored(spark, d):
    v = written(views.facts(spark, d), "facts")
    off = F.when(F.col("entity") % 4 == 0, F.col("value") + 0.4).when(F.col("entity") % 4 == 1, F.col("value") * 2).otherwise(F.col("value"))
    b = v.withColumn("expected", F.when(F.col("year") != 1996, F.round(off, 2)))
    cells = F.sort_array(F.collect_list(F.struct("concept", F.col("year").cast("string").alias("period"), F.col("expected").alias("value"))))
    base = b.groupBy(F.col("entity").alias("name")).agg(F.array(F.struct(F.lit("http://v.test/role/Sales").alias("role"), F.lit("").alias("title"), cells.alias("cells"))).alias("statements"))
    docs = views.statements(v.filter(~((F.col("concept") == "Brand#3") & (F.col("year") == 1996))), (1990, 2005)).withColumnRenamed("pair", "name")
    return accuracy.cells(docs, base)


@query("tolerant_match", f"WITH {_CELLS} SELECT entity, concept, CAST(year AS VARCHAR) AS period, expected, got, matched FROM m")
def tolerant_match(spark, d) -> DataFrame:
    """Expected cells beside produced ones, within half a unit or a millionth."""
    return _scored(spark, d).select(F.col("name").alias("entity"), "concept", "period", "expected", "got", "matched")


@query("calibration", f"""WITH {_CELLS}, s AS (SELECT entity, CASE entity % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS level, count(*) FILTER (matched) AS mc, count(*) AS tc FROM m GROUP BY ALL)
    SELECT level, count(*) AS filings, CAST(sum(mc) AS BIGINT) AS matched_cells, CAST(sum(tc) AS BIGINT) AS total_cells, round(sum(mc) / sum(tc), 9) AS accuracy FROM s GROUP BY GROUPING SETS ((), (level))""")
def calibration(spark, d) -> DataFrame:
    """Accuracy of each level and of all."""
    s = _scored(spark, d).groupBy("name").agg(F.count_if("matched").alias("matched_cells"), F.count("*").alias("total_cells"))
    k = F.col("name") % 4
    s = s.withColumn("got_confidence", F.when(k == 0, "high").when(k == 1, "low").otherwise("medium")).withColumn("matched_sections", F.lit(0)).withColumn("total_sections", F.lit(0))
    return accuracy.calibration(s).select("level", "filings", "matched_cells", "total_cells", F.round("accuracy", 9).alias("accuracy"))


_TEXT = "coalesce(regexp_replace(CAST({} AS VARCHAR), '\\.0$', ''), '')"


@query("render_markdown_rows", f"""WITH {FACTS}, r AS (SELECT entity, concept, {', '.join(f'max(value) FILTER (year = {y}) AS y{y}' for y in (1998, 1997, 1996))} FROM v WHERE year BETWEEN 1996 AND 1998 GROUP BY ALL)
    SELECT entity, '### Sales' || chr(10) || chr(10) || '|  | 1998 | 1997 | 1996 |' || chr(10) || '| --- | ---: | ---: | ---: |' || chr(10)
      || string_agg('| ' || concept || ' | ' || {_TEXT.format('y1998')} || ' | ' || {_TEXT.format('y1997')} || ' | ' || {_TEXT.format('y1996')} || ' |' || chr(10), '' ORDER BY concept)
      || chr(10) || '_source: view · confidence: high_' || chr(10) || chr(10) AS text FROM r GROUP BY entity""")
def render_markdown_rows(spark, d) -> DataFrame:
    s = views.statements(views.facts(spark, d), (1996, 1998))
    return s.select(F.col("pair").alias("entity"), render.markdown_table(F.col("statements")[0]).alias("text"))


@query("text_width", f"""WITH {FACTS}, r AS (SELECT entity, concept, {', '.join(f'max(value) FILTER (year = {y}) AS y{y}' for y in (1998, 1997))} FROM v WHERE year BETWEEN 1997 AND 1998 GROUP BY ALL),
    w AS (SELECT entity, CAST(max(length(concept)) AS INTEGER) AS a, CAST(greatest(4, max(length({_TEXT.format('y1998')}))) AS INTEGER) AS b, CAST(greatest(4, max(length({_TEXT.format('y1997')}))) AS INTEGER) AS c FROM r GROUP BY entity)
    SELECT entity, 'Sales' || chr(10) || rpad('', a, ' ') || '  ' || lpad('1998', b, ' ') || '  ' || lpad('1997', c, ' ') || chr(10) || repeat('-', a + b + c + 4) || chr(10)
      || string_agg(rpad(concept, a, ' ') || '  ' || lpad({_TEXT.format('y1998')}, b, ' ') || '  ' || lpad({_TEXT.format('y1997')}, c, ' ') || chr(10), '' ORDER BY concept)
      || '(source: view; confidence: high)' || chr(10) || chr(10) AS text FROM r JOIN w USING (entity) GROUP BY entity, a, b, c""")
def text_width(spark, d) -> DataFrame:
    """Tables in columns as wide as what they hold."""
    s = views.statements(views.facts(spark, d), (1997, 1998))
    return s.select(F.col("pair").alias("entity"), render.text_table(F.col("statements")[0]).alias("text"))


@query("number_texts", "SELECT o_orderkey, regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS plain, CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END || regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS signed, printf('%+.1f%%', o_orderkey / 4) AS percent FROM orders")
def number_texts(spark, d) -> DataFrame:
    """Shortest decimals, signed ones and percents."""
    x = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", X.decimal_text(x).alias("plain"), X.signed_text(F.when(F.col("o_orderkey") % 2 == 0, -x).otherwise(x)).alias("signed"), X.percent_text(F.col("o_orderkey") / 4).alias("percent"))


@query("layout_tables", "SELECT p_brand AS brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS n, p_name AS label, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN -CAST(p_size AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS size, p_retailprice AS price FROM part")
def layout_tables(spark, d) -> DataFrame:
    """Tables made of a brand's parts, read by their layout: label, then figures by order."""
    p = table(spark, d, "part")
    k = F.col("p_size") % 4
    size = F.when(k == 0, "—").when(k == 1, F.concat(F.lit("("), "p_size", F.lit(")"))).otherwise(F.col("p_size").cast("string"))
    tr = F.concat(F.lit("<tr><td>"), "p_name", F.lit("<sup>(1)</sup></td><td>$</td><td>"), size, F.lit("</td><td>"), X.decimal_text(F.col("p_retailprice")), F.lit("<td></td></tr>"))
    html = p.groupBy(F.col("p_brand").alias("accession")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", tr.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    html = html.select("accession", F.concat(F.lit("<html><table><tr><td><b>Parts</b></td></tr><tr><th></th><th>Size</th><th>Price</th></tr>"), "t", F.lit("</table></html>")).alias("content"))
    t = layout.tables(written(shred(html, kinds=["element"]), "nodes"))
    r = t.select("accession", F.posexplode("table.rows").alias("n", "r"))
    return r.select(F.col("accession").alias("brand"), "n", "r.label", F.col("r.values")[0].alias("size"), F.col("r.values")[1].alias("price"))


@query("inline_statements", f"WITH {FACTS}, {_KEPT} SELECT entity, concept, CAST(col_seq AS INTEGER) AS col_seq, value FROM cells")
def inline_statements(spark, d) -> DataFrame:
    """From inline-tagged HTML to statements: each entity's facts written as a tagged document,
    shredded, and projected on its concepts and years."""
    v = written(views.facts(spark, d), "facts")
    ctx = v.select("entity", "year").distinct().select("entity", F.concat(F.lit('<xbrli:context id="y'), "year", F.lit('"><xbrli:entity><xbrli:identifier>1</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>'), "year", F.lit("-01-01</xbrli:startDate><xbrli:endDate>"), "year", F.lit("-12-31</xbrli:endDate></xbrli:period></xbrli:context>")).alias("t"))
    tag = v.select("entity", F.concat(F.lit('<tr><td><ix:nonFraction name="'), "concept", F.lit('" contextRef="y'), "year", F.lit('" scale="0">'), X.decimal_text(F.col("value")), F.lit("</ix:nonFraction></td></tr>")).alias("t"))
    body = lambda x, name: x.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_list("t")), "\n").alias(name))
    html = body(ctx, "c").join(body(tag, "f"), "entity").select(F.col("entity").alias("accession"), F.concat(F.lit("<html><body><ix:header>"), "c", F.lit("</ix:header><table>"), "f", F.lit("</table></body></html>")).alias("content"))
    nodes = written(shred(html, kinds=["element"]), "nodes")
    c = facts.contexts(nodes)
    long, _ = project.cells(views.as_rows(v), facts.facts(nodes, c), c)
    return long.select(_entity(), F.col("path")[0].alias("concept"), "col_seq", "value")


@query("linkbase_roles", """SELECT s_nationkey AS nation, 'q:S' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'S' || s_suppkey END AS label, 1 AS depth, false AS has_children, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS n FROM supplier
    UNION ALL SELECT DISTINCT s_nationkey, 'q:RootAbstract', 'Root Abstract', 0, true, 0 FROM supplier""")
def linkbase_roles(spark, d) -> DataFrame:
    """Linkbase XML of each nation's suppliers, read back as ordered, labelled rows."""
    from pyspark.sql import Window

    s = table(spark, d, "supplier").withColumn("accession", F.col("s_nationkey").cast("string")).withColumn("c", F.concat(F.lit("q_S"), "s_suppkey"))
    loc = lambda c: F.concat(F.lit('<l:loc x:label="'), c, F.lit('" x:href="a.xsd#'), c, F.lit('"/>'))
    arc = F.concat(F.lit('<l:presentationArc x:from="q_RootAbstract" x:to="'), "c", F.lit('" order="'), F.col("s_acctbal").cast("string"), F.lit('"/>'))
    lab = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('<l:labelArc x:from="'), "c", F.lit('" x:to="t'), "c", F.lit('"/><l:label x:label="t'), "c", F.lit('" x:role="http://www.xbrl.org/2003/role/label">'), "s_name", F.lit("</l:label>")))
    ordered = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", x.alias("t")))), lambda r: r["t"]), "")
    g = s.groupBy("accession").agg(ordered(loc(F.col("c"))).alias("locs"), ordered(arc).alias("arcs"), F.array_join(F.collect_list(lab), "").alias("labs"))
    head = F.lit('<?xml version="1.0"?><l:linkbase xmlns:l="http://l" xmlns:x="http://x">')
    pre = g.select("accession", F.encode(F.concat(head, F.lit('<l:presentationLink x:role="http://x/role/All">'), loc(F.lit("q_RootAbstract")), "locs", "arcs", F.lit("</l:presentationLink></l:linkbase>")), "UTF-8").alias("content"))
    lab_x = g.select("accession", F.encode(F.concat(head, F.lit("<l:labelLink>"), "locs", "labs", F.lit("</l:labelLink></l:linkbase>")), "UTF-8").alias("content"))
    r = linkbase.roles(pre, linkbase.labels(lab_x))
    n = F.row_number().over(Window.partitionBy("accession").orderBy("path")) - 1
    return r.select(F.col("accession").cast("int").alias("nation"), "name", "label", "depth", "has_children", n.cast("long").alias("n"))


@query("item_ids", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN k IN ('1A','1B','1C','7A','9A','9B','9C') THEN k ELSE NULL END WHEN c_custkey % 4 = 1 THEN '1A' WHEN c_custkey % 4 = 2 THEN '9.01' ELSE NULL END AS item
    FROM (SELECT c_custkey, (c_nationkey % 10) || chr(CAST(65 + c_nationkey % 3 AS INTEGER)) AS k FROM customer)""")
def item_ids(spark, d) -> DataFrame:
    """Items that headings name: by number and letter, by words, by the other form's words."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 4
    num = F.concat(F.lit("Item  "), F.col("c_nationkey") % 10, F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("c_nationkey") % 3 + 1), F.lit(". Zz"))
    text = F.when(k == 0, num).when(k == 1, "RISK  factors — all").when(k == 2, "Financial Statements and Exhibits").otherwise("See risk factors")
    return c.select("c_custkey", X.item_id(text, anchored=True).alias("item"))


@query("fold_roles", "SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_type), '[^a-z0-9]', '', 'g') AS folded FROM part")
def fold_roles(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.fold_role(F.concat(F.lit("http://x.test/Role/"), "p_name", F.lit("-"), "p_type")).alias("folded"))


@query("archive_urls", "SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace(printf('%010d-%06d', o_custkey, o_orderkey), '-', '') || '/d' || o_orderkey || '.htm' AS url FROM orders")
def archive_urls(spark, d) -> DataFrame:
    f = views.filings(spark, d)
    return f.select(F.col("orderkey").alias("o_orderkey"), landing.archive_url(F.col("cik"), F.col("accession"), F.concat(F.lit("d"), "orderkey", F.lit(".htm"))).alias("url"))

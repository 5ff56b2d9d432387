"""Documents and comparisons as JSON, Markdown and plain text, one string a row.

Markdown and text are column expressions. JSON has its own writer: numbers print as shortest
plain decimals and fields without a value are left out level by level, while values that are
null stay.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabulon.functions import scalars as X


def _or(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _joined(xs: Column, f: Callable[[Column], Column], sep: str = "") -> Column:
    return F.coalesce(F.array_join(F.transform(xs, f), sep), F.lit(""))


def _nth(xs: Column, f: Callable[[Column, Column], Column], sep: str = "") -> Column:
    return F.coalesce(F.array_join(F.transform(xs, f), sep), F.lit(""))


def heading(m: Column) -> Column:
    """Company, ticker, form and the period's end."""
    some = lambda x, shown: F.when(_or(x) != "", shown)
    head = F.concat_ws(" ", some(m["company"], m["company"]), some(m["ticker"], F.concat(F.lit("("), m["ticker"], F.lit(")"))), some(m["form"], m["form"]))
    ending = F.concat(F.lit("— period ending "), m["period_end"])
    return F.when(_or(m["period_end"]) == "", head).otherwise(F.when(head == "", ending).otherwise(F.concat(head, F.lit(" "), ending)))


def section_title(s: Column) -> Column:
    return X.section_heading(s["item"], s["title"])


def _md_row(cells: Column) -> Column:
    return F.concat(F.lit("|"), _joined(cells, lambda c: F.concat(F.lit(" "), c, F.lit(" |"))), F.lit("\n"))


def markdown_table(t: Column) -> Column:
    first = F.array(F.lit(""))
    header = F.concat(first, F.transform(t["columns"], lambda c: X.markdown_cell(_or(c["label"]))))
    rule = F.concat(F.array(F.lit("---")), F.transform(t["columns"], lambda c: F.lit("---:")))
    rows = _joined(t["rows"], lambda r: _md_row(F.concat(F.array(X.markdown_cell(_or(r["label"]))), F.transform(r["values"], X.decimal_text))))
    title = F.when(_or(t["title"]) == "", "").otherwise(F.concat(F.lit("### "), t["title"], F.lit("\n\n")))
    return F.concat(title, _md_row(header), _md_row(rule), rows, F.lit("\n_source: "), t["source"]["extractor"], F.lit(" · confidence: "), t["confidence"]["level"], F.lit("_\n\n"))


def _has_tables(df: DataFrame) -> bool:
    return "tables" in df.schema["sections"].dataType.elementType.names


def markdown(df: DataFrame) -> DataFrame:
    """accession and text of documents as Markdown."""
    m = F.col("metadata")
    head = heading(m)
    own = (lambda s: _joined(F.coalesce(s["tables"], F.filter(s["tables"], lambda _: F.lit(False))), markdown_table)) if _has_tables(df) else (lambda s: F.lit(""))
    section = lambda s: F.concat(F.lit("## "), section_title(s), F.lit("\n\n"), F.when(_or(s["text"]) == "", "").otherwise(F.concat(s["text"], F.lit("\n\n"))), own(s))
    text = F.concat(
        F.lit("<!-- tabulon v"), m["parser_version"], F.lit(" schema "), m["schema_version"], F.lit(" -->\n\n"), F.when(head == "", "").otherwise(F.concat(F.lit("# "), head, F.lit("\n\n"))),
        _joined(F.col("sections"), section), F.when(F.size("statements") > 0, F.concat(F.lit("## Financial Statements\n\n"), _joined(F.col("statements"), markdown_table))).otherwise(""),
        F.lit("---\n\n_schema "), m["schema_version"], F.lit(" · parser "), m["parser_version"], F.lit(" · confidence: "), m["confidence"]["level"], F.lit("_\n"),
    )
    return df.select("accession", text.alias("text"))


def _underlined(title: Column, rule: str) -> Column:
    return F.concat(title, F.lit("\n"), F.repeat(F.lit(rule), F.length(title)), F.lit("\n"))


def widths(rows: Column, n: Column) -> Column:
    """The most characters of each of the n columns of an array of rows of texts."""
    most = lambda i: F.aggregate(rows, F.lit(0), lambda a, r: F.greatest(a, F.length(_or(F.get(r, i)))))
    return F.transform(F.sequence(F.lit(0), n - 1), most)


def text_table(t: Column) -> Column:
    n = F.size(t["columns"]) + 1
    header = F.concat(F.array(F.lit("")), F.transform(t["columns"], lambda c: _or(c["label"])))
    rows = F.transform(t["rows"], lambda r: F.concat(F.array(_or(r["label"])), F.transform(r["values"], X.decimal_text)))
    title = F.when(_or(t["title"]) == "", "").otherwise(F.concat(t["title"], F.lit("\n")))

    def lines(cells: Column, w: Column) -> Column:
        # pad functions would cut what is longer, but nothing is
        cell = lambda c, i: F.when(i == 0, F.rpad(c, F.get(w, i), F.lit(" "))).otherwise(F.concat(F.lit("  "), F.lpad(c, F.get(w, i), F.lit(" "))))
        line = lambda r: F.concat(_nth(F.slice(r, F.lit(1), n), cell), F.lit("\n"))
        rule = F.concat(F.repeat(F.lit("-"), F.aggregate(w, F.lit(0), lambda a, x: a + x) + 2 * (n - 1)), F.lit("\n"))
        return F.concat(line(cells[0]), rule, _joined(F.slice(cells, F.lit(2), F.size(cells)), line))

    # texts and widths are made once a table, not once a cell
    table = X.let(F.concat(F.array(header), rows), lambda cells: X.let(widths(cells, n), lambda w: lines(cells, w)))
    return F.concat(title, table, F.lit("(source: "), t["source"]["extractor"], F.lit("; confidence: "), t["confidence"]["level"], F.lit(")\n\n"))


def text(df: DataFrame) -> DataFrame:
    """accession and text of documents as plain text; widths are in characters."""
    m = F.col("metadata")
    head = heading(m)
    own = (lambda s: _joined(F.coalesce(s["tables"], F.filter(s["tables"], lambda _: F.lit(False))), text_table)) if _has_tables(df) else (lambda s: F.lit(""))
    section = lambda s: F.concat(_underlined(F.upper(section_title(s)), "-"), F.when(_or(s["text"]) == "", "").otherwise(F.concat(s["text"], F.lit("\n"))), F.lit("\n"), own(s))
    out = F.concat(
        F.when(head == "", "").otherwise(F.concat(_underlined(head, "="), F.lit("\n"))), _joined(F.col("sections"), section),
        F.when(F.size("statements") > 0, F.concat(_underlined(F.lit("FINANCIAL STATEMENTS"), "="), F.lit("\n"), _joined(F.col("statements"), text_table))).otherwise(""),
        F.lit("(schema "), m["schema_version"], F.lit("; parser "), m["parser_version"], F.lit("; confidence: "), m["confidence"]["level"], F.lit(")\n"),
    )
    return df.select("accession", out.alias("text"))


def _number(x: float) -> str:
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    short = repr(x)
    if "e" not in short:
        return short
    digits, power = short.split("e")
    if abs(x) >= 1e-6:
        return f"{x:.{len(digits.replace('.', '').lstrip('-')) - 1 - int(power)}f}"
    return f"{digits}e{int(power):+d}"


def pretty(x, indent: str = "") -> str:
    """JSON with two spaces a level and numbers as shortest decimals."""
    inner = indent + "  "
    if isinstance(x, dict):
        return "{" + ",".join(f"\n{inner}{json.dumps(k)}: {pretty(v, inner)}" for k, v in x.items()) + f"\n{indent}}}" if x else "{}"
    if isinstance(x, list):
        return "[" + ",".join(f"\n{inner}{pretty(v, inner)}" for v in x) + f"\n{indent}]" if x else "[]"
    if isinstance(x, float):
        return _number(x)
    return json.dumps(x, ensure_ascii=False)


#: Fields that are left out when they are empty, by what they are fields of.
OMITTED = {
    "metadata": ("company", "cik", "ticker", "form", "accession", "filing_date", "period_start", "period_end"),
    "prev": ("company", "ticker", "form", "accession", "filing_date", "period_end"),
    "curr": ("company", "ticker", "form", "accession", "filing_date", "period_end"),
    "sections": ("text", "tables"),
    "changes": ("item", "title", "paragraphs"),
    "statements": ("title", "role_uri", "footnotes"),
    "columns": ("context_ref", "period_start", "period_end", "instant"),
    "rows": ("concept", "depth"),
}


def pruned(x, of: str = ""):
    """x without the empty fields that OMITTED names. Missing lists stay as empty lists."""
    if isinstance(x, list):
        return [pruned(v, of) for v in x]
    if not isinstance(x, dict):
        return x
    out = {}
    for k, v in x.items():
        if k in OMITTED.get(of, ()) and (v is None or v is False or v in ("", 0) or v in ([], {})):
            continue
        if v is None and k in ("statements", "sections", "rows", "columns", "periods", "paragraphs"):
            v = []
        out[k] = pruned(v, {"tables": "statements"}.get(k, "changes" if k == "sections" and "prev" in x else k))
    return out


@F.pandas_udf(StringType())
def _pretty(rows: pd.Series) -> pd.Series:
    return rows.map(lambda s: pretty(pruned(json.loads(s))) + "\n")


def _json(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    return df.select(key, _pretty(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).alias("text"))


def to_json(df: DataFrame) -> DataFrame:
    """accession and text of documents as JSON."""
    return _json(df, "accession", ["metadata", "sections", "statements"])


def changes_json(df: DataFrame) -> DataFrame:
    """pair and text of change sets as JSON."""
    return _json(df, "pair", ["schema_version", "prev", "curr", "statements", "sections"])


def changes_heading() -> Column:
    name = F.when(_or(F.col("curr.company")) != "", F.col("curr.company")).otherwise(_or(F.col("curr.ticker")))
    some = lambda x: F.when(_or(x) != "", x)
    head = F.concat_ws(" ", some(name), some(F.col("curr.form")))
    day = lambda side: F.coalesce(some(F.col(f"{side}.period_end")), _or(F.col(f"{side}.filing_date")))
    span = F.when((day("prev") == "") & (day("curr") == ""), F.lit(None)).otherwise(F.concat(day("prev"), F.lit(" → "), day("curr")))
    whole = F.concat_ws(" ", some(head), span)
    return F.when(whole == "", "(unlabeled filings)").otherwise(whole)


def _statement_changes(s: Column) -> Column:
    title = F.coalesce(F.when(_or(s["title"]) != "", s["title"]), F.when(_or(s["role_uri"]) != "", s["role_uri"]), F.lit("(statement)"))
    title = X.markdown_cell(title)

    def row(r: Column, p: Column) -> Column:
        c = F.get(r["cells"], p)
        label = F.concat(_or(r["label"]), F.when(r["status"].isin("added", "removed"), F.concat(F.lit(" ("), r["status"], F.lit(")"))).otherwise(""))
        return _md_row(F.array(X.markdown_cell(label), X.decimal_text(c["prev"]), X.decimal_text(c["curr"]), X.signed_text(c["abs"]), X.percent_text(c["pct"])))

    def period(label: Column, p: Column) -> Column:
        rows = _joined(F.filter(s["rows"], lambda r: r["status"] != "unchanged"), lambda r: row(r, p))
        head = F.concat(F.lit("### "), title, F.lit(" — "), X.markdown_cell(_or(label)), F.lit("\n\n| Line | Previous | Current | Δ | Δ% |\n| --- | ---: | ---: | ---: | ---: |\n"))
        return F.concat(head, F.when(rows == "", "| _no changes_ |  |  |  |  |\n").otherwise(rows), F.lit("\n"))

    return F.when(F.size(s["periods"]) == 0, F.concat(F.lit("### "), title, F.lit("\n\n_no overlapping periods_\n\n"))).otherwise(_nth(s["periods"], period))


def _statements_part() -> Column:
    return F.when(F.size("statements") > 0, F.concat(F.lit("## Financial Statements\n\n"), _joined(F.col("statements"), _statement_changes))).otherwise("")


def changes_markdown(df: DataFrame) -> DataFrame:
    """pair and text of change sets as Markdown: a table a period, unchanged rows hidden."""
    title = lambda s: F.when(_or(s["item"]) == "", _or(s["title"])).otherwise(F.concat(F.lit("Item "), s["item"], F.when(_or(s["title"]) == "", "").otherwise(F.concat(F.lit(" — "), s["title"]))))
    bullet = lambda p: F.concat(F.when(p["kind"] == "removed", "- − ").otherwise("- + "), F.replace(p["text"], F.lit("\n"), F.lit(" ")), F.lit("\n"))
    section = lambda s: F.concat(F.lit("### "), title(s), F.lit("\n\n"), _joined(s["paragraphs"], bullet), F.lit("\n"))
    parts = F.when(F.size("sections") > 0, F.concat(F.lit("## Sections\n\n"), _joined(F.col("sections"), section))).otherwise("")
    return df.select("pair", F.concat(F.lit("# Changes — "), changes_heading(), F.lit("\n\n"), _statements_part(), parts).alias("text"))


def lexical_markdown(df: DataFrame, lexical: DataFrame) -> DataFrame:
    """pair and text: change sets with the marked-up paragraphs of ``compare.lexical``."""
    title = F.when(_or(F.col("item")) == "", _or(F.col("title"))).otherwise(F.concat(F.lit("Item "), "item", F.when(_or(F.col("title")) == "", "").otherwise(F.concat(F.lit(" — "), "title"))))
    paragraph = lambda p, k: F.concat(F.lit("**Paragraph "), (k + 1).cast("string"), F.lit("**\n\n"), p, F.lit("\n\n"))
    one = F.concat(F.lit("## "), title, F.lit("\n\n"), _nth(F.col("paragraphs"), paragraph))
    parts = lexical.select("pair", F.struct("n", one.alias("t")).alias("x")).groupBy("pair").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "").alias("parts"))
    d = df.join(parts, "pair", "left")
    return d.select("pair", F.concat(F.lit("# Lexical diff — "), changes_heading(), F.lit("\n\n"), _statements_part(), F.coalesce("parts", F.lit("_No modified sections with paired paragraphs._\n"))).alias("text"))


def renderer(name: str) -> Callable[[DataFrame], DataFrame]:
    """json (also ''), md or markdown, text or txt."""
    found = {"": to_json, "json": to_json, "md": markdown, "markdown": markdown, "text": text, "txt": text}.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown format {name!r} (choose json, md, text)")
    return found


def changes_renderer(name: str) -> Callable[[DataFrame], DataFrame]:
    found = {"": changes_json, "json": changes_json, "md": changes_markdown, "markdown": changes_markdown}.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown format {name!r} (choose json, md)")
    return found

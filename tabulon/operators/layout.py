"""Statements from tables without tags: headers, labels and figures by their place in rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon import schemas as S
from tabulon.functions import scalars as X
from tabulon.operators import project

TABLE = ["accession", "table_pos"]
_YEAR = r"\b(19|20)\d{2}\b"


def table_numbers(nodes: DataFrame) -> DataFrame:
    """accession, table_pos and table_seq: every table, nested ones too, from 0 in document order."""
    w = Window.partitionBy("accession").orderBy("pos")
    return nodes.filter("kind = 'element' and tag = 'table'").select("accession", F.col("pos").alias("table_pos"), (F.row_number().over(w) - 1).alias("table_seq"))


def cells(nodes: DataFrame) -> DataFrame:
    """accession, table_pos, row_pos, pos, text, bold, header, style and notes of the cells that
    are direct children of a table's own rows. A closing (n) mark is a note and no text."""
    x = nodes.filter("kind = 'element'")
    rows = x.filter("tag = 'tr' and table_pos is not null").select("accession", "table_pos", F.col("pos").alias("row_pos"))
    c = x.filter("tag in ('td', 'th')").select("accession", F.col("parent_pos").alias("row_pos"), "pos", X.collapse_spaces("shown").alias("t"), "bold", (F.col("tag") == "th").alias("header"), F.coalesce(F.col("attrs")["style"], F.lit("")).alias("style"), "notes")
    marks = F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.array_compact(F.array(X.footnote(F.col("t")))))
    marks = F.filter(F.transform(marks, lambda m: X.trim(F.regexp_replace(X.trim(m), r"^[()]+|[()]+$", ""))), lambda m: m != "")
    return c.join(rows, ["accession", "row_pos"]).select(*TABLE, "row_pos", "pos", X.without_footnote(F.col("t")).alias("text"), "bold", "header", "style", marks.alias("notes"))


def is_meaningful(text: Column) -> Column:
    return ~X.trim(text).isin("", "$", "%")


def rows_of(c: DataFrame) -> DataFrame:
    """A row for each table row with a meaningful cell: its number from 0, texts in order, and
    whether it is a header (all of it bold or header cells, or a year in every cell)."""
    some = is_meaningful(F.col("text"))
    cell = F.when(some, F.struct("pos", "text", (F.col("bold") | F.col("header")).alias("strong"), "bold"))
    d = c.groupBy(*TABLE, "row_pos").agg(
        F.sort_array(F.collect_list(cell)).alias("cells"), F.bool_or("bold").alias("any_bold"), F.bool_or(F.lower("style").contains("border-top")).alias("any_top"), F.flatten(F.collect_list("notes")).alias("notes")
    )
    d = d.filter(F.size("cells") > 0)
    w = Window.partitionBy(*TABLE).orderBy("row_pos")
    header = F.forall("cells", lambda x: x["strong"]) | F.forall("cells", lambda x: x["text"].rlike(_YEAR))
    alone = F.element_at("cells", 1)
    title = (F.size("cells") == 1) & alone["bold"] & X.layout_value(alone["text"]).isNull()
    return d.select(*TABLE, (F.row_number().over(w) - 1).alias("n"), "cells", "any_bold", "any_top", "notes", header.alias("header"), title.alias("titled"))


def column_labels(texts: Column, n: Column) -> Column:
    """The n labels that stacked header rows give: one text too many is the label column's; any
    more are aligned to the right; a column's differing texts are joined."""

    def fit(row: Column) -> Column:
        size = F.size(row)
        return F.when(size == n + 1, F.slice(row, F.lit(2), n)).when(size > n, F.slice(row, size - n + 1, n)).otherwise(row)

    fitted = F.transform(texts, fit)
    column = lambda i: F.array_join(F.array_distinct(F.filter(F.transform(fitted, lambda r: F.get(r, i)), lambda t: t.isNotNull() & (t != ""))), " ")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), column)).otherwise(F.array().cast("array<string>"))


def tables(nodes: DataFrame) -> DataFrame:
    """accession, table_pos, table_seq and table of every table that has a meaningful row.

    The first row is the title if it is one bold cell and no figure; the header rows that follow
    name the columns; of each other row the first meaningful cell is the label and the others are
    values by their order. What is read this way is never of high confidence.
    """
    r = rows_of(cells(nodes))
    w = Window.partitionBy(*TABLE).orderBy("n")
    titled = F.first("titled").over(w)
    r = r.withColumn("is_title", F.col("titled") & (F.col("n") == 0)).withColumn("plain", ~F.col("is_title") & ~F.col("header"))
    r = r.withColumn("is_data", F.coalesce(F.bool_or("plain").over(w), F.lit(False))).withColumn("has_title", titled)
    values = F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))
    widest = F.max(F.when(F.col("is_data"), F.size("cells") - 1)).over(Window.partitionBy(*TABLE))
    r = r.withColumn("n_cols", F.coalesce(widest, F.lit(0)))
    got = F.transform(values, lambda x: X.layout_value(x["text"]))
    got = F.concat(got, F.array_repeat(F.lit(None).cast("double"), F.col("n_cols") - F.size(got)))
    label = X.trim(F.element_at("cells", 1)["text"])
    row = F.struct("n", label.alias("label"), F.lit("").alias("concept"), X.layout_row_type(label, F.col("any_bold"), F.col("any_top")).alias("type"), F.lit(0).alias("depth"), got.alias("values"))
    texts = F.transform("cells", lambda x: X.trim(x["text"]))
    ordered = lambda when, what: F.sort_array(F.collect_list(F.when(when, what)))
    t = r.groupBy(*TABLE, "n_cols").agg(
        F.max(F.when(F.col("is_title"), label)).alias("title"),
        F.transform(ordered(~F.col("is_data") & ~F.col("is_title"), F.struct("n", texts.alias("t"))), lambda x: x["t"]).alias("headers"),
        ordered(F.col("is_data"), row).alias("rows"), F.array_distinct(F.flatten(F.collect_list("notes"))).alias("notes"),
    )
    whole = lambda x: (F.col("n_cols") > 0) & F.forall(x["values"], lambda v: v.isNotNull())
    n_rows = F.size("rows")
    resolved = F.aggregate("rows", F.lit(0), lambda a, x: a + F.size(F.array_compact(x["values"])))
    n_cells = n_rows * F.col("n_cols")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t = t.withColumn("row_rate", rate(F.size(F.filter("rows", whole)), n_rows)).withColumn("cell_rate", rate(resolved, n_cells)).withColumn("untagged", n_cells - resolved)
    level = X.confidence_level(F.col("row_rate"), F.col("cell_rate"))
    level = F.when(level == "high", "medium").otherwise(level)
    column = lambda label: F.struct(label.alias("label"), F.lit("").alias("context_ref"), F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"), F.lit(False).alias("instant"))
    out = F.struct(
        F.lit(S.SCHEMA_VERSION).alias("schema_version"), F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("role_uri"), F.transform(column_labels(F.col("headers"), F.col("n_cols")), column).alias("columns"),
        F.transform("rows", lambda x: x.dropFields("n")).alias("rows"), F.when(F.size("notes") > 0, F.map_from_arrays("notes", F.transform("notes", lambda _: F.lit("")))).alias("footnotes"),
        project.confidence(level, F.col("row_rate"), F.col("cell_rate"), F.col("untagged")).alias("confidence"), F.struct(F.lit(S.EXTRACT_LAYOUT).alias("extractor"), F.lit(S.PARSER_VERSION).alias("parser_version")).alias("source"),
    )
    return t.join(table_numbers(nodes), TABLE).select(*TABLE, "table_seq", out.alias("table"))

"""Statements: facts on the rows of a role and the periods it presents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon import schemas as S
from tabulon.functions import scalars as X
from tabulon.operators import facts as FA

KEY = ["accession", "statement"]


def columns(rows: DataFrame, values: DataFrame, ctx: DataFrame, floor: float = S.COLUMN_FLOOR) -> DataFrame:
    """accession, statement, col_seq, context_ref, period_start, period_end, label and coverage.

    A primary context is a column if it has values for ``floor`` times as many of the
    statement's concepts as the best one has. Newest end first, then newest start, then id.
    """
    concepts = rows.select(*KEY, "name").distinct()
    cover = concepts.join(values.withColumnRenamed("concept", "name"), ["accession", "name"]).groupBy(*KEY, "context_ref").agg(F.count("*").alias("coverage"))
    most = Window.partitionBy(*KEY)
    kept = cover.withColumn("most", F.max("coverage").over(most)).filter(F.col("coverage") >= F.col("most") * floor)
    kept = kept.join(ctx.select("accession", "context_ref", "period_start", "period_end"), ["accession", "context_ref"])
    order = Window.partitionBy(*KEY).orderBy(F.desc("period_end"), F.desc("period_start"), "context_ref")
    return kept.select(*KEY, (F.row_number().over(order) - 1).alias("col_seq"), "context_ref", "period_start", "period_end", X.column_label(F.col("period_end")).alias("label"), "coverage")


def cells(role_rows: DataFrame, f: DataFrame, ctx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long statements and their columns.

    role_rows(accession, statement, role_uri, title, path, name, label, preferred_label, depth,
    has_children, structural). The first result has a row for each (row, column): accession,
    statement, path, col_seq and value, null where no fact is. Rows that show an opening or
    closing balance take the instant at their column's boundary: the day before the start, else
    the start itself; or the end.
    """
    use = FA.usable(f, ctx)
    values = FA.last_values(use, "accession", "concept", "context_ref")
    instants = FA.last_values(use.filter(FA.is_instant()), "accession", "concept", "period_end").withColumnRenamed("concept", "name")
    rows = role_rows.filter("not structural")
    cols = columns(rows, values, ctx)
    grid = rows.select(*KEY, "path", "name", "preferred_label").join(cols.select(*KEY, "col_seq", "context_ref", "period_start", "period_end"), KEY)
    at = lambda day, name: instants.select("accession", "name", F.col("period_end").alias(day), F.col("value").alias(name))
    grid = grid.withColumn("before", F.date_sub("period_start", 1))
    d = grid.join(values.withColumnRenamed("concept", "name"), ["accession", "name", "context_ref"], "left")
    d = d.join(at("period_end", "at_end"), ["accession", "name", "period_end"], "left").join(at("before", "at_before"), ["accession", "name", "before"], "left").join(at("period_start", "at_start"), ["accession", "name", "period_start"], "left")
    value = F.when(F.col("preferred_label") == S.PERIOD_END, F.col("at_end")).when(F.col("preferred_label") == S.PERIOD_START, F.coalesce("at_before", "at_start")).otherwise(F.col("value"))
    return d.select(*KEY, "path", "col_seq", value.alias("value")), cols


def rates(long: DataFrame, by: list[str], row: list[str], value: str = "value") -> DataFrame:
    """by, n_rows, n_cells, untagged, row_rate, cell_rate and level of a long table."""
    per_row = long.groupBy(*by, *row).agg(F.count("*").alias("n"), F.count(value).alias("got"))
    d = per_row.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_cells"), F.sum(F.col("n") - F.col("got")).alias("untagged"), F.count_if(F.col("n") == F.col("got")).alias("whole"))
    d = d.withColumn("row_rate", F.col("whole") / F.col("n_rows")).withColumn("cell_rate", (F.col("n_cells") - F.col("untagged")) / F.col("n_cells"))
    return d.select(*by, "n_rows", "n_cells", "untagged", "row_rate", "cell_rate", X.confidence_level(F.col("row_rate"), F.col("cell_rate")).alias("level"))


def confidence(level: Column, row_rate: Column, cell_rate: Column, untagged: Column) -> Column:
    return F.struct(level.alias("level"), row_rate.alias("row_match_rate"), cell_rate.alias("cell_resolved_rate"), untagged.cast("long").alias("untagged_cell_count"))


def tables(role_rows: DataFrame, f: DataFrame, ctx: DataFrame) -> DataFrame:
    """accession, statement, table: each statement with a row, nested as the JSON has it.

    A statement without columns keeps its rows, with no values.
    """
    long, cols = cells(role_rows, f, ctx)
    rows = role_rows.filter("not structural")
    vals = long.groupBy(*KEY, "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_seq", "value"))), lambda c: c["value"]).alias("values"))
    kind = X.row_type(F.col("preferred_label"), F.col("label"), F.col("has_children"))
    r = rows.join(vals, [*KEY, "path"], "left").select(*KEY, "role_uri", "title", "path", F.struct("label", F.col("name").alias("concept"), kind.alias("type"), "depth", F.coalesce("values", F.array().cast("array<double>")).alias("values")).alias("row"))
    r = r.groupBy(*KEY).agg(F.first("role_uri").alias("role_uri"), F.first("title").alias("title"), F.transform(F.sort_array(F.collect_list(F.struct("path", "row"))), lambda x: x["row"]).alias("rows"))
    column = F.struct("col_seq", "label", "context_ref", "period_start", "period_end", (F.col("period_start") == F.col("period_end")).alias("instant"))
    c = cols.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(column)), lambda x: x.dropFields("col_seq")).alias("columns"))
    d = r.join(c, KEY, "left").join(rates(long, KEY, ["path"]), KEY, "left")
    none = F.array().cast("array<struct<label:string,context_ref:string,period_start:date,period_end:date,instant:boolean>>")
    conf = confidence(F.coalesce("level", F.lit("low")), F.coalesce("row_rate", F.lit(0.0)), F.coalesce("cell_rate", F.lit(0.0)), F.coalesce("untagged", F.lit(0)))
    source = F.struct(F.lit(S.EXTRACT_FACTS).alias("extractor"), F.lit(S.PARSER_VERSION).alias("parser_version"))
    notes = F.lit(None).cast("map<string,string>").alias("footnotes")
    return d.select(*KEY, F.struct(F.lit(S.SCHEMA_VERSION).alias("schema_version"), "title", "role_uri", F.coalesce("columns", none).alias("columns"), "rows", notes, conf.alias("confidence"), source.alias("source")).alias("table"))


def wide(long: DataFrame, n_columns: int) -> DataFrame:
    """One column a period, newest first: the pivot of a long statement."""
    return long.groupBy(*KEY, "path").pivot("col_seq", list(range(n_columns))).agg(F.first("value"))

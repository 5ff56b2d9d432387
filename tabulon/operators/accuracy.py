"""How well documents agree with baselines, and whether confidence levels tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import scalars as X


def ratio(matched: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise(matched / total)


def _tables(docs: DataFrame) -> DataFrame:
    d = docs.select("name", F.posexplode("statements").alias("t", "x"))
    return d.select("name", "t", F.col("x.role_uri").alias("role_uri"), F.lower("x.title").alias("title"), F.col("x.columns").alias("columns"), F.col("x.rows").alias("rows"))


def cells(docs: DataFrame, baselines: DataFrame) -> DataFrame:
    """name, statement, cell, concept, period, expected, got and matched of every baseline cell.

    A baseline's statement is the first table with its role, else the first with its title in
    any case. A cell is that of the first row with its concept and the first column with its
    label. Cells of statements that aren't there don't match, nulls included.
    """
    b = baselines.select("name", F.posexplode("statements").alias("statement", "s")).select("name", "statement", "s.role", F.lower("s.title").alias("title"), "s.cells")
    t = _tables(docs)
    by_role = b.filter("role <> ''").join(t.select("name", F.col("role_uri").alias("role"), "t"), ["name", "role"]).groupBy("name", "statement").agg(F.min("t").alias("by_role"))
    by_title = b.filter("title <> ''").join(t.select("name", "title", "t"), ["name", "title"]).groupBy("name", "statement").agg(F.min("t").alias("by_title"))
    b = b.join(by_role, ["name", "statement"], "left").join(by_title, ["name", "statement"], "left").withColumn("t", F.coalesce("by_role", "by_title"))
    b = b.join(t.select("name", "t", "columns", "rows"), ["name", "t"], "left")
    # a baseline's cells are few, and the lookups are within one table
    col = F.array_position(F.transform("columns", lambda c: c["label"]), F.col("c.period")).cast("int") - 1
    row = F.element_at(F.filter("rows", lambda r: r["concept"] == F.col("c.concept")), 1)
    d = b.select("name", "statement", "t", "columns", "rows", F.posexplode("cells").alias("cell", "c"))
    d = d.withColumn("i", col).withColumn("row", F.when(F.size(F.filter("rows", lambda r: r["concept"] == F.col("c.concept"))) > 0, row))
    got = F.when(F.col("i") >= 0, F.get(F.col("row.values"), F.col("i")))
    return d.select("name", "statement", "cell", "c.concept", "c.period", F.col("c.value").alias("expected"), got.alias("got"), (F.col("t").isNotNull() & X.cell_matches(F.col("c.value"), got)).alias("matched"))


def sections(docs: DataFrame, baselines: DataFrame) -> DataFrame:
    """name, matched_sections and total_sections."""
    b = baselines.select("name", F.size(F.coalesce("sections", F.array().cast("array<string>"))).alias("total_sections"), F.explode_outer("sections").alias("item"))
    have = docs.select("name", F.explode("sections.item").alias("item")).distinct().withColumn("have", F.lit(1))
    return b.join(have, ["name", "item"], "left").groupBy("name", "total_sections").agg(F.coalesce(F.sum("have"), F.lit(0)).alias("matched_sections"))


def score(docs: DataFrame, baselines: DataFrame) -> DataFrame:
    """A row for each baseline: expected and found level, matched and total cells and sections.
    docs has name, metadata, sections and statements."""
    c = cells(docs, baselines).groupBy("name").agg(F.count_if("matched").alias("matched_cells"), F.count("*").alias("total_cells"))
    got = docs.select("name", F.col("metadata.confidence.level").alias("got_confidence"))
    d = baselines.select("name", "ticker", "format", F.col("confidence").alias("expected_confidence")).join(got, "name").join(c, "name", "left").join(sections(docs, baselines), "name", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return d.select("name", "ticker", "format", "expected_confidence", "got_confidence", *map(zero, ("matched_cells", "total_cells", "matched_sections", "total_sections")))


def calibration(scores: DataFrame, level: str = "got_confidence") -> DataFrame:
    """level (null for all), filings, matched and total cells and sections, and accuracy."""
    d = scores.groupingSets([[], [F.col(level)]], F.col(level)).agg(F.grouping(level).alias("_all"), F.count("*").alias("filings"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched_cells", "total_cells", "matched_sections", "total_sections")])
    return d.select(F.col(level).alias("level"), "filings", "matched_cells", "total_cells", "matched_sections", "total_sections", ratio(F.col("matched_cells"), F.col("total_cells")).alias("accuracy"), ratio(F.col("matched_sections"), F.col("total_sections")).alias("coverage"))


def report(scores: DataFrame) -> DataFrame:
    """seq and line of the printed report: a line a filing, all of them, then each level."""
    # The report's headers and formats, as it is printed
    pct = lambda a, b: 100 * ratio(F.col(a), F.col(b))
    rule = "-" * 76
    w = Window.orderBy("name")  # a line a filing of a corpus of expected results
    body = scores.withColumn("nth", F.row_number().over(w)).select(
        F.struct(F.lit(2).alias("part"), F.col("nth").alias("n")).alias("seq"),
        F.format_string("%-10s %-7s %-14s %-6s→%-6s %9.1f%% %9.1f%%", "name", "ticker", "format", "expected_confidence", "got_confidence", pct("matched_cells", "total_cells"), pct("matched_sections", "total_sections")).alias("line"),
    )
    c = calibration(scores)
    rank = F.when(F.col("level") == "high", 1).when(F.col("level") == "medium", 2).otherwise(3)
    total = c.filter("level is null").select(F.struct(F.lit(4).alias("part"), F.lit(0).alias("n")).alias("seq"), F.format_string("overall: statement accuracy %.1f%% (%d/%d), section coverage %.1f%% (%d/%d)", F.col("accuracy") * 100, "matched_cells", "total_cells", F.col("coverage") * 100, "matched_sections", "total_sections").alias("line"))
    level = c.filter("level in ('high', 'medium', 'low')").select(F.struct(F.lit(6).alias("part"), rank.alias("n")).alias("seq"), F.format_string("  %-6s %d filing(s): %.1f%% cell accuracy", "level", "filings", F.col("accuracy") * 100).alias("line"))
    head = "%-10s %-7s %-14s %-6s→%-6s %10s %10s" % ("filing", "ticker", "format", "exp", "got", "stmt-acc", "sect-cov")
    fixed = [(0, head), (1, rule), (3, rule), (5, "\nconfidence calibration (accuracy within each bucket):")]
    lines = scores.sparkSession.createDataFrame([((p, 0), t) for p, t in fixed], "seq struct<part:int,n:int>, line string")
    return lines.unionByName(body).unionByName(total).unionByName(level)

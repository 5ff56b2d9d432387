"""The analytic tables seen as filings, so that every operator runs on them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity (supplier), concept (brand), year and value (price sum)."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    d = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return d.groupBy(F.col("l_suppkey").alias("entity"), F.col("p_brand").alias("concept"), F.year("l_shipdate").alias("year")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


FACTS = """v AS (SELECT l_suppkey AS entity, p_brand AS concept, CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_extendedprice), 2) AS value
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def as_facts(v: DataFrame) -> DataFrame:
    """The relation of tagged facts with one fact a cell."""
    return v.select(F.col("entity").cast("string").alias("accession"), F.struct(F.lit(0).alias("part"), F.col("year").cast("long").alias("pos")).alias("seq"), "concept", F.concat(F.lit("y"), "year").alias("context_ref"), F.lit("usd").alias("unit_ref"), F.lit(True).alias("numeric"), F.lit(False).alias("unparsed"), F.col("value").cast("string").alias("raw"), "value")


def as_contexts(v: DataFrame) -> DataFrame:
    """A duration of a calendar year for each year of an entity."""
    d = v.select(F.col("entity").cast("string").alias("accession"), "year").distinct()
    return d.select("accession", F.concat(F.lit("y"), "year").alias("context_ref"), F.make_date("year", F.lit(1), F.lit(1)).alias("period_start"), F.make_date("year", F.lit(12), F.lit(31)).alias("period_end"), F.array().cast("array<struct<dimension:string,member:string>>").alias("segments"), F.lit(True).alias("valid"))


def as_rows(v: DataFrame, preferred: str = "") -> DataFrame:
    """One role an entity, its concepts as rows by name."""
    d = v.select(F.col("entity").cast("string").alias("accession"), "concept").distinct()
    return d.select(
        "accession", F.lit("sales").alias("statement"), F.lit("http://v.test/role/Sales").alias("role_uri"), F.lit("Sales").alias("title"), F.array("concept").alias("path"), F.col("concept").alias("name"), F.col("concept").alias("label"),
        F.lit(preferred).alias("preferred_label"), F.lit(1).alias("depth"), F.lit(False).alias("has_children"), F.lit(False).alias("structural"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of customers."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("form"), F.format_string("%010d-%06d", "o_custkey", "o_orderkey").alias("accession"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_orderkey").alias("orderkey"))


FILINGS = """f AS (SELECT o_custkey AS cik, o_orderpriority AS form, printf('%010d-%06d', o_custkey, o_orderkey) AS accession,
       CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS orderkey FROM orders)"""


def statements(v: DataFrame, years: tuple[int, int]) -> DataFrame:
    """pair and statements: each entity's years between two, newest first, as one nested table."""
    lo, hi = years
    d = v.filter(F.col("year").between(lo, hi))
    columns = [F.struct(F.lit(str(y)).alias("label"), F.lit(f"y{y}").alias("context_ref"), F.lit(f"{y}-01-01").cast("date").alias("period_start"), F.lit(f"{y}-12-31").cast("date").alias("period_end"), F.lit(False).alias("instant")) for y in range(hi, lo - 1, -1)]
    values = F.array(*[F.max(F.when(F.col("year") == y, F.col("value"))) for y in range(hi, lo - 1, -1)])
    rows = d.groupBy("entity", "concept").agg(values.alias("values"))
    row = F.struct(F.col("concept").alias("label"), "concept", F.lit("data").alias("type"), F.lit(0).alias("depth"), "values")
    t = rows.groupBy("entity").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    conf = F.struct(F.lit("high").alias("level"), F.lit(1.0).alias("row_match_rate"), F.lit(1.0).alias("cell_resolved_rate"), F.lit(0).cast("long").alias("untagged_cell_count"))
    source = F.struct(F.lit("view").alias("extractor"), F.lit("0").alias("parser_version"))
    one = F.struct(F.lit("1").alias("schema_version"), F.lit("Sales").alias("title"), F.lit("http://v.test/role/Sales").alias("role_uri"), F.array(*columns).alias("columns"), "rows", F.lit(None).cast("map<string,string>").alias("footnotes"), conf.alias("confidence"), source.alias("source"))
    return t.select(F.col("entity").alias("pair"), F.array(one).alias("statements"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a text row and a break for each turn; answers end a block."""
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.col("conv_id").cast("string").alias("accession"), (F.col("turn") * 2).alias("pos"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("tag"), F.coalesce("text", F.lit("")).alias("text"), "role", "turn")
    b = t.filter("role = 'assistant'").select("accession", (F.col("pos") + 1).alias("pos"), F.lit("break").alias("kind"), F.lit("").alias("tag"), F.lit(None).cast("string").alias("text"), "role", "turn")
    return t.unionByName(b)

"""Reporting contexts and tagged facts of shredded documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import scalars as X


def _attr(name: str):
    return F.col("attrs")[name]


_PARTS = ("xbrli:identifier", "xbrli:instant", "xbrli:startdate", "xbrli:enddate", "xbrli:period", "xbrldi:typedmember", "xbrldi:explicitmember")


def contexts(nodes: DataFrame) -> DataFrame:
    """accession, context_ref, period_start, period_end, entity_cik, segments, typed and valid.

    An instant starts and ends on its date. Of contexts with one id the last stands. ``segments``
    are the explicit members only; ``typed`` tells that typed ones were left out. A context
    without id, period or readable dates makes ``valid`` false for all of its document.
    """
    # a context is in the group of its parts, so that nodes are read once
    own = F.col("tag") == "xbrli:context"
    x = nodes.filter("kind = 'element'").filter(own | (F.col("context_pos").isNotNull() & F.col("tag").isin(*_PARTS)))
    parts = x.select("accession", F.when(own, F.col("pos")).otherwise(F.col("context_pos")).alias("pos"), F.col("pos").alias("at"), "tag", X.trim("text").alias("text"), _attr("dimension").alias("dimension"), F.when(own, F.struct(_attr("id").alias("context_ref"))).alias("own"))
    first = lambda tag: F.min_by("text", F.when(F.col("tag") == tag, F.col("at")))
    member = F.when(F.col("tag") == "xbrldi:explicitmember", F.struct("at", "dimension", F.col("text").alias("member")))
    got = parts.groupBy("accession", "pos").agg(
        F.collect_list("own").alias("own"),
        first("xbrli:identifier").alias("entity_cik"), first("xbrli:instant").alias("instant"), first("xbrli:startdate").alias("start"), first("xbrli:enddate").alias("end"),
        F.bool_or(F.col("tag") == "xbrli:period").alias("period"), F.bool_or(F.col("tag") == "xbrldi:typedmember").alias("typed"),
        F.transform(F.sort_array(F.collect_list(member)), lambda m: F.struct(m["dimension"], m["member"])).alias("segments"),
    )
    date = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    c = got.withColumn("own", F.explode("own")).withColumn("context_ref", F.col("own.context_ref"))
    c = c.withColumn("period_start", F.when(F.col("instant").isNotNull(), date("instant")).otherwise(date("start"))).withColumn("period_end", F.when(F.col("instant").isNotNull(), date("instant")).otherwise(date("end")))
    sound = (F.coalesce("context_ref", F.lit("")) != "") & F.coalesce("period", F.lit(False)) & F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    kept = F.struct("period_start", "period_end", "entity_cik", F.coalesce("segments", F.array().cast("array<struct<dimension:string,member:string>>")).alias("segments"), F.coalesce("typed", F.lit(False)).alias("typed"))
    c = c.groupBy("accession", "context_ref").agg(F.max_by(kept, "pos").alias("c"), F.bool_and(sound).alias("sound"))
    c = c.filter("accession is not null").withColumn("valid", F.bool_and("sound").over(Window.partitionBy("accession")))
    return c.select("accession", "context_ref", "c.*", "valid")


def is_primary(segments="segments"):
    """No explicit segment."""
    return F.size(segments) == 0


def is_instant():
    return F.col("period_start") == F.col("period_end")


def facts(nodes: DataFrame, ctx: DataFrame) -> DataFrame:
    """accession, seq, concept, context_ref, unit_ref, numeric, raw, value, scale, decimals,
    negative, unparsed and id of every fact whose context exists, numeric ones first.

    Facts marked nil are left out, as are those of documents with an unsound context. ``value``
    is null for text and where a figure can't be read; ``unparsed`` tells the latter.
    """
    x = nodes.filter("kind = 'element' and tag in ('ix:nonfraction', 'ix:nonnumeric')").filter(F.coalesce(F.lower(_attr("xsi:nil")), F.lit("")) != "true")
    numeric = F.col("tag") == "ix:nonfraction"
    raw = X.trim("text")
    value = F.when(numeric, X.fact_value(raw, _attr("scale"), _attr("sign"), _attr("format")))
    out = x.select(
        "accession", F.when(numeric, 0).otherwise(1).alias("part"), "pos", _attr("name").alias("concept"), _attr("contextref").alias("context_ref"), _attr("unitref").alias("unit_ref"), numeric.alias("numeric"),
        raw.alias("raw"), value.alias("value"), F.when(numeric & value.isNotNull(), F.coalesce(_attr("scale").try_cast("int"), F.lit(0))).alias("scale"), _attr("decimals").alias("decimals"),
        (numeric & ((F.coalesce(_attr("sign"), F.lit("")) == "-") | X.in_parentheses(raw)) & value.isNotNull()).alias("negative"), (numeric & value.isNull()).alias("unparsed"), _attr("id").alias("id"),
    )
    out = out.join(ctx.filter("valid").select("accession", "context_ref"), ["accession", "context_ref"], "left_semi")
    # the order is a pair, so no window over a document is needed
    return out.select("accession", F.struct("part", "pos").alias("seq"), *[c for c in out.columns if c not in ("accession", "part", "pos")])


def usable(f: DataFrame, ctx: DataFrame) -> DataFrame:
    """Numeric, read facts of primary contexts, with their periods."""
    c = ctx.filter(is_primary()).select("accession", "context_ref", "period_start", "period_end")
    return f.filter("numeric and not unparsed").join(c, ["accession", "context_ref"])


def last_values(f: DataFrame, *by: str) -> DataFrame:
    """The value of the last fact of each key; units don't tell facts apart."""
    return f.groupBy(*by).agg(F.max_by("value", "seq").alias("value"))


def with_concept(f: DataFrame, needle: str) -> DataFrame:
    """Facts whose concept contains needle, in any case."""
    return f.filter(F.lower("concept").contains(needle.lower()))


def tsv(f: DataFrame, ctx: DataFrame) -> DataFrame:
    """accession, seq and line: concept, period, value and unit between tabs."""
    d = f.join(ctx.select("accession", "context_ref", "period_start", "period_end"), ["accession", "context_ref"])
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    period = F.when(is_instant(), day("period_end")).otherwise(F.concat(day("period_start"), F.lit(".."), day("period_end")))
    value = F.when(F.col("unparsed"), F.concat("raw", F.lit(" (unparsed)"))).when(F.col("numeric"), X.decimal_text(F.col("value"))).otherwise(F.col("raw"))
    return d.select("accession", "seq", F.concat_ws("\t", F.coalesce("concept", F.lit("")), period, value, F.coalesce("unit_ref", F.lit(""))).alias("line"))

"""Item sections of shredded documents, and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import scalars as X


def anchors(nodes: DataFrame) -> DataFrame:
    """Links within the document that stand in a table whose row names an item: accession, pos,
    table_pos, item, row and target (the id they point to)."""
    x = nodes.filter("kind = 'element'")
    a = x.filter("tag = 'a' and table_pos is not null").filter(F.col("attrs")["href"].rlike("(?s)^#."))
    a = a.select("accession", "pos", "table_pos", "row_pos", "text", F.expr("substring(attrs['href'], 2)").alias("target"))
    rows = x.filter("tag = 'tr'").select("accession", F.col("pos").alias("row_pos"), F.col("text").alias("row_text"))
    a = a.join(rows, ["accession", "row_pos"], "left").withColumn("row", X.collapse_spaces(F.coalesce("row_text", "text")))
    return a.withColumn("item", X.item_id(F.col("row"), anchored=False)).filter("item is not null").select("accession", "pos", "table_pos", "item", "row", "target")


def targets(nodes: DataFrame) -> DataFrame:
    """accession, target, target_pos and heading: the first element with an id, or named so."""
    x = nodes.filter("kind = 'element'")
    names = F.array_distinct(F.array_compact(F.array(F.col("attrs")["id"], F.when(F.col("tag") == "a", F.col("attrs")["name"]))))
    d = x.select("accession", "pos", "text", F.explode(names).alias("target")).filter("target <> ''")
    return d.groupBy("accession", "target").agg(F.min("pos").alias("target_pos"), F.min_by("text", "pos").alias("heading"))


def contents_tables(a: DataFrame) -> DataFrame:
    """Of each document the table whose links name most items, two at least; of equals the first."""
    n = a.groupBy("accession", "table_pos").agg(F.countDistinct("item").alias("n"))
    best = n.groupBy("accession").agg(F.max_by(F.struct("n", "table_pos"), F.struct("n", -F.col("table_pos"))).alias("b"))
    return best.filter("b.n >= 2").select("accession", "b.table_pos", F.col("b.n").alias("n_items"))


def contents_starts(nodes: DataFrame) -> DataFrame:
    """Starts by the table of contents: accession, item, heading, pos and resolved (every link
    found its target). A document has them if two items resolve at least."""
    a = anchors(nodes)
    d = a.join(contents_tables(a).drop("n_items"), ["accession", "table_pos"], "left_semi").join(targets(nodes), ["accession", "target"], "left")
    w = Window.partitionBy("accession", "item").orderBy("pos")
    # a link without target counts only while its item has no start yet
    before = F.max(F.col("target_pos").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("missed", F.col("target_pos").isNull() & ~F.coalesce(before, F.lit(False)))
    heading = X.collapse_spaces(F.coalesce("heading", F.lit("")))
    start = F.struct("pos", F.col("target_pos").alias("at"), F.when(heading != "", heading).otherwise(F.col("row")).alias("heading"))
    per = d.groupBy("accession", "item").agg(F.min(F.when(F.col("target_pos").isNotNull(), start)).alias("s"), F.bool_or("missed").alias("missed"))
    every = Window.partitionBy("accession")
    per = per.withColumn("resolved", ~F.bool_or("missed").over(every)).withColumn("n", F.count("s").over(every)).filter("s is not null and n >= 2")
    return per.select("accession", "item", F.col("s.heading").alias("heading"), F.col("s.at").alias("pos"), F.col("s.pos").alias("seq"), "resolved")


def heading_starts(nodes: DataFrame) -> DataFrame:
    """Starts by headings: the first heading of each item."""
    h = nodes.filter("kind = 'element'").filter(F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6", "b", "strong") | X.is_bold_style(F.col("attrs")["style"]))
    h = h.withColumn("heading", X.collapse_spaces(F.coalesce("text", F.lit("")))).withColumn("item", X.item_id(F.col("heading"), anchored=True)).filter("item is not null")
    return h.groupBy("accession", "item").agg(F.min_by("heading", "pos").alias("heading"), F.min("pos").alias("pos")).select("accession", "item", "heading", "pos", F.col("pos").alias("seq"), F.lit(False).alias("resolved"))


def spans(starts: DataFrame, total: DataFrame) -> DataFrame:
    """starts with seq numbered in order of pos and ``end_pos``: where the next start is, or
    ``total``. Of starts at one place all but the last are empty."""
    w = Window.partitionBy("accession").orderBy("pos", "seq")
    d = starts.join(total, "accession").withColumn("end_pos", F.lead("pos").over(w)).withColumn("end_pos", F.coalesce("end_pos", "total"))
    return d.withColumn("seq", F.row_number().over(w) - 1).drop("total")


def partition(nodes: DataFrame) -> DataFrame:
    """accession, seq, item, title, heading, kind, pos, end_pos, strategy and level.

    The table of contents decides where two of its items resolve, else the headings. Documents
    with neither have no rows. Sections tile the document from the first on.
    """
    c, h = contents_starts(nodes), heading_starts(nodes)
    by_contents = c.select("accession").distinct()
    starts = c.withColumn("strategy", F.lit("toc")).unionByName(h.join(by_contents, "accession", "left_anti").withColumn("strategy", F.lit("heading")))
    d = spans(starts, nodes.groupBy("accession").agg((F.max("pos") + 1).alias("total")))
    n = F.count("*").over(Window.partitionBy("accession"))
    item = F.col("item")
    return d.select(
        "accession", "seq", "item", X.item_title(item).alias("title"), "heading", F.when(item == "8", "financial").otherwise("narrative").alias("kind"), "pos", "end_pos", "strategy",
        X.partition_level(F.col("strategy"), F.col("resolved"), n).alias("level"),
    )


def render_text(nodes: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """accession, seq and text: shown text in blocks, a blank line between them.

    With ``parts`` (of ``partition``) each section has its own, otherwise the document has one
    with seq 0. Items of lists begin with a dash. Blocks are numbered by a running count of
    breaks; a block that two sections share is shown in both, each with its part.
    """
    t = nodes.filter("kind in ('text', 'space', 'break')").select("accession", "pos", "kind", "tag", "text")
    w = Window.partitionBy("accession").orderBy("pos")
    t = t.withColumn("block", F.coalesce(F.sum(F.when(F.col("kind") == "break", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    breaks = t.filter("kind = 'break'").select("accession", "block", F.col("tag").alias("prefix"))
    if parts is None:
        owned = t.filter("kind <> 'break'").withColumn("seq", F.lit(0))
    else:
        # sections tile the document, so the last start at or before a place owns it
        marks = parts.filter("pos < end_pos").select("accession", "pos", F.lit("start").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("block"), "seq")
        both = t.filter("kind <> 'break'").select("accession", "pos", "kind", "text", F.col("block").cast("long"), F.lit(None).cast("int").alias("seq")).unionByName(marks)
        owner = Window.partitionBy("accession").orderBy("pos", F.when(F.col("kind") == "start", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
        owned = both.withColumn("seq", F.last("seq", ignorenulls=True).over(owner)).filter("kind <> 'start' and seq is not null")
    piece = F.struct("pos", F.when(F.col("kind") == "space", F.lit(" ")).otherwise(F.col("text")).alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["t"]), "")
    b = owned.groupBy("accession", "seq", "block").agg(X.collapse_spaces(joined).alias("body")).filter("body <> ''")
    b = b.join(breaks, ["accession", "block"], "left").withColumn("body", F.concat(F.coalesce("prefix", F.lit("")), "body"))
    return b.groupBy("accession", "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "body"))), lambda x: x["body"]), "\n\n").alias("text"))


def with_text(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    return parts.join(render_text(nodes, parts), ["accession", "seq"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def formats(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """accession and formats: for each section with tables, whether one holds a tagged figure."""
    t = nodes.filter("kind = 'element' and tag = 'table'").select("accession", "pos", (F.col("n_figures") > 0).alias("tagged"), F.lit(None).cast("string").alias("item"))
    marks = parts.filter("pos < end_pos").select("accession", "pos", F.lit(None).cast("boolean").alias("tagged"), "item")
    owner = Window.partitionBy("accession").orderBy("pos", F.col("tagged").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    d = t.unionByName(marks).withColumn("item", F.last("item", ignorenulls=True).over(owner)).filter("tagged is not null and item is not null")
    per = d.groupBy("accession", "item").agg(F.when(F.bool_or("tagged"), "IXBRL").otherwise("PlainHTML").alias("format"))
    return per.groupBy("accession").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("item", "format")))).alias("formats"))


def pick_for_get(sections: DataFrame, needle: str) -> DataFrame:
    """Of each document the first section whose item is needle or whose title contains it."""
    hit = (F.lower("item") == needle.lower()) | F.lower("title").contains(needle.lower())
    first = sections.filter(hit).groupBy("accession").agg(F.min("seq").alias("seq"))
    return sections.join(first, ["accession", "seq"], "left_semi")


def pick_for_text(sections: DataFrame, needle: str) -> DataFrame:
    """Of each document the section whose item is needle, else the first whose title or heading
    contains it."""
    low = needle.lower()
    rank = F.when(F.lower("item") == low, 0).when(F.lower("title").contains(low) | F.lower("heading").contains(low), 1)
    best = sections.withColumn("rank", rank).filter("rank is not null").groupBy("accession").agg(F.min(F.struct("rank", "seq")).alias("b"))
    return sections.join(best.select("accession", F.col("b.seq").alias("seq")), ["accession", "seq"], "left_semi")


def tsv(sections: DataFrame) -> DataFrame:
    """accession, seq and line: item, title, bytes and paragraphs between tabs."""
    line = F.concat_ws("\t", F.concat(F.lit("Item "), "item"), "title", F.concat(F.octet_length("text").cast("string"), F.lit(" chars")), F.concat(X.paragraph_count(F.col("text")).cast("string"), F.lit(" paragraphs")))
    return sections.select("accession", "seq", line.alias("line"))

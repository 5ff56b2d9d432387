"""Formats of raw documents, by their first bytes and the share of tagged figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon import schemas as S
from tabulon.functions import scalars as X


def head(content: Column) -> Column:
    return F.decode(F.substring(content, 1, S.HEAD_BYTES), "ISO-8859-1")


def signals(content: Column) -> dict[str, Column]:
    """What the first bytes tell: html, namespace and plain."""
    h = head(content)
    low = F.lower(h)
    marked = low.contains("<sec-document>") | low.contains("<document>") | low.contains("<type>")
    feed = F.decode(content, "ISO-8859-1").contains("\f")
    return {"html": low.contains("<html"), "namespace": h.contains(S.NAMESPACE), "plain": marked | (feed & h.rlike("[-=]{5,}"))}


def density(nodes: DataFrame) -> DataFrame:
    """accession, numeric, tagged and any_tag: cells that show a figure, those with a tag within,
    and whether the document has a tag at all."""
    return nodes.filter("kind = 'element'").groupBy("accession").agg(*_density())


def _density() -> list[Column]:
    cell = F.col("tag").isin("td", "th") & X.is_financial_figure(F.col("text"))
    return [F.count_if(cell).alias("numeric"), F.count_if(cell & (F.col("n_ix") > 0)).alias("tagged"), F.bool_or(F.col("tag").startswith("ix:")).alias("any_tag")]


def index_reference(nodes: DataFrame) -> DataFrame:
    """accession and href: the first link to a document in a filing index's first file table."""
    d = nodes.filter("kind = 'element' and tag in ('a', 'table')").groupBy("accession").agg(*_links())
    return d.select("accession", _reference().alias("href")).filter("href is not null")


def _links() -> list[Column]:
    """The first file table of a document, and its links to documents."""
    href = F.col("attrs")["href"]
    files = (F.col("tag") == "table") & F.lower(F.col("attrs")["summary"]).contains("document format files")
    link = (F.col("tag") == "a") & F.lower(href).rlike(r"(?s)\.(htm|html|txt)$") & ~F.lower(href).contains("-index")
    return [F.min(F.when(files, F.struct("pos", "end_pos"))).alias("files"), F.collect_list(F.when(link, F.struct("pos", href.alias("href")))).alias("links")]


def _reference() -> Column:
    within = F.filter("links", lambda x: (x["pos"] > F.col("files.pos")) & (x["pos"] <= F.col("files.end_pos")))
    return F.array_min(within)["href"]


def classify(raw: DataFrame, nodes: DataFrame, resolved: bool = False) -> DataFrame:
    """accession, format, numeric, tagged, index_href and warnings of each document of ``raw``.

    A filing index (``index_href`` isn't null) has no format of its own: ``resolve`` finds the
    document that it leads to. With ``resolved`` an index is classified as what it is, with a
    warning. Null contents are of unknown format.
    """
    s = signals(F.col("content"))
    d = raw.select("accession", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in s.items()])
    # both at once, so that nodes are made once
    told = nodes.filter("kind = 'element'").groupBy("accession").agg(*_density(), *_links()).withColumn("href", _reference()).drop("files", "links")
    d = d.join(told, "accession", "left").withColumn("index_href", F.when(F.col("html"), F.col("href")))
    numeric, share = F.coalesce("numeric", F.lit(0)), F.try_divide("tagged", "numeric")
    none = ~F.coalesce("any_tag", F.lit(False))
    by_share = F.when(numeric == 0, F.when(none, S.HTML).otherwise(S.IXBRL)).when(share >= S.DENSE, S.IXBRL).when(share >= S.SPARSE, S.PARTIAL).otherwise(S.HTML)
    kind = F.when(~F.col("html"), F.when(F.col("plain"), S.TEXT).otherwise(S.UNKNOWN)).when(~F.col("namespace"), S.HTML).otherwise(by_share)
    index = F.col("index_href").isNotNull()
    empty = F.when(F.col("html") & F.col("namespace") & (numeric == 0) & none, F.lit("inline-XBRL namespace declared but no facts found"))
    if resolved:
        told = F.when(index & ~F.col("namespace"), F.lit("resolved document still resembles a filing index; not resolving further"))
    else:
        told, kind = F.when(index, F.lit("filing index detected")), F.when(index, F.lit(S.UNKNOWN)).otherwise(kind)
        empty = F.when(~index, empty)
    return d.select("accession", kind.alias("format"), F.coalesce("numeric", F.lit(0)).alias("numeric"), F.coalesce("tagged", F.lit(0)).alias("tagged"), "index_href", F.array_compact(F.array(empty, told)).alias("warnings"))


def resolve(classes: DataFrame, files: DataFrame) -> DataFrame:
    """accession and content of the documents that filing indexes lead to, one step only.

    files(accession, name, content). What isn't there is left out.
    """
    d = classes.filter("index_href is not null").select("accession", F.substring_index("index_href", "/", -1).alias("name"))
    return d.join(files, ["accession", "name"]).select("accession", "content")


def supported(classes: DataFrame) -> DataFrame:
    return classes.filter(F.col("format").isin(*S.SUPPORTED))


def refused(classes: DataFrame) -> DataFrame:
    """accession, format and reason of what isn't read."""
    return classes.filter(~F.col("format").isin(*S.SUPPORTED)).select("accession", "format", F.concat("format", F.lit(" isn't read: only inline-tagged filings are")).alias("reason"))

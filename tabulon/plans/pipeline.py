"""From landed files to documents: metadata, item sections and statements of many filings at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon import schemas as S
from tabulon.functions import scalars as X
from tabulon.operators import facts as FA
from tabulon.operators import layout, linkbase, project, router, sections
from tabulon.sources import landing
from tabulon.sources.scratch import written
from tabulon.sources.shred import shred


class Parsed:
    """The relations of a set of filings. Each is made when it is first asked for, and written,
    so a document's HTML is parsed once whatever is asked."""

    def __init__(self, found: DataFrame, filings: DataFrame):
        self.found, self.filings = found, filings
        own = filings.select("accession", X.fold_accession(F.col("accession")).alias("folder"))
        self._files = own.join(found.select("folder", "name", "content"), "folder").drop("folder")
        self._raw = landing.documents(found, filings)
        self._first = written(shred(self._raw), "nodes")
        classes = written(router.classify(self._raw, self._first), "classes")
        self._led = None
        # filing indexes are followed once: what one leads to is classified in its place
        if not classes.filter("index_href is not null").isEmpty():
            led = router.resolve(classes, self._files)
            self._led = written(shred(led), "nodes")
            second = router.classify(led, self._led, resolved=True)
            classes = written(classes.join(second, "accession", "left_anti").unionByName(second), "classes")
        self.classes = classes

    @cached_property
    def nodes(self) -> DataFrame:
        """Nodes of the documents that are read."""
        read = router.supported(self.classes).select("accession")
        nodes = self._first.join(read, "accession", "left_semi")
        if self._led is None:
            return nodes
        led = self._led.select("accession").distinct()
        return nodes.join(led, "accession", "left_anti").unionByName(self._led.join(read, "accession", "left_semi"))

    @cached_property
    def contexts(self) -> DataFrame:
        return written(FA.contexts(self.nodes), "contexts")

    @cached_property
    def facts(self) -> DataFrame:
        return written(FA.facts(self.nodes, self.contexts), "facts")

    @cached_property
    def sections(self) -> DataFrame:
        parts = written(sections.partition(self.nodes), "parts")
        return written(sections.with_text(self.nodes, parts), "sections")

    @cached_property
    def roles(self) -> DataFrame:
        return written(role_rows(self.found, router.supported(self.classes).select("accession")), "roles")


def role_rows(found: DataFrame, accessions: DataFrame) -> DataFrame:
    """Roles of filings whose directory has a presentation and a label linkbase."""
    names = landing.companions(landing.directory(found)).filter("pre is not null and lab is not null")
    names = accessions.select("accession", X.fold_accession(F.col("accession")).alias("folder")).join(names, "folder")
    body = found.select("folder", "name", "content")
    part = lambda kind: names.select("accession", "folder", F.col(kind).alias("name")).join(body, ["folder", "name"]).select("accession", "content")
    return linkbase.roles(part("pre"), linkbase.labels(part("lab")), linkbase.role_titles(part("xsd")))


def statement_rows(roles: DataFrame, statements: tuple[str, ...] = S.DEFAULT_STATEMENTS) -> DataFrame:
    """The rows of the roles that the wanted statements take; unknown names are left out."""
    chosen = linkbase.select_roles(roles, {s: S.STATEMENTS[s] for s in statements if s in S.STATEMENTS})
    return roles.join(chosen, ["accession", "role_seq"])


def combined(level_of_sections: Column, tables: Column) -> Column:
    """A document's confidence: the worst level that sections and statements have (low if none
    has one), the means of the statements' rates, and all their cells without a fact."""
    levels = F.concat(F.array_compact(F.array(level_of_sections)), F.transform(tables, lambda t: t["confidence"]["level"]))
    has = lambda v: F.array_contains(levels, v)
    level = F.when(has("low") | (F.size(levels) == 0), "low").when(has("medium"), "medium").otherwise("high")
    mean = lambda name: F.when(F.size(tables) > 0, F.aggregate(F.transform(tables, lambda t: t["confidence"][name]), F.lit(0.0), lambda a, x: a + x) / F.size(tables)).otherwise(0.0)
    untagged = F.aggregate(F.transform(tables, lambda t: t["confidence"]["untagged_cell_count"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return project.confidence(level, mean("row_match_rate"), mean("cell_resolved_rate"), untagged)


def documents(p: Parsed, statements: tuple[str, ...] = S.DEFAULT_STATEMENTS, section_tables: bool = False) -> DataFrame:
    """accession, metadata, sections and statements of every filing that is read.

    A filing without linkbases, or with an unsound context, has no statements; one without
    sections has none, and its level is that of its statements. With ``section_tables`` each
    section carries its tables without tags.
    """
    t = project.tables(statement_rows(p.roles, statements), p.facts, p.contexts)
    order = F.array_position(F.lit(list(statements)), F.col("statement"))
    t = _nested(t, order, "statements")
    s = p.sections
    if section_tables:
        own = layout.tables(p.nodes).join(s.select("accession", "seq", "pos", "end_pos"), "accession").filter("table_pos >= pos and table_pos < end_pos")
        own = own.groupBy("accession", "seq").agg(F.collect_list(F.struct("table_seq", "table")).alias("ts"))
        s = s.join(own.select("accession", "seq", F.transform(F.array_sort("ts", lambda a, b: a["table_seq"] - b["table_seq"]), lambda x: x["table"]).alias("tables")), ["accession", "seq"], "left")
    section = F.struct("item", "title", "kind", "text", *(["tables"] if section_tables else []))
    s = s.groupBy("accession").agg(F.first("level").alias("level"), F.collect_list(F.struct("seq", section.alias("s"))).alias("ss"))
    s = s.select("accession", "level", F.transform(F.array_sort("ss", lambda a, b: a["seq"] - b["seq"]), lambda x: x["s"]).alias("sections"))
    read = router.supported(p.classes).select("accession")
    d = p.filings.join(read, "accession").join(s, "accession", "left").join(t, "accession", "left")
    d = d.withColumn("statements", F.coalesce("statements", F.array().cast(t.schema["statements"].dataType))).withColumn("sections", F.coalesce("sections", F.array().cast(s.schema["sections"].dataType)))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    metadata = F.struct(
        "company", "cik", "ticker", "form", "accession", day("filing_date").alias("filing_date"), F.lit(None).cast("string").alias("period_start"), day("report_date").alias("period_end"),
        F.lit(S.SCHEMA_VERSION).alias("schema_version"), F.lit(S.PARSER_VERSION).alias("parser_version"),
        F.struct(F.lit(S.EXTRACT_ALL).alias("extractor"), F.lit(S.PARSER_VERSION).alias("parser_version")).alias("source"), combined(F.col("level"), F.col("statements")).alias("confidence"),
    )
    return d.select("accession", metadata.alias("metadata"), "sections", "statements")


def _nested(t: DataFrame, order: Column, name: str) -> DataFrame:
    """Tables of each accession in order. Maps aren't sortable, so only the number is compared."""
    d = t.groupBy("accession").agg(F.collect_list(F.struct(order.alias("n"), F.col("table"))).alias("ts"))
    return d.select("accession", F.transform(F.array_sort("ts", lambda a, b: (a["n"] - b["n"]).cast("int")), lambda x: x["table"]).alias(name))

"""The public entry points over a landing folder.

``Filings(spark, root)`` answers for one ticker; ``documents`` does all requested filings at
once. Whoever asks for one thing that isn't there gets ``NotFound``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import schemas as S
from tabulon.functions import scalars as X
from tabulon.operators import accuracy, compare, facts, filings, layout, project, router, sections
from tabulon.operators.filings import NotFound
from tabulon.plans import pipeline, render
from tabulon.sources import landing
from tabulon.sources.scratch import written
from tabulon.sources.store import Store


class Filings:
    """Filings of a landing folder. ``store`` names a folder that keeps parsed documents."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root, self.store = spark, root, Store(spark, store)
        self._made: dict[tuple, pipeline.Parsed] = {}

    def files(self, *patterns: str) -> DataFrame:
        """Landed files, all or those of some patterns."""
        return landing.files(self.spark, self.root, *patterns)

    # which filings

    def submissions(self) -> DataFrame:
        """Filings of all companies whose submissions can be read."""
        names = landing.tickers(self.files(landing.TICKERS)).groupBy("cik").agg(F.min("ticker").alias("ticker"))
        return landing.submissions(self.files(landing.SUBMISSIONS)).join(names, "cik", "left")

    def unsound(self) -> DataFrame:
        """Companies whose submissions can't be read, and why."""
        return landing.unsound(self.files(landing.SUBMISSIONS))

    def _chosen(self, ticker: str, form: str = "10-K", year: int | None = None, accession: str | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(ticker,)], "ticker string")
        known, _ = filings.with_cik(asked, landing.tickers(self.files(landing.TICKERS)))
        company = known.head()
        if company is None:
            raise NotFound(f"unknown ticker {ticker!r}")
        landed = self.files(landing.submissions_of(company["cik"]))
        if bad := landing.unsound(landed).head():
            raise ValueError(f"submissions of {ticker} have {bad['reason']}")
        mine = landing.submissions(landed).join(known, "cik", "inner")
        found = written(filings.select(mine, form, year, accession), "chosen")
        if found.isEmpty():
            raise NotFound(f"{ticker} has no filing {accession}" if accession else f"{ticker} has no {form}" + (f" filed in {year}" if year else ""))
        return found

    def latest(self, ticker: str, form: str = "10-K") -> DataFrame:
        """The latest filing of a form."""
        return self._chosen(ticker, form)

    def fetch(self, ticker: str, form: str = "10-K", year: int | None = None, n: int = 200) -> DataFrame:
        """The first bytes of a primary document, and its address."""
        f = self._chosen(ticker, form, year)
        url = f.select("accession", landing.archive_url(F.col("cik"), F.col("accession"), F.col("primary_document")).alias("url"))
        return landing.head(landing.documents(self._files_of(f), f), n).join(url, "accession")

    def _files_of(self, one: DataFrame) -> DataFrame:
        """The files of one filing."""
        r = one.head()
        return self.files(landing.files_of(r["cik"], r["accession"]))

    # documents

    def documents(self, chosen: DataFrame, statements: tuple[str, ...] = S.DEFAULT_STATEMENTS, section_tables: bool = False) -> DataFrame:
        """Documents of any set of filings (rows of ``submissions``)."""
        return pipeline.documents(pipeline.Parsed(self.files(landing.ARCHIVES), chosen), statements, section_tables)

    def unreadable(self, chosen: DataFrame) -> DataFrame:
        """Of a set of filings those in formats that aren't read."""
        return router.refused(pipeline.Parsed(self.files(landing.ARCHIVES), chosen).classes)

    def _one(self, ticker: str, form: str = "10-K", year: int | None = None, accession: str | None = None) -> DataFrame:
        p = self._parsed(ticker, form, year, accession)
        bad = router.refused(p.classes).head()
        if bad:
            raise ValueError(f"{bad['accession']} is {bad['reason']}")
        return written(pipeline.documents(p), "documents")

    def get(self, ticker: str, form: str = "10-K", year: int | None = None, accession: str | None = None, section: str | None = None) -> DataFrame:
        """A filing as one nested row. ``section`` keeps one section; the financial one keeps the
        statements, others don't."""
        d = self._one(ticker, form, year, accession)
        if section is None:
            return d
        low = section.lower()
        hit = F.filter("sections", lambda s: (F.lower(s["item"]) == low) | F.lower(s["title"]).contains(low))
        d = d.withColumn("sections", F.slice(hit, 1, 1)).filter(F.size("sections") > 0)
        if d.isEmpty():
            raise NotFound(f"no section {section!r}")
        financial = F.element_at("sections", 1)["kind"] == "financial"
        return d.withColumn("statements", F.when(financial, F.col("statements")).otherwise(F.filter("statements", lambda _: F.lit(False))))

    def rendered(self, ticker: str, output: str = "json", **which) -> DataFrame:
        """accession and text; what the store has isn't parsed again."""
        make = render.renderer(output)
        if make is render.to_json and not which.get("section"):
            chosen = self._chosen(ticker, **{k: v for k, v in which.items() if k != "section"})
            kept = self.store.documents(chosen)
            if not kept.isEmpty():
                return kept.select("accession", F.col("document").alias("text"))
            made = make(self.get(ticker, **which))
            self.store.put_documents(made.select("accession", F.col("text").alias("document")))
            return made
        return make(self.get(ticker, **which))

    def diff(self, ticker: str, before: int, after: int, form: str = "10-K", layer: str = "structural", section: str | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Change sets of the filings of two years, and marked-up sections for the lexical layer."""
        if layer == "semantic":
            raise NotImplementedError("no semantic layer")
        # both sides are refused before either is parsed further
        sides = [self._one(ticker, form, year).withColumn("pair", F.lit(ticker.upper())) for year in (before, after)]
        if section is not None:
            keep = lambda s: (F.lower(s["item"]) == section.lower()) | F.lower(s["title"]).contains(section.lower())
            sides = [d.withColumn("sections", F.filter("sections", keep)) for d in sides]
        return compare.compare(*sides, layer)

    # single stages

    def _parsed(self, *which) -> pipeline.Parsed:
        if which not in self._made:
            chosen = self._chosen(*which)
            self._made[which] = pipeline.Parsed(self._files_of(chosen), chosen)
        return self._made[which]

    def detect(self, ticker: str, form: str = "10-K", year: int | None = None) -> DataFrame:
        """Format, cell counts and warnings."""
        return self._parsed(ticker, form, year).classes

    def facts(self, ticker: str, form: str = "10-K", year: int | None = None, concept: str | None = None) -> DataFrame:
        """Facts as lines."""
        p = self._parsed(ticker, form, year)
        return facts.tsv(facts.with_concept(p.facts, concept) if concept else p.facts, p.contexts).orderBy("seq")

    def table(self, ticker: str, statement: str = "income", form: str = "10-K", year: int | None = None) -> DataFrame:
        """One statement."""
        if statement not in S.STATEMENTS:
            raise ValueError(f"unknown statement {statement!r} (choose {', '.join(S.STATEMENTS)})")
        p = self._parsed(ticker, form, year)
        return project.tables(pipeline.statement_rows(p.roles, (statement,)), p.facts, p.contexts)

    def layout_table(self, ticker: str, index: int = 0, form: str = "10-K", year: int | None = None) -> DataFrame:
        """The index-th table of a document, read by its layout."""
        found = layout.tables(self._parsed(ticker, form, year).nodes).filter(F.col("table_seq") == index)
        if found.isEmpty():
            raise NotFound(f"no table {index}")
        return found

    def sections(self, ticker: str, form: str = "10-K", year: int | None = None) -> DataFrame:
        """Sections as lines."""
        return sections.tsv(self._parsed(ticker, form, year).sections).orderBy("seq")

    def text(self, ticker: str, section: str, form: str = "10-K", year: int | None = None) -> DataFrame:
        """The text of one section."""
        found = sections.pick_for_text(self._parsed(ticker, form, year).sections, section.strip()).select("accession", "item", "text")
        if found.isEmpty():
            raise NotFound(f"no section {section!r}")
        return found


def score(spark: SparkSession, root: str) -> DataFrame:
    """Scores of a folder of corpus entries, each a landing folder of its own files with a
    baseline.json, tickers, submissions, index and documents side by side."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = found.select("path", F.substring_index("path", "/", -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("entry"), "content")
    base = landing.baselines(found)
    subs = landing.submissions(found.withColumn("path", F.concat("entry", F.lit("/submissions/CIK0.json"))).filter("name = 'submissions.json'"))
    by_entry = found.filter("name = 'submissions.json'").select(F.col("entry"), F.from_json(F.decode("content", "UTF-8"), S.SUBMISSIONS_JSON)["cik"].try_cast("long").alias("cik"))
    wanted = base.select(F.col("name").alias("entry"), "ticker", "form").join(by_entry, "entry").join(subs, ["cik", "form"])
    chosen = filings.latest(wanted, "entry")
    folder = chosen.select("entry", X.fold_accession(F.col("accession")).alias("folder"))
    landed = found.join(folder, "entry").select("path", "name", "folder", F.lit(None).cast("long").alias("cik"), "content")
    docs = pipeline.documents(pipeline.Parsed(landed, chosen)).join(chosen.select("accession", F.col("entry").alias("name")), "accession")
    return accuracy.score(docs, base)


def search(*_, **__):
    """There is no full-text search."""
    raise NotImplementedError("no full-text search")

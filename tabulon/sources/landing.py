"""Landed files as relations: tickers, submissions, directories and documents.

A landing folder holds ``company_tickers.json``, ``submissions/CIK<10 digits>.json`` and
``archives/<cik>/<accession>/<file>`` with an ``index.json`` in each. Every reader takes the
relation that ``files`` gives, so any Hadoop file system will do. Filters on it don't keep
other files from being read; who wants some names them by pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import schemas as S
from tabulon.functions import scalars as X


TICKERS, SUBMISSIONS, ARCHIVES = "company_tickers.json", "submissions/*.json", "archives/*/*/*"


def submissions_of(cik: int) -> str:
    """The pattern of one company's submissions."""
    return f"submissions/CIK{cik:010d}.json"


def files_of(cik: int, accession: str) -> str:
    """The pattern of one filing's files, whose folder has dashes or none."""
    return f"archives/{cik}/{{{accession},{accession.replace('-', '')}}}/*"


def files(spark: SparkSession, root: str, *patterns: str) -> DataFrame:
    """path, name, folder, cik and content of every file below root, or of those that the
    patterns (below root) match: no other is read. Patterns that nothing matches give none."""
    reader = spark.read.format("binaryFile")
    if patterns:
        paths = [f"{root.rstrip('/')}/{p}" for p in patterns]
        found = [p for p in paths if _matches(spark, p)]
        raw = reader.load(found) if found else spark.createDataFrame([], "path string, content binary")
    else:
        raw = reader.option("recursiveFileLookup", "true").load(root)
    part = lambda g: F.regexp_extract("path", r"/archives/(\d+)/([^/]+)/[^/]+$", g)
    return raw.select("path", F.substring_index("path", "/", -1).alias("name"), F.when(part(2) != "", X.fold_accession(part(2))).alias("folder"), part(1).try_cast("long").alias("cik"), "content")


def _matches(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def _text() -> Column:
    return F.decode("content", "UTF-8")


def tickers(found: DataFrame) -> DataFrame:
    """ticker (upper case), cik and title."""
    d = found.filter("name = 'company_tickers.json'").select(F.explode(F.from_json(_text(), S.TICKERS_JSON)).alias("k", "v"))
    # of a ticker that stands twice the last stands
    return d.groupBy(F.upper("v.ticker").alias("ticker")).agg(F.max_by("v.cik_str", F.col("k").try_cast("long")).alias("cik"), F.max_by("v.title", F.col("k").try_cast("long")).alias("title"))


def submissions(found: DataFrame) -> DataFrame:
    """cik, company, accession, filing_date, report_date, form and primary_document, one row a
    filing; a blank report date is null. Companies that ``unsound`` names have none."""
    return from_recent(_recent(found))


def unsound(found: DataFrame) -> DataFrame:
    """cik and reason of companies whose submissions can't be read: arrays of differing lengths,
    or dates that are none. They keep no other company from being read."""
    d = _recent(found).select("cik", _fault().alias("reason"))
    return d.filter("reason is not null")


def _recent(found: DataFrame) -> DataFrame:
    d = found.filter(F.col("path").rlike(r"/submissions/[^/]+\.json$") | (F.col("name") == "submissions.json"))
    d = d.select("path", F.from_json(_text(), S.SUBMISSIONS_JSON).alias("s"))
    return d.select(F.coalesce(F.col("s.cik").try_cast("long"), F.regexp_extract("path", r"CIK(\d+)", 1).try_cast("long")).alias("cik"), F.col("s.name").alias("company"), F.col("s.filings.recent").alias("recent"))


_ARRAYS = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")


def _fault() -> Column:
    """Why ``recent`` can't be read, or null."""
    n = F.size("recent.accessionNumber")
    equal = F.forall(F.array(*[F.size(f"recent.{c}") for c in _ARRAYS]), lambda x: x == n)
    day = lambda c: F.forall(f"recent.{c}", lambda x: (x == "") | F.try_to_date(x, "yyyy-MM-dd").isNotNull())
    dates = F.coalesce(day("filingDate"), F.lit(True)) & F.coalesce(day("reportDate"), F.lit(True))
    return F.when(~F.coalesce(equal, F.lit(True)), "arrays of differing lengths").when(~dates, "dates that can't be read")


def from_recent(d: DataFrame) -> DataFrame:
    """The same of rows with cik, company and a struct ``recent`` of parallel arrays."""
    d = d.filter(_fault().isNull()).select("cik", "company", F.explode(F.arrays_zip(*[F.col(f"recent.{c}") for c in _ARRAYS])).alias("f"))
    day = lambda c: F.when(F.col(c) == "", F.lit(None).cast("date")).otherwise(F.to_date(c, "yyyy-MM-dd"))
    return d.select("cik", "company", F.col("f.accessionNumber").alias("accession"), day("f.filingDate").alias("filing_date"), day("f.reportDate").alias("report_date"), F.col("f.form").alias("form"), F.col("f.primaryDocument").alias("primary_document"))


def directory(found: DataFrame) -> DataFrame:
    """folder, ordinal and name of what each filing's index.json lists."""
    d = found.filter("name = 'index.json' and folder is not null").select("folder", F.from_json(_text(), S.DIRECTORY_JSON).alias("d"))
    return d.select("folder", F.posexplode("d.directory.item").alias("ordinal", "i")).select("folder", "ordinal", F.col("i.name").alias("name"))


def companions(listed: DataFrame) -> DataFrame:
    """folder, pre, lab and xsd: the first file of each kind that a directory lists."""
    first = lambda suffix: F.min_by("name", F.when(F.col("name").endswith(suffix), F.col("ordinal")))
    return listed.groupBy("folder").agg(first("_pre.xml").alias("pre"), first("_lab.xml").alias("lab"), first(".xsd").alias("xsd"))


def documents(found: DataFrame, filings: DataFrame) -> DataFrame:
    """accession and content of each filing's primary document."""
    d = filings.select("accession", X.fold_accession(F.col("accession")).alias("folder"), F.col("primary_document").alias("name"))
    return d.join(found.select("folder", "name", "content"), ["folder", "name"]).select("accession", "content")


def archive_url(cik: Column, accession: Column, name: Column) -> Column:
    """Where a document of a filing lies in the public archive."""
    return F.concat(F.lit(f"{S.ARCHIVE}/Archives/edgar/data/"), cik.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), name)


def resolved_url(base: Column, ref: Column) -> Column:
    """An address as a filing index writes it, in full. ``base`` ends in a slash."""
    full = ref.startswith("http://") | ref.startswith("https://")
    return F.when(full, ref).when(ref.startswith("/"), F.concat(F.lit(S.ARCHIVE), ref)).otherwise(F.concat(base, ref))


def head(found: DataFrame, n: int = 200) -> DataFrame:
    """The first bytes of each file."""
    return found.withColumn("content", F.substring("content", 1, n))


def baselines(found: DataFrame) -> DataFrame:
    """name and the expected results of each corpus folder with a baseline.json."""
    d = found.filter("name = 'baseline.json'").select(F.element_at(F.split("path", "/"), -2).alias("name"), F.from_json(_text(), S.BASELINE_JSON).alias("b"))
    return d.select("name", "b.*")

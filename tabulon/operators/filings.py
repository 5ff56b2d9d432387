"""Which filings are meant: tickers, forms, years and accession numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import scalars as X


class NotFound(LookupError):
    """A ticker or filing that isn't there."""


def with_cik(requests: DataFrame, tickers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with the cik of their ticker, and those whose ticker is unknown."""
    d = requests.withColumn("ticker", F.upper(X.trim("ticker")))
    return d.join(tickers.select("ticker", "cik"), "ticker"), d.join(tickers.select("ticker"), "ticker", "left_anti")


def of_form(filings: DataFrame, form: str) -> DataFrame:
    """Exactly this form: an amendment is another one."""
    return filings.filter(F.col("form") == form)


def in_year(filings: DataFrame, year: int) -> DataFrame:
    """Filed in a year. A range of dates prunes partitions and row groups, a year() would not."""
    return filings.filter((F.col("filing_date") >= F.lit(f"{year}-01-01").cast("date")) & (F.col("filing_date") < F.lit(f"{year + 1}-01-01").cast("date")))


def by_accession(filings: DataFrame, accession: str) -> DataFrame:
    """The filing of an accession number in any spelling, of any form."""
    return filings.filter(X.fold_accession(F.col("accession")) == X.fold_accession(F.lit(accession)))


def latest(filings: DataFrame, *by: str) -> DataFrame:
    """The latest filing of each key, the greatest accession number of those of one day.

    It is an aggregate, so a key's filings are reduced before they are moved.
    """
    cols = [F.col(c) for c in filings.columns]
    return filings.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct("filing_date", "accession")).alias("f")).select("f.*")


def in_order(filings: DataFrame, *by: str) -> DataFrame:
    """Filings with ``nth``, 1 for the latest of its key."""
    w = Window.partitionBy(*by).orderBy(F.desc("filing_date"), F.desc("accession"))
    return filings.withColumn("nth", F.row_number().over(w))


def select(filings: DataFrame, form: str = "10-K", year: int | None = None, accession: str | None = None) -> DataFrame:
    """One filing of each company: by accession number, else the latest of form and year, else
    the latest of form."""
    if accession:
        return by_accession(filings, accession)
    d = of_form(filings, form)
    return latest(d if year is None else in_year(d, year), "cik")

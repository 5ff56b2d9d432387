"""``python -m tabulon COMMAND ...`` over a landing folder."""

from __future__ import annotations

import argparse
import sys

from tabulon import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabulon")
    p.add_argument("--root", default="landing", help="landing folder")
    p.add_argument("--store", help="folder that keeps parsed documents")
    p.add_argument("--no-cache", action="store_true", help="neither read nor write the store")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *more: str, ticker: bool = True):
        c = sub.add_parser(name)
        if ticker:
            c.add_argument("ticker")
            c.add_argument("--type", "-t", dest="form", default="10-K")
        for m in more:
            c.add_argument(f"--{m}", type=int if m in ("year", "from", "to", "index") else str, required=m in ("from", "to"))
        return c

    command("get", "year", "accession", "section").add_argument("--format", "-f", dest="output", default="json")
    d = command("diff", "from", "to", "section")
    d.add_argument("--layer", default="structural")
    d.add_argument("--format", "-f", dest="output", default="json")
    command("latest")
    command("fetch", "year")
    command("detect", "year")
    command("facts", "year", "concept")
    t = command("table", "year", "index")
    t.add_argument("--statement", default="income")
    t.add_argument("--layout", action="store_true")
    command("sections", "year")
    command("text", "year").add_argument("--section", required=True)
    command("cache", ticker=False).add_argument("action", choices=("path", "clear"))
    command("accuracy", ticker=False).add_argument("corpus")
    sub.add_parser("version")
    return p


def lines(a: argparse.Namespace, spark) -> list[str]:
    """What a command prints."""
    from pyspark.sql import functions as F

    from tabulon import api
    from tabulon.operators import accuracy
    from tabulon.plans import render

    if a.command == "accuracy":
        return [r["line"] for r in accuracy.report(api.score(spark, a.corpus)).orderBy("seq").collect()]
    f = api.Filings(spark, a.root, None if a.no_cache else a.store)
    if a.command == "cache":
        if a.action == "clear":
            f.store.clear()
        return [f.store.root or ""]
    if a.command == "get":
        return [r["text"] for r in f.rendered(a.ticker, a.output, form=a.form, year=a.year, accession=a.accession, section=a.section).collect()]
    if a.command == "diff":
        sets, words = f.diff(a.ticker, getattr(a, "from"), a.to, a.form, a.layer, a.section)
        out = render.lexical_markdown(sets, words) if words is not None else render.changes_renderer(a.output)(sets)
        return [r["text"] for r in out.collect()]
    if a.command == "latest":
        return ["\t".join(str(v) for v in r) for r in f.latest(a.ticker, a.form).select("accession", "form", "filing_date", "report_date", "primary_document").collect()]
    if a.command == "fetch":
        return [r["content"].decode("utf-8", "replace") for r in f.fetch(a.ticker, a.form, a.year).collect()]
    if a.command == "detect":
        return ["\t".join([r["format"], *r["warnings"]]) for r in f.detect(a.ticker, a.form, a.year).collect()]
    if a.command == "facts":
        return [r["line"] for r in f.facts(a.ticker, a.form, a.year, a.concept).collect()]
    if a.command == "sections":
        return [r["line"] for r in f.sections(a.ticker, a.form, a.year).collect()]
    if a.command == "text":
        return [r["text"] for r in f.text(a.ticker, a.section, a.form, a.year).collect()]
    t = f.layout_table(a.ticker, a.index or 0, a.form, a.year) if a.layout else f.table(a.ticker, a.statement, a.form, a.year)
    return [r["text"] for r in t.select(render.markdown_table(F.col("table")).alias("text")).collect()]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    from pyspark.sql import SparkSession

    from tabulon.operators.filings import NotFound

    spark = SparkSession.builder.appName("tabulon").getOrCreate()
    try:
        print("\n".join(lines(a, spark)))
    except NotImplementedError as e:
        print(e, file=sys.stderr)
        return 64
    except (NotFound, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

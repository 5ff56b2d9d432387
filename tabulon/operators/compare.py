"""Two filings of a company compared: statements by concept and period, sections by paragraph.

Both sides are documents (``plans.pipeline.documents``) with a ``pair`` column; a pair has one
document a side. What is in one order there keeps it here by numbered rows.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tabulon.functions import scalars as X

CHANGES = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType())]))


def _fold(x: Column) -> Column:
    return F.lower(X.trim(F.coalesce(x, F.lit(""))))


def statement_key(role_uri: Column, title: Column) -> Column:
    return F.when(F.coalesce(role_uri, F.lit("")) != "", F.concat(F.lit("r:"), role_uri)).otherwise(F.concat(F.lit("t:"), _fold(title)))


def row_key(concept: Column, label: Column) -> Column:
    return F.when(F.coalesce(concept, F.lit("")) != "", F.concat(F.lit("c:"), concept)).otherwise(F.concat(F.lit("l:"), _fold(label)))


def period_key(c: Column) -> Column:
    """A column's period, or its label if it has none."""
    day = lambda x: F.coalesce(F.date_format(x, "yyyy-MM-dd"), F.lit("0001-01-01"))
    dated = c["period_start"].isNotNull() | c["period_end"].isNotNull()
    return F.when(dated, F.concat(F.when(F.coalesce(c["instant"], F.lit(False)), "i:").otherwise("d:"), day(c["period_start"]), F.lit("_"), day(c["period_end"]))).otherwise(F.concat(F.lit("l:"), F.coalesce(c["label"], F.lit(""))))


def overlap(prev_columns: Column, curr_columns: Column) -> Column:
    """label, i and j of the periods that both have, in the order of curr; of equal ones in prev
    the last counts."""
    keys = F.transform(prev_columns, period_key)
    last = lambda c: F.size(keys) - F.array_position(F.reverse(keys), period_key(c)).cast("int")
    both = F.transform(curr_columns, lambda c, j: F.struct(c["label"].alias("label"), last(c).alias("i"), j.alias("j")))
    return F.filter(both, lambda p: p["i"] < F.size(keys))


def _statements(docs: DataFrame) -> DataFrame:
    d = docs.select("pair", F.posexplode("statements").alias("s", "t"))
    return d.select("pair", "s", statement_key(F.col("t.role_uri"), F.col("t.title")).alias("key"), "t.title", "t.role_uri", "t.columns", "t.rows")


def matched_statements(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """pair, s, title, role_uri, periods, prev_rows and curr_rows of statements on both sides."""
    p = _statements(prev).groupBy("pair", "key").agg(F.max_by(F.struct("columns", "rows"), "s").alias("p"))
    d = _statements(curr).join(p, ["pair", "key"])
    return d.select("pair", "s", "title", "role_uri", overlap(F.col("p.columns"), F.col("columns")).alias("periods"), F.col("p.rows").alias("prev_rows"), F.col("rows").alias("curr_rows"))


def cell_deltas(periods: Column, prev_values: Column, curr_values: Column) -> Column:
    """period, prev, curr, abs and pct for each period; null where a side has none."""

    def cell(p: Column) -> Column:
        a, b = F.get(prev_values, p["i"]), F.get(curr_values, p["j"])
        return F.struct(p["label"].alias("period"), a.alias("prev"), b.alias("curr"), X.delta(a, b).alias("abs"), X.delta_percent(a, b).alias("pct"))

    return F.transform(periods, cell)


def row_deltas(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """pair, s, n, concept, label, status and cells: the rows of matched statements, those of
    curr in their order, then those that only prev has. Of prev's rows with one key the last
    counts for all of curr's. Without a common period a row on both sides is unchanged."""
    m = matched_statements(prev, curr)
    row = lambda side: m.select("pair", "s", F.posexplode(f"{side}_rows").alias("n", "r")).withColumn("key", row_key(F.col("r.concept"), F.col("r.label")))
    last = row("prev").groupBy("pair", "s", "key").agg(F.max_by("r", "n").alias("p"), F.min("n").alias("first"))
    both = row("curr").withColumnRenamed("r", "c").join(last, ["pair", "s", "key"], "full_outer").join(m.select("pair", "s", "periods"), ["pair", "s"])
    d = both.withColumn("cells", cell_deltas(F.col("periods"), F.col("p.values"), F.col("c.values")))
    changed = F.exists("cells", lambda x: ~x["prev"].eqNullSafe(x["curr"]))
    status = F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed").when(changed, "changed").otherwise("unchanged")
    order = F.struct(F.col("c").isNull().alias("gone"), F.coalesce("n", "first").alias("at"))
    shown = F.coalesce("c", "p")
    return d.select("pair", "s", order.alias("n"), shown["concept"].alias("concept"), shown["label"].alias("label"), status.alias("status"), "cells")


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(removed or added, text) of a longest common subsequence's gaps, removals first on ties.

    Row i of the length table is kept as one number with a bit for each place of b, so the table
    takes an eighth of a byte a cell and a row takes a few machine words' work.
    """
    skip = 0
    while skip < min(len(a), len(b)) and a[skip] == b[skip]:
        skip += 1
    a, b = a[skip:], b[skip:]
    m, full = len(b), (1 << len(b)) - 1
    where: dict[str, int] = {}
    for k, x in enumerate(reversed(b)):
        where[x] = where.get(x, 0) | 1 << k
    rows = [full]
    for x in reversed(a):
        v = rows[-1]
        u = v & where.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    rows.reverse()  # rows[i] is of a[i:]; zero bits below m - j are the length for a[i:] and b[j:]

    def length(i: int, j: int) -> int:
        return m - j - (rows[i] & ((1 << (m - j)) - 1)).bit_count()

    out, i, j = [], 0, 0
    while i < len(a) and j < m:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif length(i + 1, j) >= length(i, j + 1):
            out.append(("removed", a[i]))
            i += 1
        else:
            out.append(("added", b[j]))
            j += 1
    return out + [("removed", x) for x in a[i:]] + [("added", x) for x in b[j:]]


@F.pandas_udf(CHANGES)
def paragraph_changes(prev: pd.Series, curr: pd.Series) -> pd.Series:
    none = lambda x: [] if x is None else list(x)
    return pd.Series([[{"kind": k, "text": t} for k, t in edit_script(none(a), none(b))] for a, b in zip(prev, curr, strict=True)])


def section_changes(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """pair, n, item, title and paragraphs of the sections that differ: those of curr in their
    order, then those that only prev has. Sections without an item don't count."""
    side = lambda docs: docs.select("pair", F.posexplode("sections").alias("n", "x")).select("pair", "n", "x.item", "x.title", X.paragraphs(F.col("x.text")).alias("text")).filter("item <> ''")
    p, c = side(prev), side(curr)
    last = p.groupBy("pair", "item").agg(F.max_by("text", "n").alias("before"))
    kept = c.join(last, ["pair", "item"], "left").select("pair", F.struct(F.lit(0).alias("gone"), F.col("n").alias("at")).alias("n"), "item", "title", "before", F.col("text").alias("after"))
    gone = p.join(c.select("pair", "item"), ["pair", "item"], "left_anti").select("pair", F.struct(F.lit(1).alias("gone"), F.col("n").alias("at")).alias("n"), "item", "title", F.col("text").alias("before"), F.array().cast("array<string>").alias("after"))
    # equal texts need no alignment, and so no Python
    d = kept.unionByName(gone).filter(~F.col("before").eqNullSafe(F.col("after")))
    return d.withColumn("paragraphs", paragraph_changes("before", "after")).filter(F.size("paragraphs") > 0).select("pair", "n", "item", "title", "paragraphs")


def paragraph_balance(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """pair, item, removed and added: how many paragraphs one side has more often than the other,
    whatever their order. It is less than an edit script, and takes no alignment."""
    one = lambda docs, k: docs.select("pair", F.explode("sections").alias("x")).select("pair", "x.item", F.explode(X.paragraphs(F.col("x.text"))).alias("t"), F.lit(k).alias("k"))
    d = one(prev, 1).unionByName(one(curr, -1)).groupBy("pair", "item", "t").agg(F.sum("k").alias("b")).filter("b <> 0")
    return d.groupBy("pair", "item").agg(F.sum(F.greatest("b", F.lit(0))).alias("removed"), F.sum(F.greatest(-F.col("b"), F.lit(0))).alias("added"))


_TOKENS = re.compile(r"\s+|\S+")


def word_markup(prev: str, curr: str) -> str:
    """Both texts word by word: what only curr has in [+ +], what only prev has in [- -]."""
    a, b = _TOKENS.findall(prev or ""), _TOKENS.findall(curr or "")
    out = []
    for op, i0, i1, j0, j1 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out.append("".join(a[i0:i1]))
        else:
            out += [f"[-{''.join(a[i0:i1])}-]"] * (i1 > i0) + [f"[+{''.join(b[j0:j1])}+]"] * (j1 > j0)
    return "".join(out)


@F.pandas_udf(StringType())
def _markup(prev: pd.Series, curr: pd.Series) -> pd.Series:
    return pd.Series([word_markup(a, b) for a, b in zip(prev, curr, strict=True)])


def lexical(changes: DataFrame) -> DataFrame:
    """pair, n, item, title and paragraphs (texts) of changed sections with both removed and added
    paragraphs; the k-th removed one is set against the k-th added one."""
    of = lambda kind: F.transform(F.filter("paragraphs", lambda x: x["kind"] == kind), lambda x: x["text"])
    d = changes.withColumn("gone", of("removed")).withColumn("new", of("added")).filter((F.size("gone") > 0) & (F.size("new") > 0))
    d = d.select("pair", "n", "item", "title", F.posexplode(F.arrays_zip("gone", "new")).alias("k", "z"))
    d = d.withColumn("text", _markup(F.coalesce("z.gone", F.lit("")), F.coalesce("z.new", F.lit(""))))
    d = d.groupBy("pair", "n", "item", "title").agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("ps"))
    return d.select("pair", "n", "item", "title", F.transform("ps", lambda p: p["text"]).alias("paragraphs"))


def change_sets(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """pair, schema_version, prev, curr, statements and sections of each pair that is on both sides."""
    ref = lambda side: F.struct(*[F.col(f"{side}_metadata.{c}").alias(c) for c in ("company", "ticker", "form", "accession", "filing_date", "period_end")])
    d = prev.select("pair", F.col("metadata").alias("prev_metadata")).join(curr.select("pair", F.col("metadata").alias("curr_metadata")), "pair")
    rows = row_deltas(prev, curr).groupBy("pair", "s").agg(F.sort_array(F.collect_list(F.struct("n", F.struct("concept", "label", "status", "cells").alias("r")))).alias("rs"))
    s = matched_statements(prev, curr).join(rows, ["pair", "s"], "left")
    s = s.select("pair", "s", F.struct("title", "role_uri", F.transform("periods", lambda p: p["label"]).alias("periods"), F.transform("rs", lambda x: x["r"]).alias("rows")).alias("d"))
    s = s.groupBy("pair").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "d"))), lambda x: x["d"]).alias("statements"))
    t = section_changes(prev, curr).groupBy("pair").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.struct("item", "title", "paragraphs").alias("d")))), lambda x: x["d"]).alias("sections"))
    d = d.join(s, "pair", "left").join(t, "pair", "left")
    return d.select("pair", F.col("curr_metadata.schema_version").alias("schema_version"), ref("prev").alias("prev"), ref("curr").alias("curr"), "statements", "sections")


def compare(prev: DataFrame | None, curr: DataFrame | None, layer: str = "structural") -> tuple[DataFrame, DataFrame | None]:
    """Change sets and, for the lexical layer, marked-up sections."""
    if layer == "semantic":
        raise NotImplementedError("no semantic layer")
    if layer not in ("structural", "lexical"):
        raise ValueError(f"unknown layer {layer!r}: structural or lexical")
    if prev is None or curr is None:
        raise ValueError("a side is missing")
    return change_sets(prev, curr), lexical(section_changes(prev, curr)) if layer == "lexical" else None

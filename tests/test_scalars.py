"""Column expressions against plain Python and tables of cases."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.functions import items
from tabulon.functions import scalars as X


def values(spark, rows, schema, expr):
    d = spark.createDataFrame(list(enumerate(rows)) if not isinstance(rows[0], tuple) else [(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["v"] for r in d.select("i", expr.alias("v")).orderBy("i").collect()]


def test_fact_value(spark):
    cases = [
        ("1,234", "6", None, None, 1234e6), ("5", None, "-", None, -5.0), ("(7.5)", "0", None, None, -7.5), ("—", "3", None, None, 0.0), ("(–)", None, None, None, 0.0), ("anything", None, None, "ixt:fixed-zero", 0.0),
        ("1.234,5", "0", None, "ixt:num-comma-decimal", 1234.5), ("none", "0", None, None, None), ("", "0", None, None, None), ("12", "x", None, None, None), ("3", "-2", None, None, 0.03), ("+8", None, None, None, 8.0), ("1-2", None, None, None, None), (None, None, None, None, None), ("٣", None, None, None, None),
    ]
    got = values(spark, [c[:4] for c in cases], "raw string, scale string, sign string, form string", X.fact_value(F.col("raw"), F.col("scale"), F.col("sign"), F.col("form")))
    assert got == [c[4] for c in cases]


def test_layout_value_and_notes(spark):
    cases = [("$ 1,200", 1200.0), ("(12)", -12.0), ("—", None), ("", None), ("12.5%", 12.5), (".", None), ("-", None), ("n/a", None), (" 7 ", 7.0)]
    assert values(spark, [c[0] for c in cases], "t string", X.layout_value(F.col("t"))) == [c[1] for c in cases]
    notes = [("Sales (1)", "Sales", "1"), ("Sales(ab)", "Sales", "ab"), ("Sales (abc)", "Sales (abc)", None), ("(1)", "(1)", None), ("", "", None)]
    assert values(spark, [n[0] for n in notes], "t string", X.without_footnote(F.col("t"))) == [n[1] for n in notes]
    assert values(spark, [n[0] for n in notes], "t string", X.footnote(F.col("t"))) == [n[2] for n in notes]


def test_spaces_and_names(spark):
    assert values(spark, [" a \n b\t", " ", ""], "t string", X.collapse_spaces(F.col("t"))) == ["a b", "", ""]
    assert values(spark, ["http://x/a.xsd#us_Gross_Profit", "a#b", "us_A"], "t string", X.concept_of_href(F.col("t"))) == ["us:Gross_Profit", "b", "us:A"]
    assert values(spark, ["us:GrossProfit", "A", "x:aBC"], "t string", X.humanize(F.col("t"))) == ["Gross Profit", "A", "a B C"]
    assert values(spark, ["x:SalesAbstract", "x:Member", "x:Sales", "AbstractSales"], "t string", X.is_structural(F.col("t"))) == [True, True, False, False]
    assert values(spark, ["http://x/role/Balance-Sheets_2", "abc"], "t string", X.fold_role(F.col("t"))) == ["balancesheets2", "abc"]


@pytest.mark.parametrize(("text", "anchored", "item"), [
    ("Item 1A. Risk Factors", True, "1A"), ("ITEM 7 a", True, "7A"), ("see Item 1A", True, None), ("see Item 1A", False, "1A"), ("Item 9.01 Exhibits", True, "9.01"), ("Item 99. Zz", True, None), ("Item 99 Properties", False, "2"),
    ("Registrant’s Code: item", False, None), ("Amendments to the Registrant’s Code of Ethics", True, "5.05"), ("Mine Safety Disclosures", True, "1.04"), ("Our properties", True, None), ("Our properties", False, "2"), ("", True, None), ("Item 1.07", True, "1"),
])
def test_item_id(spark, text, anchored, item):
    assert values(spark, [text], "t string", X.item_id(F.col("t"), anchored)) == [item]


def test_items():
    assert len(items.ANNUAL) == 23 and len(items.CURRENT) == 27 and len(items.TITLES) == 50


@pytest.mark.parametrize(("row", "cell", "level"), [(0.95, 0.95, "high"), (0.85, 0.5, "medium"), (0.1, 0.8, "medium"), (0.1, 0.95, "medium"), (0.1, 0.96, "low"), (0.84, 0.79, "low"), (1.0, 0.96, "high")])
def test_confidence(spark, row, cell, level):
    assert values(spark, [(row, cell)], "r double, c double", X.confidence_level(F.col("r"), F.col("c"))) == [level]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=30))
def test_decimal_text(spark, xs):
    for x, t in zip(xs, values(spark, xs, "x double", X.decimal_text(F.col("x"))), strict=True):
        assert "E" not in t.upper() and float(t) == x and not (t.endswith(".0") or t.startswith("."))
        digits = t.strip("-").replace(".", "").strip("0")
        assert len(digits) <= len(repr(x).lower().split("e")[0].strip("-").replace(".", "").strip("0")) + (x == math.floor(x))


def test_texts(spark):
    assert values(spark, [1e9, 0.5, None, -2.0, 1.5e-7, 3.9e11], "x double", X.decimal_text(F.col("x"))) == ["1000000000", "0.5", "", "-2", "0.00000015", "390000000000"]
    assert values(spark, [1.0, 0.0, None, -2.5], "x double", X.signed_text(F.col("x"))) == ["+1", "+0", "", "-2.5"]
    assert values(spark, [11.111, -3.0, None, 0.25], "x double", X.percent_text(F.col("x"))) == ["+11.1%", "-3.0%", "", "+0.2%"]
    assert values(spark, ["a|b\nc"], "t string", X.markdown_cell(F.col("t"))) == ["a\\|b c"]
    assert values(spark, ["a\n\nb", " ", None, "a\nb"], "t string", X.paragraph_count(F.col("t"))) == [2, 0, 0, 1]
    assert values(spark, ["a\n\n \n\nb "], "t string", X.paragraphs(F.col("t"))) == [["a", "b"]]


def test_figures(spark):
    cases = [("$ 1,200", True), ("99", False), ("100", True), ("2024", False), ("(2,100)", False), ("2101", True), ("1.5", True), ("x1", False), ("", False), (None, False), ("12 %", False)]
    assert values(spark, [c[0] for c in cases], "t string", X.is_financial_figure(F.col("t"))) == [c[1] for c in cases]


def test_matches(spark):
    cases = [(None, None, True), (None, 0.0, False), (0.0, None, False), (100.0, 100.5, True), (100.0, 100.6, False), (1e9, 1e9 + 900, True), (1e9, 1e9 + 1100, False)]
    assert values(spark, [c[:2] for c in cases], "a double, b double", X.cell_matches(F.col("a"), F.col("b"))) == [c[2] for c in cases]
    assert values(spark, [(10.0, 15.0), (0.0, 5.0), (None, 5.0), (-4.0, -2.0)], "a double, b double", X.delta_percent(F.col("a"), F.col("b"))) == [50.0, None, None, -50.0]

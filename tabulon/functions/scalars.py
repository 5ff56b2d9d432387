"""Column expressions. All stay in the JVM; each takes and gives columns.

White space is Unicode's, so no-break spaces count. Numbers are doubles, and a missing number
is null and never zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon import schemas as S
from tabulon.functions import items

DASHES = "-–—−"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse_spaces(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_heading(x: Column) -> Column:
    """Curly apostrophes straight, white space collapsed."""
    return collapse_spaces(F.translate(x, "’‘", "''"))


def is_dash(x: Column) -> Column:
    """Only dashes, one at least."""
    return F.coalesce(trim(x).rlike(f"^[{DASHES}]+$"), F.lit(False))


def normalize_number(x: Column, comma_decimal: Column | bool = False) -> Column:
    """The digits, signs and decimal point of a figure as text."""
    comma = comma_decimal if isinstance(comma_decimal, Column) else F.lit(comma_decimal)
    point = F.regexp_replace(x, r"[^\p{Nd}.+\-]", "")
    swapped = F.translate(F.regexp_replace(x, r"[^\p{Nd},+\-]", ""), ",", ".")
    return F.when(comma, swapped).otherwise(point)


def in_parentheses(x: Column) -> Column:
    t = trim(x)
    return t.startswith("(") & t.endswith(")")


def _bare(x: Column) -> Column:
    """Without the parentheses around it."""
    t = trim(x)
    return F.when(in_parentheses(t), F.regexp_replace(t, r"(?s)^\(|\)$", "")).otherwise(t)


def fact_value(raw: Column, scale: Column, sign: Column, format_: Column) -> Column:
    """A tagged figure: sign attribute or parentheses make it negative, scale is a power of ten;
    dashes and the fixed-zero format are 0; null where it isn't a number or the scale isn't one."""

    def value(f: Column) -> Column:
        text = f["text"]
        scaled = _double(normalize_number(text, f["form"].contains("comma-decimal"))) * F.pow(F.lit(10.0), f["power"])
        return F.when(f["power"].isNull(), F.lit(None)).when(is_dash(text) | f["form"].contains("fixed-zero"), F.lit(0.0)).otherwise(F.when(f["negative"], -scaled).otherwise(scaled))

    power = F.when(F.coalesce(scale, F.lit("")) == "", F.lit(0)).otherwise(F.when(scale.rlike(r"^[+-]?\d{1,4}$"), scale).try_cast("int"))
    negative = (F.coalesce(sign, F.lit("")) == "-") | in_parentheses(raw)
    parts = F.struct(_bare(raw).alias("text"), F.coalesce(format_, F.lit("")).alias("form"), power.alias("power"), negative.alias("negative"))
    return F.when(raw.isNotNull(), let(parts, value))


def _double(x: Column) -> Column:
    """A plain ASCII number as a double; null for anything else."""
    return F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), x).try_cast("double")


def layout_value(x: Column) -> Column:
    """A displayed figure: parentheses are negative; blank and dashes are null."""

    def value(t: Column) -> Column:
        digits = _double(F.regexp_replace(_bare(t), r"[^\p{Nd}.\-]", ""))
        return F.when((t == "") | is_dash(t), F.lit(None).cast("double")).otherwise(F.when(in_parentheses(t), -digits).otherwise(digits))

    return let(trim(x), value)


_NOTE = r"^(.+?)\(([0-9A-Za-z]{1,2})\)$"


def without_footnote(x: Column) -> Column:
    """Text without a closing (n) mark, if something is left before it."""
    before = trim(F.regexp_extract(trim(x), _NOTE, 1))
    return F.when(before != "", before).otherwise(trim(x))


def footnote(x: Column) -> Column:
    """The mark that without_footnote takes off, or null."""
    before = trim(F.regexp_extract(trim(x), _NOTE, 1))
    return F.when(before != "", F.regexp_extract(trim(x), _NOTE, 2))


def let(x: Column, f) -> Column:
    """f of x, where x is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def item_id(x: Column, anchored: bool) -> Column:
    """The item that a heading (anchored) or a contents row names, or null."""
    lead = "^" if anchored else r"\b"
    fragments = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(i).alias("item")) for k, i in items.FRAGMENTS])
    known = lambda c, rows: F.when(c.isin(*[i for i, _, _ in rows]), c)

    def found(t: Column) -> Column:
        dotted = F.regexp_extract(t, rf"(?i){lead}item\s+(\d+\.\d+)\b", 1)
        plain = F.regexp_extract(t, rf"(?i){lead}item\s+(\d{{1,2}})\s*([a-c])?\b", 1)
        letter = F.upper(F.regexp_extract(t, rf"(?i){lead}item\s+(\d{{1,2}})\s*([a-c])?\b", 2))
        named = let(F.lower(t), lambda low: F.get(F.filter(fragments, lambda f: low.startswith(f["key"]) if anchored else low.contains(f["key"])), F.lit(0))["item"])
        return F.coalesce(known(dotted, items.CURRENT), known(F.concat(plain, letter), items.ANNUAL), named)

    return let(normalize_heading(x), found)


def item_title(item: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in items.TITLES.items() for x in pair]), item)


def is_bold_style(style: Column) -> Column:
    s = F.replace(F.lower(F.coalesce(style, F.lit(""))), F.lit(" "), F.lit(""))
    return s.contains("font-weight:bold") | s.contains("font-weight:700")


def concept_of_href(href: Column) -> Column:
    """prefix:Local of a locator: what follows the last #, its first underscore a colon."""
    return F.regexp_replace(F.substring_index(href, "#", -1), r"^([^_]*)_", "$1:")


def local_name(concept: Column) -> Column:
    return F.regexp_replace(concept, r"^[^:]*:", "")


def humanize(concept: Column) -> Column:
    """A space before each capital but the first character."""
    return F.regexp_replace(local_name(concept), r"(?<!^)([A-Z])", " $1")


def is_structural(concept: Column) -> Column:
    return local_name(concept).rlike("(Abstract|Table|Axis|Domain|Member|LineItems)$")


def row_type(preferred: Column, label: Column, has_children: Column) -> Column:
    total = (F.coalesce(preferred, F.lit("")) == S.TOTAL) | F.lower(trim(label)).startswith("total")
    return F.when(total, "total").when(has_children, "subtotal").otherwise("data")


def layout_row_type(label: Column, any_bold: Column, any_top_border: Column) -> Column:
    return F.when(~F.lower(trim(label)).startswith("total"), "data").when(any_bold | any_top_border, "total").otherwise("subtotal")


def confidence_level(row_rate: Column, cell_rate: Column) -> Column:
    """high from .95 in both; medium from .85 of rows, or with .80 to .95 of cells; else low. So
    many resolved cells with few whole rows are low."""
    return F.when((row_rate >= 0.95) & (cell_rate >= 0.95), "high").when((row_rate >= 0.85) | cell_rate.between(0.80, 0.95), "medium").otherwise("low")


def partition_level(strategy: Column, all_resolved: Column, n: Column) -> Column:
    return F.when((strategy == "toc") & all_resolved & (n >= 2), "high").when((strategy == "toc") | ((strategy == "heading") & (n >= 2)), "medium").otherwise("low")


def column_label(end: Column) -> Column:
    return F.date_format(end, "yyyy")


def fold_role(uri: Column) -> Column:
    """The last segment of a role address, its lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.substring_index(uri, "/", -1)), "[^a-z0-9]", "")


def delta(prev: Column, curr: Column) -> Column:
    return curr - prev


def delta_percent(prev: Column, curr: Column) -> Column:
    """Null where prev is null or 0."""
    return F.try_divide(curr - prev, prev) * 100


def cell_matches(expected: Column, got: Column) -> Column:
    """Both null, or as near as half a unit or a millionth of what is expected."""
    near = F.abs(expected - got) <= F.greatest(F.lit(S.MATCH_ABS), F.abs(expected) * S.MATCH_REL)
    return (expected.isNull() & got.isNull()) | F.coalesce(near, F.lit(False))


def paragraphs(text: Column) -> Column:
    """The non-empty, trimmed parts between empty lines."""
    return F.filter(F.transform(F.split(text, "\n\n"), trim), lambda x: x != "")


def paragraph_count(text: Column) -> Column:
    blank = F.coalesce(trim(text), F.lit("")) == ""
    return F.when(blank, 0).otherwise(F.size(F.split(text, "\n\n")))


def decimal_text(x: Column) -> Column:
    """The shortest plain decimals of a double that reads back as it; null is ''.

    Java's shortest digits are shifted by their exponent as text.
    """

    def plain(s: Column) -> Column:
        return let(F.struct(F.regexp_replace(F.regexp_replace(s, "E.*$", ""), r"\.0$", "").alias("digits"), F.coalesce(F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0)).alias("exponent")), shifted)

    def shifted(f: Column) -> Column:
        digits, exponent = f["digits"], f["exponent"]
        whole, frac = F.substring_index(digits, ".", 1), F.when(digits.contains("."), F.substring_index(digits, ".", -1)).otherwise("")
        right = F.concat(whole, F.substring(F.rpad(frac, 400, "0"), F.lit(1), exponent), F.when(F.length(frac) > exponent, F.concat(F.lit("."), F.substring(frac, exponent + 1, F.lit(400)))).otherwise(""))
        left = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), whole, frac)
        return F.when(exponent > 0, right).when(exponent < 0, left).otherwise(digits)

    return F.when(x.isNull(), "").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), let(F.abs(x).cast("string"), plain)))


def signed_text(x: Column) -> Column:
    return F.when(x.isNull(), "").when(x >= 0, F.concat(F.lit("+"), decimal_text(x))).otherwise(decimal_text(x))


def percent_text(x: Column) -> Column:
    return F.when(x.isNull(), "").otherwise(F.format_string("%+.1f%%", F.bround(x, 1)))


def markdown_cell(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))


def is_financial_figure(text: Column) -> Column:
    """A number, once marks of money and grouping are off, that has a fraction or is 100 or more
    and isn't a bare year."""
    cleaned = F.regexp_replace(text, r"(?U)[\s$,()%]", "")
    v = F.abs(F.when(cleaned.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), cleaned).try_cast("double"))
    return F.coalesce(F.when(cleaned.contains("."), v.isNotNull()).otherwise((v >= S.SMALL_INTEGER) & ~v.between(1900, 2100)), F.lit(False))


def section_heading(item: Column, title: Column) -> Column:
    return F.when(F.coalesce(item, F.lit("")) == "", title).otherwise(F.concat(F.lit("Item "), item, F.lit(" — "), title))


def fold_accession(x: Column) -> Column:
    return F.lower(F.replace(x, F.lit("-"), F.lit("")))

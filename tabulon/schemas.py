"""Row types, versions and constants that the modules share."""

from __future__ import annotations

SCHEMA_VERSION = "1.0.0"
PARSER_VERSION = "0.1.0"

EXTRACT_FACTS, EXTRACT_LAYOUT, EXTRACT_ALL = "ixbrl.facts", "ixbrl.layout", "pipeline"

#: Formats a filing can have, and those that are read.
IXBRL, PARTIAL, HTML, TEXT, UNKNOWN = "IXBRL", "PartialIXBRL", "PlainHTML", "PlainText", "Unknown"
SUPPORTED = (IXBRL, PARTIAL)

NAMESPACE = "http://www.xbrl.org/2013/inlineXBRL"
HEAD_BYTES = 65_536
DENSE, SPARSE = 0.80, 0.10
SMALL_INTEGER = 100
COLUMN_FLOOR = 0.5
MATCH_ABS, MATCH_REL = 0.5, 1e-6

_LABEL = "http://www.xbrl.org/2003/role/"
LABEL, TERSE, VERBOSE = _LABEL + "label", _LABEL + "terseLabel", _LABEL + "verboseLabel"
TOTAL, PERIOD_START, PERIOD_END = _LABEL + "totalLabel", _LABEL + "periodStartLabel", _LABEL + "periodEndLabel"

# Statement selectors, and what a folded role address contains for each.
STATEMENTS = {
    "income": ("statementsofoperations", "statementsofincome"),
    "balance": ("balancesheets", "financialposition"),
    "cashflow": ("statementsofcashflows", "cashflow"),
    "equity": ("stockholdersequity", "shareholdersequity"),
    "comprehensive": ("comprehensiveincome",),
}
DEFAULT_STATEMENTS = tuple(STATEMENTS)
NOT_STATEMENTS = "details|tables|parenthetical|disclosure"

SUBMISSIONS_JSON = (
    "cik string, name string, tickers array<string>, filings struct<recent: struct<accessionNumber: array<string>, "
    "filingDate: array<string>, reportDate: array<string>, form: array<string>, primaryDocument: array<string>>>"
)
TICKERS_JSON = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
DIRECTORY_JSON = "directory struct<item: array<struct<name: string>>>"
PRESENTATION_XML = (
    "presentationLink array<struct<_role: string, loc: array<struct<_label: string, _href: string>>, "
    "presentationArc: array<struct<_from: string, _to: string, _order: double, _preferredLabel: string>>>>"
)
LABEL_XML = (
    "labelLink array<struct<loc: array<struct<_label: string, _href: string>>, labelArc: array<struct<_from: string, _to: string>>, "
    "label: array<struct<_label: string, _role: string, _VALUE: string>>>>"
)
SCHEMA_XML = "annotation array<struct<appinfo: array<struct<roleType: array<struct<_roleURI: string, definition: string>>>>>>"
BASELINE_JSON = (
    "ticker string, form string, format string, confidence string, sections array<string>, "
    "statements array<struct<role: string, title: string, cells: array<struct<concept: string, period: string, value: double>>>>"
)

#: Addresses of the public archive that filings come from.
ARCHIVE, DATA = "https://www.sec.gov", "https://data.sec.gov"
REQUESTS_PER_SECOND, TIMEOUT_S, RETRY_S = 9, 30, 0.5

NODES = (
    "accession string, pos long, kind string, tag string, attrs map<string,string>, parent_pos long, end_pos long, depth int, "
    "table_pos long, row_pos long, context_pos long, hidden boolean, bold boolean, n_ix int, n_figures int, text string, shown string, notes array<string>"
)

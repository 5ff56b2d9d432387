"""Small invented filings as files of a landing folder."""

from __future__ import annotations

import json
from pathlib import Path

CIK, TICKER = 9000123, "ZORB"
NEW, OLD, ODD = "0009000123-24-000007", "0009000123-23-000005", "0009000123-22-000003"

_CONTEXTS = """
<ix:header><ix:hidden><ix:nonNumeric name="dei:DocumentType" contextRef="y1">10-K</ix:nonNumeric></ix:hidden><ix:resources>
{contexts}
</ix:resources></ix:header>
"""


def context(id_: str, start: str, end: str = "", member: str = "") -> str:
    period = f"<xbrli:startDate>{start}</xbrli:startDate><xbrli:endDate>{end}</xbrli:endDate>" if end else f"<xbrli:instant>{start}</xbrli:instant>"
    seg = f'<xbrli:segment><xbrldi:explicitMember dimension="q:RegionAxis">{member}</xbrldi:explicitMember></xbrli:segment>' if member else ""
    return f'<xbrli:context id="{id_}"><xbrli:entity><xbrli:identifier scheme="x">{CIK:010d}</xbrli:identifier>{seg}</xbrli:entity><xbrli:period>{period}</xbrli:period></xbrli:context>'


def fact(name: str, ctx: str, raw: str, scale: str = "6", sign: str = "", extra: str = "") -> str:
    mark = f' sign="{sign}"' if sign else ""
    return f'<ix:nonFraction name="{name}" contextRef="{ctx}" unitRef="usd" scale="{scale}" decimals="-6"{mark} {extra}>{raw}</ix:nonFraction>'


def page(year: int, sales: str, risk: str) -> str:
    y0, y1 = year - 1, year
    ctx = "\n".join([
        context("y1", f"{y1}-01-01", f"{y1}-12-31"), context("y0", f"{y0}-01-01", f"{y0}-12-31"), context("e1", f"{y1}-12-31"), context("e0", f"{y0}-12-31"), context("e00", f"{y0 - 1}-12-31"),
        context("north", f"{y1}-01-01", f"{y1}-12-31", "q:NorthMember"),
    ])
    row = lambda label, a, b: f"<tr><td>{label}</td><td>{a}</td><td>{b}</td></tr>"
    f = fact
    income = "".join([
        row("Net sales", f("q:Sales", "y1", sales), f("q:Sales", "y0", "1,000")), row("Costs", f("q:Costs", "y1", "700"), f("q:Costs", "y0", "(650)")), row("Gross profit", f("q:Gross", "y1", "534"), f("q:Gross", "y0", "350")),
        row("North sales", f("q:Sales", "north", "111"), ""), row("Per share", f("q:Share", "y1", "2.50", "0"), f("q:Share", "y0", "—", "0")),
    ])
    cash = "".join([
        row("Cash at start", f("q:Cash", "e0", "80"), f("q:Cash", "e00", "60")), row("Change in cash", f("q:CashChange", "y1", "20"), f("q:CashChange", "y0", "20", sign="-")), row("Cash at end", f("q:Cash", "e1", "100"), ""),
        row("Nil", f("q:Gross", "y1", "9", extra='xsi:nil="TRUE"'), f("q:Other", "nowhere", "777")),
    ])
    return f"""<html xmlns:ix="http://www.xbrl.org/2013/inlineXBRL"><head><title>z</title><style>p {{}}</style></head><body>{_CONTEXTS.format(contexts=ctx)}
<table><tr><td>Item 1.</td><td><a href="#one">Business</a></td></tr><tr><td>Item 1A.</td><td><a href="#risk">Risk Factors</a></td></tr><tr><td>Item 8.</td><td><a href="#fin">Financial Statements</a></td></tr></table>
<div id="one"><b>Item 1. Business</b></div><p>We make  zorbs &amp; small
zorbs.</p><ul><li>round</li><li>flat</li></ul>
<div id="risk"><b>Item 1A. Risk Factors</b></div><p>{risk}</p><p>Zorbs may roll away.</p>
<div id="fin"><b>Item 8. Financial Statements</b></div><table>{income}</table><table>{cash}</table>
</body></html>"""


_ROLE = "http://zorb.test/role/"


def _loc(label: str) -> str:
    return f'<link:loc xlink:type="locator" xlink:label="{label}" xlink:href="zorb.xsd#{label.split("-")[0]}"/>'


def _arc(kind: str, a: str, b: str, order: str = "1", preferred: str = "") -> str:
    more = f' preferredLabel="http://www.xbrl.org/2003/role/{preferred}"' if preferred else ""
    return f'<link:{kind} xlink:type="arc" xlink:from="{a}" xlink:to="{b}" order="{order}"{more}/>'


def presentation() -> str:
    links = [
        ("IncomeStatementDetails", ["q_Sales"], []),
        ("ConsolidatedStatementsOfOperations", ["q_TopAbstract", "q_Sales", "q_Costs", "q_Gross", "q_Share"], [("q_TopAbstract", "q_Gross", "3", "totalLabel"), ("q_TopAbstract", "q_Sales", "1", ""), ("q_TopAbstract", "q_Costs", "2", "terseLabel"), ("q_TopAbstract", "q_Share", "4", "")]),
        ("ConsolidatedStatementsOfCashFlows", ["q_Cash-1", "q_CashChange", "q_Cash-2"], [("q_Cash-1", "q_CashChange", "1", ""), ("q_Cash-1", "q_Cash-2", "2", "periodEndLabel"), ("q_CashChange", "q_Cash-1", "9", "")]),
        ("ConsolidatedStatementsOfCashFlowsTwo", ["q_CashTopAbstract", "q_Cash-1", "q_CashChange", "q_Cash-2"], [("q_CashTopAbstract", "q_Cash-1", "1", "periodStartLabel"), ("q_CashTopAbstract", "q_CashChange", "2", ""), ("q_CashTopAbstract", "q_Cash-2", "3", "periodEndLabel")]),
    ]
    out = "".join(f'<link:presentationLink xlink:role="{_ROLE}{r}">{"".join(map(_loc, locs))}{"".join(_arc("presentationArc", *a) for a in arcs)}</link:presentationLink>' for r, locs, arcs in links)
    return f'<?xml version="1.0"?><link:linkbase xmlns:link="http://l" xmlns:xlink="http://x">{out}</link:linkbase>'


def label_linkbase() -> str:
    rows = [("q_Sales", "label", "Net sales"), ("q_Costs", "terseLabel", "Costs"), ("q_Costs", "label", "Costs of zorbs"), ("q_Gross", "totalLabel", "Gross profit"), ("q_Cash", "periodStartLabel", "Cash, start"), ("q_Cash", "periodEndLabel", "Cash, end")]
    names = dict.fromkeys(c for c, _, _ in rows)
    out = "".join(map(_loc, names)) + "".join(_arc("labelArc", c, f"lab_{c}") for c in names)
    out += "".join(f'<link:label xlink:type="resource" xlink:label="lab_{c}" xlink:role="http://www.xbrl.org/2003/role/{r}">{t}</link:label>' for c, r, t in rows)
    return f'<?xml version="1.0"?><link:linkbase xmlns:link="http://l" xmlns:xlink="http://x"><link:labelLink>{out}</link:labelLink></link:linkbase>'


def schema() -> str:
    return f'<?xml version="1.0"?><xsd:schema xmlns:xsd="http://s" xmlns:link="http://l"><xsd:annotation><xsd:appinfo><link:roleType roleURI="{_ROLE}ConsolidatedStatementsOfOperations" id="a"><link:definition>0002 - Statement - STATEMENTS OF OPERATIONS</link:definition></link:roleType></xsd:appinfo></xsd:annotation></xsd:schema>'


def write(root: Path) -> None:
    (root / "company_tickers.json").write_text(json.dumps({"0": {"cik_str": CIK, "ticker": TICKER, "title": "Zorb Works"}, "7": {"cik_str": 5, "ticker": "none", "title": "No Filings"}}))
    (root / "submissions").mkdir()
    recent = {
        "accessionNumber": [NEW, OLD, ODD, "0009000123-24-000001"], "filingDate": ["2024-02-01", "2023-02-03", "2022-02-02", "2024-01-15"], "reportDate": ["2023-12-31", "2022-12-31", "", "2024-01-15"],
        "form": ["10-K", "10-K", "10-K", "8-K"], "primaryDocument": ["z.htm", "z.htm", "z.txt", "k.htm"],
    }
    (root / "submissions" / f"CIK{CIK:010d}.json").write_text(json.dumps({"cik": str(CIK), "name": "Zorb Works", "filings": {"recent": recent}}))
    for acc, year, sales, risk in ((NEW, 2023, "1,234", "Zorb prices may fall by 10 percent."), (OLD, 2022, "1,000", "Zorb prices may fall.")):
        d = root / "archives" / str(CIK) / acc.replace("-", "")
        d.mkdir(parents=True)
        (d / "z.htm").write_text(page(year, sales, risk))
        (d / "zorb_pre.xml").write_text(presentation())
        (d / "zorb_lab.xml").write_text(label_linkbase())
        (d / "zorb.xsd").write_text(schema())
        (d / "index.json").write_text(json.dumps({"directory": {"item": [{"name": n} for n in ("z.htm", "zorb_pre.xml", "zorb_lab.xml", "zorb.xsd")]}}))
    d = root / "archives" / str(CIK) / ODD.replace("-", "")
    d.mkdir(parents=True)
    (d / "z.txt").write_text("<SEC-DOCUMENT>\n-----\nplain")

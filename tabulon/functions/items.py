"""Names of the items that annual and current reports have, and how headings name them."""

from __future__ import annotations

# The items of both forms in the forms' own order, each with its title and the
# fragments of headings that name it. Results depend on these strings and on their order.
ANNUAL = [
    ("1", "Business", ["business"]),
    ("1A", "Risk Factors", ["risk factors"]),
    ("1B", "Unresolved Staff Comments", ["unresolved staff comments"]),
    ("1C", "Cybersecurity", ["cybersecurity"]),
    ("2", "Properties", ["properties"]),
    ("3", "Legal Proceedings", ["legal proceedings"]),
    ("4", "Mine Safety Disclosures", ["mine safety"]),
    ("5", "Market for Registrant's Common Equity", ["market for registrant", "market for the registrant"]),
    ("6", "Selected Financial Data", ["[reserved]", "selected financial data"]),
    ("7", "Management's Discussion and Analysis", ["management's discussion", "md&a"]),
    ("7A", "Quantitative and Qualitative Disclosures About Market Risk", ["quantitative and qualitative"]),
    ("8", "Financial Statements and Supplementary Data", ["financial statements and supplementary", "financial statements"]),
    ("9", "Changes in and Disagreements with Accountants", ["changes in and disagreements"]),
    ("9A", "Controls and Procedures", ["controls and procedures"]),
    ("9B", "Other Information", ["other information"]),
    ("9C", "Disclosure Regarding Foreign Jurisdictions", ["foreign jurisdictions that prevent inspections"]),
    ("10", "Directors, Executive Officers and Corporate Governance", ["directors, executive officers"]),
    ("11", "Executive Compensation", ["executive compensation"]),
    ("12", "Security Ownership of Certain Beneficial Owners", ["security ownership"]),
    ("13", "Certain Relationships and Related Transactions", ["certain relationships"]),
    ("14", "Principal Accountant Fees and Services", ["principal accountant fees"]),
    ("15", "Exhibit and Financial Statement Schedules", ["exhibit and financial statement", "exhibits and financial statement"]),
    ("16", "Form 10-K Summary", ["form 10-k summary"]),
]
CURRENT = [
    ("1.01", "Entry into a Material Definitive Agreement", ["entry into a material definitive agreement"]),
    ("1.02", "Termination of a Material Definitive Agreement", ["termination of a material definitive agreement"]),
    ("1.03", "Bankruptcy or Receivership", ["bankruptcy or receivership"]),
    ("1.04", "Mine Safety - Reporting of Shutdowns and Patterns of Violations", ["mine safety"]),
    ("2.01", "Completion of Acquisition or Disposition of Assets", ["completion of acquisition or disposition"]),
    ("2.02", "Results of Operations and Financial Condition", ["results of operations and financial condition"]),
    ("2.03", "Creation of a Direct Financial Obligation", ["creation of a direct financial obligation"]),
    ("2.04", "Triggering Events That Accelerate or Increase a Direct Financial Obligation", ["triggering events that accelerate"]),
    ("2.05", "Cost Associated with Exit or Disposal Activities", ["cost associated with exit or disposal"]),
    ("2.06", "Material Impairments", ["material impairments"]),
    ("3.01", "Notice of Delisting or Failure to Satisfy a Continued Listing Rule", ["notice of delisting"]),
    ("3.02", "Unregistered Sales of Equity Securities", ["unregistered sales of equity"]),
    ("3.03", "Material Modification to Rights of Security Holders", ["material modification to rights"]),
    ("4.01", "Changes in Registrant's Certifying Accountant", ["changes in registrant's certifying accountant", "changes in registrant"]),
    ("4.02", "Non-Reliance on Previously Issued Financial Statements", ["non-reliance on previously issued"]),
    ("5.01", "Changes in Control of Registrant", ["changes in control of registrant"]),
    ("5.02", "Departure of Directors or Certain Officers", ["departure of directors or certain officers"]),
    ("5.03", "Amendments to Articles of Incorporation or Bylaws", ["amendments to articles of incorporation"]),
    ("5.04", "Temporary Suspension of Trading Under Registrant's Employee Benefit Plans", ["temporary suspension of trading"]),
    ("5.05", "Amendments to the Registrant's Code of Ethics", ["amendments to the registrant's code of ethics"]),
    ("5.06", "Change in Shell Company Status", ["change in shell company status"]),
    ("5.07", "Submission of Matters to a Vote of Security Holders", ["submission of matters to a vote"]),
    ("5.08", "Shareholder Director Nominations", ["shareholder director nominations"]),
    ("6.01", "ABS Informational and Computational Material", ["abs informational"]),
    ("7.01", "Regulation FD Disclosure", ["regulation fd disclosure"]),
    ("8.01", "Other Events", ["other events"]),
    ("9.01", "Financial Statements and Exhibits", ["financial statements and exhibits"]),
]

TITLES = {i: title for i, title, _ in [*ANNUAL, *CURRENT]}
#: (fragment, id) in the order they are tried: current reports' first.
FRAGMENTS = [(k, i) for i, _, keys in [*CURRENT, *ANNUAL] for k in keys]

"""Domain constants of the service-cost analysis.

Everything in the ``FIXED VALUES`` block must equal the analysed project's
definitions for results to agree; it is stated plainly, in natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (business rules, label spellings, benchmark figures)
# ---------------------------------------------------------------------------

SLA_TARGET_DAYS = 2
CHURN_MIN_BREACHES = 2
CHURN_MAX_AVG_CSAT = 2.5
CRITICAL_TIER_MIN_CLV = 2000
SLA_STATUS_CRITICAL_BELOW = 0.50
SLA_STATUS_AT_RISK_BELOW = 0.70
Q4_MONTHS = (10, 11, 12)
PEAK_MONTHS = (11, 12)
HIGH_VOLUME_MONTH = 10
MONTHS_IN_DATA = 24
NEUTRAL_CSAT = 3.0
BREACH_TARGET_RATE = 0.30

GUEST = "GUEST"
UNKNOWN = "Unknown"

SEGMENT_MAP = {
    "retail": "Retail",
    "RETAIL": "Retail",
    "Retail": "Retail",
    "corporate": "Corporate",
    "Corporate": "Corporate",
    "Wholesale": "Wholesale",
}
SEGMENT_INCONSISTENT = ("retail", "RETAIL", "corporate")

CATEGORY_MAP = {
    "Billing Issue": "Billing",
    "billing issue": "Billing",
    "Billing": "Billing",
    "Delivery Delay": "Delivery",
    "delivery delay": "Delivery",
    "Late Delivery": "Delivery",
    "Product Defect": "Product Defect",
    "Defective Product": "Product Defect",
    "Refund Request": "Refund",
    "refund": "Refund",
    "Account Access": "Account Access",
    "Login Issue": "Account Access",
    "General Enquiry": "General Enquiry",
}
CATEGORY_INCONSISTENT = (
    "billing issue", "Billing", "delivery delay", "Late Delivery",
    "Defective Product", "refund", "Login Issue",
)

OLD_LOCATION_NAME = "Location_03"
NEW_LOCATION_NAME = "LOC_03"

RES_BAND_ORDER = ("0-1 days", "1-2 days", "2-5 days", "5+ days", "Abandoned")
PRIORITY_ORDER = ("Critical", "High", "Medium")  # anything else sorts 4th

ORDER_BANDS = ("1 order (one-time)", "2-3 orders", "4-10 orders", "10+ orders (loyal)")

CHURN_SCENARIOS = (("10% churn", "0.10"), ("20% churn", "0.20"),
                   ("30% churn", "0.30"), ("50% churn", "0.50"))

CSAT_BENCHMARKS = (("EU E-Commerce Avg", 3.90), ("German Market Avg", 4.05),
                   ("Industry Best Practice", 4.50))
OWN_BUSINESS = "Our Business"

# category, industry average days, best practice days
RESOLUTION_BENCHMARKS = (
    ("Billing", 3.0, 1.0),
    ("Refund", 3.5, 2.0),
    ("Product Defect", 4.0, 2.0),
    ("Delivery", 2.5, 1.5),
    ("Account Access", 1.0, 0.5),
    ("General Enquiry", 1.0, 0.5),
)
BILLING_INDUSTRY_DAYS = 3.0

# country group, benchmark share %
GEO_MIX_BENCHMARK = (("UK", 55), ("Germany", 15), ("France", 12),
                     ("Netherlands", 8), ("Other", 10))
UK = "United Kingdom"
GERMANY = "Germany"
FRANCE = "France"

# metric, industry, best practice, lower_is_better  (scorecard benchmarks)
SCORECARD_BENCHMARKS = (
    ("CSAT Score", 4.05, 4.50, False),
    ("Avg Resolution Days", 2.5, 1.0, True),
    ("Billing Resolution", 3.0, 1.0, True),
    ("SLA Breach Rate", 20.0, 10.0, True),
    ("CSAT Response Rate", 85.0, 90.0, False),
    ("UK Revenue Share", 55.0, 45.0, True),
)
SCORECARD_CRITICAL_SHORTFALL = 0.10

RESPONSE_DANGER_BELOW = 0.78
RESPONSE_WARNING_BELOW = 0.84
LOCATION_BREACH_DANGER_ABOVE = 0.90
LOCATION_BREACH_WARNING_ABOVE = 0.80
LOCATION_CSAT_DANGER_BELOW = 2.5
LOCATION_CSAT_WARNING_BELOW = 3.0

# expectation, German %, EU % (consumer survey benchmarks set against the data)
EXPECTATIONS = (
    ("Expect response within 24 hours", 71, 64),
    ("Would switch after 1 bad experience", 38, 32),
    ("Would switch after 2 bad experiences", 67, 59),
    ("Rate resolution speed as top priority", 73, 68),
    ("Check reviews before purchasing", 82, 74),
    ("Share bad experience publicly", 44, 39),
)
RESPONSE_EXPECTATION_DAYS = 1.0

# priority, action, timeline, owner
ACTIONS = (
    (1, "Outreach to Critical Risk corporate accounts", "This week", "Account Management"),
    (2, "Operational review at LOC_03 and LOC_07", "This month", "Operations Director"),
    (3, "Dedicated billing resolution path (48hr SLA)", "This month", "Service Operations"),
    (4, "Q4 Operational Readiness Plan", "By September each year", "Operations + HR"),
    (5, "Weekly SLA breach reporting by location", "Next 2 weeks", "BI / Analytics"),
)
ACTION_IMPACT_TEXT = {
    2: "Restores service quality in key Germany growth market",
    3: "Billing is highest volume + worst CSAT = highest churn risk category",
    5: "Enables early intervention before breach rates compound into churn",
}

# data-quality report: (table, metric, action text) in report order
DQ_ACTIONS = {
    "cancel": "Dropped — reversed transactions, not real sales",
    "qty": "Dropped — no valid transaction without positive quantity",
    "price": "Dropped — no valid sale at zero or negative price",
    "guest": "Filled with GUEST — retained for revenue, excluded from customer analysis",
    "desc": "Filled with Unknown — description not critical for analysis",
    "dupes": "Dropped — system sync duplicates, would inflate customer counts",
    "segment": "Standardised to Retail / Corporate / Wholesale",
    "clv": "Imputed with segment median — new customers, conservative estimate",
    "region": "Filled with Unknown — data migration gap, customer still valid",
    "category": "Mapped 13 variants to 6 standard categories",
    "abandoned": "Flagged as abandoned — excluded from avg resolution, counted in abandonment rate",
    "csat": "Retained as null — non-response is a signal, NOT imputed. Response rate analysed separately.",
    "tickets_total": "No rows dropped — all issues handled by flagging",
    "location": "'Location_03' corrected to 'LOC_03' — data entry error in Q2 2010",
    "sla": "Imputed with location average — unreported quarters, conservative estimate",
    "ops_total": "No rows dropped — all issues resolved by correction or imputation",
}

# ---------------------------------------------------------------------------
# Parameters of this build (not reference values)
# ---------------------------------------------------------------------------

# The reference analyses 2010 and 2011; the driver data covers 1995-2001, and
# its fixture views use 1999 and 2000 in their place.
YEARS = (1999, 2000)

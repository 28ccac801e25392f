"""Parameters of the checked queries. The test data ends in early 2024."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from decimal import Decimal

from callsheet.params import REPEATED_DIGIT_LITERAL, CampaignParams

LABELS = ("BUILDING 0", "D'AVILA (IV)")
MIN_SUM = "500000"

PARAMS = CampaignParams(as_of=dt.date(2024, 2, 15), agreements_since=dt.date(1999, 1, 1))
FILTERED = replace(PARAMS, portfolios=(518,), labels=LABELS, max_phones=3, min_sum=Decimal(MIN_SUM))
LITERAL = replace(PARAMS, repeated_digits=REPEATED_DIGIT_LITERAL)

#: Queries that return a whole input table.
SCANS = {
    "scan_accounts": "cadastros_tb",
    "scan_phones": "fones_tb",
    "scan_events": "hist_tb",
    "scan_agreements": "acordos_tb",
    "scan_complements": "rec_comp_tb",
    "scan_receivables": "receber_tb",
    "scan_collateral": "bens_tb",
}

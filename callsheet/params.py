"""Parameters of a campaign run."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lists carry this many phone columns, however many phones are asked for.
PHONE_SLOTS = 7

#: A digit six times in a row.
REPEATED_DIGIT = r"([0-9])\1{5}"
#: The same pattern with its back-reference lost, as a server that drops unknown
#: escapes in string literals reads it: any digit followed by five ones.
REPEATED_DIGIT_LITERAL = "[0-9]1{5}"


@dataclass(frozen=True)
class CampaignParams:
    """What a user chooses for a run.

    ``portfolios`` must be listed: at least one code, usually one or all three.
    No ``labels`` means no label filter, no ``min_sum`` no minimum, and no
    ``as_of`` today.
    """

    portfolios: tuple[int, ...] = (517, 518, 519)
    labels: tuple[str, ...] = ()
    max_phones: int = PHONE_SLOTS
    min_sum: Decimal | None = None
    as_of: dt.date | None = None
    agreements_since: dt.date = dt.date(2025, 7, 1)
    recent_months: int = 2
    contact_days: int = 30
    exclude_system_events: bool = False
    repeated_digits: str = REPEATED_DIGIT
    dedupe_sum: bool = False

    def __post_init__(self) -> None:
        if not self.portfolios:
            raise ValueError("choose at least one portfolio")
        object.__setattr__(self, "portfolios", tuple(int(c) for c in self.portfolios))
        object.__setattr__(self, "labels", tuple(self.labels))
        object.__setattr__(self, "max_phones", max(1, min(PHONE_SLOTS, int(self.max_phones))))
        if self.min_sum is not None:
            # Through float, so that ties round as in printf("%.2f").
            object.__setattr__(self, "min_sum", Decimal(f"{float(self.min_sum):.2f}"))

    @property
    def today(self) -> Column:
        return F.current_date() if self.as_of is None else F.lit(self.as_of)

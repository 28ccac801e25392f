"""Amounts typed the Brazilian way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parse_br_amount(raw: Column, strict: bool = False) -> Column:
    """Amount text as decimal(38,2), the widest there is.

    Points are thousands separators only next to exactly one comma, so
    '1.234,56' is 1234.56 but '10.000' is 10.00. Blank text gives NULL. Other
    text that is no number gives NULL, or fails the job with ``strict``, as does an
    amount of 1e36 or more.
    """
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    commas = F.length(text) - F.length(F.replace(text, F.lit(",")))
    pointless = F.when((commas == 1) & text.contains("."), F.replace(text, F.lit("."))).otherwise(text)
    plain = F.replace(pointless, F.lit(","), F.lit("."))
    number = F.when(plain.rlike(_NUMBER), plain.try_cast("double"))
    # format_number rounds a double half-even on its exact value, like printf("%.2f").
    amount = F.call_function("format_number", number, F.lit("0.00")).try_cast("decimal(38,2)")
    if not strict:
        return amount
    bad = (text != "") & amount.isNull()
    reason = F.when(number.isNull(), "not an amount: ").otherwise("amount too large: ")
    return F.when(bad, F.raise_error(F.concat(reason, raw))).otherwise(amount)

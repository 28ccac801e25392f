"""Phone number tests and dialling priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsheet.params import REPEATED_DIGIT

#: Phone statuses that pass whatever the note says (fixed values).
TRUSTED_STATUSES = (2, 4, 5, 6, 1)
#: Dialling order of the phone statuses (fixed values).
STATUS_ORDER = (2, 4, 5, 6, 1, 0)
MIN_NUMBER_BYTES = 8


def full_number(area: str = "dddfone", number: str = "telefone") -> Column:
    """Area code and number as one text; NULL if either is missing."""
    return F.concat(F.col(area), F.col(number))


def has_digit_run(number: Column, pattern: str = REPEATED_DIGIT) -> Column:
    return number.rlike(pattern)


def is_reachable(status: Column, note: Column) -> Column:
    """Trusted status, or a note that speaks neither of 'Descon...' nor of 'incorret...'."""
    return status.isin(*TRUSTED_STATUSES) | (~note.ilike("%Descon%") & ~note.ilike("%incorret%"))


def is_well_formed(number: Column) -> Column:
    return (F.octet_length(number) >= MIN_NUMBER_BYTES) & ~number.ilike("%X%")


def phone_rule(rule: str, pattern: str = REPEATED_DIGIT) -> Column:
    """Predicate over a phone row that carries ``telefone_completo``.

    * ``loose``: no digit run;
    * ``strict``: ``loose``, well formed and reachable;
    * ``core``: well formed, reachable and no bad note even on a trusted status;
      digit runs pass.
    """
    number, status, note = F.col("telefone_completo"), F.col("status"), F.col("obs")
    if rule == "loose":
        return ~has_digit_run(number, pattern)
    if rule == "strict":
        return ~has_digit_run(number, pattern) & is_well_formed(number) & is_reachable(status, note)
    if rule == "core":
        return (
            is_well_formed(number)
            & is_reachable(status, note)
            & ~note.ilike("%Desconhecido%")
            & ~note.ilike("%incorreto%")
        )
    raise ValueError(f"unknown phone rule {rule!r}")


def dial_priority(status: Column, order: Sequence[int] = STATUS_ORDER) -> Column:
    """Place of ``status`` in ``order`` from 1; unlisted and NULL statuses get 0, so come first."""
    places = F.array(*[F.lit(s) for s in order])
    return F.coalesce(F.array_position(places, status), F.lit(0))

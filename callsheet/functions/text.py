"""Text forms used in lists and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_SEPARATOR = " || "


def day_text(day: Column) -> Column:
    return F.date_format(day, "dd-MM-yyyy")


def joined_list(value: str) -> Column:
    """Aggregate: the group's values in order as one text, NULL if it has none.

    Expects values that are distinct within the group; removing copies before
    keeps the collected array as small as the text itself.
    """
    ordered = F.array_sort(F.collect_list(value))
    return F.when(F.count(value) > 0, F.array_join(ordered, LIST_SEPARATOR))


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")

"""File names of exported lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsheet.functions.text import alphanumeric
from callsheet.plans.catalogue import PORTFOLIOS, WEEK


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def export_name(cod_cli: Column, campaign: Column, labels: Column, at: Column) -> Column:
    """``{portfolio}_{campaign}[_{label}...]_{yyyyMMdd_HHmmss}``.

    ``labels`` is an array, empty or NULL for none. Labels keep letters and digits
    only; one without any becomes 'Infoad'.
    """
    prefix = F.coalesce(
        _lookup({code: prefix for code, _, prefix in PORTFOLIOS}, cod_cli), F.lit(PORTFOLIOS[0][2])
    )
    part = F.coalesce(_lookup({c.id: c.file_part for c in WEEK}, campaign), campaign)
    short = F.transform(
        labels,
        lambda label: F.when(alphanumeric(label) == "", F.lit("Infoad")).otherwise(alphanumeric(label)),
    )
    # concat_ws leaves out a NULL or empty array.
    return F.concat_ws("_", prefix, part, short, F.date_format(at, "yyyyMMdd_HHmmss"))

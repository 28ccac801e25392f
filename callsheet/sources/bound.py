"""Tables from SQL text with bound parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _bound(value: Any) -> Column:
    """The value as a literal; a sequence as an array without its nulls, which equal nothing."""
    if isinstance(value, Sequence) and not isinstance(value, (str, bytes)):
        value = [x for x in value if x is not None]
        kinds = {type(x) for x in value}
        if len(kinds) > 1:
            raise TypeError(f"a list of {sorted(k.__name__ for k in kinds)} has no one type")
        return F.array(*[F.lit(x) for x in value])
    return F.lit(value)


def bound_sql(
    spark: SparkSession, text: str, tables: Mapping[str, DataFrame], params: Mapping[str, Any]
) -> DataFrame:
    """The rows of a SQL text that names tables as ``{cadastros_tb}`` and values as ``:labels``.

    Values are bound, never written into the text, so quotes and SQL in them stay text. A
    list or tuple is an array, for ``array_contains(:labels, infoad)``. Values that the
    text does not name are left out of account; one that it names and ``params`` lacks is
    an error.
    """
    used = {name: df for name, df in tables.items() if f"{{{name}}}" in text}
    return spark.sql(text, args={name: _bound(value) for name, value in params.items()}, **used)


def accounts_from_sql(
    spark: SparkSession, text: str, tables: Mapping[str, DataFrame], params: Mapping[str, Any]
) -> dict[str, DataFrame]:
    """The tables with the accounts that a SQL text selects, for a list of just these.

    The text has to return a column `cod_cad`. Accounts that it returns several times
    count once; a null counts for nothing.
    """
    chosen = bound_sql(spark, text, tables, params).select(F.col("cod_cad").alias("cod_cad"))
    accounts = tables["cadastros_tb"].join(chosen, "cod_cad", "left_semi")
    return {**{name: tables[name] for name in tables}, "cadastros_tb": accounts}

"""Portfolio summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.operators.accounts import active, in_portfolio


def is_labelled() -> Column:
    return F.col("infoad").isNotNull() & (F.col("infoad") != "")


def portfolio_counts(accounts: DataFrame) -> DataFrame:
    """Active labelled accounts per portfolio and label, in label order."""
    counts = active(accounts.where(is_labelled())).groupBy("cod_cli", "infoad")
    return counts.agg(F.count("*").alias("qtd_contratos")).orderBy("cod_cli", "infoad")


def portfolio_total(accounts: DataFrame, portfolios: Sequence[int]) -> DataFrame:
    """Active labelled accounts of each of ``portfolios``, 0 for one without any."""
    counted = active(in_portfolio(accounts, portfolios).where(is_labelled())).groupBy("cod_cli")
    totals = counted.agg(F.count("*").alias("n"))
    codes = F.array(*[F.lit(code) for code in sorted(set(portfolios))]).cast("array<int>")
    asked = accounts.sparkSession.range(1).select(F.explode(codes).alias("cod_cli"))
    # Both sides hold a row per portfolio asked for.
    return asked.join(totals, "cod_cli", "left").select(
        "cod_cli", F.coalesce("n", F.lit(0)).cast("long").alias("total_contratos")
    )


#: What a row of the summary counts, by its grouping number.
LEVELS = {0: "label", 1: "portfolio", 3: "all"}


def portfolio_summary(accounts: DataFrame, portfolios: Sequence[int]) -> DataFrame:
    """Active labelled accounts by label, by portfolio and in all, in one pass.

    ``level`` says what a row counts. A portfolio asked for has a total of 0 if it has
    no accounts, as the whole has.
    """
    codes = F.array(*[F.lit(code) for code in sorted(set(portfolios))]).cast("array<int>")
    # A row that counts nothing makes the totals appear; no label is its own.
    asked = accounts.sparkSession.range(1).select(
        F.explode(codes).alias("cod_cli"), F.lit(None).cast("string").alias("infoad"), F.lit(0).alias("n")
    )
    counted = active(in_portfolio(accounts, portfolios).where(is_labelled())).select(
        "cod_cli", "infoad", F.lit(1).alias("n")
    )
    summed = (
        counted.unionByName(asked)
        .rollup("cod_cli", "infoad")
        .agg(F.sum("n").alias("qtd_contratos"), F.grouping_id().cast("int").alias("_level"))
    )
    level = F.when(F.col("_level") == 0, LEVELS[0]).when(F.col("_level") == 1, LEVELS[1]).otherwise(LEVELS[3])
    return summed.where((F.col("_level") != 0) | F.col("infoad").isNotNull()).select(
        level.alias("level"), "cod_cli", "infoad", F.coalesce("qtd_contratos", F.lit(0)).alias("qtd_contratos")
    )


def portfolio_labels(accounts: DataFrame) -> DataFrame:
    """Labels in use over all portfolios, in order, the empty ones included."""
    return accounts.select("infoad").distinct().orderBy(F.asc_nulls_first("infoad"))

"""Agreements: the latest one per contract and what it says."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsheet.functions.agreement import (
    SETTLED,
    STATUS_LABELS,
    payment_kind,
    status_label,
)
from callsheet.functions.text import day_text
from callsheet.operators.accounts import in_portfolio
from callsheet.operators.ranking import number_rows
from callsheet.schemas import CONTRACT

#: Agreement ids in a bucket of the full ranking.
AGREEMENT_BUCKET = 65536


def since_date(agreements: DataFrame, since: dt.date) -> DataFrame:
    return agreements.where(F.col("data_cad") >= F.lit(since))


def rank_agreements(agreements: DataFrame, since: dt.date) -> DataFrame:
    """Number each contract's agreements from the newest as ``rn_aco``.

    Agreement ids are unique, so a bucket of a contract has AGREEMENT_BUCKET rows at most.
    """
    bucket = F.floor(F.col("cod_aco") / AGREEMENT_BUCKET)
    return number_rows(
        since_date(agreements, since), CONTRACT, [(bucket, True)], [F.desc("cod_aco")], "rn_aco"
    )


def newest_agreement(agreements: DataFrame, since: dt.date) -> DataFrame:
    """The newest agreement per contract, whatever its status."""
    # With the limit known, every task sends one row of a contract on.
    newest = Window.partitionBy(*CONTRACT).orderBy(F.desc("cod_aco"))
    numbered = since_date(agreements, since).withColumn("rn_aco", F.row_number().over(newest))
    return numbered.where(F.col("rn_aco") == 1).drop("rn_aco")


def agreement_columns() -> list[Column]:
    """List columns of an agreement; NULL under a status without a label."""
    labelled = F.col("staco").isin(*STATUS_LABELS)

    def shown(value: Column, name: str) -> Column:
        return F.when(labelled, value).alias(name)

    return [
        shown(F.col("vlr_aco"), "UltimoValorAcordado"),
        shown(payment_kind(F.col("qtd_p_aco")), "TipoAcordo"),
        shown(day_text(F.col("data_cad")), "DataCriacaoGecobi"),
        shown(status_label(F.col("staco")), "StatusUltimoAcordo"),
    ]


def latest_agreement(agreements: DataFrame, since: dt.date) -> DataFrame:
    """Newest agreement per contract in list form, for contracts whose status has a label."""
    newest = newest_agreement(agreements, since).where(F.col("staco").isin(*STATUS_LABELS))
    return newest.select(*CONTRACT, *agreement_columns())


def contracts_in_status(newest: DataFrame, codes: Iterable[str]) -> DataFrame:
    """Contracts whose newest agreement has one of ``codes``."""
    return newest.where(F.col("staco").isin(*codes)).select(*CONTRACT)


def blocked_portfolios(agreements: DataFrame, since: dt.date) -> DataFrame:
    """Portfolios whose newest agreement without a contract number is settled.

    ``NOT IN`` a set holding NULL is never true, so such an agreement leaves no
    contract to call in its portfolio. At most one row per portfolio code.
    """
    return (
        since_date(agreements, since)
        .where(F.col("nmcont").isNull())
        .groupBy("cod_cli")
        .agg(F.max_by("staco", "cod_aco").alias("staco"))
        .where(F.col("staco").isin(*SETTLED))
        .select("cod_cli")
    )


def exclude_paid(contracts: DataFrame, paid: DataFrame, portfolios: Sequence[int]) -> DataFrame:
    """Contracts of ``portfolios`` not in ``paid``, with the NULL rules of ``NOT IN`` in each.

    The broadcast side holds at most one row per portfolio asked for.
    """
    contracts, paid = in_portfolio(contracts, portfolios), in_portfolio(paid, portfolios)
    marks = paid.groupBy("cod_cli").agg(F.max(F.col("nmcont").isNull()).alias("has_null"))
    comparable = F.col("has_null").isNull() | (~F.col("has_null") & F.col("nmcont").isNotNull())
    return (
        contracts.join(F.broadcast(marks), "cod_cli", "left")
        .where(comparable)
        .drop("has_null")
        .join(paid, CONTRACT, "left_anti")
    )

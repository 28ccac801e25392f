"""Open contracts: invoices, product types, binding id and collateral.

Every side is reduced to one row per contract before it is joined, in two steps:
first to distinct values, which spreads a hot contract over all tasks and combines
its copies map-side, then to the contract.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.functions.agreement import BROKEN, SETTLED
from callsheet.functions.text import joined_list
from callsheet.operators.accounts import in_portfolio, join_contracts
from callsheet.operators.agreements import (
    agreement_columns,
    blocked_portfolios,
    exclude_paid,
    newest_agreement,
)
from callsheet.params import CampaignParams
from callsheet.schemas import CONTRACT

#: Complement code that keeps a contract out of the core lists (fixed value).
CORE_EXCLUDED_CODE = 400


def complement_facts(complements: DataFrame) -> DataFrame:
    """Per contract: complement rows, product types and the highest binding id.

    ``core_BindingID`` leaves out rows with the excluded code, ``core_rows`` counts
    the others.
    """
    passes = F.col("int_1") != CORE_EXCLUDED_CODE
    by_type = complements.groupBy(*CONTRACT, "char_5").agg(
        F.count("*").alias("rows"),
        F.max("int_2").alias("BindingID"),
        F.count(F.when(passes, 1)).alias("core_rows"),
        F.max(F.when(passes, F.col("int_2"))).alias("core_BindingID"),
    )
    return by_type.groupBy(*CONTRACT).agg(
        F.sum("rows").alias("rows"),
        joined_list("char_5").alias("TipoProduto"),
        F.max("BindingID").alias("BindingID"),
        F.sum("core_rows").alias("core_rows"),
        F.max("core_BindingID").alias("core_BindingID"),
    )


def receivable_facts(receivables: DataFrame) -> DataFrame:
    """Per contract: invoices and their sum, down payments left out."""
    by_invoice = (
        receivables.where(~F.col("fat_parc").ilike("%ENTRADA%"))
        .groupBy(*CONTRACT, "fat_parc")
        .agg(F.sum("vlrparc").alias("vlrparc"))
    )
    return by_invoice.groupBy(*CONTRACT).agg(
        joined_list("fat_parc").alias("Contratos"),
        F.sum("vlrparc").alias("vlrparc"),
    )


def contract_values(
    complements: DataFrame,
    receivables: DataFrame,
    min_sum: Decimal | None = None,
    dedupe_sum: bool = False,
) -> DataFrame:
    """Contracts with a complement and an invoice, with their texts and ``soma``.

    ``soma`` counts every invoice once per complement row, as a join of the two
    tables would; ``dedupe_sum`` counts it once.
    """
    copies = F.lit(1) if dedupe_sum else F.col("rows")
    values = (
        complement_facts(complements)
        .join(receivable_facts(receivables), CONTRACT)
        .withColumn("soma", (F.col("vlrparc") * copies).cast("decimal(38,2)"))
        .drop("vlrparc", "rows")
    )
    return values if min_sum is None else values.where(F.col("soma") >= F.lit(min_sum))


def unpaid_contracts(
    complements: DataFrame, paid: DataFrame, portfolios: Sequence[int]
) -> DataFrame:
    return exclude_paid(complements.select("nmcont", "cod_cli").distinct(), paid, portfolios)


def collateral(goods: DataFrame) -> DataFrame:
    """Per contract: number of distinct chassis and the good with the lowest plate."""
    shown = [
        F.col("placa").isNull().alias("unplated"),
        F.col("placa"),
        F.concat("marca", F.lit(" - "), "modelo").alias("MarcaModelo"),
        F.col("cor"),
        F.concat(F.col("anofab").cast("string"), F.lit("/"), F.col("anomodelo").cast("string")).alias(
            "AnoFabModelo"
        ),
    ]
    # A generator makes the good before the rows are sorted. As an expression it would be made
    # by the aggregation, which runs no compiled loop over texts.
    good = F.inline(F.array(F.struct(F.struct(*shown).alias("good"))))
    # Texts are aggregated over sorted rows. With hashes in front of the keys most comparisons
    # end at the sort's prefix, and rows by contract and chassis stand by contract, too.
    of_contract = F.shiftleft(F.xxhash64(*CONTRACT), 32)
    of_chassis = F.shiftrightunsigned(F.xxhash64(*CONTRACT, "chassi"), 32)
    place = of_contract.bitwiseOR(of_chassis).alias("place")
    made = goods.select(*CONTRACT, "chassi", good)
    by_chassis = made.groupBy(place, *CONTRACT, "chassi").agg(F.min("good").alias("good"))
    by_contract = by_chassis.groupBy(F.shiftright("place", 32).alias("place"), *CONTRACT).agg(
        F.min("good").alias("good"), F.count("chassi").alias("QtdGarantiasUnicas")
    )
    return by_contract.select(
        *CONTRACT,
        "good.MarcaModelo",
        "good.placa",
        "good.cor",
        "good.AnoFabModelo",
        "QtdGarantiasUnicas",
    )


def contract_profile(tables: dict[str, DataFrame], params: CampaignParams) -> DataFrame:
    """One row per contract that may be called, with all its list columns.

    All sides hold one row per contract and are partitioned by contract, so they
    join without another shuffle or skew. ``is_broken`` tells whether the newest
    agreement is broken or rejected; contracts with a settled one are left out.
    The broadcast side holds one row per portfolio code.
    """

    def rows(name: str) -> DataFrame:
        return in_portfolio(tables[name], params.portfolios)

    agreements = rows("acordos_tb")
    values = contract_values(
        rows("rec_comp_tb"), rows("receber_tb"), params.min_sum, params.dedupe_sum
    )
    return (
        values.join(newest_agreement(agreements, params.agreements_since), CONTRACT, "left")
        .where(F.col("staco").isNull() | ~F.col("staco").isin(*SETTLED))
        .select(
            *values.columns,
            *agreement_columns(),
            F.coalesce(F.col("staco").isin(*BROKEN), F.lit(False)).alias("is_broken"),
        )
        .join(
            F.broadcast(blocked_portfolios(agreements, params.agreements_since)),
            "cod_cli",
            "left_anti",
        )
        .join(collateral(rows("bens_tb")), CONTRACT, "left")
    )


def with_core_complement(accounts: DataFrame, complements: DataFrame) -> DataFrame:
    """Accounts whose contract has a complement row without the excluded code."""
    passing = complements.where(F.col("int_1") != CORE_EXCLUDED_CODE).select(*CONTRACT).distinct()
    return join_contracts(accounts, passing, "left_semi")


def binding_id(accounts: DataFrame, complements: DataFrame) -> DataFrame:
    """The accounts with their contract's highest binding id, NULL for none."""
    highest = complements.groupBy(*CONTRACT).agg(F.max("int_2").alias("BindingID"))
    return join_contracts(accounts, highest, "left")

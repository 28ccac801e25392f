"""Account selection and portfolio filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.functions.text import day_text
from callsheet.params import CampaignParams
from callsheet.schemas import CONTRACT


def in_portfolio(df: DataFrame, codes: Iterable[int]) -> DataFrame:
    return df.where(F.col("cod_cli").isin(*codes))


def active(accounts: DataFrame) -> DataFrame:
    """Accounts not marked inactive; an unknown status counts as inactive."""
    return accounts.where(F.col("stcli") != "INA")


def with_labels(accounts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Accounts under one of ``labels``; all accounts if none is given."""
    return accounts.where(F.col("infoad").isin(*labels)) if labels else accounts


def recent_accounts(accounts: DataFrame, as_of: Column, months: int = 2) -> DataFrame:
    """New loads: registered on their file date, within the last ``months`` months."""
    return accounts.where(is_recent(as_of, months))


def is_recent(as_of: Column, months: int = 2) -> Column:
    registered = F.col("data_cad")
    return (registered == F.col("data_arq")) & (registered >= F.add_months(as_of, -months))


def select_accounts(accounts: DataFrame, params: CampaignParams) -> DataFrame:
    """Active accounts of the chosen portfolios and labels."""
    return with_labels(active(in_portfolio(accounts, params.portfolios)), params.labels)


def account_columns() -> list[Column]:
    """Account fields as lists show them, after the keys."""
    return [
        F.col("cod_cad"),
        F.col("cod_cli"),
        F.col("nmcont"),
        F.col("nomecli").alias("nome"),
        F.col("cpfcnpj").alias("cpf"),
        day_text(F.col("nascto")).alias("DataNascimento"),
        F.col("infoad").alias("Portfolio"),
    ]


def join_contracts(accounts: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Accounts with the contract columns of ``facts``, which has one row per contract.

    A contract may have very many accounts. Joined on its two columns, ``facts``
    would keep the partitioning it was aggregated by and pin all those accounts to
    one task. A key of its own makes Spark shuffle both sides for this join, which
    lets adaptive execution split such a contract.
    """
    key = F.concat(F.col("cod_cli").cast("string"), F.lit("/"), F.col("nmcont")).alias("contract")
    keyed = facts.select(key, *[c for c in facts.columns if c not in CONTRACT])
    return accounts.select("*", key).join(keyed, "contract", how).drop("contract")

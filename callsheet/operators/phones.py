"""Phones: cleaning, ranking per account, one row per account.

Phones are cleaned and ranked before they meet the accounts. Every account filter
is the same for all phones of an account, so the order does not change results,
and it keeps an account with very many phones harmless: copies fall away in the
map-side part of the de-duplication, whose shuffle spreads one account over all
tasks, and the ranking sends at most ``k`` phones per account and task on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsheet.functions.phone import STATUS_ORDER, dial_priority, full_number, phone_rule
from callsheet.operators.ranking import number_rows
from callsheet.params import PHONE_SLOTS, REPEATED_DIGIT

#: Leading characters of a phone that make a bucket of the full ranking.
PREFIX = 4

_PHONE = ["cod_cad", "dddfone", "telefone", "status"]


def number_phones(phones: DataFrame) -> DataFrame:
    return phones.withColumn("telefone_completo", full_number())


def clean_phones(phones: DataFrame, rule: str, pattern: str = REPEATED_DIGIT) -> DataFrame:
    """Distinct phones per account that pass ``rule``.

    A number kept under two statuses stays twice.
    """
    kept = number_phones(phones).where(phone_rule(rule, pattern))
    return number_phones(kept.select(*_PHONE).distinct())


def clean_phones_by_rule(
    phones: DataFrame, rules: Sequence[str], pattern: str = REPEATED_DIGIT
) -> DataFrame:
    """Distinct phones per account that pass any of ``rules``, with a flag column per rule."""
    if len(set(rules)) == 1:
        # All phones that are left pass it; no need to test them again.
        return clean_phones(phones, rules[0], pattern).withColumn(rules[0], F.lit(True))
    tests = {rule: phone_rule(rule, pattern) for rule in rules}
    # Copies of a phone may differ in their note; one good copy is enough.
    flags = [F.coalesce(F.max(test), F.lit(False)).alias(rule) for rule, test in tests.items()]
    kept = number_phones(phones).where(reduce(or_, tests.values()))
    return number_phones(kept.groupBy(*_PHONE).agg(*flags))


def _dial_order(priority: Sequence[int]) -> list[Column]:
    status = F.col("status")
    return [dial_priority(status, priority), status.asc_nulls_first(), F.col("telefone_completo")]


def rank_phones(phones: DataFrame, priority: Sequence[int] = STATUS_ORDER) -> DataFrame:
    """Number each account's phones in dialling order as ``num``; ties go by phone text.

    Numbered within the phones of a status that begin alike, so that an account with
    very many phones is split.
    """
    status = F.col("status")
    buckets = [
        (dial_priority(status, priority), False),
        (status, False),
        (F.substring("telefone_completo", 1, PREFIX), False),
    ]
    return number_rows(phones, ["cod_cad"], buckets, _dial_order(priority), "num")


def top_phones(
    phones: DataFrame, k: int, priority: Sequence[int] = STATUS_ORDER
) -> DataFrame:
    """The first ``k`` phones of each account, numbered as :func:`rank_phones` does.

    With the limit known, every task sends ``k`` phones of an account on.
    """
    order = Window.partitionBy("cod_cad").orderBy(*_dial_order(priority))
    return phones.withColumn("num", F.row_number().over(order)).where(F.col("num") <= k)


def slot_names() -> list[str]:
    return [f"Telefone{num}" for num in range(1, PHONE_SLOTS + 1)]


def widen_phones(ranked: DataFrame) -> DataFrame:
    """One row per account with ``Telefone1`` to ``Telefone7``."""
    slots = [
        F.max(F.when(F.col("num") == num, F.col("telefone_completo"))).alias(name)
        for num, name in enumerate(slot_names(), 1)
    ]
    return ranked.groupBy("cod_cad").agg(*slots)


def phone_lists_by_rule(
    phones: DataFrame, rules: Sequence[str], k: int, priority: Sequence[int] = STATUS_ORDER
) -> DataFrame:
    """One row per account with an array per rule, named after it: its first ``k`` phones.

    A phone among the first ``k`` of a rule is among the first ``k`` of the phones that
    pass the same rules as it does. So few phones per account are left to collect.
    """
    alike = Window.partitionBy("cod_cad", *rules).orderBy(*_dial_order(priority))
    few = phones.withColumn("num", F.row_number().over(alike)).where(F.col("num") <= k)
    place = dial_priority(F.col("status"), priority).alias("place")
    entries = F.collect_list(F.struct(place, "status", "telefone_completo", *rules))
    by_account = few.groupBy("cod_cad").agg(F.array_sort(entries).alias("phones"))

    def first(rule: str) -> Column:
        passing = F.filter("phones", lambda phone: phone[rule])
        numbers = F.transform(passing, lambda phone: phone["telefone_completo"])
        return F.slice(numbers, 1, k).alias(rule)

    return by_account.select("cod_cad", *[first(rule) for rule in rules])


def phones_of(accounts: DataFrame, phones: DataFrame) -> DataFrame:
    """Phones of the given accounts."""
    return accounts.select("cod_cad").join(phones, "cod_cad")

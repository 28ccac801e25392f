"""One account, contract or group of copies holding a third of the rows, against brute force."""

import datetime as dt
import random
import re
from collections import defaultdict
from decimal import Decimal

import pytest

from callsheet.operators.accounts import join_contracts
from callsheet.operators.contracts import contract_values
from callsheet.operators.agreements import rank_agreements
from callsheet.operators.phones import (
    clean_phones,
    clean_phones_by_rule,
    phone_lists_by_rule,
    rank_phones,
    top_phones,
    widen_phones,
)

ORDER = {2: 1, 4: 2, 5: 3, 6: 4, 1: 5, 0: 6}
TRUSTED = {2, 4, 5, 6, 1}


def strict(number, status, note):
    if number is None or len(number.encode()) < 8 or "x" in number.lower():
        return False
    if any(d * 6 in number for d in "0123456789"):
        return False
    if status in TRUSTED:
        return True
    note = None if note is None else note.lower()
    return note is not None and "descon" not in note and "incorret" not in note


def loose(number, status, note):
    return number is not None and not any(d * 6 in number for d in "0123456789")


@pytest.fixture(scope="module")
def phones():
    rng = random.Random(7)

    def phone(account):
        return (
            account,
            rng.choice(["11", "21", None]),
            rng.choice(["9123456", "99999999", "9x123456", "12345", ""]) + str(rng.randrange(40)),
            rng.choice([0, 1, 2, 3, 4, 5, 6, 7, None]),
            rng.choice([None, "ok", "Desconhecido", "numero INCORRETO"]),
        )

    rows = [phone(rng.randrange(2, 60)) for _ in range(1200)]
    rows += [phone(1) for _ in range(500)]  # a hot account
    rows += [(2, "11", "91230000", 3, rng.choice(["ok", None])) for _ in range(600)]  # copies
    return rows


def slots(rows, test, k):
    by_account = defaultdict(set)
    for account, area, number, status, note in rows:
        full = None if area is None or number is None else area + number
        if test(full, status, note):
            by_account[account].add((full, area, number, status))
    wide = {}
    for account, kept in by_account.items():
        def key(p):
            return (ORDER.get(p[3], 0), p[3] is not None, p[3] or 0, p[0])

        numbers = [p[0] for p in sorted(kept, key=key)][:k]
        wide[account] = tuple(numbers + [None] * (7 - len(numbers)))
    return wide


@pytest.mark.parametrize("rule, test, k", [("strict", strict, 7), ("loose", loose, 3)])
def test_phone_slots(make, phones, rule, test, k):
    names = ("cod_cad", "dddfone", "telefone", "status", "obs")
    df = make("fones_tb", *[dict(zip(names, row)) for row in phones]).repartition(8)
    wide = widen_phones(top_phones(clean_phones(df, rule), k))
    assert {r[0]: tuple(r)[1:] for r in wide.collect()} == slots(phones, test, k)


def test_phone_slots_of_two_rules_in_one_pass(make, phones):
    names = ("cod_cad", "dddfone", "telefone", "status", "obs")
    df = make("fones_tb", *[dict(zip(names, row)) for row in phones]).repartition(8)
    cleaned = clean_phones_by_rule(df, ["strict", "loose"])
    for k in (2, 7):
        rows = phone_lists_by_rule(cleaned, ["strict", "loose"], k).collect()
        for rule, test in (("strict", strict), ("loose", loose)):
            want = {a: [n for n in numbers if n] for a, numbers in slots(phones, test, k).items()}
            assert {r["cod_cad"]: r[rule] for r in rows if r[rule]} == want


def test_values_of_a_hot_contract(make):
    rng = random.Random(3)
    contracts = [f"C{rng.choice([0, 0, n])}" for n in range(300)]
    complements = [(c, rng.randrange(99), rng.choice(["p", "q", None])) for c in contracts]
    invoices = [
        (rng.choice(contracts), rng.choice(["F", "ENTRADA "]) + str(rng.randrange(9)), Decimal(rng.randrange(999)) / 100)
        for _ in range(2000)
    ]
    joined = defaultdict(list)
    for c, binding, kind in complements:
        for d, label, amount in invoices:
            if c == d and "ENTRADA" not in label:
                joined[c].append((binding, kind, label, amount))
    want = {
        c: (
            " || ".join(sorted({r[2] for r in rows})),
            " || ".join(sorted({r[1] for r in rows if r[1]})) or None,
            sum(r[3] for r in rows),
        )
        for c, rows in joined.items()
    }
    left = make("rec_comp_tb", *[{"cod_cli": 517, "nmcont": c, "int_2": b, "char_5": k} for c, b, k in complements])
    right = make("receber_tb", *[{"cod_cli": 517, "nmcont": c, "fat_parc": f, "vlrparc": v} for c, f, v in invoices])
    got = contract_values(left, right).select("nmcont", "Contratos", "TipoProduto", "soma").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_accounts_of_a_hot_contract_are_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        accounts = spark.range(0, 90000, 1, 8).selectExpr(
            "id AS cod_cad", "517 AS cod_cli", "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('C', id) END AS nmcont")
        facts = accounts.groupBy("cod_cli", "nmcont").count()
        joined = join_contracts(accounts, facts)
        assert len(joined.collect()) == 90000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_full_rankings_split_hot_keys(spark):
    phones = spark.range(30000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0L ELSE id END AS cod_cad", "string(id % 9) AS dddfone",
        "string(id * 7919 % 99991) AS telefone", "int(id % 7) AS status",
        "concat(id % 9, id * 7919 % 99991) AS telefone_completo")
    ranked = rank_phones(phones).collect()
    by_account = defaultdict(list)
    for r in sorted(ranked, key=lambda r: r["num"]):
        by_account[r["cod_cad"]].append((ORDER.get(r["status"], 0), r["status"], r["telefone_completo"]))
    assert all(rows == sorted(rows) for rows in by_account.values())
    assert sorted(r["num"] for r in ranked if r["cod_cad"] == 0) == list(range(1, 10001))
    # The hot account's rows are spread before they are numbered.
    plan = rank_phones(phones)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\((.*?)\)", plan)
    assert any("_bucket2" in k for k in keys)


def test_full_rankings_broadcast_no_counts(spark):
    # The estimate of rows made by an explode is that of the few keys they are made of.
    keys = spark.range(0, 40000, 1, 1).selectExpr("id AS cod_cad", "explode(sequence(0, 4)) AS n")
    phones = keys.selectExpr("cod_cad", "'11' AS dddfone", "string(n) AS telefone", "n AS status",
                             "concat('11', n) AS telefone_completo")
    for ranked in (rank_phones(phones), rank_agreements(
            phones.selectExpr("cod_cad AS cod_aco", "517 AS cod_cli", "telefone AS nmcont",
                              "DATE '2025-01-01' AS data_cad"), dt.date(2024, 1, 1))):
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_agreements_are_ranked_across_buckets(make):
    rows = [{"cod_aco": n * 30000, "cod_cli": 517, "nmcont": "A", "data_cad": dt.date(2025, 1, 1)} for n in range(20)]
    rows.append({"cod_aco": 5, "cod_cli": 517, "nmcont": None, "data_cad": dt.date(2025, 1, 1)})
    ranked = rank_agreements(make("acordos_tb", *rows), dt.date(2024, 1, 1)).collect()
    assert {r["cod_aco"]: r["rn_aco"] for r in ranked if r["nmcont"]} == {n * 30000: 20 - n for n in range(20)}
    assert [r["rn_aco"] for r in ranked if r["nmcont"] is None] == [1]

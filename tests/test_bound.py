import datetime as dt
from decimal import Decimal

import pytest

from callsheet.sources.bound import accounts_from_sql, bound_sql

ROWS = [dict(cod_cad=n, cod_cli=517 + n % 3, infoad=label) for n, label in enumerate(
    ["A", "D'AVILA (IV)", 'say "hi"', "x' OR '1'='1", None, "", "back\\slash", ":labels"])]


def ids(df):
    return sorted(r["cod_cad"] for r in df.collect())


def test_values_stay_values(spark, make):
    tables = {"cadastros_tb": make("cadastros_tb", *ROWS)}
    text = "SELECT * FROM {cadastros_tb} WHERE array_contains(:labels, infoad)"
    for n, row in enumerate(ROWS):
        want = [n] if row["infoad"] is not None else []
        assert ids(bound_sql(spark, text, tables, {"labels": [row["infoad"]]})) == want
    assert ids(bound_sql(spark, text, tables, {"labels": ("A", "D'AVILA (IV)", None)})) == [0, 1]
    assert ids(bound_sql(spark, text, tables, {"labels": []})) == []


def test_other_types_and_tables_that_are_not_named(spark, make):
    tables = {"cadastros_tb": make("cadastros_tb", *ROWS), "hist_tb": None}
    text = """SELECT *, :day AS day, :sum AS amount, :none AS nothing FROM {cadastros_tb}
        WHERE array_contains(:portfolios, cod_cli) AND cod_cad < :most"""
    values = {"portfolios": (517, 519), "most": 6, "day": dt.date(2024, 2, 29), "sum": Decimal("1.50"), "none": None}
    rows = bound_sql(spark, text, tables, values)
    assert ids(rows) == [0, 2, 3, 5]
    assert rows.first()[-3:] == (dt.date(2024, 2, 29), Decimal("1.50"), None)


def test_a_missing_value_and_a_mixed_list_are_errors(spark, make):
    tables = {"cadastros_tb": make("cadastros_tb", *ROWS)}
    with pytest.raises(Exception, match="UNBOUND_SQL_PARAMETER"):
        bound_sql(spark, "SELECT * FROM {cadastros_tb} WHERE cod_cad = :most", tables, {}).collect()
    with pytest.raises(TypeError, match="no one type"):
        bound_sql(spark, "SELECT :x", tables, {"x": [1, "a"]})


def test_accounts_that_come_twice_count_once(spark, make):
    tables = {"cadastros_tb": make("cadastros_tb", *ROWS), "stcob_tb": make("stcob_tb", {"st": "x"})}
    text = "SELECT a.cod_cad FROM {cadastros_tb} a CROSS JOIN (VALUES (1), (2)) v WHERE infoad <> '' UNION ALL SELECT NULL"
    found = accounts_from_sql(spark, text, tables, {})
    assert ids(found["cadastros_tb"]) == [0, 1, 2, 3, 6, 7] and found["stcob_tb"] is tables["stcob_tb"]

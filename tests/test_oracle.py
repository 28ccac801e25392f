"""Every registered query against its SQL twin, over whole tables."""

from collections import Counter

import pytest

from testbed.compare import duck, duck_table, spark_table
from testbed.oracle import oracle_sql
from testbed.queries import queries
from tests.conftest import SMALL

QUERIES = queries()
TWINS = oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == TWINS.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_twin(spark, connection, name):
    columns, rows = spark_table(QUERIES[name](spark, SMALL))
    want_columns, want_rows = duck_table(connection, TWINS[name])
    assert columns == want_columns
    assert rows == want_rows
    assert rows


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", QUERIES)
def test_types_equal_those_of_the_twin(spark, connection, name):
    ours = {n: SQL_TYPES.get(kind, kind.upper()) for n, kind in QUERIES[name](spark, SMALL).dtypes}
    assert ours == {r[0]: r[1] for r in connection.execute(f"DESCRIBE {TWINS[name]}").fetchall()}


def test_list_sizes_are_those_of_the_fixture_notes(spark):
    rows = QUERIES["weekly_lists"](spark, SMALL).groupBy("campaign", "cod_cli").count().collect()
    sizes = Counter({(r["campaign"], r["cod_cli"]): r["count"] for r in rows})
    assert sizes == {
        **dict(zip([("seg_quebras_rcs", c) for c in (517, 518, 519)], (6, 53, 20))),
        **dict(zip([("ter_cpc", c) for c in (517, 518, 519)], (8, 56, 29))),
        **dict(zip([("qua_nunca_contatados", c) for c in (517, 518, 519)], (7, 39, 25))),
        **dict(zip([("geral", c) for c in (517, 518, 519)], (10, 57, 29))),
        **dict(zip([("base_recente", c) for c in (517, 518, 519)], (6, 29, 16))),
    }

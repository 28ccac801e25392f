"""Every registered query runs over its whole table; those that SQL can express equal their twins."""

import pytest

import corpus_pipeline
from callsheet.llm.oracle import ORACLE
from callsheet.llm.queries import QUERIES
from testbed.compare import duck, duck_table, spark_table
from tests.conftest import SMALL


def test_names():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert ORACLE.keys() <= QUERIES.keys()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_twin(spark, name):
    columns, rows = spark_table(QUERIES[name](spark, SMALL))
    want_columns, want_rows = duck_table(duck(SMALL), ORACLE[name])
    assert columns == want_columns
    assert rows == want_rows and rows


@pytest.mark.parametrize("name", ["op4_chat_formatting", "op5_secret_scans"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))

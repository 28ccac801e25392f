"""What the plans must and must not contain, over Parquet tables too big to broadcast."""

import re
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from callsheet.operators.phones import clean_phones_by_rule
from callsheet.plans import catalogue as cat
from callsheet.plans.campaigns import campaign_list, weekly_lists
from callsheet.schemas import SCHEMAS
from callsheet.sources import tables as source_tables
from callsheet.sources.tables import (
    JDBC_RANGES,
    JDBC_TEXT_RANGES,
    jdbc_options,
    load,
    load_jdbc,
    range_options,
    save,
    text_bounds,
    text_predicates,
)
from testbed.domain import DomainTables
from testbed.queries import queries
from testbed.settings import FILTERED, PARAMS
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "base")
    derived = DomainTables(spark, SMALL)
    save({name: derived[name] for name in SCHEMAS}, path)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    yield load(spark, path)
    spark.conf.set(threshold, before)


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_saved_tables_read_back(spark, tables):
    derived = DomainTables(spark, SMALL)
    for name, schema in SCHEMAS.items():
        assert [(f.name, f.dataType) for f in tables[name].schema] == [(f.name, f.dataType) for f in schema]
        assert tables[name].exceptAll(derived[name]).isEmpty()
        assert derived[name].exceptAll(tables[name]).isEmpty()


@pytest.mark.parametrize("name", ["fones_tb", "rec_comp_tb"])
def test_rows_made_of_one_small_file_are_made_by_many_tasks(spark, name):
    made = DomainTables(spark, SMALL)[name].groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 4
    assert max(r["count"] for r in made) < sum(r["count"] for r in made) / 2


@pytest.mark.parametrize("name", ["phones_loose", "phones_strict", "phones_core", "phones_topk", "list_with_agreement",
                                  "campaign_quebras", "campaign_cpc", "campaign_cpc_core", "weekly_lists_windows"])
def test_methods_made_for_phones_are_short_enough_for_the_jvm_to_compile(spark, name):
    made = queries()[name](spark, SMALL)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", made._jdf.queryExecution().explainString(mode))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(map(int, sizes)) < 8000


def test_the_one_rule_of_a_list_is_tested_once(tables):
    one = clean_phones_by_rule(tables["fones_tb"], ["strict"])
    assert one._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1
    both = clean_phones_by_rule(tables["fones_tb"], ["loose", "strict"]).where("strict").select(*one.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, both.collect())) and not one.isEmpty()


@pytest.mark.parametrize("campaign", [*cat.WEEK, *cat.CORE], ids=lambda c: c.id)
def test_campaign_plans(tables, campaign):
    text = plan(campaign_list(tables, campaign, PARAMS))
    for bad in ("CartesianProduct", "NestedLoop", "Python", "BatchEval"):
        assert bad not in text
    assert text.count("WindowGroupLimit") >= 4
    # Events are never shuffled by their few codes before they are reduced.
    for line in text.splitlines():
        assert not (line.startswith("Arguments: hashpartitioning(ocorr") and "data_at" in line)
    # The event table is read only where it decides who is listed.
    assert ("hist_tb" in text) == (campaign.selects in ("right_person", "not_contacted"))


def test_filters_and_columns_reach_the_scans(tables):
    text = plan(campaign_list(tables, cat.NOT_CONTACTED, FILTERED))
    scans = {s.split("/base/")[1].split("]")[0]: s for s in text.split("Scan parquet")[1:] if "/base/" in s}
    # Only the asked portfolio's folders are read.
    assert "PartitionFilters: [isnotnull(cod_cli" in scans["receber_tb"]
    assert "IsNotNull(data_at)" in scans["hist_tb"] and "GreaterThanOrEqual(data_at" in scans["hist_tb"]
    assert "ReadSchema: struct<cod_cli:bigint,data_at:timestamp_ntz,ocorr:string,cod_usu:string>" in scans["hist_tb"]
    assert "data_arq" not in scans["cadastros_tb"].split("ReadSchema")[1].split("\n")[0]
    assert "GreaterThanOrEqual(data_cad,1999-01-01)" in scans["acordos_tb"]
    assert "data_aco" not in scans["acordos_tb"].split("ReadSchema")[1].split("\n")[0]


def test_weekly_job_reads_phones_and_receivables_once(tables):
    text = plan(weekly_lists(tables, PARAMS))
    for name in ("fones_tb", "receber_tb", "rec_comp_tb", "bens_tb"):
        locations = [line for line in text.splitlines() if line.startswith("Location") and f"/{name}]" in line]
        assert len(locations) == 1, name


def test_weekly_job_reads_events_once(tables):
    for with_last_contact in (False, True):
        lists = weekly_lists(tables, PARAMS, with_last_contact=with_last_contact)
        lists.collect()  # the plan that has run shows what it has used twice
        text = lists._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(r"FileScan parquet \[[^\]]*ocorr", text)) == 1


def test_selective_runs_cut_the_tables_first(tables):
    text = plan(campaign_list(tables, cat.WHOLE_BASE, FILTERED))
    assert text.count("LeftSemi") >= 4
    assert "LeftSemi" not in plan(campaign_list(tables, cat.WHOLE_BASE, PARAMS))


def test_events_of_other_accounts_fall_before_the_shuffle(spark, tables):
    one = replace(PARAMS, portfolios=(518,))
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before, seen = spark.conf.get(name), []
    for threshold in (before, "0"):
        spark.conf.set(name, threshold)
        try:
            made = campaign_list(tables, cat.WHOLE_BASE, one, with_last_contact=True)
            optimized = made._jdf.queryExecution().optimizedPlan().toString()
            seen.append((sorted(map(str, made.collect())), re.findall(r"might_contain\(.*?xxhash64\((\w+)#", optimized)))
        finally:
            spark.conf.set(name, before)
    (plain, none), (filtered, columns) = seen
    # The tables of this test are far below the limit.
    assert none == [] and {"cod_cli", "cod_cad"} <= set(columns)
    assert filtered == plain and plain
    # Accounts of more than Spark's 10 MB may make the filter, and it stays small.
    limit = spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold").lower()
    assert limit in ("2gb", "2147483648b")
    assert int(spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.maxNumBits")) <= 8 * (8 << 20)


def test_no_query_runs_python_or_cross_joins(spark):
    for name, run in queries().items():
        text = plan(run(spark, SMALL))
        assert not any(bad in text for bad in ("CartesianProduct", "NestedLoop", "Python")), name


def test_jdbc_splits_cover_the_tables():
    assert JDBC_RANGES.keys() | JDBC_TEXT_RANGES.keys() | {"stcob_tb"} == SCHEMAS.keys()
    for name, column in (JDBC_RANGES | JDBC_TEXT_RANGES).items():
        assert column in SCHEMAS[name].fieldNames()
    assert range_options("cod_cad", 1, 9, 4) == {
        "partitionColumn": "cod_cad", "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}


def read_once(connection, bounds, values, escapes=False):
    """Every value is in exactly one of the clauses, as the database judges them."""
    clauses = text_predicates("k", bounds, escapes)
    for value in values:
        hits = [connection.execute(f"SELECT count(*) FROM t WHERE ({c}) AND k IS NOT DISTINCT FROM ?", [value]).fetchall()[0][0]
                for c in clauses]
        assert sorted(hits)[:-1] == [0] * (len(clauses) - 1) and max(hits) > 0, (value, clauses)
    counts = [connection.execute(f"SELECT count(*) FROM t WHERE {c}").fetchall()[0][0] for c in clauses]
    assert sum(counts) == connection.execute("SELECT count(*) FROM t").fetchall()[0][0]
    return counts


@pytest.mark.parametrize("kind", ["VARCHAR", "VARCHAR COLLATE NOCASE", "VARCHAR COLLATE NOCASE.NOACCENT"])
def test_text_ranges_read_every_row_once_under_any_collation(kind):
    values = [None, "", "a", "A", "b", "B", "K'1", "k'1", "É", "e", "E", "z", "Z", "ß", "a\\b", *(f"c{n}" for n in range(40)),
              *(f"C{n}" for n in range(40)), *["hot", "HOT", "Hot"] * 30]
    connection = duckdb.connect()
    connection.execute(f"CREATE TABLE t (k {kind})")
    connection.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    rows = connection.execute(f"SELECT * FROM {text_bounds('t', 'k', 8)}").fetchall()
    bounds = [low for _, low in sorted(rows, key=lambda r: r[0])]
    assert connection.execute(f"SELECT count(DISTINCT k) FROM t WHERE k IN (SELECT unnest(?))", [bounds]).fetchall()[0][0] == len(bounds)
    counts = read_once(connection, bounds, values)
    assert max(counts) <= 100 + len(values) // 8


def test_text_ranges_of_bounds_that_the_database_takes_for_equal():
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (k VARCHAR COLLATE NOCASE)")
    values = ["a", "A", "b", "B", "c", None]
    connection.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    assert read_once(connection, ["a", "B", "b", "C"], values) == [3, 0, 2, 1]


def test_text_literals():
    assert text_predicates("x", ["B", "K'1", "T"]) == ["x < 'K''1' OR x IS NULL", "x >= 'K''1' AND x < 'T'", "x >= 'T'"]
    assert text_predicates("x", []) == text_predicates("x", ["A"]) == ["1 = 1"]
    assert text_predicates("x", ["", "a\\"], True)[1] == "x >= 'a\\\\'"
    assert text_predicates("x", ["", "a\\"])[1] == "x >= 'a\\'"


def test_text_bounds_are_the_first_values_of_equal_shares():
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t AS SELECT 'C' || (1000 + range) AS k FROM range(100)")
    rows = connection.execute(f"SELECT * FROM {text_bounds('t', 'k', 4)} ORDER BY 1").fetchall()
    assert rows == [(1, "C1000"), (2, "C1025"), (3, "C1050"), (4, "C1075")]


def test_bounds_of_a_read_keep_the_order_of_the_database(monkeypatch):
    class Reader:
        asked = []

        def __init__(self):
            self.given = {}

        format = lambda self, _: self

        def options(self, **given):
            self.given = given
            return self

        def load(self):
            return self

        def collect(self):
            if "NTILE" in self.given["dbtable"]:
                return [{"share": 3, "low": "B"}, {"share": 1, "low": "a"}, {"share": 2, "low": "Ab'"}]
            return [{"low": None}]

        def jdbc(self, url, name, predicates, properties):
            self.asked.append(predicates)

    class Session:
        read = property(lambda self: Reader())

    monkeypatch.setattr(source_tables, "conform", lambda df, name: df)
    load_jdbc(Session(), "jdbc:mysql://host/db", {})
    want = ["nmcont < 'Ab''' OR nmcont IS NULL", "nmcont >= 'Ab''' AND nmcont < 'B'", "nmcont >= 'B'"]
    assert Reader.asked == [want] * 3


def test_jdbc_options():
    options = jdbc_options("hist_tb", {"user": "u"}, 5000)
    assert options == {
        "user": "u", "fetchsize": "5000", "preferTimestampNTZ": "true",
        "customSchema": "cod_cli bigint, data_at timestamp_ntz, ocorr string, cod_usu string"}


def test_tables_of_the_right_types_are_not_cast(tables):
    assert "cast" not in tables["hist_tb"]._jdf.queryExecution().analyzed().toString().lower()


def test_load_from_the_catalog(spark, tmp_path):
    derived = DomainTables(spark, SMALL)
    spark.sql(f"CREATE DATABASE lists LOCATION '{tmp_path}'")
    try:
        for name in SCHEMAS:
            derived[name].write.saveAsTable(f"lists.{name}")
        loaded = load(spark, "catalog:lists")
        assert {n: df.count() for n, df in loaded.items()} == {n: derived[n].count() for n in SCHEMAS}
    finally:
        spark.sql("DROP DATABASE lists CASCADE")


def test_catalogue(spark):
    assert {r["campaign"]: r["file_part"] for r in cat.campaign_dim(spark).collect()} == {
        c.id: c.file_part for c in cat.WEEK}


def test_lists_need_adaptive_execution(spark, tables):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        with pytest.raises(ValueError, match="skewJoin"):
            weekly_lists(tables, PARAMS)
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")

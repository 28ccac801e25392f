import datetime as dt
import uuid
from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter

from callsheet.sinks.chunks import chunked
from callsheet.sinks.csv import export_lists, to_text, write_csv, write_lists
from callsheet.sinks.files import SharedFiles

SCHEMA = "nome string, `descrição` string, valor decimal(12,2), dia date, at timestamp_ntz, n bigint"
AT = dt.datetime(2024, 2, 15, 10, 0, 0)
ROWS = [
    ("a;b", 'say "hi"', Decimal("1234.50"), dt.date(2024, 2, 15), AT, 1),
    (None, "", None, None, None, None),
    (" lead", "trail ", Decimal("0.00"), None, AT.replace(microsecond=120000), -1),
    ("back\\slash", "ação", None, None, None, 2),
    ('"', "'", None, None, None, 3),
    ("tab\there", "#hash", None, None, None, 4),
]


LINES = [
    'nome;descrição;valor;dia;at;n',
    '"a;b";"say ""hi""";1234.50;2024-02-15;2024-02-15 10:00:00;1',
    ';;;;;',
    ' lead;trail ;0.00;;2024-02-15 10:00:00.120000;-1',
    'back\\slash;ação;;;;2',
    '"""";\';;;;3',
    'tab\there;#hash;;;;4',
]


def parts(path):
    return [p.read_bytes() for p in sorted(Path(path).rglob("part-*"))]


def test_bytes_are_those_of_a_plain_csv_writer(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    write_csv(df, str(tmp_path / "one"), files=1)
    (written,) = parts(tmp_path / "one")
    header, *lines, rest = written.decode("utf-8").split("\r\n")
    assert header == "\ufeff" + LINES[0] and rest == ""
    assert sorted(lines) == sorted(LINES[1:])


def test_line_breaks_stay(spark, tmp_path):
    df = spark.createDataFrame([("a\nb\r\nc\rd", 1)], "x string, y int").coalesce(1)
    write_csv(df, str(tmp_path / "x"))
    assert parts(tmp_path / "x") == [b'\xef\xbb\xbfx;y\r\n"a\nb\r\nc\rd";1\r\n']


def test_a_lone_empty_value_is_a_line(spark, tmp_path):
    df = spark.createDataFrame([("",), (None,)], "x string").coalesce(1)
    write_csv(df, str(tmp_path / "x"))
    assert parts(tmp_path / "x") == [b'\xef\xbb\xbfx\r\n""\r\n""\r\n']


def test_no_rows_no_file(spark, tmp_path):
    write_csv(spark.createDataFrame([], "x string"), str(tmp_path / "x"))
    assert [f for f in parts(tmp_path / "x") if f] == []


def test_files_split_by_rows_are_complete(spark, tmp_path):
    df = spark.range(10).selectExpr("id AS n", "'é' AS t").coalesce(1)
    write_csv(df, str(tmp_path / "split"), rows_per_file=4)
    files = parts(tmp_path / "split")
    assert sorted(f.count(b"\r\n") for f in files) == [3, 5, 5]
    assert all(f.startswith(b"\xef\xbb\xbfn;t\r\n") for f in files)


def test_many_lists_in_one_job(spark, tmp_path):
    df = spark.createDataFrame([("a", 517, 1), ("a", 518, 2), ("b", 517, 3)], "campaign string, cod_cli int, n int")
    write_lists(df, str(tmp_path / "all"), by=["campaign", "cod_cli"])
    files = {str(p.parent.relative_to(tmp_path / "all")): p.read_bytes() for p in (tmp_path / "all").rglob("part-*")}
    assert files == {
        "campaign=a/cod_cli=517": b"\xef\xbb\xbfn\r\n1\r\n",
        "campaign=a/cod_cli=518": b"\xef\xbb\xbfn\r\n2\r\n",
        "campaign=b/cod_cli=517": b"\xef\xbb\xbfn\r\n3\r\n",
    }


def test_to_text(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted(tuple(r) for r in to_text(df).collect())
    assert got == sorted(tuple("" if v is None else str(v) for v in row) for row in ROWS)


WEEKLY = "campaign string, cod_cli int, cod_cad int"


def test_weekly_rows_go_to_files_named_after_their_lists(spark, tmp_path):
    df = spark.createDataFrame([("geral", 517, 1), ("geral", 518, 2), ("ter_cpc", 517, 3)], WEEKLY)
    names = export_lists(df, str(tmp_path / "out"), dt.datetime(2025, 1, 1, 10, 15), labels=["Bradesco IV"])
    files = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert files == {
        "AutosPF_Geral_BradescoIV_20250101_101500.csv": b"\xef\xbb\xbfcod_cad\r\n1\r\n",
        "DivZeroPF_Geral_BradescoIV_20250101_101500.csv": b"\xef\xbb\xbfcod_cad\r\n2\r\n",
        "AutosPF_CPC_BradescoIV_20250101_101500.csv": b"\xef\xbb\xbfcod_cad\r\n3\r\n",
    }
    assert names == sorted(f.removesuffix(".csv") for f in files)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_list_of_several_files_has_a_manifest(spark, tmp_path):
    df = spark.range(25).selectExpr("'geral' AS campaign", "517 AS cod_cli", "id AS cod_cad").repartition(4)
    (name,) = export_lists(df, str(tmp_path / "out"), AT, rows_per_file=10)
    listed = (tmp_path / "out" / f"{name}.manifest").read_text().split()
    assert listed == [f"{name}.{k}.csv" for k in (1, 2, 3)]
    texts = [(tmp_path / "out" / file).read_bytes().split(b"\r\n") for file in listed]
    assert all(t[0] == b"\xef\xbb\xbfcod_cad" and t[-1] == b"" for t in texts)
    assert sorted(int(x) for t in texts for x in t[1:-1]) == list(range(25))
    assert sorted(len(t) - 2 for t in texts) == [5, 10, 10]


def test_a_failed_run_leaves_no_file(spark, tmp_path):
    df = spark.range(4).selectExpr("'geral' AS campaign", "517 AS cod_cli", "raise_error('no') AS x")
    with pytest.raises(Exception, match="no"):
        export_lists(df, str(tmp_path / "out"), AT)
    assert list(tmp_path.rglob("*")) == []
    # Names that exist stay as they are, and none of the run's other lists appears.
    taken = tmp_path / "out" / "AutosPF_Geral_20240215_100000.csv"
    taken.parent.mkdir()
    taken.write_text("mine")
    df = spark.createDataFrame([("geral", 517, 1), ("geral", 518, 2)], WEEKLY)
    with pytest.raises(FileExistsError, match=taken.name):
        export_lists(df, str(tmp_path / "out"), AT)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == [taken] and taken.read_text() == "mine"


def test_moves_are_undone_if_one_fails(spark, tmp_path, monkeypatch):
    for name in ("a", "b"):
        (tmp_path / "in" / f"x={name}").mkdir(parents=True)
        (tmp_path / "in" / f"x={name}" / "part-0").write_text(name)
        (tmp_path / "in" / f"x={name}" / "part-1").write_text(name)
    store = SharedFiles(spark)
    monkeypatch.setattr(store, "write", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        store.publish(str(tmp_path / "in"), "x", str(tmp_path / "out"), ".csv")
    assert [p for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == []


def test_files_of_one_list(spark, tmp_path):
    df = spark.range(10).repartition(3)
    for files, sizes in ((1, [10]), (4, [1, 3, 3, 3]), (20, [1] * 10)):
        write_csv(df, str(tmp_path / f"n{files}"), files=files)
        assert sorted(f.count(b"\r\n") - 1 for f in parts(tmp_path / f"n{files}")) == sizes


def test_no_python_and_no_text_of_a_file_in_memory(spark, tmp_path, monkeypatch):
    plans = []
    text = DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **k: (
        plans.append(self._df._jdf.queryExecution().executedPlan().toString()), text(self, *a, **k))[1])
    write_csv(spark.range(10), str(tmp_path / "x"))
    assert len(plans) == 1 and not any(w in plans[0] for w in ("Python", "Arrow", "collect_list"))


def numbered(df, tmp_path, **options):
    return chunked(df, options.pop("by", ["k"]), str(tmp_path / uuid.uuid4().hex), **options)


def test_numbers_are_contiguous_in_every_list(spark, tmp_path):
    rows = [(n % 3 if n % 7 else None, n * 37 % 1000, "x" * (n % 5)) for n in range(1000)] + [(1, 5, "same")] * 50
    df = spark.createDataFrame(rows, "k int, v int, t string").repartition(6)
    got = numbered(df, tmp_path, order=["v", "t"], rows=64).collect()
    want, order = [], lambda r: (r[1], r[2])
    for k in (None, 0, 1, 2):
        mine = sorted((r for r in rows if r[0] == k), key=order)
        want += [(*r, n, (n - 1) // 64, (n - 1) // 64 * 64 + 1, 64) for n, r in enumerate(mine, 1)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_a_hot_list_is_numbered_by_many_tasks(spark, tmp_path):
    df = spark.range(0, 20_000, 1, 16).selectExpr("1 AS k", "id AS v")
    folder = str(tmp_path / "rows")
    # Small partitions would be merged here.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chunked(df, ["k"], folder, rows=5000, order=["v"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got.where("row_no <> v + 1").count() == 0
    assert {r["chunk_no"]: r["count"] for r in got.groupBy("chunk_no").count().collect()} == dict.fromkeys(range(4), 5000)
    tasks = spark.read.parquet(folder).groupBy("_task").count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 8000
    # The only windows run over a row per list and task.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "Python" not in plan


def test_no_rows_no_numbers(spark, tmp_path):
    assert numbered(spark.range(0).selectExpr("1 AS k", "id"), tmp_path, order=["id"]).collect() == []
    assert numbered(spark.range(5), tmp_path, by=[]).selectExpr("max(row_no)", "count(*)").first()[:] == (5, 5)

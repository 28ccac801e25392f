"""Side-by-side run of queries and their SQL twins."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

STAR = """region nation customer supplier part orders lineitem events documents embeddings
    pages benchmark labels conversations""".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in STAR:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def table(columns: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    """Rows as a multiset, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(str(r[i]) for i in order) for r in rows)


def spark_table(df) -> tuple[list[str], Counter]:
    return table(df.columns, [tuple(row) for row in df.collect()])


def duck_table(connection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    return table([d[0] for d in cursor.description], cursor.fetchall())


def main() -> int:
    from callsheet.session import session_builder
    from testbed.oracle import oracle_sql
    from testbed.queries import queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:]
    spark = (
        session_builder("compare")
        .master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    twins = oracle_sql()
    failed = 0
    for name, run in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.perf_counter()
        got_columns, got = spark_table(run(spark, sf_dir))
        seconds = time.perf_counter() - start
        want_columns, want = duck_table(connection, twins[name])
        same = got_columns == want_columns and got == want
        failed += not same
        print(f"{'ok  ' if same else 'FAIL'} {name:32} {sum(got.values()):8} {seconds:6.2f}s", flush=True)
        if not same:
            print("   columns", got_columns, want_columns)
            print("   only here", list((got - want).items())[:2])
            print("   only there", list((want - got).items())[:2])
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())

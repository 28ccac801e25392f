"""Readers for the eight input tables.

Every reader is lazy: Spark sends filters and column lists down to the files or
the database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callsheet.schemas import SCHEMAS, conform


def load(
    spark: SparkSession, source: str, jdbc: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """All tables from ``source``.

    That is a folder with a Parquet folder per table, ``catalog:database`` or the
    ``jdbc:`` URL of a database, whose user, password and driver are in ``jdbc``.
    """
    if source.startswith("jdbc:"):
        return load_jdbc(spark, source, jdbc or {})
    if source.startswith("catalog:"):
        database = source.removeprefix("catalog:")
        return {t: conform(spark.table(f"{database}.{t}"), t) for t in SCHEMAS}
    return {t: conform(spark.read.parquet(f"{source.rstrip('/')}/{t}"), t) for t in SCHEMAS}


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables as Parquet for :func:`load`.

    Tables with a portfolio code are partitioned by it, so that a run for one
    portfolio reads only its share. Events are laid out by time, so that a look at
    the last days skips the older files by their statistics.
    """
    for name, df in tables.items():
        if name == "hist_tb":
            df = df.repartitionByRange("data_at").sortWithinPartitions("data_at")
        writer = df.write.mode("errorifexists")
        if name != "hist_tb" and "cod_cli" in df.columns:
            writer = writer.partitionBy("cod_cli")
        writer.parquet(f"{path.rstrip('/')}/{name}")


#: Columns a JDBC read splits by number or time ranges. Events split by time, which also
#: splits the events of one account.
JDBC_RANGES = {
    "cadastros_tb": "cod_cad",
    "fones_tb": "cod_cad",
    "hist_tb": "data_at",
    "acordos_tb": "cod_aco",
}
#: Indexed text columns that the other tables are split by.
JDBC_TEXT_RANGES = {"rec_comp_tb": "nmcont", "receber_tb": "nmcont", "bens_tb": "nmcont"}


def text_bounds(table: str, column: str, parts: int) -> str:
    """Query for the first value of each of ``parts`` equal shares; an index serves it.

    ``share`` rises with the values as the database orders them, whatever its collation;
    values that it takes for equal give one row.
    """
    shares = f"SELECT {column} AS low, NTILE({parts}) OVER (ORDER BY {column}) AS share FROM {table}"
    firsts = f"SELECT share, MIN(low) AS low FROM ({shares} WHERE {column} IS NOT NULL) s GROUP BY share"
    return f"(SELECT MIN(share) AS share, low FROM ({firsts}) f GROUP BY low) b"


def text_literal(value: str, backslash_escapes: bool) -> str:
    """The value as SQL text; some databases take a backslash in it for an escape."""
    value = value.replace("'", "''")
    return "'" + (value.replace("\\", "\\\\") if backslash_escapes else value) + "'"


def text_predicates(column: str, bounds: list[str], backslash_escapes: bool = False) -> list[str]:
    """WHERE clauses that cover a table in disjoint ranges between ``bounds``, NULL included.

    ``bounds`` come in the order of the database, which also judges the clauses. Each
    value is then below the first bound, or at or above a last one and below the next;
    between bounds that the database takes for equal there is nothing. So every row is
    read once under any collation.
    """
    lows = [text_literal(b, backslash_escapes) for b in bounds[1:]]
    if not lows:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(lows, lows[1:])]
    return [f"{column} < {lows[0]} OR {column} IS NULL", *inner, f"{column} >= {lows[-1]}"]


#: Databases whose text literals take a backslash for an escape.
BACKSLASH_ESCAPES = ("jdbc:mysql:", "jdbc:mariadb:")


def range_options(column: str, low: object, high: object, parts: int) -> dict[str, str]:
    """Options of a JDBC read by ranges; rows outside the bounds are read as well."""
    return {
        "partitionColumn": column,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(parts),
    }


def jdbc_options(name: str, options: dict[str, str], fetch_size: int) -> dict[str, str]:
    """Options of every read of a table.

    The columns come with our types, so nothing is cast after the scan and filters reach
    the database. A DATETIME is read as it stands, without a time zone.
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[name])
    return {
        **options,
        "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true",
        "customSchema": columns,
    }


def load_jdbc(
    spark: SparkSession,
    url: str,
    options: dict[str, str],
    parts: int = 64,
    fetch_size: int = 5000,
) -> dict[str, DataFrame]:
    """All tables from a database, each in ``parts`` ranges of a key.

    ``options`` carries user, password and driver; keep them in the cluster's secret
    store. The database works out the bounds, with one query for each table.
    """

    def ask(query: str) -> list:
        return spark.read.format("jdbc").options(url=url, dbtable=query, **options).load().collect()

    tables = {}
    for name in SCHEMAS:
        reading = jdbc_options(name, options, fetch_size)
        if name in JDBC_RANGES:
            column = JDBC_RANGES[name]
            (row,) = ask(f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {name}) b")
            ranges = range_options(column, row["low"], row["high"], parts) if row["low"] is not None else {}
            df = spark.read.format("jdbc").options(url=url, dbtable=name, **reading, **ranges).load()
        elif name in JDBC_TEXT_RANGES:
            column = JDBC_TEXT_RANGES[name]
            shares = ask(text_bounds(name, column, parts))  # a row per share at most
            bounds = [row["low"] for row in sorted(shares, key=lambda row: row["share"])]
            clauses = text_predicates(column, bounds, url.startswith(BACKSLASH_ESCAPES))
            df = spark.read.jdbc(url, name, predicates=clauses, properties=reading)
        else:
            df = spark.read.format("jdbc").options(url=url, dbtable=name, **reading).load()
        tables[name] = conform(df, name)
    return tables

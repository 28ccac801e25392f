"""CSV for the dialler."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet.sinks.chunks import chunked
from callsheet.sinks.files import SharedFiles
from callsheet.sinks.names import export_name

BOM = "\ufeff"
SEPARATOR = ";"
#: Rows of a file, if the caller does not say.
FILE_ROWS = 1_000_000


def _text(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        # Six digits of fraction, or none.
        fraction = F.date_format(value, ".SSSSSS")
        text = F.concat(
            F.date_format(value, "yyyy-MM-dd HH:mm:ss"),
            F.when(fraction != ".000000", fraction).otherwise(""),
        )
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def to_text(df: DataFrame) -> DataFrame:
    """Every value as text, NULL as ''."""
    return df.select([_text(field).alias(field.name) for field in df.schema])


def _quoted(value: Column) -> Column:
    """The value in quotes if it has a separator, quote or line break, else as it is."""
    return F.when(
        value.rlike(f'[{SEPARATOR}"\r\n]'),
        F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"')),
    ).otherwise(value)


def to_lines(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ``by`` columns and ``line``, the other columns as a line of the dialler's CSV."""
    fields = [_quoted(_text(f)) for f in df.schema if f.name not in by]
    line = F.concat_ws(SEPARATOR, *fields)
    # A lone empty field has to show that there is a line.
    return df.select(*by, (F.when(line == "", '""').otherwise(line) if len(fields) == 1 else line).alias("line"))


def _header(df: DataFrame, by: Sequence[str]) -> str:
    names = [f.name for f in df.schema if f.name not in by]
    marks = (SEPARATOR, '"', "\r", "\n")
    quoted = ['"' + n.replace('"', '""') + '"' if any(m in n for m in marks) else n for n in names]
    return BOM + SEPARATOR.join(quoted)


def _write(
    df: DataFrame, path: str, by: list[str], rows_per_file: int | None, files: int | None = None
) -> None:
    """Write the lists of the ``by`` columns, a header before the first line of each file.

    The lines are put down beside ``path`` first, which numbers them. A file's rows come
    to one task in the order of their numbers, and the task's writer starts a new file
    after each full one. Spark's text writer takes the lines as they are; its CSV
    writer would change line breaks inside values.
    """
    header = _header(df, by)
    store = SharedFiles(df.sparkSession)
    with store.beside(path) as staging:
        lines = chunked(to_lines(df, by), by, f"{staging}/lines", rows_per_file or FILE_ROWS, files)
        first = F.col("row_no") == F.col("first_row")
        texts = F.explode(F.when(first, F.array(F.lit(header), "line")).otherwise(F.array("line")))
        ready = (
            lines.repartition(*by, "chunk_no")
            .sortWithinPartitions(*by, "row_no")
            .select(*by, texts.alias("line"))
        )
        most = rows_per_file or FILE_ROWS
        if files:
            most = lines.agg(F.max("rows")).first()[0] or 1
        # All files of a list but its last one are full.
        writer = ready.write.option("lineSep", "\r\n").option("maxRecordsPerFile", most + 1)
        (writer.partitionBy(*by) if by else writer).text(path)


def write_csv(
    df: DataFrame, path: str, rows_per_file: int | None = None, files: int | None = None
) -> None:
    """Write one list: ';', CRLF, quotes where needed, UTF-8 with BOM and header in each file.

    A file has ``rows_per_file`` rows, FILE_ROWS by default, and the last one what is
    left. ``files`` asks for that many files instead, or fewer for a list of fewer rows;
    use 1 only for a list that a single dialler upload can take. A list without rows has
    no file.
    """
    _write(df, path, [], rows_per_file, files)


def write_lists(df: DataFrame, path: str, by: list[str], rows_per_file: int | None = None) -> None:
    """Write many lists in one job, one folder per value of the ``by`` columns.

    A small list becomes one file, a big one is split over many tasks.
    """
    _write(df, path, by, rows_per_file)


def export_lists(
    lists: DataFrame,
    path: str,
    at: dt.datetime,
    labels: Sequence[str] = (),
    rows_per_file: int | None = None,
) -> list[str]:
    """Write the rows of a weekly run, each list in a file of its export name.

    The files are written aside and moved to ``path`` once all of them are whole, so a
    failed run leaves no file there. A list of more rows than a file takes has several,
    ``name.1.csv`` and so on, which ``name.manifest`` lists. Names that exist already
    are an error. Returns the names of the lists.
    """
    chosen = F.array(*[F.lit(label) for label in labels]).cast("array<string>")
    stamp = F.lit(f"{at:%Y-%m-%d %H:%M:%S}").cast("timestamp_ntz")
    name = export_name(F.col("cod_cli"), F.col("campaign"), chosen, stamp)
    named = lists.withColumn("file_name", name).drop("campaign", "cod_cli")
    store = SharedFiles(lists.sparkSession)
    with store.beside(path) as aside:
        write_lists(named, f"{aside}/lists", ["file_name"], rows_per_file)
        return store.publish(f"{aside}/lists", "file_name", path, ".csv")

"""Rows in numbered chunks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a reader takes at a time.
CHUNK_ROWS = 5000


def chunked(
    df: DataFrame,
    by: Sequence[str],
    folder: str,
    rows: int = CHUNK_ROWS,
    chunks: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """The rows with `row_no` from 1 in each list of ``by``, `chunk_no` from 0, and the chunk's
    `first_row` and `rows` at most.

    Numbers follow ``order``, nulls first, and are contiguous, however many tasks hold a
    list: the rows are written to ``folder``, which must be new and shared, with their
    place in the task that wrote them. A sum over the tasks, of a row each per list, gives
    the number before a task's first row. Rows that are equal in ``order``, or all without
    one, are in any order. With ``chunks`` a list has that many, or fewer if it has
    fewer rows, each of equal size but for the last. A list may be the null one.
    """
    laid = df.repartitionByRange(*by, *order) if order else df
    keys = [*by, *order]
    placed = (laid.sortWithinPartitions(*keys) if keys else laid).select(
        "*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_place")
    )
    placed.write.parquet(folder)
    stored = df.sparkSession.read.schema(placed.schema).parquet(folder)
    # A list stands together in a task, so its places there are contiguous.
    counts = stored.groupBy(*by, "_task").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = counts.select(
        *[F.col(c).alias(f"_of_{c}") for c in by],
        F.col("_task").alias("_of_task"),
        "_first",
        F.sum("_n").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.sum("_n").over(whole).alias("_all"),
    )
    same = [F.col("_task") == F.col("_of_task"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]]
    size = F.ceil(F.col("_all") / F.lit(chunks)) if chunks else F.lit(rows)
    number = F.col("_place") - F.col("_first") + F.coalesce("_before", F.lit(0)) + 1
    return (
        stored.join(before, reduce(and_, same))
        .select(*df.columns, number.alias("row_no"), size.cast("long").alias("rows"))
        .withColumn("chunk_no", F.expr("(row_no - 1) div rows"))
        .select(*df.columns, "row_no", "chunk_no", (F.col("chunk_no") * F.col("rows") + 1).alias("first_row"), "rows")
    )

"""Row numbers for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame,
    key: Sequence[str],
    buckets: Sequence[tuple[Column, bool]],
    order: Sequence[Column],
    name: str,
) -> DataFrame:
    """Adds ``name``, the row's number in its key by ``order``.

    A key may hold very many rows. They are numbered within buckets of the key, and the
    rows of the buckets before are added, so no task needs all rows of a key. ``buckets``
    are values that never go against ``order``, with whether they descend; nulls come
    first, or last if they descend. There must be few buckets in a key.

    All keys together may have nearly as many buckets as rows, and Spark's estimate of
    them, which rests on the size of the files, can be far too small. So the join sorts
    both sides and broadcasts neither.
    """
    parts = [f"_bucket{i}" for i in range(len(buckets))]
    rows = df.select("*", *[value.alias(p) for p, (value, _) in zip(parts, buckets)])
    in_bucket = Window.partitionBy(*key, *parts).orderBy(*order)
    by_bucket = [
        F.col(p).desc_nulls_last() if descends else F.col(p).asc_nulls_first()
        for p, (_, descends) in zip(parts, buckets)
    ]
    earlier = Window.partitionBy(*key).orderBy(*by_bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(*key, *parts)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(*[F.col(c).alias(f"_of_{c}") for c in (*key, *parts)], "_before")
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*key, *parts)])
    numbered = rows.withColumn("_in_bucket", F.row_number().over(in_bucket))
    return numbered.join(before.hint("merge"), same).select(
        *df.columns, (F.col("_in_bucket") + F.col("_before")).cast("int").alias(name)
    )

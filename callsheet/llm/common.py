"""Helpers that several operators share: stored steps, clash-free columns, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of texts in an Arrow batch.
BATCH_ROWS = 512
#: Bytes of an Arrow batch, but for a row that is larger.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or "cluster" in context.master:
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder of its own below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder that `new_folder` has named, with all its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder; survives lost executors.

    Use it for narrow rows: they are read more than once and must not change between
    reads.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_small_batches(df: DataFrame) -> DataFrame:
    """The same rows, in a session that sends few of them to a Python worker at a time.

    Spark's defaults of 10,000 rows and 64 MB a batch are meant for narrow rows. Texts
    have any length, so the session's settings are lowered to BATCH_ROWS and BATCH_BYTES;
    one that has been set to another number already stays.
    """
    conf, names = df.sparkSession.conf, "spark.sql.execution.arrow."
    if conf.get(names + "maxRecordsPerBatch") == "10000":
        conf.set(names + "maxRecordsPerBatch", str(BATCH_ROWS))
    if conf.get(names + "maxBytesPerBatch").lower() == "67108864b":
        conf.set(names + "maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shipped(spark: SparkSession, value: Any, keep: bool = True) -> Callable[[], Any]:
    """Broadcasts a value of a size that the caller has bounded; tasks call the result for it.

    The value may be of a class of this package, which the executors need not have. A
    task makes it once, or with `keep` off for every call.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list[Any] = []

    def get() -> Any:
        if not keep:
            return cloudpickle.loads(sent.value)
        if not held:
            held.append(cloudpickle.loads(sent.value))
        return held[0]

    return get


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links between ids of any orderable type.

    Returns `node`, `root` for every id that has a link to another id; `root` is the
    smallest id of the component. Links may repeat, point either way or to
    themselves; rows with a null end are no links.

    Each round gives every node's larger neighbours, then every node, the smallest
    neighbour as their new partner (large star, small star). Trees flatten in a
    number of rounds that grows with the logarithm of the longest chain. Every step
    is an aggregation that combines on the map side or an equi-join. The aggregated
    side is stored, so that both sides are shuffled for the join alone and adaptive
    execution can split a node with very many links. Rounds end with a checkpoint, so
    the lineage stays short.
    """
    edges = stored(
        links.select(
            F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
        )
        .where(F.col("u") > F.col("v"))
        .distinct()
    )
    state = _signature(edges)
    while state[0]:
        edges = stored(_small_star(_large_star(edges)))
        after = _signature(edges)
        if after == state:
            break
        state = after
    smallest = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(smallest)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours get its smallest neighbour (or itself)."""
    lowest = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    # A node without a smaller neighbour is its own minimum: its links stay as they are.
    return (
        edges.select(F.col("v").alias("c"), F.col("u").alias("larger"))
        .join(lowest.withColumnRenamed("u", "c"), "c", "left")
        .select(F.col("larger").alias("u"), F.coalesce("m", "c").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours get the smallest of them."""
    lowest = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    return (
        edges.join(lowest, "u")
        .where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(lowest.withColumnRenamed("m", "v"))
        .distinct()
    )

"""Session defaults for jobs and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What hot contracts and many small lists rely on.
_ADAPTIVE = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")


def require_adaptive(spark: SparkSession) -> None:
    """Fails in a session without the adaptive execution that splits hot contracts."""
    off = [name for name in _ADAPTIVE if spark.conf.get(name).lower() != "true"]
    if off:
        raise ValueError(f"turn on {', '.join(off)}: hot contracts and list files need it")


def session_builder(name: str = "callsheet") -> SparkSession.Builder:
    """Builder with the settings the plans rely on.

    Adaptive execution does three things here: it merges small shuffle
    partitions, turns a join into a broadcast join once a side has proved small,
    and splits the hot partition of the account-to-contract join. Master, memory
    and shuffle partitions stay with the caller or the cluster.
    """
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Every scan names its portfolios already. Measured: pruning them again at run time
        # puts 15 more scans of the receivables into the plan of the weekly lists.
        .config("spark.sql.optimizer.dynamicPartitionPruning.enabled", "false")
        # A run for some portfolios or labels drops events and phones of other accounts by a
        # Bloom filter of its accounts, of 8 MB at most, before it shuffles them. Spark's own
        # limits ask for less than 10 MB of accounts and more than 10 GB of events.
        .config("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
        .config("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "2GB")
        .config("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1GB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Recording the Python call site of every column takes longer than making it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )

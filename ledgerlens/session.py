"""Session helpers.

The library never creates a cluster session on its own; callers pass one in.
``local_session`` is for tests and the bench only.  ``checkpoint_dir`` reads the
shared folder the cluster names in ``spark.checkpoint.dir`` and raises when the
setting is absent.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every ledgerlens job relies on.  UTC keeps TIMESTAMPTZ semantics
# ("always UTC") and makes date/month derivations deterministic; AQE coalesces
# small shuffles, splits skewed join partitions and turns joins whose runtime
# side is small into broadcasts.  Arrow batches of 2,000 rows keep a batch of
# long texts small in a Python worker.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


MB = 1 << 20


def sizing_conf(input_bytes: int, total_cores: int, shuffled_share: float = 0.1,
                partition_bytes: int = 256 * MB, split_bytes: int = 1024 * MB) -> dict[str, str]:
    """Shuffle and scan sizing for a job that reads ``input_bytes`` on a
    cluster with ``total_cores`` task slots.

    Shuffle partitions follow the bytes that are shuffled, not those read:
    ``input_bytes * shuffled_share / partition_bytes``, at least three tasks
    per core.  The widest shuffle here (dedupe, the unique-id test) carries a
    few of the columns, about a tenth of the input.  Scan splits are larger
    than shuffle partitions: map tasks times reduce partitions is the number
    of shuffle blocks, and a column-pruned split holds far less than its size.
    AQE coalesces small stages and splits skewed join partitions.

    Example: 100 TB on 8,000 cores gives about 93,000 scan splits and 37,000
    shuffle partitions of 256 MB."""
    partitions = max(3 * int(total_cores), -(-int(input_bytes * shuffled_share) // int(partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{int(partition_bytes) // MB}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{2 * int(partition_bytes) // MB}m",
        "spark.sql.files.maxPartitionBytes": f"{int(split_bytes) // MB}m",
    }


def configure(spark: SparkSession, input_bytes: int | None = None,
              total_cores: int | None = None) -> SparkSession:
    """Apply the runtime settings ledgerlens depends on to an existing session.

    With ``input_bytes`` (and optionally ``total_cores``; default: the
    session's default parallelism) the shuffle and scan sizing of
    :func:`sizing_conf` is applied as well.  Without it partition counts are
    left as the cluster configured them."""
    for key, value in JOB_CONF.items():
        spark.conf.set(key, value)
    if input_bytes is not None:
        cores = total_cores or spark.sparkContext.defaultParallelism
        for key, value in sizing_conf(input_bytes, cores).items():
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ledgerlens") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stored intermediates: the one the
    cluster names in ``spark.checkpoint.dir`` (or a caller set with
    ``SparkContext.setCheckpointDir``).  Raises when there is none: a folder
    picked here would be local to the driver, and executors could not see it.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()

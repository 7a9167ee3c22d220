"""Table scans (SRC-2).

Reads are lazy and declarative, so Catalyst prunes columns and pushes filters
into the parquet scan; nothing here triggers a job.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_parquet_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """One table stored as ``{base_dir}/{name}.parquet`` (file or folder)."""
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


# Options that make a JDBC scan parallel.
JDBC_PARALLEL = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def read_table(spark: SparkSession, name: str, base_dir: str | None = None,
               fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """Warehouse table scan.

    With ``base_dir`` the table is a file-based dataset; otherwise ``name`` is a
    catalog table (``spark.table``).  ``fmt='jdbc'`` reads through JDBC with the
    given options (``url``, ``dbtable``, and the partitioning options, which are
    required: without them one task would read the whole table).
    """
    if fmt == "jdbc":
        missing = [o for o in JDBC_PARALLEL if o not in (options or {})]
        if missing:
            raise ValueError(f"a JDBC scan without {', '.join(missing)} reads through one task")
        return spark.read.format("jdbc").options(**(options or {})).load()
    if base_dir is None:
        return spark.table(name)
    return spark.read.options(**(options or {})).format(fmt).load(os.path.join(base_dir, f"{name}.{fmt}"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_dir

MB = 1 << 20

#: The six white-space characters of the contracts (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read
    back: cuts lineage, survives lost executors, and carries file statistics."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/ledgerlens-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes on the shared folder of a :func:`stored` table (file listing, no job)."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
    fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(path).getLength())


def small_side(df: DataFrame, max_bytes: int = 32 * MB) -> DataFrame:
    """A :func:`stored` table with a broadcast hint if its files are within
    ``max_bytes``; beyond that the planner's own (shuffled, skew-split) join."""
    return F.broadcast(df) if stored_bytes(df) <= max_bytes else df


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until ``df`` has no such column (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: inside a lambda a plain
    expression would be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_of(modulus: int, column: str = "doc_id") -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id has remainder -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1))


def labelled_rows(labels: DataFrame, target: str, modulus: int, held_out: int) -> DataFrame:
    """Every (doc_id, label) training row.

    Rows in fold ``held_out``, null ids and null labels are left out; a document
    labelled more than once gets the rounded mean of its labels."""
    return (labels.select(F.col("doc_id"), F.col(target).cast("double").alias("y"))
            .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold_of(modulus) != held_out))
            .groupBy("doc_id").agg(F.when(F.avg("y") >= 0.5, 1).otherwise(0).alias("label")))


def labelled_sample(labels: DataFrame, target: str, modulus: int, held_out: int,
                    max_per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """:func:`labelled_rows`, at most about ``max_per_class`` of each class
    (chosen by a hash of the id), and the share of each class taken."""
    rows = labelled_rows(labels, target, modulus, held_out)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    shares = {c: min(1.0, max_per_class / n) for c, n in counts.items()}
    pick = F.lit(False)
    for label, share in shares.items():
        pick = pick | ((F.col("label") == label)
                       & (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    return rows.where(pick), shares

"""Dimension joins (JON-5) and the bound for computed key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest stored parent table (bytes, from its file statistics) whose computed
# subsets are shipped whole to every task.
PARENT_MAX_BYTES = 32 << 20


def subset_side(keys: DataFrame, parent: DataFrame, max_bytes: int = PARENT_MAX_BYTES) -> DataFrame:
    """``keys``, a subset of the rows of the stored table ``parent``, hinted for
    broadcast when the parent's file statistics are within ``max_bytes``.

    The planner cannot size a computed key set, but a subset is no larger than
    its parent.  The statistics come from the file listing; no job runs.
    Beyond the bound the join is the planner's own."""
    size = int(parent._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(keys) if size <= max_bytes else keys


def attach_customer(tx: DataFrame, customers: DataFrame, key: str = "customer_id",
                    attrs: tuple[str, ...] = ("province", "age_group", "account_type")) -> DataFrame:
    """JON-5: each transaction carries its customer's attributes.

    Inner join on the customer key (every transaction references a known
    customer).  The planner broadcasts a small dimension; a large one is
    shuffle-joined, and a customer owning a third of all transactions is
    handled by AQE's skew-join split."""
    return tx.join(customers.select(key, *attrs), key, "inner")

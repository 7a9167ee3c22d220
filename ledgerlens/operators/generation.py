"""Resumable insight generation (INS-4): every request is asked until it is answered, once.

Requests are known by a hash of their content.  A run asks only what the log at
``path`` has no answer to, slice by slice; each slice's answers and the insights
parsed from them are committed together, so an answer is never paid for twice
and no insight is stored twice.  What a lost task or a failed commit can cost is
one slice's questions.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits
from .insights import split_insights, store_columns

ANSWERS = "key string, org_id string, type string, response string, error string, attempts int"


def timed_call(call: Callable, batch: pd.DataFrame, seconds: float):
    """``call(batch)``, or TimeoutError after ``seconds``; a call that hangs is left behind."""
    box: queue.Queue = queue.Queue(1)

    def run():
        try:
            box.put((True, call(batch)))
        except BaseException as e:
            box.put((False, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        good, value = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds} s") from None
    if not good:
        raise value
    return value


def ask(requests: DataFrame, generator: Callable, attempts: int, seconds: float, batch_rows: int) -> DataFrame:
    """One row per request: its response, or the last error after ``attempts`` tries.
    A failed, slow or short answer counts for the ``batch_rows`` requests it was asked with."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), batch_rows):
                batch = whole.iloc[at:at + batch_rows].reset_index(drop=True)
                responses, error, tries = [None] * len(batch), None, 0
                while tries < attempts:
                    tries += 1
                    try:
                        out = timed_call(generator, batch.drop(columns="key"), seconds)
                        found = list(out["response"] if isinstance(out, pd.DataFrame) else out)
                        if len(found) != len(batch):
                            raise ValueError(f"{len(found)} responses to {len(batch)} requests")
                        responses, error = found, None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"key": batch["key"], "org_id": batch["org_id"], "type": batch["type"],
                                    "response": pd.Series(responses, dtype=object), "error": pd.Series([error] * len(batch), dtype=object),
                                    "attempts": pd.Series([tries] * len(batch), dtype="int32")})

    return requests.mapInPandas(run, ANSWERS)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The log: a row per asked request and run; unanswered ones have an error."""
    at = commits.snapshot(spark, path)
    if "answers" not in at.tables:
        return spark.createDataFrame([], ANSWERS)
    return commits.read_snapshot(spark, path, at, "answers", schema=ANSWERS)


def generate_resumable(requests: DataFrame, path: str, generator: Callable, attempts: int = 3, seconds: float = 30.0,
                       batch_rows: int = 8, slices: int = 8, created_at=None) -> dict[str, int]:
    """Ask every unanswered request of ``org_id, type, prompt, data, user_message``,
    log the answers and store the insights (tables ``answers`` and ``insights`` of
    the set at ``path``).  Returns how many were asked, answered and failed; the
    failed ones are asked again by the next run."""
    spark = requests.sparkSession
    keyed = requests.withColumn("key", F.sha2(F.to_json(F.struct("org_id", "type", "user_message")), 256)).dropDuplicates(["key"])
    asked = answered = 0
    for piece in range(slices):
        own = keyed.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == piece)
        while True:
            at = commits.snapshot(spark, path)
            done = answers(spark, path).where("response IS NOT NULL").select("key")
            left = own.join(done, "key", "left_anti").checkpoint()
            if left.isEmpty():
                break
            load = commits.Load(spark, path, {"answers": "append", "insights": "append"}, conflict="fail", base=at)
            try:
                ask(left, generator, attempts, seconds, batch_rows).write.parquet(load.folder("answers"))
                rows = spark.read.schema(ANSWERS).parquet(load.folder("answers"))
                good = rows.where("response IS NOT NULL")
                store_columns(split_insights(good.select("org_id", "type", "response")), created_at).write.parquet(load.folder("insights"))
                counts = rows.agg(F.count(F.lit(1)).alias("asked"), F.count("response").alias("answered")).first()
            except BaseException:
                load.abandon()
                raise
            try:
                load.commit()
            except commits.ConcurrentLoad:
                continue                                     # another run answered meanwhile: ask what it left
            asked, answered = asked + counts.asked, answered + counts.answered
            break
    return {"asked": asked, "answered": answered, "failed": asked - answered}

"""INS-4: a generator that fails and hangs is asked once per finished request."""

import os
import time

import pandas as pd
import pytest

from ledgerlens.operators import generation as G
from ledgerlens.sources import sinks as K


def test_two_runs_ask_each_finished_request_once(spark, scratch):
    path, calls, mood = (os.path.join(scratch, x) for x in ("log", "calls", "mood"))
    os.makedirs(calls)
    open(mood, "w").write("bad")

    def generator(batch: pd.DataFrame) -> list:
        bad = open(mood).read() == "bad"
        for org in batch["org_id"]:
            if bad and org == "3":
                time.sleep(60)                              # hangs
            if bad and org == "5":
                raise OSError("model gone")
        if bad and "7" in set(batch["org_id"]):
            return []                                       # too few answers
        for org in batch["org_id"]:
            open(os.path.join(calls, f"{org}-{time.time_ns()}"), "w").close()
        return ['{"title": "t%s", "content": "c", "confidence": 0.5}' % o if o != "1" else "not json" for o in batch["org_id"]]

    rows = [(str(i), "summary", "p", "d", f"message {i}") for i in range(10)]
    requests = spark.createDataFrame(rows + rows[:3], "org_id string, type string, prompt string, data string, user_message string")

    def run():
        return G.generate_resumable(requests, path, generator, attempts=2, seconds=2.0, batch_rows=1, slices=2)

    assert run() == {"asked": 10, "answered": 7, "failed": 3}
    errors = {r.org_id: (r.error, r.attempts) for r in G.answers(spark, path).where("response IS NULL").collect()}
    assert errors == {"3": ("TimeoutError: no answer within 2.0 s", 2), "5": ("OSError: model gone", 2),
                      "7": ("ValueError: 0 responses to 1 requests", 2)}
    open(mood, "w").write("good")
    assert run() == {"asked": 3, "answered": 3, "failed": 0}
    assert run() == {"asked": 0, "answered": 0, "failed": 0}
    assert sorted(n.split("-")[0] for n in os.listdir(calls)) == [str(i) for i in range(10)]
    stored = K.read_set(spark, path)["insights"].collect()
    assert sorted(r.title for r in stored) == [f"t{i}" for i in range(10) if i != 1]


def test_a_job_that_dies_stores_nothing(spark, scratch):
    path = os.path.join(scratch, "log")
    requests = spark.createDataFrame([("1", "summary", "p", "d", "m")], "org_id string, type string, prompt string, data string, user_message string")

    def generator(batch):
        return ['{"title": "t", "content": "c"}'] * len(batch)

    real = G.split_insights
    G.split_insights = lambda df: (_ for _ in ()).throw(RuntimeError("driver gone"))
    try:
        with pytest.raises(RuntimeError):
            G.generate_resumable(requests, path, generator, slices=1)
    finally:
        G.split_insights = real
    assert G.answers(spark, path).isEmpty()
    assert G.generate_resumable(requests, path, generator, slices=1) == {"asked": 1, "answered": 1, "failed": 0}
    assert K.read_set(spark, path)["insights"].count() == 1

"""The pipeline's models are fitted on every row, however many there are: the quality
classifier's logistic map on all training rows, the secret scan's forest on all settled findings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import quality_qda, secret_scan


def brute_logistic(z, y):
    """Ridge-regularised logistic fit by Newton steps over the whole arrays."""
    width = max(1.0, float(np.median(np.abs(z))))
    t, w = np.stack([np.clip(z / width, -30, 30), np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(t @ w, -30, 30)))
        h = (t * (p * (1 - p))[:, None]).T @ t + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, t.T @ (p - y) + 1e-2 * w), -2, 2)
    return max(w[0], 1e-6) / width, w[1]


@pytest.mark.parametrize("n", [1, 2, 5, 24_000, 24_001])
def test_the_logistic_map_is_fitted_on_every_row(spark, n):
    rng = np.random.default_rng(n)
    y = (rng.random(n) < 0.4).astype(float)
    z = rng.normal(size=n) * 5 + 4 * y - 2
    got = quality_qda.logistic(spark.createDataFrame(pd.DataFrame({"z": z, "y": y})).repartition(3), n)
    assert np.allclose(got, brute_logistic(z, y), rtol=1e-6, atol=1e-9)


def test_the_pipeline_classifier_calibrates_on_every_training_row(spark, scratch, monkeypatch):
    """Over 20,000 training rows: the model's map is that of all of them."""
    n = 31_000
    words = F.expr("transform(sequence(1, cast(3 + id % 17 as int)), k -> substr(sha2(concat(id, '-', k), 256), 1, 4))")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    labels = docs.select("doc_id", F.expr("cast((doc_id % 17 + xxhash64(doc_id) % 9) > 8 as int)").alias("quality"))
    labels.write.parquet(f"{scratch}/labels.parquet")
    made, fit = [], quality_qda.fit
    monkeypatch.setattr(quality_qda, "fit", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    corpus_pipeline.quality_classifier(spark, docs, scratch)
    (model,) = made
    rows = docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 <> 1").toPandas()
    assert len(rows) > 20_400
    z = model.log_ratio(np.array([quality_qda.statistics(t.encode()) for t in rows["text"]]))
    assert np.allclose([model.scale, model.offset], brute_logistic(z, rows["quality"].to_numpy(float)), rtol=1e-6)


def test_the_pipeline_forest_learns_from_every_settled_finding(spark, scratch, monkeypatch):
    n = 21_000
    core = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("my api_key is "), core, F.lit(" here")).alias("text"))
    made, train = [], secret_scan.train
    monkeypatch.setattr(secret_scan, "train", lambda f, **k: made.append((f, train(f, **k))) or made[-1][1])
    clean = corpus_pipeline.secret_scans(spark, docs, scratch)
    ((findings, forest),) = made
    cores = docs.select(F.split("text", " ")[3].alias("core"))
    own = findings.join(cores, "core")
    assert {r["label"]: r["n"] for r in own.groupBy("label").agg(F.countDistinct("core").alias("n")).collect()} == {1.0: n, 0.0: n}
    assert own.where("label = 1").agg(F.sum("weight")).first()[0] == n / 2      # about 10,000, at one power of two
    assert clean.where(F.contains("text", F.lit("<SECRET>"))).count() == n


def test_weights_and_partitions_of_the_forest(spark):
    """Findings without weights count 1 each; many partitions give the same forest every time."""
    trees = lambda *a, **k: [t.toDebugString.partition("\n")[2] for t in secret_scan.train(*a, trees=3, **k).trees]
    seed = secret_scan.seed_findings(spark)
    assert trees(seed) == trees(seed.withColumn("weight", F.lit(1.0)).repartition(5))
    assert trees(seed.repartition(2), part_rows=1_000) == trees(seed.repartition(7), part_rows=1_000)

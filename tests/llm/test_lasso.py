import numpy as np
from pyspark.ml.functions import array_to_vector

from sojourn.llm import quality


def test_a_fit_takes_few_jobs(spark):
    """Each job leaves broadcasts on the driver, and a gradient's steps would be a job each."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    context = spark.sparkContext
    context.setJobGroup("few-jobs", "fit")
    try:
        model = quality.fit(docs, labels)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert model.rules and len(context.statusTracker().getJobIdsForGroup("few-jobs")) < 120


def test_lasso_ends_at_the_least(spark):
    """At the optimum no gradient is beyond the penalty, and those of weights in use are the penalty."""
    rng = np.random.default_rng(3)
    x = (rng.random((400, 12)) < rng.random(12)).astype(float)
    x[:, 11] = x[:, 0]
    y = (rng.random(400) < 1 / (1 + np.exp(2.0 - 4 * x[:, 0] + 3 * x[:, 1]))).astype(float)
    rows = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y, strict=True)], "label double, features array<double>")
    data = rows.withColumn("features", array_to_vector("features"))
    weights, intercept = quality.lasso_logistic(data, y.mean())
    off = 1 / (1 + np.exp(-(x @ weights + intercept))) - y
    slope = x.T @ off / len(y)
    assert abs(off.mean()) < 1e-4 and (abs(slope) < quality.LASSO + 1e-4).all()
    used = abs(weights) > 0.01
    assert used.any() and np.allclose(slope[used], -quality.LASSO * np.sign(weights[used]), atol=1e-4)

import random

import numpy as np
import pytest
from duebook.operators import quantiles
from pyspark.sql import functions as F

SHARES = (0.0, 0.01, 0.25, 0.5, 0.95, 1.0)


@pytest.fixture
def apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart, as large ones would
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_against_numpy(apart):
    spark = apart
    rng = random.Random(4)
    hot = [7.0] * 2000 + [rng.lognormvariate(0, 9) for _ in range(2000)] + [-rng.random() for _ in range(1999)] + [None] * 50
    few = [float(rng.randint(-2, 2)) for _ in hot]
    rows = spark.createDataFrame(list(zip(hot, few)), "a double, b double").repartition(16)
    wanted = {f"{c}{k}": (F.col(c), q) for c in "ab" for k, q in enumerate(SHARES)}
    got = quantiles.exact(rows, wanted).collect()
    assert len(got) == 1
    for c, values in (("a", [x for x in hot if x is not None]), ("b", few)):
        assert [got[0][f"{c}{k}"] for k in range(len(SHARES))] == [pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12) for q in SHARES]
    counted = quantiles.counted_ranges(rows, {"a": F.col("a")})
    assert counted.filter("value = 7").first().n == 2000
    edges = [(r.low, r.high) for r in counted.groupBy("part").agg(F.min("value").alias("low"), F.max("value").alias("high")).orderBy("low").collect()]
    assert len(edges) > 1 and all(a[1] < b[0] for a, b in zip(edges, edges[1:]))


def test_quantiles_of_nothing_and_of_one_value(spark):
    rows = spark.createDataFrame([(1.5, None), (None, None)], "a double, b double")
    assert [tuple(r) for r in quantiles.exact(rows, {"x": (F.col("a"), 0.5), "y": (F.col("b"), 0.5), "z": (F.col("a") * 2, 1.0)}).collect()] == [(1.5, None, 3.0)]
    assert [tuple(r) for r in quantiles.exact(rows.limit(0), {"x": (F.col("a"), 0.5)}).collect()] == [(None,)]
    with pytest.raises(ValueError, match="outside"):
        quantiles.exact(rows, {"x": (F.col("a"), 1.5)})

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmenta.operators import joins as J
from segmenta.operators import vectors as V
from segmenta.plans import catalog, more  # noqa: F401


def _sides(spark, rows):
    e = spark.createDataFrame(rows, "vec_id long, x array<double>, label int")
    return e.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("a"), F.col("x").alias("av"), F.col("label").alias("al")), e.select(F.col("vec_id").alias("b"), F.col("x").alias("bv"), F.col("label").alias("bl"))


def _listed(df):
    return sorted((tuple(repr(x) for x in r) for r in df.select("a", "al", "b", "bl", "score", "rank").collect()))


@pytest.mark.parametrize("k", [3, 70, 10_000])
def test_cosine_nearest_equals_all_pairs(spark, monkeypatch, k):
    draw = np.random.default_rng(3)
    rows = [(i, [round(float(x), 1) for x in draw.normal(size=4)], i % 3) for i in range(400)]
    # many ties: copies, and multiples of few directions
    rows += [(1000 + i, [1.0, float(i % 3), 0.0, 0.0], None) for i in range(300)]
    rows += [(2000, None, 1), (2005, [0.0] * 4, 1), (2010, [1.0, None, 2.0, 3.0], 1), (2015, [1e200, 1.0, 1e200, 0.0], 1), (2020, [1e-200] * 4, 1), (2025, [float("inf"), 1.0, 1.0, 1.0], 1), (2030, [float("nan"), 1.0, 1.0, 1.0], 1), (2035, [1.0, 2.0], 1), (None, [1.0] * 4, 1)]
    monkeypatch.setattr(V, "GROUP", 64)
    q, v = _sides(spark, rows)
    want = J.nearest(q, v, J.cosine(F.col("av"), F.col("bv")), k)
    assert _listed(V.cosine_nearest(q, v, k)) == _listed(want)


@pytest.mark.parametrize("name", ["knn_cosine", "knn_contrast", "knn_boosted", "combined_search"])
def test_pairs_are_no_rows_of_a_join(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan

"""Skew-safe positions and top-k against pandas, with one group holding a third of the rows."""

import numpy as np
from pyspark.sql import functions as F

from slotwise.plans.ranking import positions, top_k


def skewed(spark, n=30000):
    return (spark.range(n).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97))
            .withColumn("v", (F.col("id") * 7919) % 1000))


def test_positions_with_hot_group(spark):
    df = skewed(spark)
    got = positions(df, ["g"], [F.col("v").desc(), F.col("id")], "pos", size_name="n").toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values(["v", "id"], ascending=[False, True])
        assert (part["pos"].values == np.arange(1, len(part) + 1)).all()
        assert (part["n"] == len(part)).all()


def test_global_positions_are_contiguous(spark):
    got = positions(skewed(spark, 5000), [], [F.col("v"), F.col("id")], "pos").toPandas()
    assert sorted(got["pos"]) == list(range(1, 5001))


def test_top_k_small_and_large_k(spark):
    df = skewed(spark, 6000)
    pdf = df.toPandas().sort_values(["g", "v", "id"], ascending=[True, False, True])
    pdf["rn"] = pdf.groupby("g").cumcount() + 1
    for k, skip in ((5, 0), (20, 10), (1500, 1400)):
        got = top_k(df, ["g"], [F.col("v").desc(), F.col("id")], k=k, skip=skip).toPandas()
        want = pdf[(pdf.rn <= k) & (pdf.rn > skip)]
        assert sorted(zip(got.g, got.id, got.rn)) == sorted(zip(want.g, want.id, want.rn))

import numpy as np
from pyspark.sql import functions as F

from claimwright.operators import rbf


def test_a_start_from_some_rows_ends_where_all_rows_lead(spark, monkeypatch):
    """Few rows give the start, all rows the weights: their loss is no greater."""
    x = spark.range(0, 6000, 1, 1).select((F.col("id") % 17 / 4).alias("noise"), (F.col("id") % 101 / 20.0).alias("a"), F.when(F.col("id") % 13 > 0, F.col("id") % 7 / 3.0).alias("b"))
    rows = x.withColumn("y", F.sin("a") * 5 + F.coalesce("b", F.lit(1.0)) * 2 + F.col("noise")).cache()
    inner, seen = rbf._descend, []
    monkeypatch.setattr(rbf, "_descend", lambda df, *a: seen.append(df.count()) or inner(df, *a))
    cold = rbf.fit_rbf(rows, ["a", "b"], landmarks=40)
    monkeypatch.setattr(rbf, "WARM_ROWS", 600)
    warm = rbf.fit_rbf(rows, ["a", "b"], landmarks=40)
    assert seen[0] == seen[2] == 6000 and 0 < seen[1] < 1200

    def loss(model):
        block = np.array([[np.nan if v is None else v for v in r] for r in rows.select("y", "a", "b").collect()], float)
        return rbf._sums(iter([block]), model, 1.0, 0.1)[2] + float(model.weights[:-1] @ model.weights[:-1]) / 2

    assert loss(warm) <= loss(cold) * (1 + 1e-3)
    got, expected = (np.array([r[0] for r in m.transform(rows).select("prediction").collect()]) for m in (warm, cold))
    assert np.abs(got - expected).max() < 0.1

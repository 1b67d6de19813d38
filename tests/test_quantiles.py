import numpy as np
import pytest

from claimwright.functions import quantiles


@pytest.mark.parametrize("accuracy, largest", [(50, 10**6), (20_000, 10**6), (400, 20)])
def test_exact_quantiles_match_numpy(spark, monkeypatch, accuracy, largest):
    """Also with a coarse sketch, so that rows fall outside the bracket, and with a limit
    so low that brackets are narrowed several times."""
    monkeypatch.setattr(quantiles, "LARGEST", largest)
    monkeypatch.setattr(quantiles, "GRID", 8)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MARGIN", 8.0 / accuracy if accuracy > 100 else 0.06)
    rng = np.random.default_rng(1)
    rows = [("a", float(v), None) for v in rng.normal(size=3000)]
    rows += [("b", float(v), float(v % 3)) for v in rng.integers(0, 9, 2000)]
    rows += [("b", 4.0, 1.0)] * 1500 + [("c", 1.5, 2.0)] + [("d", 1.0, None), ("d", 2.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, z double").repartition(6)
    probs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {
        (r["k"], r["feature"], r["p"]): r["value"]
        for r in quantiles.exact_quantiles(df, ["x", "z"], probs, ["k"]).collect()
    }
    for k in "abcd":
        for feature, at in (("x", 1), ("z", 2)):
            values = [r[at] for r in rows if r[0] == k and r[at] is not None]
            for p in probs:
                if values:
                    assert got[(k, feature, p)] == pytest.approx(np.quantile(values, p), abs=1e-12)
                else:
                    assert (k, feature, p) not in got
    whole = quantiles.quantile_values(df, ["x"], [0.5])
    assert whole[("x", 0.5)] == pytest.approx(np.median([r[1] for r in rows]))

import re

import pytest
from pyspark.sql import functions as F

from claimwright.operators import ensembles as en
from claimwright.operators import models as mo
from claimwright.operators import trees as tr
from claimwright.operators import unified as un
from claimwright.operators.clean import finite_target
from claimwright.operators.unified import FittedSegmentedModel, UnifiedSegmentedModel, boosted_per_segment
from claimwright.session import settle, shared_path
from claimwright.sources.claims import KEY, TARGET, claims
from claimwright.sources.tables import CLAIMS_SCHEMA, append_run, scan_claims, sink_metrics


@pytest.fixture(scope="module")
def frame(spark):
    k = F.col("id")
    df = spark.range(600).select(
        k.alias("id"), (k % 7).cast("double").alias("a"), (k % 11).cast("double").alias("b"), (k % 5).alias("f")
    )
    return settle(df.withColumn("y", F.col("a") * 3 + F.col("b") * F.col("b")), "tree-frame")


def test_decision_paths_hold_for_their_records(frame):
    model = mo.fit_on(frame, ["a", "b"], mo.boosted_trees(3, 0.1, 3))
    found = tr.decision_paths(model, frame, "id", ["a", "b"]).withColumn("text", tr.predicate(F.col("path")))
    rows = found.join(frame.select("id", "a", "b"), "id").collect()
    assert len(rows) == 3 * 600
    for r in rows:
        for test in r["path"]:
            value = r[test["feature"]]
            assert (value <= test["threshold"]) == (test["sign"] == "<=")
    total = found.groupBy("id").agg((F.sum("value") + float(model.base[0])).alias("total"))
    worst = model.transform(frame).join(total, "id").agg(F.max(F.abs(F.col("total") - F.col("prediction")))).first()[0]
    assert worst < 1e-9
    assert re.match(r"[ab] (<=|>) [\d.]+( and [ab] (<=|>) [\d.]+)*$", rows[0]["text"])


def test_out_of_fold_table_has_every_training_row_once(frame):
    bases = {"gb": mo.gradient_boosting(2), "rf": mo.random_forest(2, 3)}
    inside, outside, _ = en.tree_out_of_fold(frame, frame.where("id < 10"), ["a", "b"], bases, "f", 3)
    assert inside.count() == frame.where("f < 3").count() == inside.select("id").distinct().count()
    assert outside.count() == 10 and {"pred_gb", "pred_rf"} <= set(outside.columns)


def test_unified_model_predicts_saves_and_loads(spark, sf_dir):
    raw = settle(claims(spark, sf_dir), "unified-test")
    model = UnifiedSegmentedModel(["exceptional_circumstances"], trees=2, folds=2).fit(raw)
    assert model.boosted.segments == model.segments and len(model.segments) == 2
    new = raw.withColumn("exceptional_circumstances", F.when(F.col(KEY) % 2 == 0, "Never seen").otherwise("No"))
    scored = settle(model.transform(new).select(KEY, "segment", "prediction"), "unified-scored")
    assert scored.count() == raw.count()
    assert scored.where("prediction IS NULL OR prediction < 0 OR segment IS NULL").count() == 0
    path = shared_path(spark, "unified")
    model.save(path)
    again = FittedSegmentedModel.load(spark, path).transform(new).select(KEY, F.col("prediction").alias("again"))
    assert scored.join(again, KEY).where("abs(prediction - again) > 1e-9").count() == 0
    assert model.score(finite_target(raw, TARGET)).first()["r2"] > 0.5


def test_csv_scan_sink_and_log(spark, sf_dir):
    path = shared_path(spark, "claims") + ".csv"
    raw = claims(spark, sf_dir)
    raw.write.option("header", True).csv(path)
    back = scan_claims(spark, path)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in CLAIMS_SCHEMA]
    for c in ("accident_date", "injury_description", "special_care"):
        assert back.where(F.col(c).isNull()).count() == raw.where(F.col(c).isNull()).count()
    assert back.where(F.isnan(TARGET)).count() == raw.where(F.isnan(TARGET)).count()

    metrics = spark.createDataFrame([("m", 1.0, 0.5), ("n", 2.0, 0.4)], "model string, rmse double, r2 double")
    out, log = shared_path(spark, "metrics"), shared_path(spark, "log")
    sink_metrics(metrics, out, "csv")
    assert spark.read.option("header", True).csv(out).count() == 2
    append_run(metrics, log, "one")
    append_run(metrics, log, "two")
    assert spark.read.parquet(log).groupBy("run_id").count().collect()[0]["count"] == 4


def test_every_segment_gets_a_booster(spark):
    """Forty segments, one of them with an empty name, and none for a segment without rows."""
    df = spark.range(400).selectExpr(
        "id", "case when id % 40 = 0 then '' else concat('s', cast(id % 40 as string)) end segment", "cast(id as double) a", "cast(id % 40 as double) y"
    )
    rows = settle(df, "forty")
    fitted = boosted_per_segment(rows, ["a"], mo.boosted_trees(1, 1.0, 1))
    assert len(fitted.segments) == 40
    scored = fitted.transform(rows)
    assert scored.where("prediction is null or abs(prediction - y) > 1e-9").count() == 0


def test_candidate_segmentations_grow_in_one_fit(spark, monkeypatch):
    """Each candidate gets the metrics that it has alone, from one fit of all, or of as many as fit."""
    rows = spark.range(0, 4000, 1, 4).selectExpr(
        "id AS claim_id", "concat('a', id % 2) AS one", "if(id % 50 = 0, NULL, concat('b', id % 3)) AS two",
        "double(id % 41) AS x", "double(id % 41) * (1 + id % 3) + id % 2 AS y", "if(id % 5 = 0, 'test', 'train') AS split",
    )
    found = {c: un.segment_composite(rows, [c]) for c in ("one", "two")}
    fits = []
    inner = un.fit_many
    monkeypatch.setattr(un, "fit_many", lambda *a, **k: fits.append(1) or inner(*a, **k))
    growth = mo.boosted_trees(3)
    both = {r["candidate"]: r for r in un.boosted_segmentations(rows, found, ["x"], growth).collect()}
    assert len(fits) == 1 and sorted(both) == ["one", "two"]
    monkeypatch.setattr(un, "SEARCH_ROWS", 4000)
    apart = {r["candidate"]: r for r in un.boosted_segmentations(rows, found, ["x"], growth).collect()}
    assert len(fits) == 3
    for c in found:
        alone = un.boosted_segmentations(rows, {c: found[c]}, ["x"], growth).first()
        for r in (both[c], apart[c]):
            assert r["n_total"] == alone["n_total"]
            assert all(abs(r[m] - alone[m]) < 1e-9 for m in ("rmse", "mae", "r2"))

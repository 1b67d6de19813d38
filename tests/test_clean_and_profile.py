import math

import pytest
from pyspark.sql import functions as F

from claimwright.operators import clean, profile, split
from claimwright.operators.features import claim_delay, days_to_claim, row_total, severe_flag
from claimwright.functions.hashing import fold_of, inner_fold_of
from claimwright.functions.numbers import guarded

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def targets(spark):
    rows = [(1, 10.0), (2, None), (3, NAN), (4, INF), (5, -INF), (6, 20.0), (7, 0.0)]
    return spark.createDataFrame(rows, "id long, y double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_target_filters(targets):
    assert ids(clean.drop_missing_target(targets, "y")) == [1, 4, 5, 6, 7]
    assert ids(clean.finite_target(targets, "y")) == [1, 6, 7]
    assert ids(clean.quantile_trim(targets, "y", 0.5)) == [1, 7]


def test_table_shape_counts_each_step(targets):
    y = F.col("y")
    shape = profile.table_shape(
        targets, {"all": F.lit(True), "present": y.isNotNull() & ~F.isnan(y), "finite": F.abs(y) < INF}
    )
    assert {r["step"]: r["n_rows"] for r in shape.collect()} == {"all": 7, "present": 5, "finite": 3}


def test_missing_profile_counts_nan_and_null(targets):
    assert [tuple(r) for r in profile.missing_profile(targets).collect()] == [("y", 2)]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "c double, x double")
    scaler = clean.fit_scaler(df, ["c", "x"])
    got = df.select(clean.scaled("c", scaler), clean.scaled("x", scaler)).collect()
    assert [tuple(r) for r in got] == [(0.0, -1.0), (0.0, 1.0)]


def test_text_exclude_uses_first_column_with_a_hit(spark):
    df = spark.createDataFrame([(1, "a", "Foo"), (2, None, "bar"), (3, "b", None)], "id int, p string, q string")
    assert ids(clean.text_exclude(df, ["p", "q"], "FOO")) == [2, 3]
    assert ids(clean.text_exclude(df, ["p", "q"], "nothing")) == [1, 2, 3]


def test_one_hot_of_unseen_value_is_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    columns = clean.one_hot("c", clean.fit_categories(train, "c"))
    assert [tuple(r) for r in test.select(*columns).collect()] == [(1, 0), (0, 0), (0, 0)]


def test_indicator_vector_takes_any_number_of_values(spark):
    train = spark.range(3000).selectExpr("cast(id as string) c")
    test = spark.createDataFrame([("7",), ("never seen",), (None,)], "c string")
    found = [r.indicators for r in clean.indicator_vector(train, ["c"]).transform(test).collect()]
    assert [v.size for v in found] == [3000] * 3 and [v.numNonzeros() for v in found] == [1, 0, 0]


def test_projection_and_all_null_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert clean.drop_all_null_columns(df, ["a", "b"]).columns == ["a"]
    assert clean.feature_projection(df, ["a", "zz"]).first().asDict() == {"a": 1.0, "zz": 0.0}


def test_dates_damages_and_flags(spark):
    df = spark.createDataFrame(
        [("2024-01-10", "2024-01-02", 3.0, 0.0, "MAJOR burn"), ("not a date", "2024-01-02", None, -2.0, None)],
        "a string, b string, s double, g double, t string",
    )
    got = df.select(
        claim_delay(F.col("a"), F.col("b")).alias("d"),
        guarded(row_total(["s"]), F.col("g")).alias("ratio"),
        severe_flag(F.col("t")).alias("severe"),
    ).collect()
    assert [tuple(r) for r in got] == [(-8, 3.0, 1), (0, -0.0, 0)]
    dates = spark.sql("SELECT DATE'2024-03-01' AS a, DATE'2024-02-28' AS b, CAST(NULL AS DATE) AS c")
    row = dates.select(days_to_claim(F.col("a"), F.col("b")), days_to_claim(F.col("a"), F.col("c"))).first()
    assert tuple(row) == (-2, None)


def test_folds_are_balanced_and_work_for_large_keys(spark):
    df = spark.range(0, 20000).select(fold_of(F.col("id")).alias("f"), inner_fold_of(F.col("id")).alias("g"))
    for column in ("f", "g"):
        sizes = [r["count"] for r in df.groupBy(column).count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) < 400
    huge = spark.sql("SELECT explode(array(0L, 6000000000000L, 9223372036854775807L)) AS id")
    assert all(0 <= r[0] < 5 for r in huge.select(fold_of(F.col("id"))).collect())


def test_contiguous_folds_are_equal_blocks(spark):
    df = split.contiguous_folds(spark.range(100).select(F.col("id").alias("k")), "k", 5)
    blocks = df.groupBy("fold").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("k").alias("n")).orderBy("fold")
    assert [(r["a"], r["b"], r["n"]) for r in blocks.collect()] == [(i * 20, i * 20 + 19, 20) for i in range(5)]


def test_histogram_keeps_every_row_and_closes_the_last_bin(spark):
    df = spark.createDataFrame([("s", float(i)) for i in range(41)] + [("one", 7.0)], "segment string, y double")
    bins = profile.target_histogram(df, "segment", "y").collect()
    assert sum(r["n"] for r in bins) == 42
    assert max(r["bin"] for r in bins if r["segment"] == "s") == 19
    assert [r["bin"] for r in bins if r["segment"] == "one"] == [0]
    assert not any(math.isnan(r["low"]) for r in bins)

from pyspark.sql import functions as F

from claimwright.operators import segments as sg


def table(spark, counts):
    rows = [(i, *values) for i, values in enumerate(v for v, n in counts for _ in range(n))]
    names = ["a", "b", "c"][: len(counts[0][0])]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} string" for n in names))


def sizes(df):
    return {r["segment"]: r["count"] for r in df.groupBy("segment").count().collect()}


def test_single_keeps_a_real_other_apart(spark):
    df = table(spark, [(("Other",), 6), (("x",), 7), (("y",), 3), (("z",), 2)])
    rows = sg.segment_single(df, "a", 5).split(df)
    assert sizes(rows) == {"Other": 6, "x": 7, sg.LEFTOVER: 5}
    shown = rows.select(sg.shown(F.col("segment")).alias("s")).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in shown} == {"Other": 11, "x": 7}


def test_small_leftover_is_dropped_and_residual_lists_it(spark):
    df = table(spark, [(("x",), 7), (("y",), 3), ((None,), 1)])
    dictionary = sg.segment_single(df, "a", 5)
    assert sizes(dictionary.split(df)) == {"x": 7}
    assert sg.segment_residual(df, dictionary).count() == 4


def test_no_segment_at_all_is_empty(spark):
    df = table(spark, [(("x",), 2), (("y",), 1)])
    assert sg.segment_single(df, "a", 5).split(df).count() == 0
    assert sg.segment_composite(df, ["a"], 5).split(df).count() == 0


def test_multi_and_values_with_separators(spark):
    df = table(spark, [(("a_b", "c"), 5), (("a", "b_c"), 5), (("q", "r"), 5), (("q", "s"), 1)])
    assert sizes(sg.segment_multi(df, ["a", "b"], 5).split(df)) == {
        "a=a_b & b=c": 5, "a=a & b=b_c": 5, "a=q & b=r": 5,
    }
    assert sum(sizes(sg.segment_composite(df, ["a", "b"], 5).split(df)).values()) == 16


def test_hierarchical_rule(spark):
    df = table(
        spark,
        [(("big", "u"), 12), (("big", "v"), 5), (("big", "w"), 2), (("mid", "u"), 4), (("mid", "v"), 4),
         (("low", "u"), 3)],
    )
    got = sizes(sg.segment_hierarchical(df, "a", "b", 5).split(df))
    assert got == {"big_u": 12, "big_v": 5, "mid": 8, sg.LEFTOVER: 5}


def test_composite_merges_leftovers_into_the_largest_also_when_scoring(spark):
    df = table(spark, [(("x", "u"), 9), (("y", "u"), 6), (("z", "u"), 2)])
    dictionary = sg.segment_composite(df, ["a", "b"], 5)
    assert sizes(dictionary.split(df)) == {"x_u_": 11, "y_u_": 6}
    new = table(spark, [(("never", "seen"), 1), (("z", "u"), 1), (("y", "u"), 1)])
    assert sizes(dictionary.assign(new)) == {"x_u_": 2, "y_u_": 1}
    assert {r["segment"]: r["n"] for r in dictionary.sizes().collect()} == {"x_u_": 11, "y_u_": 6}


def test_every_row_gets_exactly_one_segment(spark):
    df = table(spark, [((f"v{i}",), i + 1) for i in range(12)])
    rows = sg.segment_composite(df, ["a"], 6).split(df)
    assert rows.count() == df.count() == rows.select("id").distinct().count()

"""Segmentation rules and the search over segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.functions.numbers import rounded
from claimwright.operators import search
from claimwright.operators import segments as sg
from claimwright.operators.metrics import improvement_pct
from claimwright.plans.base import CRITERIA, base, hierarchy
from claimwright.plans.registry import query
from claimwright.plans.sql import on_base, on_segments
from claimwright.sources.claims import CATEGORICAL, KEY


def _labelled(df: DataFrame) -> DataFrame:
    return df.select(KEY, sg.shown(F.col("segment")).alias("segment"))


@query(
    "segment_single",
    on_base(
        """SELECT claim_id, segment FROM (SELECT claim_id, CASE WHEN n >= 50 THEN accident_type
          WHEN n_rest >= 50 THEN 'Other' END AS segment FROM base JOIN c USING (accident_type), r)
        WHERE segment IS NOT NULL""",
        "c AS (SELECT accident_type, count(*) AS n FROM base GROUP BY 1)",
        "r AS (SELECT coalesce(sum(n), 0) AS n_rest FROM c WHERE n < 50)",
    ),
)
def segment_single(spark, sf_dir) -> DataFrame:
    frame = base(spark, sf_dir, "accident_type")
    return _labelled(sg.segment_single(frame, "accident_type").split(frame))


@query(
    "segment_multi",
    on_base(
        """SELECT claim_id, segment FROM (SELECT claim_id, CASE WHEN n >= 100
            THEN 'exceptional_circumstances=' || exceptional_circumstances || ' & accident_type=' || accident_type
            WHEN n_rest >= 100 THEN 'Other' END AS segment
          FROM base JOIN c USING (exceptional_circumstances, accident_type), r) WHERE segment IS NOT NULL""",
        "c AS (SELECT exceptional_circumstances, accident_type, count(*) AS n FROM base GROUP BY 1, 2)",
        "r AS (SELECT coalesce(sum(n), 0) AS n_rest FROM c WHERE n < 100)",
    ),
)
def segment_multi(spark, sf_dir) -> DataFrame:
    frame = base(spark, sf_dir, *CRITERIA)
    columns = list(CRITERIA)
    return _labelled(sg.segment_multi(frame, columns).split(frame))


@query("segment_hierarchical", on_segments("SELECT claim_id, segment FROM seg"))
def segment_hierarchical(spark, sf_dir) -> DataFrame:
    frame = base(spark, sf_dir, *CRITERIA)
    return _labelled(hierarchy(frame).split(frame))


_COMPOSITE = [
    """c AS (SELECT exceptional_circumstances AS p, accident_type AS s, injury_description AS i,
      p || '_' || s || '_' || i || '_' AS id, count(*) AS n FROM base GROUP BY 1, 2, 3)""",
    """r AS (SELECT coalesce(sum(CASE WHEN n < {min} THEN n END), 0) AS n_rest,
      (SELECT id FROM c WHERE n >= {min} ORDER BY n DESC, id LIMIT 1) AS largest FROM c)""",
    """d AS (SELECT p, s, i, CASE WHEN n >= {min} THEN id WHEN n_rest >= {min} THEN 'Other'
      ELSE largest END AS segment FROM c, r)""",
]


def _composite(size: int) -> list[str]:
    return [c.format(min=size) for c in _COMPOSITE]


@query(
    "segment_composite",
    on_base(
        """SELECT claim_id, segment, 'kept' AS leftovers FROM base JOIN d ON p = exceptional_circumstances
          AND s = accident_type AND i = injury_description WHERE segment IS NOT NULL
        UNION ALL SELECT claim_id, CASE WHEN n >= 70 THEN accident_type WHEN n_rest >= 70 THEN 'Other'
          ELSE largest END, 'merged' FROM base JOIN c1 USING (accident_type), r1""",
        *_composite(50),
        "c1 AS (SELECT accident_type, count(*) AS n FROM base GROUP BY 1)",
        """r1 AS (SELECT sum(CASE WHEN n < 70 THEN n ELSE 0 END) AS n_rest,
          (SELECT accident_type FROM c1 WHERE n >= 70 ORDER BY n DESC, accident_type LIMIT 1) AS largest FROM c1)""",
    ),
)
def segment_composite(spark, sf_dir) -> DataFrame:
    """Three columns, where the leftovers suffice for a bucket, and one column with a
    minimum they miss, so that they go into the largest segment."""
    columns = [*CRITERIA, "injury_description"]
    frame = base(spark, sf_dir, *columns)
    kept = _labelled(sg.segment_composite(frame, columns, 50).split(frame))
    merged = _labelled(sg.segment_composite(frame, ["accident_type"], 70).split(frame))
    return kept.withColumn("leftovers", F.lit("kept")).union(
        merged.withColumn("leftovers", F.lit("merged"))
    )


@query(
    "segment_assign",
    on_base(
        """SELECT claim_id, coalesce(segment, CASE WHEN n_rest >= 50 THEN 'Other' ELSE largest END) AS segment
        FROM base LEFT JOIN d ON p = exceptional_circumstances AND s = accident_type, r WHERE split = 'test'""",
        "c AS (SELECT exceptional_circumstances AS p, accident_type AS s, p || '_' || s || '_' AS id, count(*) AS n FROM base WHERE split = 'train' GROUP BY 1, 2)",
        """r AS (SELECT coalesce(sum(CASE WHEN n < 50 THEN n END), 0) AS n_rest,
          (SELECT id FROM c WHERE n >= 50 ORDER BY n DESC, id LIMIT 1) AS largest FROM c)""",
        "d AS (SELECT p, s, CASE WHEN n >= 50 THEN id END AS segment FROM c)",
    ),
)
def segment_assign(spark, sf_dir) -> DataFrame:
    """The training dictionary applied to test rows."""
    frame = base(spark, sf_dir, *CRITERIA)
    columns = list(CRITERIA)
    dictionary = sg.segment_composite(frame.where("split = 'train'"), columns)
    return _labelled(dictionary.assign(frame.where("split = 'test'")))


@query(
    "segment_residual",
    on_base(
        "SELECT claim_id, accident_type FROM base WHERE accident_type IN (SELECT accident_type FROM base GROUP BY 1 HAVING count(*) < 50)"
    ),
)
def segment_residual(spark, sf_dir) -> DataFrame:
    frame = base(spark, sf_dir, "accident_type").select(KEY, "accident_type")
    return sg.segment_residual(frame, sg.segment_single(frame, "accident_type"))


@query(
    "distinct_combinations",
    on_base("SELECT DISTINCT exceptional_circumstances, accident_type, vehicle_type FROM base"),
)
def distinct_combinations(spark, sf_dir) -> DataFrame:
    return base(spark, sf_dir, *CRITERIA, "vehicle_type").select(
        "exceptional_circumstances", "accident_type", "vehicle_type"
    ).distinct()


def _search_sql(source: str, min_size: int, cap: str, x: str = "") -> list[str]:
    """From ``{x}long(candidate, value, y, split)`` to ``{x}result`` with weighted metrics."""
    return [
        source,
        f"""{x}vals AS (SELECT candidate, value, count(*) AS n FROM {x}long GROUP BY 1, 2),
        {x}lab AS (SELECT *, CASE WHEN n >= {min_size} THEN value ELSE '__other__' END AS segment FROM {x}vals),
        {x}ok AS (SELECT candidate FROM {x}lab GROUP BY 1 HAVING {cap}),
        {x}sz AS (SELECT candidate, segment, sum(n) AS n_total FROM {x}lab
          WHERE candidate IN (SELECT candidate FROM {x}ok) GROUP BY 1, 2 HAVING sum(n) >= {min_size}),
        {x}many AS (SELECT candidate FROM {x}sz GROUP BY 1 HAVING count(*) > 1),
        {x}rws AS (SELECT l.*, segment, n_total FROM {x}long l JOIN {x}lab USING (candidate, value)
          JOIN {x}sz USING (candidate, segment) WHERE candidate IN (SELECT candidate FROM {x}many)),
        {x}mu AS (SELECT candidate, segment, avg(y) AS p FROM {x}rws WHERE split = 'train' GROUP BY 1, 2),
        {x}seg_m AS (SELECT candidate, segment, n_total, sqrt(avg((y-p)*(y-p))) AS rmse, avg(abs(y-p)) AS mae,
          1 - sum((y-p)*(y-p)) / nullif(var_pop(y) * count(*), 0) AS r2
          FROM {x}rws JOIN {x}mu USING (candidate, segment) WHERE split = 'test' GROUP BY 1, 2, 3),
        {x}result AS (SELECT candidate, sum(rmse * n_total) / sum(n_total) AS rmse,
          sum(mae * n_total) / sum(n_total) AS mae,
          sum(r2 * n_total) / sum(CASE WHEN r2 IS NOT NULL THEN n_total END) AS r2,
          CAST(sum(n_total) AS BIGINT) AS n_total FROM {x}seg_m GROUP BY 1)""",
    ]


_SINGLE = _search_sql(
    "long AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS candidate, {c} AS value, y, split FROM base"
        for c in CATEGORICAL
    )
    + " UNION ALL SELECT 'accident_day', coalesce(CAST(accident_date AS VARCHAR), 'Unknown'), y, split FROM base)",
    50,
    "count(*) <= 20",
)
_SHOW = """candidate, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 6) + 0.0 AS r2, n_total"""


def single_search(frame: DataFrame) -> DataFrame:
    candidates = {c: F.col(c) for c in CATEGORICAL}
    candidates["accident_day"] = F.coalesce(F.col("accident_date").cast("string"), F.lit("Unknown"))
    return search.evaluate_candidates(frame, candidates, min_size=50, most_values=20)


def _shown(results: DataFrame) -> DataFrame:
    return results.select(
        "candidate",
        rounded(F.col("rmse")).alias("rmse"),
        rounded(F.col("mae")).alias("mae"),
        rounded(F.col("r2"), 6).alias("r2"),
        "n_total",
    )


@query("segmentation_search", on_base(f"SELECT {_SHOW} FROM result", *_SINGLE))
def segmentation_search(spark, sf_dir) -> DataFrame:
    """Every text column; the date as text shows how a column of many values is skipped."""
    return _shown(single_search(base(spark, sf_dir, *CATEGORICAL, "accident_date")))


@query(
    "top_k_segmentations",
    on_base(f"SELECT {_SHOW} FROM result ORDER BY r2 DESC, candidate LIMIT 5", *_SINGLE),
)
def top_k_segmentations(spark, sf_dir) -> DataFrame:
    return _shown(search.top_candidates(single_search(base(spark, sf_dir, *CATEGORICAL, "accident_date"))))


_RANKED = "top5 AS (SELECT candidate, row_number() OVER (ORDER BY r2 DESC, candidate) AS rk FROM result ORDER BY rk LIMIT 5)"
_VALUE = (
    "CASE {c} "
    + " ".join(f"WHEN '{c}' THEN {c}" for c in CATEGORICAL)
    + " END"
)


_PAIRS = _search_sql(
    """p_long AS (SELECT a.candidate || ' + ' || b.candidate AS candidate,
      a.candidate || '=' || {va} || ' & ' || b.candidate || '=' || {vb} AS value, y, split
      FROM base, top5 a, top5 b WHERE a.rk < b.rk)""".format(
        va=_VALUE.format(c="a.candidate"), vb=_VALUE.format(c="b.candidate")
    ),
    100,
    "true",
    "p_",
)


@query("pairwise_search", on_base(f"SELECT {_SHOW} FROM p_result", *_SINGLE, _RANKED, *_PAIRS))
def pairwise_search(spark, sf_dir) -> DataFrame:
    """All pairs of the five best columns; five names come to the driver, no rows."""
    frame = base(spark, sf_dir, *CATEGORICAL, "accident_date")
    best = [r["candidate"] for r in search.top_candidates(single_search(frame)).collect()]
    pairs = search.pair_candidates(best)
    return _shown(search.evaluate_candidates(frame, pairs, min_size=100, most_values=None))

"""One segmented model behind fit / transform / score / save / load.

Clean, derive features, cut into segments, fit one booster per segment, and stack a
forest and two boosters with an elastic net on the segments' predictions.

* The meta-model sees out-of-fold segment predictions only.
* Medians and the segment dictionary (with the merge target of small segments) are kept
  with the model, so a scored batch does not change how its own rows are read.
* Every segment gets its own trees and its own set of features, chosen once on all its training
  rows. The trees of all segments, and of all folds that are left out, grow in the same jobs.
  Segments are a table that rows join, so scoring has no branch for each and no write: a
  stream is scored by the same expressions as a batch.
* The meta-models see each row's own ``segment_prediction`` and one ``pred_segment_<i>`` column
  for every segment, 0 outside it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.functions.hashing import inner_fold_of
from claimwright.operators import ensembles as en
from claimwright.operators import models as mo
from claimwright.operators.boosting import Growth, Lane, TreeModel, fit_many
from claimwright.operators.clean import constant_impute, finite_target, fit_medians, impute
from claimwright.operators.features import engineered
from claimwright.operators.metrics import regression_metrics, weighted_metrics
from claimwright.operators.segments import SegmentDictionary, segment_composite
from claimwright.session import settle, spread
from claimwright.sources.claims import CATEGORICAL, KEY, NUMERIC, TARGET

FEATURES = [*NUMERIC, "days_to_claim", "total_special", "total_general", "total_damages",
            "log_special", "log_general", "log_damages", "special_general_ratio", "severe_injury",
            "whiplash_flag", "psych_flag", "severe_total", "psych_total"]
TOTALS = ["total_special", "total_general", "total_damages"]
#: Rows times candidate segmentations that grow in one fit.
SEARCH_ROWS = 1 << 26


def select_features(shares: np.ndarray, least: int = 3) -> np.ndarray:
    """Which features have at least the mean importance; the top ``least`` if fewer do."""
    kept = shares >= shares.mean()
    if kept.sum() < least:
        kept = np.zeros(len(shares), bool)
        kept[np.argsort(-shares, kind="stable")[:least]] = True
    return kept


def segment_names(rows: DataFrame) -> list[str]:
    return [r[0] for r in rows.where("segment is not null").select("segment").distinct().sort("segment").collect()]


def boosted_per_segment(rows: DataFrame, features: Sequence[str], growth: Growth, target: str = "y") -> TreeModel:
    """One booster for every ``segment`` of ``rows``, all grown side by side."""
    names = segment_names(rows)
    return fit_many(rows, features, {"own": Lane(growth)}, target, segment="segment", key=KEY if KEY in rows.columns else None, segments=names)["own"]


def boosted_segmentations(
    df: DataFrame, dictionaries: Mapping[str, SegmentDictionary], features: Sequence[str], growth: Growth
) -> DataFrame | None:
    """For each ``candidate`` segmentation the size-weighted test metrics of one booster per
    segment. ``df`` has ``y`` and ``split``. Segments of several candidates are segments of one fit
    over the rows of each, so that a candidate's largest segment, which grows in one task, does not
    keep the others waiting; as many candidates at once as ``SEARCH_ROWS`` allow."""
    names = list(dictionaries)
    step = max(1, SEARCH_ROWS // max(df.count(), 1))
    result = None
    for low in range(0, len(names), step):
        rows = sizes = None
        for name in names[low : low + step]:
            own = F.concat(F.lit(f"{names.index(name)}|"), F.col("segment")).alias("segment")
            part = dictionaries[name].split(df).select(KEY, own, "split", "y", *features)
            size = dictionaries[name].sizes().select(F.lit(name).alias("candidate"), own, F.col("n").alias("n_total"))
            rows, sizes = (part, size) if rows is None else (rows.unionByName(part), sizes.unionByName(size))
        rows = settle(rows, "search-rows")
        model = boosted_per_segment(rows.where("split = 'train'"), features, growth)
        scored = model.transform(rows.where("split = 'test'")).where("prediction is not null")
        found = settle(weighted_metrics(regression_metrics(scored, ["segment"]).join(sizes, "segment"), "n_total", ["candidate"]), "search-metrics")
        result = found if result is None else result.unionByName(found)
    return result


@dataclass
class UnifiedSegmentedModel:
    segmentation: list[str] = field(default_factory=lambda: ["exceptional_circumstances", "accident_type"])
    min_segment: int = 50
    feature_selection: bool = True
    trees: int = 150
    folds: int = 5

    def fit(self, df: DataFrame) -> FittedSegmentedModel:
        kept = finite_target(df, TARGET)
        medians = fit_medians(kept, NUMERIC)
        overall = kept.agg(F.avg(TARGET)).first()[0]
        ready = _prepared(kept, medians).withColumns(
            {"y": F.col(TARGET), "fold": inner_fold_of(F.col(KEY), self.folds)}
        )
        dictionary = segment_composite(ready, self.segmentation, self.min_segment)
        dictionary.table = settle(dictionary.table, "unified-segments")
        rows = settle(dictionary.split(ready).select(KEY, "segment", "fold", "y", *FEATURES), "unified-rows")
        growth = mo.boosted_trees(self.trees, 0.1, 5, subsample=0.8, column_share=0.8)
        names = segment_names(rows)
        shared = {"fold": "fold", "segment": "segment", "segments": names, "key": KEY}
        chosen = None
        if self.feature_selection and names:
            first = fit_many(rows, FEATURES, {"all": Lane(growth)}, **shared)["all"]
            chosen = np.stack([select_features(first.importances(k)) for k in range(len(names))])
        lanes = {str(k): Lane(growth, k if k < self.folds else None) for k in range(self.folds + 1)}
        boosted = fit_many(rows, FEATURES, lanes, chosen=chosen, **shared)
        meta_rows = None
        for k in range(self.folds):
            part = _own_prediction(rows.where(F.col("fold") == k), boosted[str(k)], overall)
            meta_rows = part if meta_rows is None else meta_rows.unionByName(part)
        meta = _meta_columns(names)
        meta_rows = _with_segment_columns(meta_rows, names)
        meta_rows = settle(spread(meta_rows.select(KEY, "y", "fold", *meta), KEY), "unified-meta")
        bases = {
            "boosted": mo.boosted_trees(self.trees, 0.05, 4),
            "gbm": mo.gradient_boosting(self.trees, 0.05, 4),
            "rf": mo.random_forest(self.trees, 8),
        }
        inside, _, full = en.tree_out_of_fold(meta_rows, None, meta, bases, "fold", self.folds, KEY)
        names_in = [f"pred_{b}" for b in bases]
        final = mo.elastic_net(0.001, 0.5, mo.target_deviation(inside, "y")[1])
        return FittedSegmentedModel(
            asdict(self), medians, overall, dictionary, names, boosted[str(self.folds)], full,
            mo.fit_on(inside, names_in, final),
        )


def _prepared(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    derived = engineered(constant_impute(impute(df, medians), CATEGORICAL))
    return derived.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES}
    )


def _own_prediction(df: DataFrame, boosted: TreeModel, overall: float | None) -> DataFrame:
    """``segment_prediction``: that of the segment's booster, else the overall mean."""
    found = boosted.transform(df, "segment_prediction")
    return found.withColumn("segment_prediction", F.coalesce("segment_prediction", F.lit(overall), F.lit(0.0)))


def _meta_columns(segments: Sequence[str]) -> list[str]:
    """By number, as a segment's name may hold any character."""
    return ["segment_prediction", *TOTALS, *[f"pred_segment_{i}" for i in range(len(segments))]]


def _with_segment_columns(df: DataFrame, segments: Sequence[str]) -> DataFrame:
    own = {f"pred_segment_{i}": F.when(F.col("segment") == s, F.col("segment_prediction")).otherwise(0.0) for i, s in enumerate(segments)}
    return df.withColumns(own) if own else df


@dataclass
class FittedSegmentedModel:
    params: dict
    medians: dict[str, float]
    overall: float
    dictionary: SegmentDictionary
    segments: list[str]
    boosted: TreeModel
    bases: dict[str, TreeModel]
    final: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``segment``, ``segment_prediction`` and the non-negative ``prediction``."""
        ready = self.dictionary.assign(_prepared(df, self.medians))
        scored = _with_segment_columns(_own_prediction(ready, self.boosted, self.overall), self.segments)
        for name, model in self.bases.items():
            scored = model.transform(scored, f"pred_{name}")
        scored = self.final.transform(scored).drop("features", *[f"pred_{b}" for b in self.bases], *_meta_columns(self.segments)[4:])
        return scored.withColumn(
            "prediction", en.clip_nonnegative(F.coalesce(F.col("prediction"), F.lit(self.overall)))
        )

    def score(self, df: DataFrame) -> DataFrame:
        """Metrics on rows that have a target."""
        return regression_metrics(self.transform(df).select(F.col(TARGET).alias("y"), "prediction"))

    def weights(self) -> DataFrame:
        """``place``, ``model``, ``coefficient`` and ``share`` of the stack's inputs, largest first."""
        coefficients = [float(c) for c in self.final.stages[-1].coefficients]
        order = sorted(zip(self.bases, coefficients), key=lambda p: (-abs(p[1]), p[0]))
        total = sum(abs(c) for _, c in order)
        rows = [(k, n, c, abs(c) / total if total else 0.0) for k, (n, c) in enumerate(order, 1)]
        return self.dictionary.table.sparkSession.createDataFrame(rows, "place int, model string, coefficient double, share double")

    def save(self, path: str) -> None:
        spark = self.dictionary.table.sparkSession
        self.boosted.save(spark, f"{path}/boosted")
        for i, model in enumerate(self.bases.values()):
            model.save(spark, f"{path}/bases/{i}")
        self.final.write().overwrite().save(f"{path}/final")
        self.dictionary.table.write.mode("overwrite").parquet(f"{path}/segments")
        facts = {
            "params": self.params,
            "medians": self.medians,
            "overall": self.overall,
            "columns": self.dictionary.columns,
            "fallback": self.dictionary.fallback,
            "segments": self.segments,
            "bases": list(self.bases),
        }
        text = spark.createDataFrame([(json.dumps(facts),)], "facts string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedSegmentedModel:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        bases = {n: TreeModel.load(spark, f"{path}/bases/{i}") for i, n in enumerate(facts["bases"])}
        dictionary = SegmentDictionary(
            spark.read.parquet(f"{path}/segments"), facts["columns"], facts["fallback"]
        )
        return cls(
            facts["params"], facts["medians"], facts["overall"], dictionary, facts["segments"], TreeModel.load(spark, f"{path}/boosted"),
            bases, PipelineModel.load(f"{path}/final"),
        )

"""Quality scores by a generalised additive model with pairwise interactions.

Each text has a few countable features. A feature is cut into bins at quantiles, and its
share in the log odds is a lookup table over the bins. The tables are learned by cyclic
boosting: in every round each feature in turn gets a shallow tree on the present residual,
whose small steps are added to its table; then pairs of features, picked by how much of the
residual a tree over both explains, get tables over the grid of their bins in the same way.
A score is the intercept plus one looked-up number for each feature and pair.

The fit uses at most about ``FIT_ROWS`` labelled rows (by a hash of the row); only their few
numbers reach the driver. All texts are scored whole in one pass without a shuffle.

Defined cases: null and empty texts have all features 0 and are scored; labels other than 0
and 1 and rows without label are not learned from; repeated label rows weigh as often; if
nothing can be learned every score is 0.5; extra columns of the documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm import words as W
from claimwright.llm.blocks import held_out
from claimwright.llm.registry import query

#: Bound of the labelled rows in the fit.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST_ROWS = 150, 60, 0.1, 20
THRESHOLD = 0.3
SLICE_BYTES = 2 << 20

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "punctuation", "symbols", "bars", "blanks", "beyond_ascii",
    "distinct_words", "top_word", "words_per_line", "repeated_lines", "line_ends", "short_words", "mixed_words", "number_words",
    "words_per_sentence", "upper_starts",
)

_UPPER, _DIGIT = W.byte_class((0x41, 0x5A)), W.byte_class((0x30, 0x39))
_STOPS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_PUNCTUATION = np.isin(np.arange(256), [ord(c) for c in ".,;:!?'\"()-"])
_SYMBOLS = W.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)) & ~_PUNCTUATION
_BLANK, _HIGH = ~W.NOT_BLANK, W.byte_class((0x80, 0xFF))
_LETTER = W.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_NOT_NEWLINE = ~W.byte_class((0x0A, 0x0A))


def _runs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many values are distinct and how often the commonest occurs."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, t[at], np.diff(np.concatenate([at, [len(h)]])))
    return np.bincount(t[at], minlength=n), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, first = W.find_words(data, offsets, W.NOT_BLANK)
    count = np.diff(first)
    words = np.maximum(count, 1)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)

    def inside(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return sums[ends] - sums[starts]

    def by_words(flags: np.ndarray) -> np.ndarray:
        return W.per_text(flags.astype(np.int64), first) / words

    length = ends - starts
    distinct, top = _runs(W.hash_words(data, starts, ends), first)
    line_starts, line_ends, line_first = W.find_words(data, offsets, _NOT_NEWLINE)
    lines = np.maximum(np.diff(line_first), 1)
    distinct_lines, _ = _runs(W.hash_words(data, line_starts, line_ends, W.BYTE_VALUES), line_first)
    stopped = W.per_text(_STOPS[data[line_ends - 1]].astype(np.int64), line_first)
    sentence_ends = W.per_text(_STOPS[data[ends - 1]].astype(np.int64), first)
    letters, digits = inside(_LETTER), inside(_DIGIT)
    symbols = inside(_SYMBOLS)
    columns = [
        np.log1p(size), np.log1p(count), W.per_text(length, first) / words, share(_UPPER), share(_DIGIT), share(_PUNCTUATION),
        share(_SYMBOLS), share(W.byte_class((0x7C, 0x7C))), share(_BLANK), share(_HIGH), distinct / words, top / words,
        count / lines, 1 - distinct_lines / lines, stopped / lines, by_words(length <= 2), by_words((letters > 0) & (symbols > 0)),
        by_words((letters == 0) & (digits > 0)), count / np.maximum(sentence_ends, 1), by_words(_UPPER[data[starts]]),
    ]
    out = np.stack([np.asarray(c, float) for c in columns], 1) if n else np.zeros((0, len(FEATURES)))
    out[size == 0] = 0
    return out


@dataclass
class AdditiveModel:
    """Bin edges, a table for each feature, and a grid for each pair."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, k], "right")]
        coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.pair_edges)]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[coarse[a], coarse[b]]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Best place to split bins in two, and what it gains."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < LEAST_ROWS) | (n.sum() - nl < LEAST_ROWS)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values of the bins under a tree of depth two."""
    out = np.empty(len(g))
    gain, middle = _best_cut(g, h, n)
    parts = [(0, middle), (middle, len(g))] if gain > 0 else [(0, len(g))]
    for low, high in parts:
        gain, cut = _best_cut(g[low:high], h[low:high], n[low:high])
        for a, b in [(low, low + cut), (low + cut, high)] if gain > 0 else [(low, high)]:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a grid of bins under a tree that splits rows, then columns, and its gain."""
    best, out = -1.0, np.zeros_like(g)
    total = _gain(g.sum(), h.sum())
    for row in range(1, g.shape[0]):
        trial, gain = np.zeros_like(g), -total
        for low, high in ((0, row), (row, g.shape[0])):
            gs, hs, ns = g[low:high].sum(0), h[low:high].sum(0), n[low:high].sum(0)
            got, cut = _best_cut(gs, hs, ns)
            for a, b in [(0, cut), (cut, len(gs))] if got > 0 else [(0, len(gs))]:
                trial[low:high, a:b] = gs[a:b].sum() / (hs[a:b].sum() + 1.0)
            gain += _gain(gs.sum(), hs.sum()) + got
        if gain > best:
            best, out = gain, trial
    return out, best


def fit_rows(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Learn the tables from feature rows and labels 0 and 1."""
    if not len(y):
        return AdditiveModel()
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(float(np.log(rate / (1 - rate))), _edges(x, BINS))
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    odds = np.full(len(y), model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            g, h = residual()
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(own, g, size), np.bincount(own, h, size), np.bincount(own, minlength=size))
            model.tables[k] += step
            odds += step[own]
    model.pair_edges = _edges(x, PAIR_BINS)
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.pair_edges)]

    def grids(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        size = shape[0] * shape[1]
        return tuple(np.bincount(cell, w, size).reshape(shape) for w in (g, h, np.ones(len(y))))

    g, h = residual()
    found = [(_grid_tree(*grids(a, b, g, h))[1], a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])]
    model.pairs = [(a, b) for gain, a, b in sorted(found, reverse=True)[:PAIRS] if gain > 0]
    model.grids = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            step, _ = _grid_tree(*grids(a, b, *residual()))
            model.grids[k] += RATE * step
            odds += RATE * step[coarse[a], coarse[b]]
    return model


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents without their text, with an array ``features`` in place of such a column."""
    docs = docs.drop("features")
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.flat(pa.chunked_array([batch.column(at)]))
            for low, high in W.cuts(offsets, SLICE_BYTES):
                x = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                kept = batch.slice(low, high - low)
                columns = [c for k, c in enumerate(kept.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(x), pa.list_(pa.float64()))], names=[n for n in names if n != text] + ["features"])

    schema = docs.drop(text).withColumn("features", F.array(F.lit(0.0))).schema
    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> AdditiveModel:
    """Learn from the documents of label rows where ``train`` (of the label row) holds."""
    own = labels.where(train & F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_label"))
    count = own.count()
    if count > rows:
        share = int(rows / count * (1 << 30))
        own = own.where(F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 30)) < share)
    # At most about ``rows`` pairs of numbers: small enough to go to every task.
    chosen = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(own), "_id")
    found = with_features(chosen.select("_id", "_label", "text")).select("_id", "_label", "features").toArrow().sort_by([("_id", "ascending"), ("_label", "ascending")])
    x = np.array(found["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_rows(x, found["_label"].to_numpy().astype(float))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """The documents, without text, with their ``score`` in place of such a column."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.flat(pa.chunked_array([batch.column(at)]))
            for low, high in W.cuts(offsets, SLICE_BYTES):
                x = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                kept = batch.slice(low, high - low)
                columns = [c for k, c in enumerate(kept.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.probability(x))], names=[n for n in names if n != text] + ["score"])

    return docs.mapInArrow(run, docs.drop(text).withColumn("score", F.lit(0.0)).schema)


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id", 5))
    scored = score(docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Hard negatives of anchors by integer inner products of tiles.

All rows are packed into tiles in the order of label and id, the anchors into blocks in the same
order. A block and a tile are multiplied by Strassen's recursion: both are filled up with zeros
to sizes that halve evenly, seven products of halves take the place of eight, and all sums are
sums of 64-bit integers. What those give beyond 64 bits is cut off on every way to a result, so
results are exact wherever the inner products themselves fit 64 bits.

There are two rounds. In the first a block meets the tiles whose labels overlap its own, and each
anchor keeps a heap of its best rows of the same label. In the second it meets the tiles that
hold any other label, and each pair of anchor and positive keeps a heap of the best rows
whose score lies in the positive's window. Heaps are bounded, so those of the tiles that a task
has seen are merged there, and those of all tasks by Spark; what travels is one heap for
each task and anchor and never a score for each pair. Tiles lie in panels; a block is sent once
to each panel, in the narrowest integers that hold its numbers.

Defined cases: rows without id, label or vector, or with a null or non-finite component, take no
part; shorter vectors count as filled up with zeros; equal rows count once; different rows under
one id are rows of their own but never candidates of each other; fewer rows than asked for give
all; ties go to the smaller id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimwright.llm.blocks import saved
from claimwright.llm.registry import query

#: Rows of a tile, anchors of a block, tiles of a panel.
TILE, BLOCK, PANEL = 2_048, 256, 8
#: Strassen's recursion ends where a side is not above this.
LEAF = 16
#: Blocks whose heaps a task holds at once.
HELD = 64
SCALE, POSITIVES, NEGATIVES, EVERY = 256, 5, 5, 100

_PACKED = "panel int, place long, low long, high long, ids binary, labels binary, vectors binary, width int"


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of 64-bit integers, modulo 2**64."""
    levels, least = 0, min(a.shape[0], a.shape[1], b.shape[1])
    while least > leaf:
        levels, least = levels + 1, -(-least // 2)
    step = 1 << levels
    m, k, n = (-(-s // step) * step for s in (a.shape[0], a.shape[1], b.shape[1]))
    left, right = np.zeros((m, k), np.int64), np.zeros((k, n), np.int64)
    left[: a.shape[0], : a.shape[1]], right[: b.shape[0], : b.shape[1]] = a, b
    return _strassen(left, right, levels)[: a.shape[0], : b.shape[1]]


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return _leaf(a, b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    both = _strassen(a11 + a22, b11 + b22, levels - 1)
    low_left = _strassen(a21 + a22, b11, levels - 1)
    up_right = _strassen(a11, b12 - b22, levels - 1)
    down = _strassen(a22, b21 - b11, levels - 1)
    across = _strassen(a11 + a12, b22, levels - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, n:] = up_right + across
    out[m:, :n] = low_left + down
    out[:m, :n] = both + down - across + _strassen(a12 - a22, b21 + b22, levels - 1)
    out[m:, n:] = both - low_left + up_right + _strassen(a21 - a11, b11 + b12, levels - 1)
    return out


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of small sides: in doubles where these hold every sum exactly."""
    most = float(max(a.max(initial=0), -float(a.min(initial=0)))) * float(max(b.max(initial=0), -float(b.min(initial=0)))) * a.shape[1]
    return (a.astype(float) @ b.astype(float)).astype(np.int64) if most < 2**52 else a @ b


class Heaps:
    """The best few entries for each slot, by score and then smaller id; heaps of different
    tiles, tasks and partitions merge to the heap of all."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.slot, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, ~score, slot))  # ~x falls as x grows, at both ends of the range too
        slot, score, ids = slot[order], score[order], ids[order]
        kept = np.arange(len(slot)) - np.searchsorted(slot, slot, "left") < self.size
        self.slot, self.score, self.ids = slot[kept], score[kept], ids[kept]

    def least(self, slots: int) -> np.ndarray:
        """The score below which nothing enters a slot."""
        out = np.full(slots, np.iinfo(np.int64).min)
        full = np.bincount(self.slot, minlength=slots) >= self.size if len(self.slot) else np.zeros(slots, bool)
        last = np.searchsorted(self.slot, np.arange(slots), "right") - 1
        out[full] = self.score[last[full]]
        return out


def positives(heaps: Heaps, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, own_ids: np.ndarray, own_labels: np.ndarray) -> None:
    """Let the rows of a tile with an anchor's label enter its heap."""
    enters = (labels[:, None] == own_labels) & (ids[:, None] != own_ids) & (scores >= heaps.least(len(ids))[:, None])
    a, b = np.nonzero(enters)
    heaps.add(a, scores[a, b], own_ids[b])


def window_floor(score: np.ndarray) -> np.ndarray:
    """The least integer that is at least 80 % of each score."""
    return score - score // 5


def negatives(heaps: Heaps, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, own_ids: np.ndarray, own_labels: np.ndarray, anchor: np.ndarray, positive_score: np.ndarray) -> None:
    """Let the rows of a tile with another label enter the heaps of the windows they lie in;
    ``anchor`` and ``positive_score`` tell the windows, one slot each."""
    if not len(anchor):
        return
    floor = np.maximum(window_floor(positive_score), heaps.least(len(anchor)))
    low, high = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), np.iinfo(np.int64).min)
    np.minimum.at(low, anchor, floor)
    np.maximum.at(high, anchor, positive_score)
    # What lies in no window of its anchor is left out at once; the rest meets each window.
    a, b = np.nonzero((scores >= low[:, None]) & (scores <= high[:, None]) & (labels[:, None] != own_labels) & (ids[:, None] != own_ids))
    first, last = np.searchsorted(a, anchor, "left"), np.searchsorted(a, anchor, "right")
    size = last - first
    total = np.concatenate([[0], np.cumsum(size)])
    slot = np.repeat(np.arange(len(anchor)), size)
    at = np.arange(total[-1]) + np.repeat(first - total[:-1], size)
    score = scores[a[at], b[at]]
    inside = (score >= floor[slot]) & (score <= positive_score[slot])
    heaps.add(slot[inside], score[inside], own_ids[b[at[inside]]])


def labelled_vectors(table: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """``id``, ``label`` and ``v``, the scaled integer components, of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    chosen = table.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"), finite.alias("finite")).where("id is not null and label is not null and finite")
    return chosen.select("id", "label", F.transform("x", lambda c: F.floor(c.cast("double") * scale)).alias("v")).distinct()


def _packer(dimensions: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                v = part.column(2).flatten().to_numpy().reshape(len(ids), dimensions)
                width = next((w for w in (1, 2, 4) if -(1 << 8 * w - 1) <= v.min(initial=0) and v.max(initial=0) < 1 << 8 * w - 1), 8)
                row = [partition, partition << 32 | count, int(labels.min()), int(labels.max()), ids.tobytes(), labels.tobytes(), v.astype(f"<i{width}").tobytes(), width]
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])
                count += 1

    return run


def _packed(rows: DataFrame, dimensions: int, n: int, most: int, name: str) -> DataFrame:
    """Rows in the order of label and id, packed; a hot label falls into many ranges."""
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dimensions) - F.size("v")))
    rows = rows.select("id", "label", filled.alias("v")).repartitionByRange(n, "label", "id").sortWithinPartitions("label", "id", "v")
    return saved(rows.mapInArrow(_packer(dimensions, most), _PACKED), name)


def _unpacked(batch: pa.RecordBatch, side: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, vectors = (batch[f"{side}_{c}"][k].as_buffer() for c in ("ids", "labels", "vectors"))
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(labels, np.int64), np.frombuffer(vectors, f"<i{batch[f'{side}_width'][k].as_py()}").astype(np.int64).reshape(len(ids), -1)


def _met(blocks: DataFrame, tiles: DataFrame, panels: int, *more: str) -> DataFrame:
    """Blocks beside the tiles of every panel."""
    columns = ("low", "high", "ids", "labels", "vectors", "width")
    left = blocks.select("place", *(F.col(c).alias(f"q_{c}") for c in columns), *more, F.explode(F.sequence(F.lit(0), F.lit(panels - 1))).alias("panel"))
    return left.join(tiles.select("panel", *(F.col(c).alias(f"t_{c}") for c in columns)), "panel")


def hard_negatives(table: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
                   scale: int = SCALE, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows
    where ``is_anchor`` (a condition on ``id``) holds."""
    rows = saved(labelled_vectors(table, key, vector, F.col("label") if label is None else label, scale), "rows")
    total, dimensions = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dimensions = max(dimensions or 1, 1)
    anchors = rows.where(is_anchor)
    tiles = _packed(rows, dimensions, max(1, -(-total // (TILE * PANEL))), TILE, "tiles")
    blocks = _packed(anchors, dimensions, max(1, -(-anchors.count() // BLOCK)), BLOCK, "blocks")
    panels = (tiles.agg(F.max("panel")).first()[0] or 0) + 1

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, Heaps]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for place, (ids, heaps) in held.items():
                columns = [np.full(len(heaps.slot), place), heaps.slot, ids[heaps.slot], heaps.score, heaps.ids]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "anchor", "anchor_id", "score", "id"])
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                place = batch["place"][k].as_py()
                if place not in held and len(held) >= HELD:
                    yield from emit()
                ids, labels, q = _unpacked(batch, "q", k)
                own_ids, own_labels, v = _unpacked(batch, "t", k)
                positives(held.setdefault(place, (ids, Heaps(n_positives)))[1], ids, labels, product(q, v.T), own_ids, own_labels)
        yield from emit()

    same = _met(blocks, tiles, panels).where("q_low <= t_high and t_low <= q_high")
    found = same.mapInArrow(first_round, "place long, anchor long, anchor_id long, score long, id long")
    order = Window.partitionBy("place", "anchor").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n_positives)
    # A block has a bounded number of anchors, and these of positives.
    windows = found.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("anchor", "r", "score", "id"))).alias("windows"))
    asked = saved(blocks.join(windows, "place"), "asked")

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, tuple[np.ndarray, ...], Heaps]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for place, (ids, (anchor, score, positive), heaps) in held.items():
                columns = [np.full(len(heaps.slot), place), heaps.slot, ids[anchor[heaps.slot]], positive[heaps.slot], score[heaps.slot], heaps.score, heaps.ids]
                names = ["place", "slot", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                place = batch["place"][k].as_py()
                if place not in held and len(held) >= HELD:
                    yield from emit()
                ids, labels, q = _unpacked(batch, "q", k)
                own_ids, own_labels, v = _unpacked(batch, "t", k)
                if place not in held:
                    own = batch["windows"][k].values
                    held[place] = ids, tuple(own.field(c).to_numpy() for c in ("anchor", "score", "id")), Heaps(n_negatives)
                anchor, score, _ = held[place][1]
                negatives(held[place][2], ids, labels, product(q, v.T), own_ids, own_labels, anchor, score)
        yield from emit()

    other = _met(asked, tiles, panels, "windows").where("not (q_low = q_high and t_low = t_high and q_low = t_low)")
    mined = other.mapInArrow(second_round, "place long, slot long, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long")
    order = Window.partitionBy("place", "slot").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query(
    "op11_hard_negatives",
    """
    WITH kept AS (
        SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
               [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
    ), scored AS MATERIALIZED (
        SELECT a.id AS anchor_id, a.label AS anchor_label, a.v AS anchor_v, c.id, c.label,
               CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM kept a JOIN kept c ON a.id <> c.id WHERE a.id % 100 = 0
    ), positive AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY anchor_id, anchor_label, anchor_v ORDER BY score DESC, id) AS r
        FROM scored WHERE label = anchor_label QUALIFY r <= 5
    ), mined AS (
        SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, p.anchor_v, p.r ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
        FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND n.anchor_label = p.anchor_label AND n.anchor_v = p.anchor_v
        WHERE n.label <> n.anchor_label AND 80 * p.score <= 100 * n.score AND n.score <= p.score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 5
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table, F.col("id") % EVERY == 0, label=label)

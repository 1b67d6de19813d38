"""Exact top-k inner products over vectors in the order of their lengths.

Vectors are packed into tiles by descending length, queries into blocks. A block first meets
the tiles of the longest vectors, which gives each query a score that its k-th best will not
fall below. By Cauchy and Schwarz no vector shorter than that score over the query's length
can enter, so the block needs only the tiles down to some length, a prefix of the tiles.
Within a tile all vectors are rotated by the singular vectors of a sample, which moves most
of their length to the front: a partial sum over the leading components plus the product of
the lengths of the rests bounds the score from above, and only stretches in which a bound
reaches the query's k-th best are summed exactly, in integers.

The rotation is fitted on at most about ``SAMPLE`` vectors; it decides what is pruned and never
a result. Memory of a task is one tile and one block.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows
without id, take no part; shorter vectors count as filled up with zeros; equal rows count
once; rows that share an id are never candidates of each other; fewer than k candidates give
all; ties go to the smaller id; extra columns are ignored.
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

SAMPLE, TILE, STRETCH, BLOCK, SEEDS = 20_000, 4_096, 512, 512, 2
SCALE, TOP, EVERY = 1024, 10, 100

_PACKED = "panel int, place long, longest double, ids binary, vectors binary"
#: Tiles of a panel, the unit in which blocks are sent.
PANEL = 8


def integer_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v``, the scaled integer components, of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    chosen = table.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return chosen.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v")).distinct()


def _filled(v: Column, dimensions: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(dimensions) - F.size(v)))


def _packer(dimensions: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                part = batch.slice(low, most)
                ids = part.column(0).to_numpy()
                v = part.column(1).flatten().to_numpy().reshape(-1, dimensions)
                longest = float(np.sqrt((v.astype(float) ** 2).sum(1).max()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([panel], pa.int32()), pa.array([panel << 32 | count]), pa.array([longest]), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())],
                    names=["panel", "place", "longest", "ids", "vectors"],
                )
                count += 1

    return run


def _unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(vectors, np.int64).reshape(len(names), -1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in floats where these hold every sum exactly."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64) if bound < 2**52 else a @ b.T


class Best:
    """The best candidates of each query so far, by score and then smaller id."""

    def __init__(self, queries: int, top: int, floor: np.ndarray) -> None:
        self.top, self.floor = top, floor
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = floor.copy()

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        q, i, s = np.concatenate([self.query, query]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept = rank < self.top
        self.query, self.ids, self.scores = q[kept], i[kept], s[kept]
        full = rank == self.top - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])


def search(best: Best, names: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray) -> int:
    """Let the vectors of a tile enter ``best``; the number of exact products summed up."""
    lead = max(1, queries.shape[1] // 4)
    q, v = queries @ rotation, vectors @ rotation
    q_length, v_length = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    q_rest, v_rest = np.linalg.norm(q[:, lead:], axis=1), np.linalg.norm(v[:, lead:], axis=1)
    order = np.argsort(-v_length, kind="stable")
    summed = 0
    for low in range(0, len(order), STRETCH):
        own = order[low : low + STRETCH]
        slack = 1.0 + 1e-6 * q_length * v_length[own[0]]
        active = np.flatnonzero(q_length * v_length[own[0]] + slack >= best.least)
        if not len(active):
            break  # all later vectors are shorter
        bound = q[active, :lead] @ v[own, :lead].T + np.outer(q_rest[active], v_rest[own]) + slack[active, None]
        reach = (bound >= best.least[active, None]) & (names[active][:, None] != ids[own][None, :])
        rows, columns = reach.any(1), reach.any(0)
        if not rows.any():
            continue
        scores = exact_products(queries[active[rows]], vectors[own[columns]])
        summed += scores.size
        good = reach[np.ix_(rows, columns)] & (scores >= best.least[active[rows], None])
        a, b = np.nonzero(good)
        best.add(active[rows][a], ids[own[columns]][b], scores[a, b])
    return summed


def _rotation(vectors: DataFrame, rows: int, dimensions: int) -> np.ndarray:
    share = int(min(1.0, SAMPLE / max(rows, 1)) * (1 << 30))
    sample = vectors.where(F.pmod(F.xxhash64("id", F.lit("rotation")), F.lit(1 << 30)) < share).select("v").toArrow()
    if not sample.num_rows:
        return np.eye(dimensions)
    x = np.array(sample["v"].to_pylist(), float)
    return np.linalg.svd(x.T @ x)[0]


def top_k(table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """For each row where ``is_query`` (a condition on ``id``) holds, its ``top`` best others:
    ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = table.sparkSession
    vectors = integer_vectors(table, key, vector)
    size = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    rows, dimensions = size[0], size[1] or 1
    result = "query_id long, vec_id long, score long"
    vectors = vectors.select("id", _filled(F.col("v"), dimensions).alias("v"))
    rotation = spark.sparkContext.broadcast(_rotation(vectors, rows, dimensions))
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    ordered = vectors.withColumn("length", squares).repartitionByRange(max(1, -(-rows // (TILE * PANEL))), F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id", "v")
    tiles = saved(ordered.select("id", "v").mapInArrow(_packer(dimensions, TILE), _PACKED), "tiles")
    # Panels are ranges of lengths, the longest first: those a block needs are the first ones.
    panels = tiles.groupBy("panel").agg(F.max("longest").alias("longest"))
    count = (tiles.agg(F.max("panel")).first()[0] or 0) + 1
    first = tiles.orderBy("panel", "place").limit(SEEDS).select("ids", "vectors").collect()
    seeds = spark.sparkContext.broadcast([_unpack(r["ids"], r["vectors"]) for r in first])
    asked = vectors.where(is_query)
    asked = asked.repartition(max(1, -(-asked.count() // BLOCK)), "id").select("id", "v").mapInArrow(_packer(dimensions, BLOCK), _PACKED)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The floor under each query's k-th best, and the length below which a block needs no tile."""
        for batch in batches:
            floors, needed = [], []
            for ids, packed in zip(batch["ids"].to_pylist(), batch["vectors"].to_pylist(), strict=True):
                names, queries = _unpack(ids, packed)
                best = Best(len(names), top, np.full(len(names), -(2.0**62)))
                for tile_ids, tile in seeds.value:
                    search(best, names, queries, tile_ids, tile, rotation.value)
                own = np.maximum(np.linalg.norm(queries.astype(float), axis=1), 1e-9)
                needed.append(float(np.where(best.least > 0, best.least / own * (1 - 1e-6), 0.0).min()))
                floors.append(best.least.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["place"], batch["ids"], batch["vectors"], pa.array(floors, pa.binary()), pa.array(needed, pa.float64())], names=["place", "q_ids", "q_vectors", "floors", "needed"]
            )

    blocks = saved(asked.mapInArrow(seed, "place long, q_ids binary, q_vectors binary, floors binary, needed double"), "queries")
    # Which panels a block meets is decided on numbers alone; then it is sent to those.
    pairs = blocks.select("place", "needed", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("panel")).join(panels, "panel").where("longest >= needed").select("place", "panel")
    met = pairs.join(blocks, "place").join(tiles.select("panel", "ids", "vectors", F.col("longest").alias("own")), "panel").where("own >= needed")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_vectors, floors, ids, packed in zip(*(batch[c].to_pylist() for c in ("q_ids", "q_vectors", "floors", "ids", "vectors")), strict=True):
                names, queries = _unpack(q_ids, q_vectors)
                best = Best(len(names), top, np.frombuffer(floors, float).copy())
                search(best, names, queries, *_unpack(ids, packed), rotation.value)
                yield pa.RecordBatch.from_arrays([pa.array(names[best.query]), pa.array(best.ids), pa.array(best.scores)], names=["query_id", "vec_id", "score"])

    found = met.select("q_ids", "q_vectors", "floors", "ids", "vectors").mapInArrow(meet, result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


@query(
    "op8_top_k",
    """
    WITH kept AS (
        SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    ), ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % EVERY == 0)

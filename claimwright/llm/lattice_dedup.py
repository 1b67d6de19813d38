"""Near duplicates among vectors by hashing to E8 lattice points.

Two vectors link when their cosine reaches ``LINK``. Copies are one class from the start.

1. Classes are dealt by a first lattice cell and put into balls there: all members of a ball lie
   within half the link's angle of its centre, so they all link with each other and none of
   these links is ever listed. A large group of near copies is a few balls.
2. Each vector is projected at random to sixteen dimensions, in several tables, and decoded to
   the nearest point of E8 x E8; that is its home cell. It also visits the neighbouring cells
   that its projection is nearest to. Two balls are candidates if a member of one visits or has
   its home where a member of the other has its home.
3. Under a cell, signs of 128 more projections of the balls' centres let through what can
   link, with five standard deviations to spare on top of both radii. A crowded cell is cut
   into units of bounded size, each some homes against some visitors.
4. Each candidate pair of balls is decided once, in doubles: by the triangle inequality for all
   members together, or by the cosines of all members of one with all of the other.
5. Links are added up by ball and member, and components are those of the balls.

What a cell holds is never cut off. A pair just at the link's angle meets with a probability of
about 0.99, nearer ones almost surely; tests measure it against all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; shorter vectors count as filled up with zeros; repeated rows, and rows that share an id
or have none, are vectors of their own; a row without id has the least id of its component, and is
kept only where that has none; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm.blocks import saved
from claimwright.llm.graph import components
from claimwright.llm.registry import query

LINK = 0.9
#: Tables, neighbouring cells visited in each, spread of the projections against lattice cells.
TABLES, PROBES, SPREAD = 5, 8, 0.4
#: Members of a ball at the most, rows that are put into balls together, rows of a side of a unit.
BALL, RUN, UNIT = 1_024, 2_048, 1_024
#: Pairs that are compared at once.
STRETCH = 1 << 21
SIGNS, SPARE = 128, 5.0
SEED = 8

_CELLS = "cell long, home boolean, ball long, sign0 long, sign1 long, radius int"
_BALLS = "ball long, weight long, radius double, centre binary, vectors binary, width int, h1 array<long>, h2 array<long>, copies array<long>, least array<long>"
_VERIFIED = "ball long, member int, links long, other long"


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two places of ±1, or all of ±1/2 with an even number of
    minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            out.append([s if k == i else t if k == j else 0.0 for k in range(8)])
    out += [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = roots()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    rest = x[odd] - near[odd]
    worst = np.abs(rest).argmax(1)
    near[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is the integer points of even sum and those moved by 1/2."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


class Lattice:
    """Projections of one dimensionality, the same in every task."""

    def __init__(self, dimensions: int, tables: int = TABLES, probes: int = PROBES) -> None:
        rng = np.random.default_rng([SEED, dimensions])
        self.probes = probes
        self.tables = [rng.normal(size=(dimensions, 16)) * SPREAD for _ in range(tables)]
        self.signs = rng.normal(size=(dimensions, SIGNS))
        self.mixers = rng.integers(-(2**62), 2**62, size=(tables, 16)) | 1
        # A move in either half, or one of the nearest in both.
        few = min(4, probes)
        self.moves = np.array([(i, -1) for i in range(probes)] + [(-1, i) for i in range(probes)] + [(i, j) for i in range(few) for j in range(few)])

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of unit vectors in each table, and the cells they visit."""
        homes = np.empty((len(v), len(self.tables)), np.int64)
        visits = np.empty((len(v), len(self.tables), self.probes), np.int64)
        for t, projection in enumerate(self.tables):
            x = v @ projection
            points, nearest, costs = [], [], []
            for half in (x[:, :8], x[:, 8:]):
                point = nearest_point(half)
                towards = (half - point) @ ROOTS.T
                best = np.argpartition(-towards, self.probes - 1, 1)[:, : self.probes]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(towards, best, 1), 1, kind="stable"), 1)
                points.append(point)
                nearest.append(best)
                costs.append(2 - 2 * np.take_along_axis(towards, best, 1))  # a root has length two, squared
            # One more column for a half that stays where it is.
            cost = [np.concatenate([c, np.zeros((len(v), 1))], 1) for c in costs]
            cost = cost[0][:, self.moves[:, 0]] + cost[1][:, self.moves[:, 1]]
            chosen = self.moves[np.argsort(cost, 1, kind="stable")[:, : self.probes]]
            mixer = self.mixers[t]
            # Twice the points are integers, and a hash that adds up moves by adding.
            homes[:, t] = (np.concatenate(points, 1) * 2).astype(np.int64) @ mixer + t
            visits[:, t] = homes[:, t, None]
            for half in (0, 1):
                moved = np.append((ROOTS * 2).astype(np.int64) @ mixer[8 * half : 8 * half + 8], 0)
                index = np.concatenate([nearest[half], np.full((len(v), 1), len(ROOTS))], 1)
                visits[:, t] += moved[np.take_along_axis(index, chosen[:, :, half] % index.shape[1], 1)]
        return homes, visits

    def sketch(self, v: np.ndarray) -> np.ndarray:
        """Signs of the other projections, as two 64-bit numbers each."""
        return np.packbits(v @ self.signs > 0, axis=1).view(np.int64)


_LATTICES: dict[int, Lattice] = {}


def lattice(dimensions: int) -> Lattice:
    if dimensions not in _LATTICES:
        _LATTICES[dimensions] = Lattice(dimensions)
    return _LATTICES[dimensions]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in doubles; large and small numbers are brought near one first."""
    v = v.astype(float)
    v = v / np.maximum(np.abs(v).max(1, keepdims=True, initial=0), np.finfo(float).tiny)
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), np.finfo(float).tiny)


def angles(x: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x, -1.0, 1.0))


def balls_of(v: np.ndarray, most: int, link: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Unit vectors in balls: members, centre and radius, which is at most half the link's angle."""
    half = math.acos(link) / 2 * (1 - 1e-6)
    if len(v) == 1:
        return [(np.zeros(1, np.int64), v[0], 0.0)]
    near = v @ v.T >= math.cos(half)
    left, out = np.ones(len(v), bool), []
    for first in range(len(v)):
        if not left[first]:
            continue
        members = np.flatnonzero(near[first] & left)[:most]
        centre, radius = v[first], 0.0
        if len(members) > 1:
            # The middle of what is near a member is nearer to all of them.
            middle = unit(v[members].mean(0, keepdims=True))[0]
            far = angles(v[members] @ middle)
            inside = far <= half
            if members[0] == first and inside[0]:
                members, centre, radius = members[inside], middle, float(far[inside].max()) + 1e-7
            else:
                members = members[:1]
        left[members] = False
        out.append((members, centre, radius))
    return out


def sign_limits(link: float) -> np.ndarray:
    """Signs in which the centres of linked balls may differ, for the sum of their radii in
    steps of 1/255 of half the link's angle."""
    theta = math.acos(link)
    share = np.minimum((theta + np.arange(511) * theta / 2 / 255) / math.pi, 1.0)
    return np.minimum(SIGNS * share + SPARE * np.sqrt(SIGNS * share * (1 - share)) + 1, SIGNS)


def linked(a: np.ndarray, b: np.ndarray, link: float) -> np.ndarray:
    """Which pairs of vectors reach the cosine; what rounding could turn is computed anew, from
    the vectors themselves."""
    x, y = unit(a), unit(b)
    cosine = x @ y.T
    found = cosine >= link
    for i, j in zip(*np.nonzero(np.abs(cosine - link) < 1e-9), strict=True):
        p, q = a[i].astype(float), b[j].astype(float)
        exact = math.fsum(p * q) / (math.sqrt(math.fsum(p * p)) * math.sqrt(math.fsum(q * q)))
        found[i, j] = exact >= link if math.isfinite(exact) else found[i, j]
    return found


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _with_cell(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(dimensions)
        for batch in batches:
            if batch.num_rows:
                homes, _ = own.cells(unit(_vectors(batch["v"], batch.num_rows)))
                yield pa.RecordBatch.from_arrays([pa.array(homes[:, 0]), *batch.columns], names=["cell", *batch.schema.names])

    return run


def _ball_maker(link: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Balls of the classes of one cell, for rows in the order of cells."""
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            cell = batch["cell"].to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, np.diff(cell) != 0)), len(cell)) if len(cell) else np.zeros(1, np.int64)
            if not len(cell):
                continue
            raw = _vectors(batch["v"], len(cell))
            # Narrow numbers where they hold the vectors exactly.
            width = 4 if raw.dtype == np.float32 or (np.abs(raw).max(initial=0) < 1e38 and (raw.astype(np.float32) == raw).all()) else 8
            v = unit(raw)
            rows: list[list] = [[] for _ in range(10)]
            copies = batch["copies"].to_numpy()
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for start in range(low, high, RUN):
                    for members, centre, radius in balls_of(v[start : min(high, start + RUN)], BALL, link):
                        at = members + start
                        lists = [batch[c].take(pa.array(at)).to_pylist() for c in ("h1", "h2", "copies", "least")]
                        row = [number, int(copies[at].sum()), radius, centre.tobytes(), raw[at].astype(f"<f{width}").tobytes(), width, *lists]
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
                        number += 1
            lists = pa.list_(pa.int64())
            types = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), lists, lists, lists, lists]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=[c.split()[0] for c in _BALLS.split(", ")])

    return run


def _members(vectors: pa.Scalar, width: int, dimensions: int) -> np.ndarray:
    return np.frombuffer(vectors.as_buffer(), f"<f{width}").reshape(-1, dimensions)


def _cell_maker(dimensions: int, link: float):
    half = math.acos(link) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells where a ball's members are at home, and cells they visit, each once."""
        own = lattice(dimensions)
        for batch in batches:
            widths = batch["width"].to_pylist()
            parts = [_members(x, w, dimensions).astype(float) for x, w in zip(batch["vectors"], widths, strict=True)]
            low = 0
            while low < len(parts):
                high, size = low, 0
                while high < len(parts) and (high == low or size + len(parts[high]) <= 8_192):
                    size, high = size + len(parts[high]), high + 1
                at = np.repeat(np.arange(low, high), [len(p) for p in parts[low:high]])
                homes, visits = own.cells(unit(np.concatenate(parts[low:high])))
                at = np.concatenate([np.repeat(at, homes.shape[1]), np.repeat(at, visits.shape[1] * visits.shape[2])])
                cell = np.concatenate([homes.reshape(-1), visits.reshape(-1)])
                visit = np.concatenate([np.zeros(homes.size, bool), np.ones(visits.size, bool)])
                order = np.lexsort((visit, cell, at))
                at, cell, visit = at[order], cell[order], visit[order]
                new = np.append(True, (at[1:] != at[:-1]) | (cell[1:] != cell[:-1]))  # home comes before visits
                at, cell, visit = at[new], cell[new], visit[new]
                centre = np.frombuffer(b"".join(c.as_py() for c in batch["centre"][low:high]), float).reshape(high - low, -1)
                signs = own.sketch(centre)
                steps = np.ceil(batch["radius"].to_numpy()[low:high] / half * 255).astype(np.int32)
                ball = batch["ball"].to_numpy()
                columns = [pa.array(cell), pa.array(~visit), pa.array(ball[at]), pa.array(signs[at - low, 0]), pa.array(signs[at - low, 1]), pa.array(steps[at - low])]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _CELLS.split(", ")])
                low = high

    return run


def met_in_units(unit_of: np.ndarray, home: np.ndarray, ball: np.ndarray, signs: np.ndarray, radius: np.ndarray, limits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of balls whose signs let them link: each home of a unit with all of the unit.
    ``unit_of`` ascends; pairs are listed in bounded stretches and only those that pass go on."""
    homes, signs = np.flatnonzero(home), signs.view(np.uint64)  # bits of a negative number are counted without its sign
    low, high = np.searchsorted(unit_of, unit_of[homes], "left"), np.searchsorted(unit_of, unit_of[homes], "right")
    total = np.concatenate([[0], np.cumsum(high - low)])
    first = 0
    while first < len(homes):
        last = max(first + 1, int(np.searchsorted(total, total[first] + STRETCH, "right")) - 1)
        size = (high - low)[first:last]
        a = np.repeat(homes[first:last], size)
        b = np.arange(total[last] - total[first]) + np.repeat(low[first:last] - (total[first:last] - total[first]), size)
        differ = np.bitwise_count(signs[a, 0] ^ signs[b, 0]).astype(np.int64) + np.bitwise_count(signs[a, 1] ^ signs[b, 1])
        passed = (differ <= limits[radius[a] + radius[b]]) & (ball[a] != ball[b])
        x, y = ball[a[passed]], ball[b[passed]]
        if len(x):
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            yield pairs[:, 0], pairs[:, 1]
        first = last


def _unit_task(link: float):
    limits = sign_limits(link)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = [rows[c].to_numpy() for c in ("cell", "i", "g")]
            change = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)) if rows.num_rows else np.zeros(0, bool)
            signs = np.stack([rows["sign0"].to_numpy(), rows["sign1"].to_numpy()], 1)
            for a, b in met_in_units(np.cumsum(change), rows["home"].to_numpy(), rows["ball"].to_numpy(), signs, rows["radius"].to_numpy(), limits):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # The last unit of what is held may go on in the next batch.
            rows = pa.Table.from_batches(held)
            keys = np.stack([rows[c].to_numpy() for c in ("cell", "i", "g")], 1)
            whole = int(np.flatnonzero((keys != keys[-1]).any(1))[-1] + 1) if (keys[0] != keys[-1]).any() else 0
            if whole:
                yield from emit(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held))

    return run


def _verifier(dimensions: int, link: float):
    theta = math.acos(link)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centre = [np.frombuffer(b"".join(batch[f"{s}_centre"].to_pylist()), float).reshape(batch.num_rows, -1) for s in "ab"]
            apart = angles((centre[0] * centre[1]).sum(1))
            reach = batch["a_radius"].to_numpy() + batch["b_radius"].to_numpy()
            balls, weights = [[batch[f"{s}_{c}"].to_numpy() for s in "ab"] for c in ("ball", "weight")]
            inside = (apart + reach <= theta - 1e-6) & (reach > 0)
            out: list[tuple[int, int, int, int | None]] = []
            for k in np.flatnonzero(inside).tolist():
                a, b = int(balls[0][k]), int(balls[1][k])
                out += [(a, -1, int(weights[1][k]), b), (b, -1, int(weights[0][k]), None)]
            for k in np.flatnonzero(~inside & (apart - reach <= theta + 1e-6)).tolist():
                a, b = int(balls[0][k]), int(balls[1][k])
                v = [_members(batch[f"{s}_vectors"][k], batch[f"{s}_width"][k].as_py(), dimensions) for s in "ab"]
                copies = [batch[f"{s}_copies"][k].values.to_numpy() for s in "ab"]
                found = linked(*v, link)
                if found.any():
                    sums = found @ copies[1], copies[0] @ found
                    out += [(a, int(m), int(sums[0][m]), b) for m in np.flatnonzero(sums[0]).tolist()]
                    out += [(b, int(m), int(sums[1][m]), None) for m in np.flatnonzero(sums[1]).tolist()]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["ball", "member", "links", "other"])

    return run


def candidates(balls: DataFrame, dimensions: int, link: float) -> DataFrame:
    """Pairs of balls ``a`` < ``b`` that meet in a cell and whose signs let them link."""
    entries = saved(balls.select("ball", "radius", "centre", "vectors", "width").mapInArrow(_cell_maker(dimensions, link), _CELLS), "cells")
    cells = entries.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all"))
    cells = cells.where("homes > 0 and all > 1").select("cell", F.ceil(F.col("homes") / UNIT).cast("int").alias("parts"))
    met = entries.join(cells, "cell")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.pmod(F.xxhash64("ball"), F.col("parts")).cast("int")
    # Homes stand in their part's units; visitors, and homes of several parts, in a unit of each part.
    left = met.where("home").withColumn("i", own).withColumn("g", F.explode(every))
    right = met.where("not home or parts > 1").withColumn("home", F.lit(False)).withColumn("g", own).withColumn("i", F.explode(every))
    units = left.unionByName(right).select("cell", "i", "g", "home", "ball", "sign0", "sign1", "radius")
    dealt = units.repartition("cell", "i", "g").sortWithinPartitions("cell", "i", "g")
    return saved(dealt.mapInArrow(_unit_task(link), "a long, b long").distinct(), "candidates")


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", link: float = LINK) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    usable = finite & F.exists(x, lambda c: c != 0)
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.when(usable, F.transform(x, lambda c: c + F.lit(0).cast("float"))).alias("v"))
    dimensions = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if dimensions <= 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    blank = F.array_repeat(F.lit(0).cast("float"), F.lit(dimensions) - F.size("v"))
    rows = rows.withColumn("v", F.concat("v", blank))
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"))
    classes = rows.where(F.col("v").isNotNull()).groupBy("h1", "h2", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = saved(classes, "classes")
    n = classes.count()
    placed = classes.mapInArrow(_with_cell(dimensions), "cell long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema))
    # By range of cell and hash: a cell that holds a third of all rows falls into many partitions.
    placed = placed.repartitionByRange(max(1, -(-n // (8 * RUN))), "cell", "h1", "h2").sortWithinPartitions("cell", "h1", "h2")
    balls = saved(placed.mapInArrow(_ball_maker(link), _BALLS), "balls")
    pairs = candidates(balls, dimensions, link)
    sides = ("ball", "weight", "radius", "centre", "vectors", "width", "copies")
    for side in "ab":
        pairs = pairs.join(balls.select(*(F.col(c).alias(f"{side}_{c}") for c in sides)), F.col(side) == F.col(f"{side}_ball"))
    verified = saved(pairs.drop("a", "b").mapInArrow(_verifier(dimensions, link), _VERIFIED), "verified")
    edges = components(verified.where("other is not null").select(F.col("ball").alias("a"), F.col("other").alias("b")).distinct())
    sums = verified.groupBy("ball", "member").agg(F.sum("links").alias("links"))
    whole = sums.where("member = -1").select("ball", F.col("links").alias("whole"))
    members = balls.select("ball", "weight", F.posexplode(F.arrays_zip("h1", "h2", "least")).alias("member", "own"))
    members = members.select("ball", "weight", "member", "own.h1", "own.h2", "own.least").join(whole, "ball", "left").join(sums.where("member >= 0"), ["ball", "member"], "left")
    links = F.col("weight") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("links", F.lit(0))
    members = members.join(edges, F.col("ball") == F.col("node"), "left").select("h1", "h2", "least", links.alias("n_links"), F.coalesce("root", "ball").alias("root"))
    members = saved(members, "members")
    least = members.groupBy("root").agg(F.min("least").alias("component"))
    found = members.join(least, "root").select("h1", "h2", "n_links", "component")
    out = rows.select("vec_id", "h1", "h2", F.col("v").isNotNull().alias("used")).join(found.withColumn("used", F.lit(True)), ["h1", "h2", "used"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query(
    "op12_lattice_dedup",
    """
    WITH RECURSIVE own AS (
        SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    ), usable AS MATERIALIZED (
        SELECT r, v, sqrt(list_dot_product(v, v)) AS length FROM own
        WHERE v IS NOT NULL AND len([x for x in v if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND list_dot_product(v, v) > 0
    ), links AS MATERIALIZED (
        SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.r <> b.r
        WHERE list_dot_product(a.v, b.v) / (a.length * b.length) >= 0.9
    ), reach(r, other) AS (
        SELECT r, r FROM own UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.other = links.a
    ), least AS (
        SELECT reach.r, min(own.vec_id) AS component_id FROM reach JOIN own ON own.r = reach.other GROUP BY reach.r
    )
    SELECT own.vec_id, (SELECT count(*) FROM links WHERE links.a = own.r) AS n_links, least.component_id, own.vec_id IS NOT DISTINCT FROM least.component_id AS kept
    FROM own JOIN least USING (r)
    """,
)
def op12_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Hard negatives, near vectors and token alignment."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import ordered
from tools.check import compare

from claimwright.llm import hard_negatives, lattice_dedup, token_alignment
from claimwright.llm.registry import ORACLES, QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_lattice_dedup"])
def test_vector_queries(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
        assert compare(QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df()) == "ok"


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 64, 300), (33, 5, 40), (70, 17, 65), (3, 200, 2)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(0)
    m, k, n = shape
    for most in (3, 1 << 20, 1 << 29):
        a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
        assert (hard_negatives.product(a, b, 4) == a @ b).all()


def test_heaps_merge_to_the_heap_of_all():
    rng = np.random.default_rng(1)
    slot, score, ids = rng.integers(0, 5, 400), rng.integers(-3, 3, 400), rng.permutation(400)
    score[:2] = [-(2**63), 2**63 - 1]
    whole, parts = hard_negatives.Heaps(7), hard_negatives.Heaps(7)
    whole.add(slot, score, ids)
    for part in np.array_split(np.arange(400), 9):
        own = hard_negatives.Heaps(7)
        own.add(slot[part], score[part], ids[part])
        parts.add(own.slot, own.score, own.ids)
    for x, y in ((whole.slot, parts.slot), (whole.score, parts.score), (whole.ids, parts.ids)):
        assert (x == y).all()


def vector_rows():
    own = random.Random(3)
    rows = [(k, k % 3 if k % 11 else None, [own.gauss(0, 1) + (k % 3) for _ in range(7)]) for k in range(120)]
    rows += [(200, 1, None), (201, 1, [None, 1.0]), (202, 2, [float("nan")] * 7), (203, 0, [float("inf")] + [0.0] * 6), (204, 0, []), (205, 0, [1.0, 2.0]), (None, 1, [1.0] * 7)]
    rows += [rows[10], rows[10], (20, 1, [2.0] * 7), (20, 2, [0.5] * 7), (210, 0, rows[0][2]), (211, 1, rows[0][2]), (212, 0, [0.0] * 7)]
    return rows


def test_hard_negative_edges(spark, monkeypatch):
    rows = vector_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, panel int, place string")
    kept = {(i, lab, tuple(int(np.floor(256 * x)) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = ordered(brute.hard_negatives(sorted(kept), lambda i: i % 10 == 0))
    for tile, block in ((2048, 256), (16, 3)):
        monkeypatch.setattr(hard_negatives, "TILE", tile)
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        got = hard_negatives.hard_negatives(docs, F.col("id") % 10 == 0).collect()
        assert ordered(got) == expected and len(expected) > 100
    assert hard_negatives.hard_negatives(docs.where("vec_id < 0"), F.col("id") % 10 == 0).count() == 0


def test_near_vector_edges(spark):
    own = random.Random(4)
    base = [[own.gauss(0, 1) for _ in range(12)] for _ in range(40)]
    rows = [(k, v) for k, v in enumerate(base)]
    rows += [(100 + 10 * k + j, [x + own.gauss(0, 0.05 * (j + 1)) for x in base[k]]) for k in range(8) for j in range(9)]
    rows += [(300, base[0]), (300, base[0]), (300, base[1]), (None, base[2]), (None, base[2]), (None, [9.0] * 12), (301, [3 * x for x in base[3]]), (302, None), (303, []), (304, [0.0] * 12)]
    rows += [(305, [float("nan")] * 12), (306, [None] * 12), (307, [1e300 * x for x in base[4]]), (308, [1.0]), (309, [1.0] + [0.0] * 11), (310, [-0.0, 1.0]), (311, [0.0, 1.0, 0.0])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, ball int, cell string")
    got = ordered((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice_dedup.near_vectors(docs).collect())
    # Rows whose plain cosine overflows are left out of the comparison.
    expected = brute.near_vectors([(i, [x / 1e300 for x in v] if i == 307 else v) for i, v in rows])
    assert got == ordered(expected)
    assert lattice_dedup.near_vectors(docs.where("vec_id < 0")).count() == 0
    assert ordered(lattice_dedup.near_vectors(docs.where("vec_id in (302, 303)")).collect()) == [(302, 0, 302, True), (303, 0, 303, True)]


def test_decoded_points_are_nearest():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * 2
    near = lattice_dedup.nearest_point(x)
    assert len(lattice_dedup.ROOTS) == len(np.unique(lattice_dedup.ROOTS, axis=0)) == 240
    whole = (near * 2) % 2
    assert ((whole == whole[:, :1]).all(1) & (near.sum(1) % 2 == 0)).all()  # points of the lattice
    # No neighbour is nearer; the roots are all that can be.
    own = ((x - near) ** 2).sum(1)
    assert all((((x[k] - near[k] - lattice_dedup.ROOTS) ** 2).sum(1) >= own[k] - 1e-9).all() for k in range(300))


def test_pairs_at_the_link_meet():
    """Share of pairs just at the cosine that share a cell, and of farther pairs that pass the signs."""
    rng = np.random.default_rng(6)
    own = lattice_dedup.Lattice(64)
    a = lattice_dedup.unit(rng.normal(size=(4000, 64)))
    z = rng.normal(size=(4000, 64))
    z = lattice_dedup.unit(z - (z * a).sum(1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * z
    (ha, va), (hb, vb) = own.cells(a), own.cells(b)
    met = ((ha == hb) | (ha[:, :, None] == vb).any(2) | (hb[:, :, None] == va).any(2)).any(1)
    signs = np.bitwise_count((own.sketch(a) ^ own.sketch(b)).view(np.uint64)).sum(1)
    assert met.mean() > 0.98 and (signs <= lattice_dedup.sign_limits(0.9)[0]).all()
    assert (np.bitwise_count((own.sketch(a) ^ own.sketch(z)).view(np.uint64)).sum(1) <= lattice_dedup.sign_limits(0.9)[0]).mean() < 0.001


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Two overlapping groups in small balls, runs and units: no link is lost or counted twice."""
    monkeypatch.setattr(lattice_dedup, "BALL", 5)
    monkeypatch.setattr(lattice_dedup, "UNIT", 7)
    rng = np.random.default_rng(7)
    centre = lattice_dedup.unit(rng.normal(size=(2, 16)))
    v = np.concatenate([centre[0] + rng.normal(size=(150, 16)) * 0.03, centre[1] + rng.normal(size=(60, 16)) * 0.06])
    docs = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in lattice_dedup.near_vectors(docs).collect()}
    u = lattice_dedup.unit(v)
    expected = (u @ u.T >= 0.9).sum(1) - 1
    assert sum(got.values()) >= 0.98 * expected.sum() and all(got[k] <= n for k, n in enumerate(expected.tolist()))


def token_texts():
    own = random.Random(0)
    parts = [*"  \n\t'sreveLLlltmdaB9 .,!é漢x-😀　\u0085٣▁\x00ﬁ½", "'re", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", " the ", "hello world", "aaaaaaaa", "0123456789abcdef"]
    texts = ["".join(own.choice(parts) for _ in range(own.randrange(60))) for _ in range(600)]
    texts += [None, "", " ", "  ", "\n", " a", "▁", "x" * 500, "".join(own.choice("0123456789abcdef") for _ in range(3000)), "one two", "one two"]
    return texts


@pytest.mark.parametrize(("piece", "stretch"), [(1 << 16, 1 << 21), (7, 50)])
def test_alignment_of_one_slice(piece, stretch, monkeypatch):
    monkeypatch.setattr(token_alignment, "STRETCH", stretch)
    monkeypatch.setattr(token_alignment.group_bounds, "__defaults__", (piece,))
    rows = list(enumerate(token_texts()))
    own = token_alignment.align(pa.chunked_array([[i for i, _ in rows]]), pa.chunked_array([[t for _, t in rows]]), token_alignment.BytePieces(A), token_alignment.FallbackPieces(B))
    own = token_alignment.Slice.unpacked(own.packed())
    listed = list(own.pairs())
    pair, n = (np.concatenate(c) for c in zip(*listed, strict=True))
    assert len(np.unique(pair)) == len(pair)
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    most = np.zeros(60_000, np.int64)
    np.maximum.at(most, pair >> 32, n)
    scored = own.scored(pair, n, (n == most[pair >> 32]).astype(np.int64))
    got = zip(*(c.tolist() for c in (own.doc_id, own.n_a, own.n_b, own.n_groups, own.n_links, scored["n_best"], scored["count_sum"])), own.sha, strict=True)
    assert list(got) == brute.token_alignment(rows, A, B)


def test_merge_path_pieces_are_equal():
    rng = np.random.default_rng(8)
    for size in ((0, 5), (5, 0), (1000, 900), (50, 3000)):
        a, b = (np.unique(rng.integers(0, 5000, n)) for n in size)
        i, j = token_alignment.merge_path(a, b, 64)
        assert (np.diff(i + j)[:-1] == 64).all() and i[-1] == len(a) and j[-1] == len(b)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):  # what comes before is never above what follows
            assert not x or y == len(b) or a[x - 1] <= b[y]
            assert not y or x == len(a) or b[y - 1] < a[x]


def test_alignment_edges(spark, monkeypatch, edge_docs, edge_rows, no_docs):
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 2000)
    rows = edge_rows + [(1000 + k, t) for k, t in enumerate(token_texts())] + [(5000 + k, "the same row again") for k in range(40)]
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, slice int, payload binary").repartition(5)
    got = token_alignment.align_tokenizers(docs, A, B).collect()
    assert ordered(got) == ordered(brute.token_alignment(rows, A, B))
    assert token_alignment.align_tokenizers(no_docs, A, B).count() == 0


def test_alignment_query(spark, sf_dir, small_rows):
    assert ordered(QUERIES["op13_token_alignment"](spark, sf_dir).collect()) == ordered(brute.token_alignment(small_rows, A, B))

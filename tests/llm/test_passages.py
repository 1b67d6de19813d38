"""Suffix-array dedup, decontamination and the n-gram join against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import brute
from tests.llm.conftest import ordered, prose

from claimwright.llm import decontaminate, graph, ngram_join, suffix_dedup
from claimwright.llm.registry import QUERIES


def test_suffix_dedup_edges(edge_docs, edge_rows):
    assert ordered(suffix_dedup.repeated_passages(edge_docs).drop("spans").collect()) == ordered(brute.suffix_dedup(edge_rows))


def test_suffix_dedup_query(spark, sf_dir, small_rows):
    assert ordered(QUERIES["op2_suffix_dedup"](spark, sf_dir).collect()) == ordered(brute.suffix_dedup(small_rows))


def test_suffix_dedup_empty(no_docs):
    assert suffix_dedup.repeated_passages(no_docs).count() == 0


def test_longest_previous_factor():
    text = b"abracadabra_abracadabra"
    rows = np.frombuffer(b"".join(text[k : k + 6] for k in range(len(text) - 5)), np.uint8).reshape(-1, 6)
    got = suffix_dedup.longest_previous(rows, np.arange(len(rows)))

    def shared(a, b):
        return next((k for k in range(6) if text[a + k] != text[b + k]), 6)

    assert got.tolist() == [max((shared(j, i) for j in range(i)), default=0) for i in range(len(rows))]


@pytest.mark.parametrize("crowd", [0, 4_000])
def test_crowded_anchors_give_the_same(monkeypatch, edge_rows, crowd):
    """All phases of one block, without Spark, with and without windows dealt one by one."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1 << 12)
    block = pa.table({"doc_id": pa.array([i for i, _ in edge_rows], pa.int64()), "text": pa.array([t for _, t in edge_rows], pa.string()), "block": pa.array([0] * len(edge_rows), pa.int32())})
    verdicts = suffix_dedup._answer(suffix_dedup._asker(1)(block))
    block = block.take(pa.array(np.random.default_rng(0).permutation(block.num_rows)))  # rows arrive in any order
    found = suffix_dedup._find(suffix_dedup._shipper(1)(block, verdicts))
    answers = pa.concat_tables([verdicts, found.append_column("shard", pa.array([-1] * found.num_rows, pa.int32()))], promote_options="default")
    got = suffix_dedup._cutter(block, answers).drop_columns(["spans"]).to_pylist()
    assert ordered(tuple(r.values()) for r in got) == ordered(brute.suffix_dedup(edge_rows))


ITEMS = [(1, "alpha beta gamma"), (2, "one"), (3, None), (4, "!!"), (None, "Ünï cödé"), (5, " ".join(["a"] * 12)), (5, "ONE two")]


def test_contamination_edges(spark, edge_docs, edge_rows):
    passage = edge_rows[10][1]
    items = [*ITEMS, (6, passage), (7, passage.split(" ", 20)[20])]
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, source string")
    got = decontaminate.digest(decontaminate.contamination(edge_docs, table)).collect()
    assert ordered(got) == ordered(brute.contamination(edge_rows, items))
    cleaned = decontaminate.remove_spans(edge_docs, table)
    assert cleaned.columns == edge_docs.columns and cleaned.count() == edge_docs.count()
    assert cleaned.where("text is null").count() == sum(t is None for _, t in edge_rows)


def test_contamination_in_chunks(monkeypatch, spark, edge_docs, edge_rows):
    items = [*ITEMS, (6, edge_rows[10][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 40)
    got = decontaminate.digest(decontaminate.contamination(edge_docs, table)).distinct().collect()
    assert ordered(got) == ordered(set(brute.contamination(edge_rows, items)))


def test_chunks_lose_no_rows_and_no_words(monkeypatch, spark):
    passage = prose(8, 40).split(" ")
    # Windows of one item overlap spans of others; cutting one after the other loses their ends
    # and joins the words beside a cut to a window that no text holds.
    items = [(k, " ".join(passage[k : k + 12])) for k in range(0, 28, 3)] + [(90, "left right " * 5)]
    text = prose(9, 15) + " " + " ".join(passage) + " " + prose(10, 15)
    rows = [(1, text), (1, text), (1, text), (None, text), (None, text.replace(passage[20], "other")), (2, "left right left right left " + items[0][1] + " right left right left right")]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found, cut = [], []
    for size in (1 << 20, 60):
        monkeypatch.setattr(decontaminate, "CHUNK_BYTES", size)
        assert size > 60 or len(list(decontaminate._passes(table, "item_id", "text", 10))) > 5
        found.append(ordered(decontaminate.digest(decontaminate.contamination(docs, table)).collect()))
        cut.append(ordered(decontaminate.remove_spans(docs, table).collect()))
    assert found[0] == found[1] == ordered(brute.contamination(rows, items))
    assert cut[0] == cut[1]
    assert (2, "left right left right left  right left right left right") in cut[1]
    assert not {*passage[:20], *passage[21:39]} & set(next(t for i, t in cut[1] if i == 1).split()) - set(prose(9, 15).split() + prose(10, 15).split())


def test_contamination_query(spark, sf_dir, small_rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert ordered(QUERIES["op3_decontaminate"](spark, sf_dir).collect()) == ordered(brute.contamination(small_rows, items))


def test_contamination_empty(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_docs, none).count() == 0
    assert decontaminate.digest(decontaminate.contamination(edge_docs, none)).where("contaminated").count() == 0


def test_fm_index_finds_all():
    rng = np.random.default_rng(0)
    symbols = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (7, 1, 30, 12)]).astype(np.int32)
    index = decontaminate.FMIndex(symbols, 3)
    for width in (1, 2, 3):
        windows = np.array(np.meshgrid(*[[1, 2, 3]] * width)).reshape(width, -1).T.astype(np.int32)
        begin, end = index.search(windows)
        for w, a, b in zip(windows, begin, end, strict=True):
            expected = [k for k in range(len(symbols) - width + 1) if symbols[k : k + width].tolist() == w.tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_ngram_join_edges(edge_docs, edge_rows):
    assert ordered(ngram_join.near_duplicates(edge_docs).collect()) == ordered(brute.near_duplicates(edge_rows))
    kept = ngram_join.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    groups = {r[2] for r in brute.near_duplicates(edge_rows) if r[0] is not None}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(groups)


def test_ngram_join_query(spark, sf_dir, small_rows):
    assert ordered(QUERIES["op5_ngram_join"](spark, sf_dir).collect()) == ordered(brute.near_duplicates(small_rows))


def test_ngram_join_empty(no_docs):
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_overlap_bound_is_above():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, 40)), np.unique(np.concatenate([rng.choice(pool, 35), rng.integers(0, 2**63, rng.choice([0, 3000])).astype(np.uint64)]))
        ours, theirs = ngram_join._bits([ngram_join.signature(a)], [ngram_join.signature(b)])
        most = ngram_join.overlap_bound(ours, len(a), theirs, len(b))
        assert most[0] >= len(np.intersect1d(a, b))


def test_tile_pairs_meet_all_labels():
    """All pairs of different labels that can link, once each, in one tile and in two."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 75, False), rng.integers(0, 2**63, 5).astype(np.uint64)])) for _ in range(40)]
    label = np.array([k if k % 3 else 100 for k in range(40)])

    def tile(at):
        return np.array(at), np.array([len(sets[k]) for k in at]), label[at], [ngram_join.signature(sets[k]) for k in at]

    def possible(a, b):
        one, other = ngram_join._bits([ngram_join.signature(sets[a])], [ngram_join.signature(sets[b])])
        return label[a] != label[b] and ngram_join.links(ngram_join.overlap_bound(one, len(sets[a]), other, len(sets[b])), len(sets[a]), len(sets[b]))[0]

    whole, low, high = list(range(40)), list(range(15)), list(range(15, 40))
    for left, right in ((whole, whole), (low, high)):
        a, b = ngram_join.tile_pairs(tile(left), tile(right), left == right, False)
        expected = {(min(x, y), max(x, y)) for x in left for y in right if x != y and possible(x, y)}
        got = list(zip(a.tolist(), b.tolist(), strict=True))
        assert set(got) == expected and len(expected) > 20
        a, b = ngram_join.tile_pairs(tile(left), tile(right), left == right, True)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) <= expected and len(a) <= len(left) + len(right)


def test_components(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in (100, 101, 103)}

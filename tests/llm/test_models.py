"""Language model, language identification and quality model."""

import collections
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import ordered

from claimwright.llm import language_id, language_model, quality
from claimwright.llm.blocks import held_out, pack_sorted, unpack_sorted
from claimwright.llm.registry import QUERIES


def rounded(rows):
    return ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows)


def test_language_model_edges(edge_docs, edge_rows):
    got = language_model.score_texts(edge_docs, ~held_out("doc_id", 10)).collect()
    scale, power = eval(got[0].smoothing)
    assert rounded(got) == ordered(brute.language_model(edge_rows, scale, power))


def test_language_model_of_word_pairs(spark, sf_dir, small_rows):
    got = QUERIES["op1_language_model_order2"](spark, sf_dir).collect()
    scale, power = eval(got[0].smoothing)
    assert rounded(got) == ordered(brute.language_model(small_rows, scale, power))
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def plain_order_three(rows, scale, power):
    """Scores with two words of context from dictionaries of whole sequences."""
    tokens = [["<s>", "<s>", *brute.words(t), "</s>"] for _, t in rows]
    train = [not brute.held_out(i, 10) for i, _ in rows]
    count, before = collections.Counter(), collections.Counter()
    for own, learn in zip(tokens, train, strict=True):
        for at in range(2, len(own) if learn else 0):
            for n in range(3):
                count[tuple(own[at - n : at + 1])] += 1
                before[tuple(own[at - n : at])] += 1
    total, types = before[()], sum(len(g) == 1 for g in count)
    # A state that is no beginning counts wherever it ends, as the last one of a text does.
    ends = collections.Counter(tuple(own[at - n + 1 : at + 1]) for own, learn in zip(tokens, train, strict=True) if learn for at in range(2, len(own)) for n in (1, 2))
    out = {}
    for (i, t), own in zip(rows, tokens, strict=True):
        score = 0.0
        for at in range(2, len(own)):
            p = (count[(own[at],)] + 0.1) / (total + 0.1 * (types + 1))
            for n in (1, 2):
                state = tuple(own[at - n : at])
                if c := sum(train) if set(state) == {"<s>"} else ends[state]:
                    m = scale * c**power
                    p = (count[(*state, own[at])] + m * p) / (c + m)
            score += math.log10(p)
        out.setdefault((i, len(own) - 2), []).append(round(score, 6))
    return {k: sorted(v) for k, v in out.items()}


def test_language_model_with_two_words_of_context(spark, sf_dir, small_rows):
    got = QUERIES["op1_language_model"](spark, sf_dir).collect()
    scale, power = eval(got[0].smoothing)
    scores = {}
    for r in got:
        scores.setdefault((r.doc_id, r.n_tokens), []).append(r.score)
    expected = plain_order_three(small_rows, scale, power)
    assert scores.keys() == expected.keys() and all(np.allclose(sorted(v), expected[k], rtol=0, atol=1e-5) for k, v in scores.items())
    # More context than the word pairs of the other query: other scores.
    assert [r.score for r in sorted(got)] != [r.score for r in sorted(QUERIES["op1_language_model_order2"](spark, sf_dir).collect())]
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


@pytest.mark.parametrize("bits", [3, 12, 64])
def test_language_model_counts_do_not_hang_on_fingerprints(edge_rows, bits, monkeypatch):
    """Three blocks, two of them sharing passages: counts of all n-grams equal plain counts."""
    monkeypatch.setattr(language_model, "fingerprint_bits", lambda blocks: bits)
    order, shards = 4, 5
    blocks = [pa.table({"text": pa.array([t for _, t in edge_rows[k::3]], pa.string()), "train": [j % 4 > 0 for j in range(len(edge_rows[k::3]))]}) for k in range(3)]
    blocks = [b.append_column("block", pa.array([k] * b.num_rows, pa.int32())) for k, b in enumerate(blocks)]
    answered = language_model._answer(pa.concat_tables([language_model._asker(order, shards)(b) for b in blocks]))
    told = [answered.filter(pc.equal(answered["block"], k)) for k in range(3)]
    again = pa.concat_tables([language_model._second_asker(order, shards)(b, a) for b, a in zip(blocks, told, strict=True)])
    second = language_model._answer(again)
    plain = collections.Counter()
    lines = []
    for b in blocks:
        line, place, text, inner = language_model.token_lines(b["text"], order)
        learn = b["train"].to_numpy()[text]
        lines.append((line, place, inner, learn))
        for level in range(2, order + 1):
            plain.update((level, int(g)) for g in language_model._grams(line, place, level)[learn])
    settled = 0
    for k, own_line in enumerate(lines):
        first, last = language_model._Answers(told[k]), language_model._Answers(second.filter(pc.equal(second["block"], k)))
        for level, keys, _, own, sent in language_model._open_grams(*own_line, order, shards, first):
            own[sent] = last.sums(order + level)
            settled += int((~sent).sum())
            assert own.tolist() == [plain[level, int(g)] for g in keys]
    assert (settled > 0) == (bits > 3)  # three bits settle nothing


@pytest.mark.parametrize("top", [2**64 - 1, 2**40, 5000])
def test_sorted_numbers_are_packed_without_loss(top):
    for n in (0, 1, 2, 9, 3000):
        values = np.unique(np.random.default_rng(n).integers(0, top, n, dtype=np.uint64, endpoint=True))
        packed = pack_sorted(values)
        assert unpack_sorted(packed).tolist() == values.tolist()
        assert n < 3000 or len(packed) < 24 + len(values) * (2.5 + math.log2(top / len(values))) / 8 + 8
    ends = np.array([0, 2**64 - 1], np.uint64)
    assert unpack_sorted(pack_sorted(ends)).tolist() == ends.tolist()


def test_language_model_of_order_three_sums_to_one(spark):
    """The probabilities of all continuations of one beginning, and of an unseen word."""
    corpus = ["a b a b c", "b a c", "a b c c", "c"]
    vocabulary = ["a", "b", "c", "zzz"]
    prefix = "a b"
    texts = [(k, t, True) for k, t in enumerate(corpus)] + [(10 + k, f"{prefix} {w}", False) for k, w in enumerate(vocabulary)] + [(20, prefix, False)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, learn boolean")
    # The smoothing weights of shorter texts are those of the same fit.
    got = {r.doc_id: r for r in language_model.score_texts(docs, F.col("learn"), order=3).collect()}
    end = {}  # log10 P(end | prefix w) differs by w: score one more text without its end
    scale, power = eval(got[0].smoothing)
    tokens = [["<s>", "<s>", *t.split(), "</s>"] for t in corpus]

    def count(gram):
        return sum(t[k : k + len(gram)] == gram for t in tokens for k in range(3 - len(gram), len(t) - len(gram) + 1) if k + len(gram) > 2 or gram[-1] == "<s>")

    total, types = sum(len(t) - 2 for t in tokens), len({w for t in tokens for w in t[2:]})

    def probability(history, word):
        p = (sum(t[2:].count(word) for t in tokens) + 0.1) / (total + 0.1 * (types + 1))
        for n in (1, 2):
            h = history[-n:]
            c = len(tokens) if set(h) == {"<s>"} else count(h)
            if c:
                m = scale * c**power
                p = (count([*h, word]) + m * p) / (c + m)
        return p

    for k, w in enumerate(vocabulary):
        line = ["<s>", "<s>", *prefix.split(), w, "</s>"]
        expected = sum(math.log10(probability(line[:j], line[j])) for j in range(2, len(line)))
        assert got[10 + k].score == pytest.approx(expected, abs=1e-9), (w, end)
    known = sum(probability(["<s>", "<s>", "a", "b"], w) for w in ["a", "b", "c", "</s>"])
    assert known + probability(["<s>", "<s>", "a", "b"], "zzz") == pytest.approx(1)


def test_walk_takes_failure_arcs():
    """A lane that fails once pays the failure arc and goes on from the shorter state."""
    seen = [np.array([True, True, False, True]), np.array([False, True, False, True])]
    arcs = [np.full((4, 1), -1.0), np.full((4, 1), -0.25)]
    fails = [np.zeros((1, 1)), np.full((4, 1), -0.5)]
    total = language_model.walk(seen, arcs, fails, np.array([1]), np.array([0]), np.array([4]))
    # Place 0 fails; 1 has its arc; 2 fails and is unseen; 3 starts from the empty state.
    assert total[0, 0] == pytest.approx(-0.5 - 1 - 0.25 - 0.5 - 1 - 1)


def test_language_model_empty(no_docs):
    assert language_model.score_texts(no_docs, ~held_out("doc_id", 10)).count() == 0


def test_language_id_query_is_accurate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op9_language_id"](spark, sf_dir).join(docs, "doc_id").where("held_out and length(lang) > 0").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(spark, edge_docs, edge_rows, no_docs):
    model = language_id.fit(edge_docs, F.lit(True))
    got = language_id.identify(edge_docs, model).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.lang_score <= 1
    clashing = edge_docs.withColumn("lang_score", F.lit("x"))
    assert language_id.accepted(clashing, model).columns == clashing.columns
    nothing = language_id.fit(no_docs, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(edge_docs, nothing).collect()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0
    assert language_id.fit(edge_docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).languages == []


def test_unseen_words_fall_back_to_grams(spark):
    rows = [(k, "singing ringing bringing thing", "a") for k in range(5)] + [(9 + k, "ostrava moldava krava", "b") for k in range(5)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    asked = spark.createDataFrame([(1, "flinging"), (2, "sitava")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(asked, model).orderBy("doc_id").collect()] == ["a", "b"]


def test_quality_query_is_accurate(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op10_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_edges(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(i, k % 2, 0) for k, (i, _) in enumerate(edge_rows)] + [(6, None, 1), (6, 7, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(edge_docs, labels, F.lit(True))
    got = quality.score(edge_docs, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    untrained = quality.fit(edge_docs, labels.where("false"), F.lit(True))
    assert {r.score for r in quality.score(edge_docs, untrained).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_rows(x, y)
    assert (0, 1) in model.pairs
    assert ((model.probability(x) > 0.5) == y).mean() > 0.95

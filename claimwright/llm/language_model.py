"""Language-model scores of whole texts by a weighted backoff automaton.

The states are word sequences seen in training, shortest the empty one. A state has an arc
for each word seen after it, weighing log10 of the smoothed probability, and a failure arc
to its longest proper suffix, weighing log10 of the share left to unseen words. A text is
walked once from left to right: a lane of the walk carries its state, takes failure arcs
until the state has an arc for the next word, adds up the weights and goes on from there.

Smoothing: ``P(w|h) = (c(hw) + m P(w|h')) / (c(h) + m)`` with ``m = scale * c(h)**power``,
the shortest being the additive estimate of single words. The pair (scale, power) is the
one of ``GRID`` under which the training tokens, each left out of its own counts, are most
likely; this covers every training token. The probabilities of all words and one unseen
word sum to 1 after any state.

Nothing of the model is ever whole in one place. Blocks of documents ask shards about their
n-grams in two rounds. In the first they send single words with their own counts and, of
longer n-grams, only short fingerprints; shards add up the words and tell which fingerprints
another block has too. An n-gram without such a fingerprint, or with a part that is known to
be nowhere else, stands in this block alone: its own count is its whole count. In the second
round the others are sent in full with their counts. Fingerprints only settle what cannot be
elsewhere, so counts are exact whatever their size. Each block then builds the part of the
automaton that its texts can reach. ``op1_language_model`` scores with two words of context;
``op1_language_model_order2`` keeps to word pairs, and ``order`` may be any.

Defined cases: null and empty texts consist of the end token; rows without id are not
learned from; repeated rows count as often as they occur; an empty table gives an empty
result. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm import words as W
from claimwright.llm.blocks import BLOCK_BYTES, block_count, held_out, in_blocks, pack_sorted, planes, saved, shard_cuts, table, unpack_sorted, unplanes
from claimwright.llm.registry import query

ADD = 0.1
GRID = [(0.5, 0.9), (1.0, 0.8), (2.0, 0.7), (2.0, 0.9), (8.0, 0.5), (8.0, 0.8)]
#: Tokens of a lane, and of the lanes walked together.
LANE, TOGETHER = 512, 200_000
START = np.uint64(0x53544152545354)
END = np.uint64(0x454E44454E444E)

_ASK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("level", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("level", pa.int32()), ("counts", pa.binary())])
_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()),
     ("scores", pa.list_(pa.float64())), ("left_out", pa.list_(pa.float64()))]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.float64()): "array<double>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def token_lines(column: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens in one line with starts before each text; places of the tokens, text of
    each token, and its number within the text."""
    data, offsets = W.flat(column)
    starts, ends, first = W.find_words(data, offsets, W.NOT_BLANK)
    count = np.diff(first)
    pad = order - 1
    begin = np.concatenate([[0], np.cumsum(count + 1 + pad)])
    line = np.full(int(begin[-1]), START, np.uint64)
    text = np.repeat(np.arange(len(count)), count + 1)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(count + 1) - count - 1, count + 1)
    place = begin[text] + pad + inner
    is_end = inner == count[text]
    line[place[is_end]] = END
    line[place[~is_end]] = W.hash_words(data, starts, ends)
    return line, place, text, inner


def _grams(line: np.ndarray, place: np.ndarray, level: int) -> np.ndarray:
    """Hash of the ``level`` tokens that end at each place."""
    return W.hash_grams(line, level)[place - level + 1]


def _indexed(grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in order, the number of each place's one, and the sums of weights."""
    by_gram = np.argsort(grams)
    ordered = grams[by_gram]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    number = np.empty(len(grams), np.int64)
    number[by_gram] = np.cumsum(new) - 1
    keys = ordered[new]
    return keys, number, np.bincount(number, weights, len(keys)).astype(np.int64)


def _singles(line: np.ndarray, place: np.ndarray, train: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The single words of a block; the last place stands for the starts of its training texts."""
    return _indexed(np.append(line[place], START), np.append(train, texts))


def fingerprint_bits(blocks: int) -> int:
    """Bits that make most n-grams of so many blocks differ."""
    return min(64, (blocks * BLOCK_BYTES).bit_length())


def _fingerprints(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of sorted n-grams, moved to the upper bits, and the number of
    each n-gram's one."""
    short = keys & ~np.uint64((1 << (64 - bits)) - 1)
    new = np.concatenate([[True], short[1:] != short[:-1]])
    return short[new], np.cumsum(new) - 1


def _send(rows: dict[str, list], block: int, level: int, shards: int, keys: np.ndarray, counts: np.ndarray | None, drop: int = 0) -> None:
    cut = shard_cuts(keys, shards)
    for shard in np.flatnonzero(np.diff(cut)):
        a, b = cut[shard], cut[shard + 1]
        packed = pack_sorted(keys[a:b] >> np.uint64(drop) if drop else keys[a:b])
        for name, value in zip(_ASK.names, (shard, block, level, packed, b"" if counts is None else planes(counts[a:b].astype(np.uint32))), strict=True):
            rows[name].append(value)


def _asker(order: int, shards: int):
    bits = fingerprint_bits(shards)

    def ask(group: pa.Table) -> pa.Table:
        line, place, text, _ = token_lines(group["text"], order)
        learn = group["train"].to_numpy()
        rows: dict[str, list] = {n: [] for n in _ASK.names}
        block = group["block"][0].as_py()
        keys, _, own = _singles(line, place, learn[text], int(learn.sum()))
        _send(rows, block, 1, shards, keys, own)
        for level in range(2, order + 1):
            short, _ = _fingerprints(np.sort(_grams(line, place, level)), bits)
            _send(rows, block, level, shards, short, None, 64 - bits)
        return table(_ASK, rows)

    return ask


def _answer(group: pa.Table) -> pa.Table:
    """Sums of counts; where none were sent, marks of what more than one block has."""
    rows: dict[str, list] = {n: [] for n in _ANSWER.names}
    levels = group["level"].to_numpy()
    for level in np.unique(levels):
        part = group.filter(pa.array(levels == level))
        keys = [unpack_sorted(k) for k in part["keys"].to_pylist()]
        counts = [unplanes(c, np.uint32) for c in part["counts"].to_pylist()]
        whole, number, _ = _indexed(np.concatenate(keys), np.ones(sum(map(len, keys))))
        if len(counts[0]):
            sums = np.bincount(number, np.concatenate(counts), len(whole)).astype(np.int64)[number]
        else:
            sums = np.bincount(number)[number] > 1
        at = 0
        for own, block, shard in zip(keys, part["block"].to_pylist(), part["shard"].to_pylist(), strict=True):
            mine = sums[at : at + len(own)]
            for name, value in zip(_ANSWER.names, (block, shard, level, np.packbits(mine).tobytes() if mine.dtype == bool else planes(mine)), strict=True):
                rows[name].append(value)
            at += len(own)
    return table(_ANSWER, rows)


class _Answers:
    """The answers to one block, by round and level in the order of shards."""

    def __init__(self, answers: pa.Table) -> None:
        self.levels, self.owners = answers["level"].to_numpy(), answers["shard"].to_numpy()
        self.packed = answers["counts"]

    def _of(self, level: int) -> list[tuple[int, bytes]]:
        mine = np.flatnonzero(self.levels == level)
        return [(int(self.owners[k]), self.packed[int(k)].as_py()) for k in mine[np.argsort(self.owners[mine])]]

    def sums(self, level: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[unplanes(c, np.int64) for _, c in self._of(level)]])

    def marks(self, level: int, short: np.ndarray, shards: int) -> np.ndarray:
        size = np.diff(shard_cuts(short, shards))
        return np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8), count=size[s]) for s, c in self._of(level)]).astype(bool)


def _open_grams(line, place, inner, learn, order: int, shards: int, answers: _Answers):
    """For each level from 2 on: the distinct n-grams of a block, the number of each place's
    one, their counts in the block, and which of them other blocks may have too."""
    bits = fingerprint_bits(shards)
    elsewhere = np.ones(len(line), bool)  # by place, of the n-gram one word shorter
    for level in range(2, order + 1):
        keys, number, own = _indexed(_grams(line, place, level), learn)
        short, of_key = _fingerprints(keys, bits)
        parts = elsewhere[place] & ((inner == 0) | elsewhere[place - 1])
        sent = answers.marks(level, short, shards)[of_key] & (np.bincount(number, ~parts, len(keys)) == 0)
        elsewhere[place] = sent[number]
        yield level, keys, number, own, sent


def _second_asker(order: int, shards: int):
    def ask(group: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[str, list] = {n: [] for n in _ASK.names}
        if group.num_rows and order > 1:
            line, place, text, inner = token_lines(group["text"], order)
            learn = group["train"].to_numpy()[text]
            for level, keys, _, own, sent in _open_grams(line, place, inner, learn, order, shards, _Answers(answers)):
                _send(rows, group["block"][0].as_py(), order + level, shards, keys[sent], own[sent])
        return table(_ASK, rows)

    return ask


def walk(seen: list[np.ndarray], arcs: list[np.ndarray], fails: list[np.ndarray], state: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Walk all lanes from left to right and add up the weights, for each smoothing.

    ``seen[k]``: at each place, whether the state of length k that stands before it has an
    arc for its word; ``arcs[k]``, ``fails[k]``: weights of that arc and of the failure arc
    (rows: places); ``state``: the lengths of the states that the lanes begin in.
    """
    longest = len(seen) - 1
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths, state = starts[by_length], lengths[by_length], state[by_length].copy()
    total = np.zeros((len(starts), arcs[0].shape[1]))
    for step in range(int(lengths[0]) if len(lengths) else 0):
        active = int(np.searchsorted(-lengths, -step, "left"))
        at, now = starts[:active] + step, state[:active]
        for level in range(longest, 0, -1):
            failing = np.flatnonzero((now == level) & ~seen[level][at])
            if len(failing):
                total[failing] += fails[level][at[failing]]
                now[failing] = level - 1
        for level in range(longest + 1):
            taken = np.flatnonzero(now == level)
            if len(taken):
                total[taken] += arcs[level][at[taken]]
        # The words just read are a state as long as they were seen in training.
        known = np.where((now > 0) | seen[0][at], now + 1, 0)
        state[:active] = np.minimum(known, longest)
    out = np.empty_like(total)
    out[by_length] = total
    return out


def _scorer(order: int, shards: int, tokens: int, types: int):
    mass = tokens + ADD * (types + 1)
    grid = np.array(GRID)

    def weights(c_gram: list[np.ndarray], c_state: list[np.ndarray]):
        p = ((c_gram[0] + ADD) / mass)[:, None].repeat(len(GRID), 1)
        arcs, fails, seen = [np.log10(p)], [np.zeros((1, len(GRID)))], [c_gram[0] > 0]
        for level in range(1, order):
            c = c_state[level].astype(float)[:, None]
            m = grid[:, 0] * np.maximum(c, 0) ** grid[:, 1]
            known = c[:, 0] > 0
            p = np.where(known[:, None], (c_gram[level][:, None] + m * p) / np.where(c > 0, c + m, 1), p)
            arcs.append(np.log10(p))
            fails.append(np.where(known[:, None], np.log10(np.maximum(m, 1e-300) / np.where(c > 0, c + m, 1)), 0.0))
            seen.append((c_gram[level] > 0) & known)
        return arcs, fails, seen

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return table(_SCORED, {n: [] for n in _SCORED.names})
        line, place, text, inner = token_lines(group["text"], order)
        train = group["train"].to_numpy()
        told = _Answers(answers)
        _, number, _ = _singles(line, place, train[text], 0)
        whole = told.sums(1)[number]
        c_gram, c_state = [whole[:-1]], [np.full(len(place), tokens)]
        before = np.full(len(line), whole[-1])  # by place; every start stands for all training texts
        before[place] = c_gram[0]
        for level, _, number, own, sent in _open_grams(line, place, inner, train[text], order, shards, told):
            # The state before a token: the sequence that ends one place earlier.
            c_state.append(np.where(inner == 0, whole[-1], before[place - 1]))
            own[sent] = told.sums(order + level)
            c_gram.append(own[number])
            before[place] = c_gram[-1]
        n_texts = group.num_rows
        base = np.bincount(text, np.log10((c_gram[0] + ADD) / mass), n_texts)
        lane_start = np.flatnonzero(inner % LANE == 0)
        lane_length = np.diff(np.concatenate([lane_start, [len(place)]]))
        totals, left = np.zeros((n_texts, len(GRID))), np.zeros((n_texts, len(GRID)))
        bounds = np.concatenate([[0], np.cumsum(lane_length)])
        for a, b in W.cuts(bounds, TOGETHER):
            low, high = bounds[a], bounds[b]
            part_gram, part_state = [c[low:high] for c in c_gram], [c[low:high] for c in c_state]
            arcs, fails, seen = weights(part_gram, part_state)
            state = np.zeros(b - a, np.int64)
            for level in range(1, order):
                state[part_state[level][lane_start[a:b] - low] > 0] = level
            lanes = walk(seen, arcs, fails, state, lane_start[a:b] - low, lane_length[a:b])
            np.add.at(totals, text[lane_start[a:b]], lanes)
            own = np.flatnonzero(train[text[low:high]])
            if len(own):
                p = ((part_gram[0][own] - 1 + ADD) / mass)[:, None].repeat(len(GRID), 1)
                for level in range(1, order):
                    c = (part_state[level][own] - 1.0)[:, None]
                    m = grid[:, 0] * np.maximum(c, 0) ** grid[:, 1]
                    p = np.where(c > 0, (part_gram[level][own][:, None] - 1 + m * p) / np.where(c > 0, c + m, 1), p)
                np.add.at(left, text[low:high][own], np.log10(p))
        return table(
            _SCORED,
            {
                "doc_id": group["doc_id"], "held_out": ~train, "n_tokens": np.bincount(text, minlength=n_texts),
                "n_known": np.bincount(text, c_gram[0] > 0, n_texts).astype(np.int64), "base_score": base,
                "scores": list(totals), "left_out": list(left),
            },
        )

    return score


def _distinct_asker(shards: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            line, place, _, _ = token_lines(pa.chunked_array([batch.column(0)]), 1)
            keys, _, counts = _indexed(line[place], np.ones(len(place)))
            cut = shard_cuts(keys, shards)
            used = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array([pack_sorted(keys[cut[s] : cut[s + 1]]) for s in used], pa.binary()),
                 pa.array([int(counts[cut[s] : cut[s + 1]].sum()) for s in used], pa.int64())],
                names=["shard", "keys", "tokens"],
            )

    return run


def _distinct(group: pa.Table) -> pa.Table:
    keys = np.sort(np.concatenate([unpack_sorted(k) for k in group["keys"].to_pylist()]))
    return pa.table({"types": pa.array([1 + int((keys[1:] != keys[:-1]).sum())], pa.int64()), "tokens": pa.array([sum(group["tokens"].to_pylist())], pa.int64())})


def training_totals(docs: DataFrame, train: Column, text: str, shards: int) -> tuple[int, int]:
    """Tokens and distinct tokens of the training rows."""
    own = docs.where(train).select(F.col(text).alias("text"))
    asked = own.mapInArrow(_distinct_asker(shards), "shard int, keys binary, tokens long")
    row = asked.groupBy("shard").applyInArrow(_distinct, "types long, tokens long").agg(F.sum("tokens"), F.sum("types")).first()
    return int(row[0] or 0), int(row[1] or 0)


def score_texts(docs: DataFrame, train: Column, order: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all texts by a model learned from those where ``train`` holds: ``doc_id``,
    ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, and
    ``smoothing``, the pair chosen."""
    blocks = block_count(docs, text)
    tokens, types = training_totals(docs, train, text, blocks)
    rows = in_blocks(docs, blocks, key, text, train=F.coalesce(train, F.lit(False)))
    asked = rows.groupBy("block").applyInArrow(_asker(order, blocks), _ddl(_ASK))
    told = asked.groupBy("shard").applyInArrow(_answer, _ddl(_ANSWER)).repartition(blocks, "block")
    asked_again = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_second_asker(order, blocks), _ddl(_ASK))
    answers = told.union(asked_again.groupBy("shard").applyInArrow(_answer, _ddl(_ANSWER)))
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(order, blocks, tokens, types), _ddl(_SCORED))
    scored = saved(scored, "scores")
    sums = scored.agg(*[F.sum(F.col("left_out")[k]).alias(str(k)) for k in range(len(GRID))]).first()
    best = max(range(len(GRID)), key=lambda k: sums[k] if sums[k] is not None else 0.0)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score",
        F.col("scores")[best].alias("score"), F.lit(str(GRID[best])).alias("smoothing"),
    )


@query("op1_language_model")
@query("op1_language_model_order3")
def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, ~held_out("doc_id", 10), order=3)


@query("op1_language_model_order2")
def op1_language_model_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, ~held_out("doc_id", 10))

"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier: in a document
of smaller id, or earlier in the same one. The longest previous factor at a place says how
long the longest such string is that begins there; places where it reaches ``WINDOW`` cover
what goes. It comes from a suffix array: of the suffixes around a place in suffix order, the
nearest ones before and after it that start earlier in the text share the longest prefix.

One suffix array over everything would be in one place, so equal windows are first brought
together by their content:

1. Every window has an anchor, the place of its smallest hash of ``GRAM`` bytes. Equal windows
   have equal anchors at the same offset. The windows that share one anchor form a context.
2. Blocks send shards the hash of each anchor and of its context. An anchor that occurs once
   has no repeats. Equal contexts go, but for the first. Only anchors with several different
   contexts are contested.
3. Contested contexts (the first of equal ones) are sent as bytes to the shard of their
   anchor, which builds the suffix array of their windows and its previous factors. Under an
   anchor with very many contexts each window is sent to the shard of its own hash instead,
   once from each block, so that a passage costs a shard no more rows than there are blocks.
4. The verdicts meet their block again, which cuts its texts.

Defined cases: null texts are empty; texts shorter than a window lose nothing; documents of
equal id start no earlier than each other, so repeated rows keep their copies alike; a row
without id comes after all others; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm import words as W
from claimwright.llm.blocks import block_count, ids_of, in_blocks, planes, shard_cuts, table, unplanes
from claimwright.llm.registry import query

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
#: Different contexts of one anchor above which its windows are dealt out one by one.
CROWD = 4_000
#: Bytes of text in a block; a task holds some twenty times as much in arrays.
BLOCK_BYTES = 6 << 20
#: Places of text handled at once, and windows in one suffix array.
STRETCH, SORTED = 1 << 19, 200_000
#: Verdicts on an entry.
KEPT, GONE, CONTESTED, CROWDED = 0, 1, 2, 3

_ASK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("anchors", pa.binary()), ("contexts", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("verdicts", pa.binary())])
_SHIP = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("anchors", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("windows", pa.binary()), ("entries", pa.binary()), ("text", pa.binary())])
_FOUND = pa.schema([("block", pa.int32()), ("entries", pa.binary()), ("repeats", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, from running minima of fixed stretches."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    full = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    full[: len(values)] = values
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Contexts:
    """Anchors of the windows of a block: for each the first window, the number of windows,
    the hashes of anchor and context, and the text it lies in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        parts: list[tuple[np.ndarray, ...]] = []
        step = STRETCH - WINDOW
        for low in range(0, max(len(data) - WINDOW + 1, 0), step):
            part = data[low : low + STRETCH]
            if len(part) < WINDOW:
                break
            sums = W.prefix_sums(W.BYTE_VALUES[part])
            at = np.arange(len(part) - GRAM + 1)
            hashes = W.range_hash(sums, at, at + GRAM)
            # The place in the lower bits: of equal hashes the leftmost is the least.
            place_bits = np.uint64(STRETCH - 1)
            least = _sliding_least((hashes & ~place_bits) | at.astype(np.uint64), SPAN)[:step]
            anchor = (least & place_bits).astype(np.int64)
            # Windows must lie in one text.
            first = np.arange(low, low + len(anchor))
            text = np.searchsorted(offsets, first, "right") - 1
            good = first + WINDOW <= offsets[text + 1]
            first, anchor, text = first[good], anchor[good], text[good]
            if not len(first):
                continue
            new = np.ones(len(first), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            begin = np.flatnonzero(new)
            count = np.diff(np.concatenate([begin, [len(first)]]))
            own = first[begin] - low
            context = W.mix(W.range_hash(sums, own, own + WINDOW + count - 1) + (anchor[begin] - own).astype(np.uint64))
            parts.append((first[begin], count, hashes[anchor[begin]], context, text[begin]))
        if not parts:
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        self.first, self.count, self.anchor, self.context, self.text = (np.concatenate(c) for c in zip(*parts, strict=True))


class Entries:
    """The contexts of a block in the order in which it asks: one for each pair of anchor
    and context, the earliest; ``rank`` leads from contexts to entries."""

    def __init__(self, group: pa.Table) -> None:
        # Rows of a block arrive in any order, and stretches must be cut alike every time.
        self.group = group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.data, self.offsets = W.flat(group["text"])
        self.contexts = c = Contexts(self.data, self.offsets)
        self.doc = ids_of(group["doc_id"])
        doc, start = self.doc[c.text], c.first - self.offsets[c.text]
        order = np.lexsort((start, doc, c.context, c.anchor))
        anchor, context = c.anchor[order], c.context[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(new) - 1
        self.at = order[new]  # the context that stands for each entry
        self.anchor, self.context = c.anchor[self.at], c.context[self.at]
        self.entry_doc, self.entry_start = doc[self.at], start[self.at]
        # Later ones of the block go; equal id and start is not later.
        self.later = (doc != self.entry_doc[self.rank]) | (start != self.entry_start[self.rank])


def _asker(shards: int):
    def ask(group: pa.Table) -> pa.Table:
        e = Entries(group)
        block = group["block"][0].as_py()
        cut = shard_cuts(e.anchor, shards)
        rows: dict[str, list] = {n: [] for n in _ASK.names}
        for shard in np.flatnonzero(np.diff(cut)):
            own = slice(cut[shard], cut[shard + 1])
            values = (shard, block, cut[shard + 1] - cut[shard], e.anchor[own].tobytes(), e.context[own].tobytes(), planes(e.entry_doc[own]), planes(e.entry_start[own]))
            for name, value in zip(_ASK.names, values, strict=True):
                rows[name].append(value)
        return table(_ASK, rows)

    return ask


def _answer(group: pa.Table) -> pa.Table:
    """A verdict on each entry, from all entries of its anchor."""
    anchor = np.concatenate([np.frombuffer(x, np.uint64) for x in group["anchors"].to_pylist()])
    context = np.concatenate([np.frombuffer(x, np.uint64) for x in group["contexts"].to_pylist()])
    doc = np.concatenate([unplanes(x, np.int64) for x in group["docs"].to_pylist()])
    start = np.concatenate([unplanes(x, np.int64) for x in group["starts"].to_pylist()])
    order = np.lexsort((start, doc, context, anchor))
    a, c, d, s = anchor[order], context[order], doc[order], start[order]
    new_anchor, new = np.ones(len(a), bool), np.ones(len(a), bool)
    new_anchor[1:] = a[1:] != a[:-1]
    new[1:] = new_anchor[1:] | (c[1:] != c[:-1])
    group_of = np.cumsum(new_anchor) - 1
    kinds = np.bincount(group_of, new).astype(np.int64)[group_of]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = (d == d[lead]) & (s == s[lead])
    verdict = np.where(~first, GONE, np.where(kinds == 1, KEPT, np.where(kinds > CROWD, CROWDED, CONTESTED))).astype(np.uint8)
    out = np.empty(len(a), np.uint8)
    out[order] = verdict
    cut = np.cumsum([0, *group["n"].to_pylist()])
    return table(_ANSWER, {"block": group["block"], "shard": group["shard"], "verdicts": [planes(out[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]})


def _verdicts(answers: pa.Table, n: int) -> np.ndarray:
    answers = answers.sort_by("shard")
    found = [unplanes(x, np.uint8) for x in answers["verdicts"].to_pylist()]
    return np.concatenate(found) if found else np.zeros(n, np.uint8)


class Crowd:
    """Windows of the crowded contexts of a block. Equal ones are one, the earliest, which is
    asked about; the others start later or at the same place as it."""

    def __init__(self, e: Entries, crowded: np.ndarray) -> None:
        times = e.contexts.count[e.at[crowded]]
        inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        self.entry, self.shift = np.repeat(crowded, times), inner
        self.first = e.contexts.first[e.at[self.entry]] + inner
        self.key = np.zeros(len(inner), np.uint64)
        along = np.argsort(self.first, kind="stable")
        if len(along):
            self.key[along] = W.hash_words(e.data, self.first[along], self.first[along] + WINDOW, W.BYTE_VALUES)
        doc, start = e.entry_doc[self.entry], e.entry_start[self.entry] + inner
        order = np.lexsort((start, doc, self.key))
        new = np.ones(len(order), bool)
        new[1:] = self.key[order][1:] != self.key[order][:-1]
        self.leads = order[new]
        self.lead = np.empty(len(order), np.int64)  # number of the leading window of each
        self.lead[order] = np.cumsum(new) - 1
        ahead = self.leads[self.lead]
        self.later = (doc != doc[ahead]) | (start != start[ahead])


def _shipper(shards: int):
    def ship(group: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[str, list] = {n: [] for n in _SHIP.names}
        if not group.num_rows:
            return table(_SHIP, rows)
        e = Entries(group)
        verdict = _verdicts(answers, len(e.at))
        block, c = group["block"][0].as_py(), e.contexts
        # Contested contexts whole; of crowded ones each different window on its own.
        whole, crowd = np.flatnonzero(verdict == CONTESTED), Crowd(e, np.flatnonzero(verdict == CROWDED))
        entry = np.concatenate([whole, crowd.entry[crowd.leads]])
        shift = np.concatenate([np.zeros(len(whole), np.int64), crowd.shift[crowd.leads]])
        windows = np.concatenate([c.count[e.at[whole]], np.ones(len(crowd.leads), np.int64)])
        first = c.first[e.at[entry]] + shift
        key = np.concatenate([e.anchor[whole], crowd.key[crowd.leads]])
        order = np.argsort(key, kind="stable")
        cut = shard_cuts(key[order], shards)
        for shard in np.flatnonzero(np.diff(cut)):
            own = order[cut[shard] : cut[shard + 1]]
            size = windows[own] + WINDOW - 1
            source = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            values = (
                shard, block, len(own), key[own].tobytes(), planes(e.entry_doc[entry[own]]), planes(e.entry_start[entry[own]] + shift[own]),
                planes(windows[own].astype(np.uint8)), planes(entry[own] * 128 + shift[own]), e.data[source].tobytes(),
            )
            for name, value in zip(_SHIP.names, values, strict=True):
                rows[name].append(value)
        return table(_SHIP, rows)

    return ship


def nearest_smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix in suffix order, the longest prefix it shares with the nearest suffix
    before it that starts earlier (0 without one). ``lcp[i]``: shared by i - 1 and i."""
    n = len(position)
    before, shared = np.arange(n) - 1, lcp.copy()
    shared[:1] = 0
    while True:
        # All between ``before`` and here start later, so its own ``before`` is next.
        wrong = np.flatnonzero(before >= 0)
        wrong = wrong[position[before[wrong]] >= position[wrong]]
        if not len(wrong):
            return np.where(before >= 0, shared, 0)
        jump = before[wrong]
        shared[wrong], before[wrong] = np.minimum(shared[wrong], shared[jump]), before[jump]


def longest_previous(windows: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Longest previous factor, up to the width, of each row of ``windows``, a suffix cut at
    that width; ``position``: where it starts, equal for starts that are not earlier."""
    n, width = windows.shape
    keys = np.ascontiguousarray(windows).view(f"S{width}").reshape(-1)
    order = np.lexsort((position, keys)) if n else np.zeros(0, np.int64)
    ordered = windows[order]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        apart = ordered[1:] != ordered[:-1]
        lcp[1:] = np.where(apart.any(1), apart.argmax(1), width)
    own = position[order]
    ahead = nearest_smaller(own, lcp)
    behind = nearest_smaller(own[::-1], np.concatenate([[0], lcp[:0:-1]]) if n else lcp)[::-1]
    out = np.empty(n, np.int64)
    out[order] = np.maximum(ahead, behind)
    return out


def _ranks(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Order of the places in the whole text; equal places have equal ranks."""
    order = np.lexsort((start, doc))
    d, s = doc[order], start[order]
    new = np.zeros(len(d), np.int64)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    out = np.empty(len(d), np.int64)
    out[order] = np.cumsum(new)
    return out


def _find(group: pa.Table) -> pa.Table:
    """Windows of the shard that also start earlier, as bits of each context."""
    counts = group["n"].to_pylist()
    row = np.repeat(np.arange(len(counts)), counts)
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in group["anchors"].to_pylist()])
    doc = np.concatenate([unplanes(x, np.int64) for x in group["docs"].to_pylist()])
    start = np.concatenate([unplanes(x, np.int64) for x in group["starts"].to_pylist()])
    windows = np.concatenate([unplanes(x, np.uint8) for x in group["windows"].to_pylist()]).astype(np.int64)
    entry = np.concatenate([unplanes(x, np.int64) for x in group["entries"].to_pylist()])
    text = np.frombuffer(b"".join(group["text"].to_pylist()), np.uint8)
    at = np.concatenate([[0], np.cumsum(windows + WINDOW - 1)])[:-1]
    repeats = np.zeros((len(key), 128), bool)
    order = np.argsort(key, kind="stable")
    total = np.concatenate([[0], np.cumsum(windows[order])])
    low = 0
    while low < len(order):
        # As many anchors as one suffix array takes, and always whole anchors.
        high = max(low + 1, int(np.searchsorted(total, total[low] + SORTED, "right")) - 1)
        if high < len(order):
            last = key[order[high - 1]]
            begin = int(np.searchsorted(key[order], last, "left"))
            high = begin if begin > low and key[order[high]] == last else int(np.searchsorted(key[order], key[order[high - 1]], "right"))
        own = order[low:high]
        times = windows[own]
        inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        which = np.repeat(own, times)
        rows = sliding_window_view(text, WINDOW)[at[which] + inner]
        repeats[which, inner] = longest_previous(rows, _ranks(doc[which], start[which] + inner)) >= WINDOW
        low = high
    bits = np.packbits(repeats, axis=1)
    return table(
        _FOUND,
        {"block": group["block"], "entries": [planes(entry[row == k]) for k in range(len(counts))], "repeats": [planes(bits[row == k].reshape(-1)) for k in range(len(counts))]},
    )


def _cutter(group: pa.Table, answers: pa.Table) -> pa.Table:
    """Cut the texts of a block; ``answers`` holds verdicts and found repeats."""
    rows: dict[str, list] = {n: [] for n in _KEPT.names}
    if not group.num_rows:
        return table(_KEPT, rows)
    e = Entries(group)
    c, data, offsets = e.contexts, e.data, e.offsets
    verdict = _verdicts(answers.filter(answers["verdicts"].is_valid()), len(e.at))
    repeats = np.zeros((len(e.at), 128), bool)
    found = answers.filter(answers["entries"].is_valid())
    for packed, bits in zip(found["entries"].to_pylist(), found["repeats"].to_pylist(), strict=True):
        place = unplanes(packed, np.int64)
        own = np.unpackbits(unplanes(bits, np.uint8).reshape(-1, 16), axis=1).astype(bool)
        entry, shift = place // 128, place % 128
        moved = shift > 0
        repeats[entry[~moved]] |= own[~moved]
        repeats[entry[moved], shift[moved]] |= own[moved, 0]
    crowd = Crowd(e, np.flatnonzero(verdict == CROWDED))
    answered = repeats[crowd.entry[crowd.leads], crowd.shift[crowd.leads]]
    repeats[crowd.entry, crowd.shift] = crowd.later | answered[crowd.lead]
    change = np.zeros(len(data) + 1, np.int32)
    whole = e.later | (verdict == GONE)[e.rank]
    np.add.at(change, c.first[whole], 1)
    np.add.at(change, c.first[whole] + c.count[whole] + WINDOW - 1, -1)
    part = np.flatnonzero(~whole & repeats.any(1)[e.rank])
    which, shift = np.nonzero(repeats[e.rank[part]])
    place = c.first[part[which]] + shift
    np.add.at(change, place, 1)
    np.add.at(change, place + WINDOW, -1)
    removed = np.cumsum(change[:-1]) > 0
    names = e.group["doc_id"].to_pylist()
    for k, name in enumerate(names):
        low, high = offsets[k], offsets[k + 1]
        own = removed[low:high]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        rows["doc_id"].append(name)
        rows["n_bytes"].append(high - low)
        rows["n_removed"].append(int(own.sum()))
        rows["n_spans"].append(len(edges) // 2)
        rows["kept_sha256"].append(hashlib.sha256(data[low:high][~own].tobytes()).hexdigest())
        rows["spans"].append(edges)
    return table(_KEPT, rows)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its bytes, how many go in how many spans, the hash of what is left, and
    the ``spans`` as pairs of byte offsets in one list."""
    blocks = block_count(docs, text, BLOCK_BYTES)
    rows = in_blocks(docs, blocks, key, text)
    by_block = rows.groupBy("block")
    verdicts = by_block.applyInArrow(_asker(blocks), _ddl(_ASK)).groupBy("shard").applyInArrow(_answer, _ddl(_ANSWER))
    shipped = by_block.cogroup(verdicts.groupBy("block")).applyInArrow(_shipper(blocks), _ddl(_SHIP))
    found = shipped.groupBy("shard").applyInArrow(_find, _ddl(_FOUND))
    answers = verdicts.select("block", "shard", "verdicts", F.lit(None).cast("binary").alias("entries"), F.lit(None).cast("binary").alias("repeats")).unionByName(
        found.select("block", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("verdicts"), "entries", "repeats")
    )
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_cutter, _ddl(_KEPT))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")

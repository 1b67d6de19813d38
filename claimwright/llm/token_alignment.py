"""Alignment of the tokens of two tokenizers over the bytes of each text.

A is a byte-level vocabulary, B one of pieces with byte fallback. Both read a text after one
space. The ends of A's and of B's tokens are two sorted lists of byte offsets; where both have
an end, a group of tokens closes. The lists of a slice of documents are merged by merge-path
partitioning: binary searches along evenly spaced diagonals find how many ends of either list
come before each, so the merge falls into pieces of equal work that know nothing of each other.
A piece gives the common ends it saw and the tokens on both sides of them; groups that lie
across pieces are stitched by adding the open end of one piece to the next.

A group is told by its two lists of ids, and most groups of a corpus are few: a slice keeps
each distinct group once, and its documents as numbers of groups. The pairs of ids that
share a group are counted by documents, in each slice first, then by Spark; every slice gets
the counts of its own pairs back, adds them up for each distinct group, and each document
is a sum over its groups. Slices are bounded in bytes of text, pairs are listed in
bounded stretches, so a text without common ends costs time and not memory.

Both tokenizers encode each distinct piece of text once. B's texts are cut where a space
follows something else, since no piece of its vocabulary holds a space there (checked when it
is loaded); A's are cut by the tokenizer's own pattern.

Defined cases: null and empty texts, and those whose tokens do not give back the bytes of
space and text, have no tokens: zeros and an empty ``groups_sha256``; they count for no pair.
Strings of special tokens are plain text. Repeated rows, and rows that share an id or have
none, count as documents each and keep their rows; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm import words as W
from claimwright.llm.blocks import saved
from claimwright.llm.packing import split_pieces
from claimwright.llm.registry import query

#: Bytes of text in a slice, which is one row of the written alignments.
SLICE_BYTES = 4 << 20
#: Bytes of text that are tokenised at once.
PART_BYTES = 1 << 20
#: Ends that one piece of the merge passes.
PIECE = 1 << 16
#: Pairs listed at once.
STRETCH = 1 << 21
#: Distinct pieces of text that a process remembers; beyond, it starts afresh.
REMEMBERED = 500_000
SPACE = "▁"

_ALIGNED = "slice long, payload binary"
_PAIRS = "slice long, pair long, n long"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_COLUMNS = [c.split()[0] for c in _RESULT.split(", ")]


class Pieces:
    """Ids and byte lengths of pieces of text, each distinct one encoded once."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.ids, self.whole = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in one line, how many each has, and whether they give its bytes."""
        raise NotImplementedError

    def cuts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces begin among the code points of several texts."""
        raise NotImplementedError

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.slots[at], -1)

    def tokens(self, whole: str, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in one line, the bounds of each text, and which texts are whole."""
        starts = self.cuts(points, bounds)
        ends = np.concatenate([starts[1:], [len(points)]])
        hashes = np.empty(len(starts), np.uint64)
        low = 0
        while low < len(starts):  # prefix sums over bounded stretches
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + W.CHUNK, "right")))
            sums = W.prefix_sums(W.mix(points[starts[low] : ends[high - 1]].astype(np.uint64) + np.uint64(7)))
            hashes[low:high] = W.range_hash(sums, starts[low:high] - starts[low], ends[low:high] - starts[low])
            low = high
        if len(self.keys) > REMEMBERED:
            self.forget()
        slot = self._slots(hashes)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            keys, first = np.unique(hashes[missing], return_index=True)
            at = missing[first]
            ids, counts, sound = self.encode([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            base = len(self.starts) - 1
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
            self.ids, self.whole = np.concatenate([self.ids, ids]), np.concatenate([self.whole, sound])
            keys, slots = np.concatenate([self.keys, keys]), np.concatenate([self.slots, base + np.arange(len(at))])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slots = keys[order], slots[order]
            slot = self._slots(hashes)
        count = self.starts[slot + 1] - self.starts[slot]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.starts[slot] - total[:-1], count)]
        first = np.searchsorted(starts, bounds)
        broken = np.concatenate([[0], np.cumsum(~self.whole[slot])])
        return ids, total[first], broken[first[1:]] == broken[first[:-1]]


class BytePieces(Pieces):
    """A: byte-level vocabulary of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        # An entry has one letter for each byte.
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for entry, i in vocabulary.items():
            self.lengths[i] = len(entry)

    def cuts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return split_pieces(points, bounds)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, np.int32)
        counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces))
        size = np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, counts, np.diff(size) == np.array([len(p.encode()) for p in pieces])


class FallbackPieces(Pieces):
    """B: pieces with byte fallback of the ``sentencepiece`` library, which adds a space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.bytes.append(piece.replace(SPACE, " ").encode())
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} has a space after something else; texts cannot be cut there")
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def cuts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        space = points == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[bounds[bounds < len(points)]] = True
        return np.flatnonzero(begin)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.model.encode([p[1:] for p in pieces])  # every piece begins with a space
        # What is a space alone has no text to add one to.
        found = [ids or self.model.encode("  ")[:0] + [self.model.piece_to_id(SPACE)] for ids in found]
        ids = np.array([i for own in found for i in own], np.int32)
        sound = [b"".join(self.bytes[i] for i in own) == p.encode() for own, p in zip(found, pieces, strict=True)]
        return ids, np.array([len(own) for own in found], np.int64), np.array(sound, bool)


_LOADED: dict[tuple[type, str], Pieces] = {}


def _loaded(kind: type, path: str) -> Pieces:
    """One for each process, since its memory of pieces pays."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` come before each diagonal, spaced ``piece`` apart; of
    equal values that of ``a`` comes first. All searches go on side by side."""
    n = len(a) + len(b)
    diagonal = np.append(np.arange(0, n, piece, dtype=np.int64), n)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) >> 1
        open_ = low < high
        at = np.where(open_, middle, 0)
        # a[middle] belongs before the diagonal if it is not above the last of b before it.
        before = open_ & (a[np.minimum(at, max(len(a) - 1, 0))] <= b[np.where(open_, diagonal - 1 - middle, 0)])
        low, high = np.where(before, middle + 1, low), np.where(open_ & ~before, middle, high)
    return low, diagonal - low


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece of the merge: places in ``a`` and in ``b`` of the ends that both hold."""
    at = np.searchsorted(b, a)
    same = at < len(b)
    same[same] = b[at[same]] == a[same]
    return np.flatnonzero(same), at[same]


def group_bounds(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """For ascending ends ``a`` and ``b`` of the same bytes: after how many tokens of A and of B
    each group closes, with a zero in front."""
    i, j = merge_path(a, b, piece)
    ends_a, ends_b = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for k in range(len(i) - 1):
        a_low, a_high, b_low, b_high = int(i[k]), int(i[k + 1]), int(j[k]), int(j[k + 1])
        # An end of A that closes the piece may have its equal as the first of the next piece.
        if b_high < len(b) and a_high > a_low and b[b_high] == a[a_high - 1]:
            b_high += 1
        if b_low < b_high and a_low and b[b_low] == a[a_low - 1]:
            b_low += 1  # the piece before has it
        x, y = common_ends(a[a_low:a_high], b[b_low:b_high])
        # Stitched: tokens before a piece's first common end join what earlier pieces left open.
        ends_a.append(a_low + x + 1)
        ends_b.append(b_low + y + 1)
    return np.concatenate(ends_a), np.concatenate(ends_b)


def _sequence_hash(ids: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    sums = W.prefix_sums(W.mix(ids.astype(np.uint64) + np.uint64(salt)))
    return W.range_hash(sums, bounds[:-1], bounds[1:])


_DIGITS = np.frombuffer(b"".join(b"%06d" % k for k in range(100_000)), np.uint8).reshape(-1, 6)


def written_groups(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all groups as ``a1,a2|b1;``, one after the other, and where each group ends."""
    size_a, size_b = np.diff(a_ends), np.diff(b_ends)
    n = len(a_ids) + len(b_ids)
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    # In a line: the tokens of A of a group, then those of B.
    at_a = np.arange(len(a_ids)) + np.repeat(b_ends[:-1], size_a)
    at_b = np.arange(len(b_ids)) + np.repeat(a_ends[1:], size_b)
    ids[at_a], ids[at_b] = a_ids, b_ids
    last = a_ends[1:] + b_ends[1:]
    mark[last - size_b - 1], mark[last - 1] = ord("|"), ord(";")
    width = 1 + (ids > 9) + (ids > 99).astype(np.int64) + (ids > 999) + (ids > 9999) + (ids > 99999)
    stop = np.cumsum(width + 1)
    out = np.empty(int(stop[-1]) if n else 0, np.uint8)
    out[stop - 1] = mark
    for k in range(6):
        has = np.flatnonzero(width > k)
        out[stop[has] - 2 - k] = _DIGITS[ids[has], 5 - k]
    return out, stop[last - 1] if n else np.zeros(0, np.int64)


def _flat_lists(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``values[low:high]`` of all ranges, one after the other."""
    size = high - low
    total = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(total[-1]) + np.repeat(low - total[:-1], size)]


class Slice:
    """Alignment of some documents: their distinct groups, and each document's groups."""

    FIELDS = ("doc_id", "null", "n_a", "n_b", "n_groups", "n_links", "sha", "first", "group", "times", "a_bounds", "a_ids", "b_bounds", "b_ids")

    def __init__(self, **fields: np.ndarray) -> None:
        self.__dict__.update(fields)

    def packed(self) -> bytes:
        import pickle

        return zlib.compress(pickle.dumps([getattr(self, f) for f in self.FIELDS], protocol=5), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Slice:
        import pickle

        return cls(**dict(zip(cls.FIELDS, pickle.loads(zlib.decompress(data)), strict=True)))

    def incidence(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ids of A in each distinct group (group, id, times), then those of B, with
        where each group's begin."""
        out = []
        for bounds, ids in ((self.a_bounds, self.a_ids), (self.b_bounds, self.b_ids)):
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            keys, times = np.unique(group.astype(np.int64) << 32 | ids.astype(np.int64), return_counts=True)
            out.append((keys >> 32, keys & 0xFFFFFFFF, times))
        (ga, a, ta), (gb, b, tb) = out
        return ga, a, ta, b, tb, np.searchsorted(gb, np.arange(len(self.b_bounds)))

    def stretches(self, weight: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of entries that expand to about ``STRETCH`` pairs, or one entry."""
        total = np.concatenate([[0], np.cumsum(weight)])
        low = 0
        while low < len(weight):
            high = max(low + 1, int(np.searchsorted(total, total[low] + STRETCH, "right")) - 1)
            yield low, high
            low = high

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (id of A above 32 bits, id of B) with the documents that hold them linked."""
        ga, a, _, b, _, b_first = self.incidence()
        a_first = np.searchsorted(ga, np.arange(len(self.a_bounds)))
        # Entries: document and distinct id of A, for each of the document's groups.
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        size = np.diff(a_first)[self.group]
        doc, group = np.repeat(doc, size), np.repeat(self.group, size)
        own = _flat_lists(a, a_first[self.group], a_first[self.group + 1])
        order = np.argsort(own, kind="stable")
        doc, group, own = doc[order], group[order], own[order]
        weight = np.diff(b_first)[group]
        # Stretches end where the id of A changes, so that no pair meets itself in another.
        edges = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
        total = np.concatenate([[0], np.cumsum(weight)])[edges]
        low = 0
        while low < len(edges) - 1:
            high = max(low + 1, int(np.searchsorted(total, total[low] + STRETCH, "right")) - 1)
            part = slice(edges[low], edges[high])
            other = _flat_lists(b, b_first[group[part]], b_first[group[part] + 1])
            pair = np.repeat(own[part] << 32, weight[part]) | other
            at = np.repeat(doc[part], weight[part])
            order = np.lexsort((at, pair))
            pair, at = pair[order], at[order]
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:] != pair[:-1]) | (at[1:] != at[:-1])
            yield np.unique(pair[new], return_counts=True)
            low = high

    def scored(self, pair: np.ndarray, count: np.ndarray, best: np.ndarray) -> dict:
        """Per document: links with the best count of their id of A, and counts of all links."""
        ga, a, ta, b, tb, b_first = self.incidence()
        weight = np.diff(b_first)[ga]
        n = len(self.a_bounds) - 1
        sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for low, high in self.stretches(weight):
            group = ga[low:high]
            other = _flat_lists(b, b_first[group], b_first[group + 1])
            times = np.repeat(ta[low:high], weight[low:high]) * _flat_lists(tb, b_first[group], b_first[group + 1])
            at = np.searchsorted(pair, np.repeat(a[low:high] << 32, weight[low:high]) | other)
            group = np.repeat(group, weight[low:high])
            np.add.at(sums, group, times * count[at])
            np.add.at(bests, group, times * best[at])
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        out = []
        for values in (bests, sums):
            total = np.zeros(len(self.first) - 1, np.int64)
            np.add.at(total, doc, values[self.group] * self.times)
            out.append(total)
        return {"n_best": out[0], "count_sum": out[1]}


def align(doc_ids: pa.ChunkedArray, texts: pa.ChunkedArray, a_pieces: Pieces, b_pieces: Pieces) -> Slice:
    """The alignment of some documents."""
    data, offsets = W.flat(texts)
    parts = []
    for low, high in W.cuts(offsets, PART_BYTES):
        parts.append(_aligned_part(data, offsets, low, high, a_pieces, b_pieces))
    columns = {f: np.concatenate([p[f] for p in parts]) for f in ("n_a", "n_b", "n_groups", "n_links")}
    sha = [s for p in parts for s in p["sha"]]
    # Distinct groups of the slice, each with its ids.
    keys = np.concatenate([p["keys"] for p in parts])
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    a_size, b_size = (np.concatenate([np.diff(p[c]) for p in parts])[first] for c in ("a_bounds", "b_bounds"))
    a_ids, b_ids = [], []
    base = np.concatenate([[0], np.cumsum([len(p["keys"]) for p in parts])])
    source = np.searchsorted(base, first, "right") - 1
    a_bounds, b_bounds = np.concatenate([[0], np.cumsum(a_size)]), np.concatenate([[0], np.cumsum(b_size)])
    a_ids, b_ids = np.zeros(a_bounds[-1], np.int32), np.zeros(b_bounds[-1], np.int32)
    for k, p in enumerate(parts):
        at = np.flatnonzero(source == k)
        own = first[at] - base[k]
        for ids, bounds, name in ((a_ids, a_bounds, "a"), (b_ids, b_bounds, "b")):
            size = bounds[at + 1] - bounds[at]
            total = np.concatenate([[0], np.cumsum(size)])
            place = np.arange(total[-1]) + np.repeat(bounds[at] - total[:-1], size)
            ids[place] = _flat_lists(p[f"{name}_ids"], p[f"{name}_bounds"][own], p[f"{name}_bounds"][own + 1])
    # Groups of each document, with how often they occur.
    group = np.concatenate([number[base[k] + p["group"]] for k, p in enumerate(parts)])
    times = np.concatenate([p["times"] for p in parts])
    size = np.concatenate([p["size"] for p in parts])
    null = doc_ids.is_null().to_numpy() if isinstance(doc_ids, pa.ChunkedArray) else np.zeros(len(doc_ids), bool)
    return Slice(
        doc_id=doc_ids.cast(pa.int64()).fill_null(0).to_numpy(), null=null, sha=sha, first=np.concatenate([[0], np.cumsum(size)]), group=group.astype(np.int32), times=times.astype(np.int32),
        a_bounds=a_bounds, a_ids=a_ids, b_bounds=b_bounds, b_ids=b_ids, **columns,
    )


def _aligned_part(data: np.ndarray, offsets: np.ndarray, low: int, high: int, a_pieces: Pieces, b_pieces: Pieces) -> dict:
    """Alignment of the rows ``low`` to ``high``, with the distinct groups of each document."""
    n = high - low
    texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[low:high], offsets[low + 1 : high + 1], strict=True)]
    used = np.array([bool(t) for t in texts], bool)
    whole = "".join(" " + t for t in texts if t)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts if t])]).astype(np.int64)
    points = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    empty = np.zeros(n, np.int64)
    out = {"n_a": empty.copy(), "n_b": empty.copy(), "n_groups": empty.copy(), "n_links": empty.copy(), "sha": [""] * n, "size": empty.copy()}
    out |= {"keys": np.zeros(0, np.uint64), "group": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
    out |= {"a_ids": np.zeros(0, np.int32), "b_ids": np.zeros(0, np.int32), "a_bounds": np.zeros(1, np.int64), "b_bounds": np.zeros(1, np.int64)}
    if not len(points):
        return out
    sides = [p.tokens(whole, points, bounds) for p in (a_pieces, b_pieces)]
    sound = sides[0][2] & sides[1][2]
    if not sound.any():
        return out
    # Tokens of the texts that both tokenizers give back.
    ids, firsts = [], []
    for own, cut, _ in sides:
        kept = np.repeat(sound, np.diff(cut))
        ids.append(own[kept])
        firsts.append(np.concatenate([[0], np.cumsum(np.diff(cut)[sound])]))
    rows = np.flatnonzero(used)[sound]
    ends = [np.cumsum(p.lengths[i]) for p, i in zip((a_pieces, b_pieces), ids, strict=True)]
    a_ends, b_ends = group_bounds(*ends)
    # A text's end closes a group, so groups never lie across texts.
    last = np.searchsorted(a_ends, firsts[0])
    groups = np.diff(last)
    text = np.repeat(np.arange(len(rows)), groups)
    size_a, size_b = np.diff(a_ends), np.diff(b_ends)
    written, stop = written_groups(ids[0], ids[1], a_ends, b_ends)
    stop = np.concatenate([[0], stop])[last]
    view = memoryview(written)
    for k, row in enumerate(rows.tolist()):
        out["sha"][row] = hashlib.sha256(view[stop[k] : stop[k + 1] - 1]).hexdigest()  # without the last mark
    out["n_a"][rows], out["n_b"][rows], out["n_groups"][rows] = np.diff(firsts[0]), np.diff(firsts[1]), groups
    links = np.concatenate([[0], np.cumsum(size_a * size_b)])[last]
    out["n_links"][rows] = np.diff(links)
    keys = W.mix(_sequence_hash(ids[0], a_ends, 1)) + _sequence_hash(ids[1], b_ends, 2)
    distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
    pairs, times = np.unique(text.astype(np.int64) << 32 | number, return_counts=True)
    out["size"][rows] = np.bincount(pairs >> 32, minlength=len(rows))
    out["keys"], out["group"], out["times"] = distinct, pairs & 0xFFFFFFFF, times
    for name, own, cut in (("a", ids[0], a_ends), ("b", ids[1], b_ends)):
        out[f"{name}_ids"] = _flat_lists(own, cut[first], cut[first + 1])
        out[f"{name}_bounds"] = np.concatenate([[0], np.cumsum(cut[first + 1] - cut[first])])
    return out


def aligned_slices(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed alignments, ``slice`` and ``payload``, one row for each slice of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_pieces, b_pieces = _loaded(BytePieces, a_path), _loaded(FallbackPieces, b_path)
        number = TaskContext.get().partitionId() << 32
        held: list[pa.Table] = []
        size = 0

        def emit() -> pa.RecordBatch:
            whole = pa.concat_tables(held)
            payload = align(whole[0], whole[1], a_pieces, b_pieces).packed()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary())], names=["slice", "payload"])

        for batch in batches:
            _, offsets = W.flat(batch.column(1))
            for low, high in W.cuts(offsets, SLICE_BYTES):
                held.append(pa.Table.from_batches([batch.slice(low, high - low)]))
                size += int(offsets[high] - offsets[low])
                if size >= SLICE_BYTES:
                    yield emit()
                    held, size, number = [], 0, number + 1
        if held:
            yield emit()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _ALIGNED)


def _slice_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for pair, n in Slice.unpacked(payload.as_buffer()).pairs():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), number)), pa.array(pair), pa.array(n.astype(np.int64))], names=["slice", "pair", "n"])


def _slice_rows(slices: pa.Table, counts: pa.Table) -> pa.Table:
    pair = counts["pair"].to_numpy()
    order = np.argsort(pair)
    pair, count, best = pair[order], counts["n"].to_numpy()[order], counts["best"].to_numpy()[order]
    out = []
    for payload in slices["payload"]:
        own = Slice.unpacked(payload.as_buffer())
        columns = {f: getattr(own, f) for f in ("n_a", "n_b", "n_groups", "n_links")} | own.scored(pair, count, best)
        columns["doc_id"] = pa.array(own.doc_id, mask=own.null)
        columns["groups_sha256"] = pa.array(own.sha, pa.string())
        out.append(pa.table({c: columns[c] for c in _COLUMNS}))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.string() if c == "groups_sha256" else pa.int64()) for c in _COLUMNS})


def pair_counts(slices: DataFrame) -> DataFrame:
    """``slice``, ``pair``, and over all slices ``n``, the documents that hold the pair linked,
    and ``best``, whether none of its id of A has more."""
    own = saved(slices.mapInArrow(_slice_pairs, _PAIRS), "pairs")
    counts = own.groupBy("pair").agg(F.sum("n").alias("n"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    # At most as many rows for an id of A as B has ids.
    flagged = counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    return own.select("slice", "pair").join(flagged, "pair")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the numbers of tokens, groups and links, how the links stand in the whole
    corpus, and the digest of its groups."""
    slices = saved(aligned_slices(docs, a_path, b_path, key, text), "slices")
    counts = pair_counts(slices)
    return slices.groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(_slice_rows, _RESULT)


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

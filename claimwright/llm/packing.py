"""Packing of tokenised documents into sequences by exact-complement hashing.

Pieces of one length are interchangeable, so the plan is made on the counts of lengths, of
which there are at most as many as a sequence has places. Lengths are taken from the longest
down; the gap they leave is looked up in an index of the sums of one, two and three lengths
that are still available, and the combination that fills the gap exactly is consumed as
often as its members allow. What has no exact complement is placed best-fit: the largest
length that still fits, again and again. A plan is a short list of patterns with counts.

Each piece gets its rank among the pieces of its length, by counts of blocks added up over
the blocks, and finds the sequence and the place that the plan has for that rank. No step
gathers the pieces of a length in one task.

Tokenising splits the text of a slice at the tokenizer's added tokens and then into the pieces
of its own pattern with arrays, and encodes each distinct piece once with the tokenizer as it
was loaded.

Defined cases: null and empty texts are the end token alone; only documents longer than a
sequence are cut, into a first piece with the remainder and full pieces; repeated rows are
packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimwright.llm import words as W
from claimwright.llm.blocks import saved
from claimwright.llm.registry import query

SEQUENCE, END_TOKEN = 1024, 2
SLICE_BYTES = 1 << 20
#: Distinct pieces that a process remembers between slices; beyond, it starts afresh.
REMEMBERED = 500_000
#: Pieces in one block of the ranking.
BLOCK_PIECES = 50_000

# White space of the tokenizer's pattern, by code point.
SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions of the tokenizer's pattern, after the apostrophe.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

_OTHER, _LETTER, _NUMBER, _BLANK = 0, 1, 2, 3
_KINDS: list[np.ndarray] = []
_TOKENIZERS: dict[str, "PieceTokenizer"] = {}


def kinds() -> np.ndarray:
    """For each code point: letter, number, white space or other; made once in a process."""
    if not _KINDS:
        major = {"L": _LETTER, "N": _NUMBER}
        table = np.fromiter((major.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[SPACES] = _BLANK
        _KINDS.append(table)
    return _KINDS[0]


def split_pieces(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern begin among the code points of several texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds()[points]
    text_start = np.zeros(n + 1, bool)
    text_start[bounds] = True
    text_start = text_start[:n]
    change = text_start.copy()
    change[1:] |= kind[1:] != kind[:-1]
    last = np.ones(n, bool)  # last place of its text
    last[:-1] = text_start[1:]
    begin = change.copy()
    blank = kind == _BLANK
    follows = np.zeros(n, bool)  # another kind follows in the same text
    follows[:-1] = change[1:] & ~last[:-1]
    # The last blank before something else stands apart, and a space joins what follows.
    before = np.flatnonzero(blank & follows)
    begin[before] = True
    joined = before[points[before] == 0x20] + 1
    begin[joined] = False
    # An apostrophe that begins a piece takes the letters of a contraction with it.
    marks = np.flatnonzero((points == 0x27) & begin & follows)
    marks = marks[kind[marks + 1] == _LETTER]
    if len(marks):
        one = points[marks + 1]
        two = np.where((marks + 2 < n) & ~last[marks + 1], points[np.minimum(marks + 2, n - 1)], 0)
        width = np.where(np.isin(one, [ord(c) for c in SHORT]), 1, 0)
        for pair in LONG:
            width[(width == 0) & (one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        marks, width = marks[width > 0], width[width > 0]
        begin[marks + 1] = False
        rest = marks + 1 + width
        inside = (rest < n) & ~last[rest - 1]
        begin[rest[inside]] = True
    return np.flatnonzero(begin)


class PieceTokenizer:
    """Ids of whole texts; every distinct piece is encoded once and remembered by hash."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings that the tokenizer maps to one id wherever they stand in a text.
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        plain = all(not (t.single_word or t.lstrip or t.rstrip) for t in self.tokenizer.get_added_tokens_decoder().values())
        if not plain:
            raise ValueError("added tokens that look at what stands beside them are not supported")
        self.pattern = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode pieces, each as a word of one call, and add them to what is known."""
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)  # an added token is one piece, and one id
        counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces))
        base = len(self.starts) - 1
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, np.array(found.ids, np.uint32)])
        keys, slots = np.concatenate([self.keys, keys]), np.concatenate([self.slots, base + np.arange(len(pieces))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one line, each text followed by the end token, and bounds."""
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        whole = "".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        points = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        # An added token ends the text before it and begins one after it.
        marked = [(m.start() + int(b), m.end() + int(b)) for t, b in zip(texts, bounds, strict=False) for m in (self.pattern.finditer(t) if self.pattern else ())]
        starts = split_pieces(points, np.unique(np.concatenate([bounds, np.array(marked, np.int64).reshape(-1)])) if marked else bounds)
        if marked:
            low, high = np.array(marked, np.int64).T
            starts = starts[np.searchsorted(high, starts, "right") == np.searchsorted(low, starts, "left")]  # none inside a token
        ends = np.concatenate([starts[1:], [len(points)]]) if len(starts) else starts
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
        if (slot < 0).any():
            missing = np.flatnonzero(slot < 0)
            keys, first = np.unique(hashes[missing], return_index=True)
            at = missing[first]
            self.learn(keys, [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slot = self._slots(hashes)
        count = self.starts[slot + 1] - self.starts[slot]
        total = np.concatenate([[0], np.cumsum(count)])
        source = np.arange(total[-1]) + np.repeat(self.starts[slot] - total[:-1], count)
        ids = self.ids[source]
        # Room for the end token after each text.
        cut = total[np.searchsorted(starts, bounds)]
        line = np.full(len(ids) + len(texts), END_TOKEN, np.uint32)
        line[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(cut))] = ids
        return line, cut + np.arange(len(cut))

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.slots[at], -1)


def tokenizer_path() -> str:
    """The public vocabulary that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: ``doc_id, piece, start, length, ids_crc32`` and ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = PieceTokenizer(path)
        for batch in batches:
            data, offsets = W.flat(pa.chunked_array([batch.column(1)]))
            for low, high in W.cuts(offsets, SLICE_BYTES):
                line, bounds = _TOKENIZERS[path].encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                size = np.diff(bounds)
                count = -(-size // sequence)
                doc = np.repeat(np.arange(high - low), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                lead = np.where(size % sequence == 0, sequence, size % sequence)
                start = np.where(piece == 0, 0, lead[doc] + (piece - 1) * sequence)
                length = np.where(piece == 0, np.minimum(lead, size)[doc], sequence)
                at = bounds[doc] + start
                crc = [zlib.crc32(line[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                ids = batch.column(0).slice(low, high - low).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: np.ndarray, sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of placing lengths, longest first, where they leave the smallest gap. Equal
    sequences are handled together, so the work does not follow the number of pieces."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                opened = n if length * 2 > sequence else -(-n // (sequence // length))
                gap, group = sequence, ((), opened)
            else:
                group = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            pattern, times = group
            fit = min(gap // length, max(1, n // times)) if times <= n else 1
            used = min(times, n // fit)
            if used < times and gap < sequence:
                gaps.setdefault(gap, []).append((pattern, times - used))
            gaps.setdefault(gap - fit * length, []).append((pattern + (length,) * fit, used))
            n -= used * fit
    return [group for groups in gaps.values() for group in groups]


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many sequences follow each; every length is used up.

    Of the plans that index single lengths, also pairs, and also triples, the one with the
    fewest sequences is taken: many triples leave less for best fit to work with."""
    plans = [plan_by(counts, sequence, most) for most in (3, 2, 1)]
    return min(plans, key=lambda patterns: sum(times for _, times in patterns))


def plan_by(counts: dict[int, int], sequence: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact complements of up to ``most`` lengths, then best fit."""
    left = np.zeros(sequence + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for length in pattern:
            need[length] = need.get(length, 0) + 1
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        patterns.append((pattern, times))

    def enough(pattern: tuple[int, ...]) -> bool:
        return all(left[x] >= pattern.count(x) for x in pattern)

    def pair(total: int, own: int) -> tuple[int, int] | None:
        """Two available lengths with this sum, the larger as large as can be."""
        if total < 2:
            return None
        large = np.arange(total - 1, (total + 1) // 2 - 1, -1)
        for a in large[(left[large] > 0) & (left[total - large] > 0)].tolist():
            if enough((own, a, total - a)):
                return a, total - a
        return None

    def complement(own: int) -> tuple[int, ...] | None:
        gap = sequence - own
        if gap == 0:
            return ()
        if left[gap] and enough((own, gap)):
            return (gap,)
        found = pair(gap, own) if most > 1 else None
        if found:
            return found
        for a in np.flatnonzero(left[: gap - 1])[::-1].tolist() if gap >= 3 and most > 2 else []:
            rest = gap - a
            if rest > 2 * a:
                break
            large = np.arange(min(a, rest - 1), (rest + 1) // 2 - 1, -1)
            for b in large[(left[large] > 0) & (left[rest - large] > 0)].tolist():
                if enough((own, a, b, rest - b)):
                    return (a, b, rest - b)
        return None

    inexact: list[tuple[int, int]] = []
    for own in range(sequence, 0, -1):
        while left[own]:
            found = complement(own)
            if found is None:
                inexact.append((own, int(left[own])))
                left[own] = 0
            else:
                use((own, *found))
    for length, n in inexact:
        left[length] += n
    return patterns + best_fit(left, sequence)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """For each length, ranges of ranks with the first sequence and the offset they get."""
    out, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            out.append((length, rank, rank + times, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return out


def _ranker(group: pa.Table) -> pa.Table:
    """Rank of each piece among those of its length in the block."""
    group = group.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
    length = group["length"].to_numpy()
    first = np.searchsorted(length, length, "left")
    return group.append_column("rank", pa.array(np.arange(len(length)) - first))


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces (``doc_id, piece, start, length, ids_crc32``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    pieces = saved(pieces, "pieces")
    total = pieces.count()
    blocks = max(36, -(-total // BLOCK_PIECES))
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int")
    ranked = pieces.withColumn("block", block).groupBy("block").applyInArrow(
        _ranker, "doc_id long, piece int, start long, length long, ids_crc32 long, block int, rank long"
    )
    ranked = saved(ranked, "ranks")
    counts = ranked.groupBy("length", "block").agg(F.count("*").alias("n"))
    # One row for each block and length; the window adds up the blocks before.
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    sizes = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(plan(sizes, sequence))
    # Bounded by the number of lengths, whatever the number of pieces.
    by_length: dict[int, list] = {}
    for row in places:
        by_length.setdefault(row[0], []).append(row[1:])
    tables = {n: np.array(rows, np.int64) for n, rows in by_length.items()}
    shared = spark.sparkContext.broadcast(tables)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequences, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for own in np.unique(length):
                at = np.flatnonzero(length == own)
                rows = shared.value[int(own)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                sequences[at], offsets[at] = row[:, 2] + rank[at] - row[:, 0], row[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences), pa.array(offsets)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.join(before, ["length", "block"]).select(*columns, (F.col("rank") + F.col("earlier")).alias("rank"))
    return placed.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()))

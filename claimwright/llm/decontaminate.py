"""Benchmark decontamination by an FM-index for each shard of the training texts.

A shard is a few megabytes of whole texts inside a Spark task. Its words become symbols:
those of the benchmark keep a number, all others end a run, and only runs as long as the
shortest window are indexed, as no other place can hold one. Over the runs stands a suffix
array, its Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled
every few places. All windows of the benchmark are searched backward together through the
ranks of the matrix, their occurrences located by walking to the next sampled position,
and the spans they cover merged.

The documents are read once and not shuffled. The benchmark goes to the tasks in chunks of
about ``CHUNK_BYTES`` of text, whatever its size. A shard meets all chunks, one in memory at a
time, before anything is reported or cut: the hits of all chunks are places in the original
text, so results do not depend on how the benchmark is cut into chunks.

Defined cases: a null text has no words; null or repeated item ids count as one item (null
is written ``null``); an item without words is in no document; repeated document rows give
repeated result rows; extra columns of the input are ignored by ``contamination`` and kept
by ``remove_spans``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwright.llm import words as W
from claimwright.llm.registry import query

WINDOW = 10
#: Bytes of benchmark text that a shard meets at once.
CHUNK_BYTES = 4 << 20
#: Bytes of training text under one index.
SHARD_BYTES = 4 << 20
SAMPLE_EVERY = 8


class Phrases:
    """The distinct windows of some benchmark items, as numbers of a sorted vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        data, offsets = W.flat(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = W.find_words(data, offsets, W.ALNUM)
        hashes = W.hash_words(data, starts, ends)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        found: dict[tuple[int, ...], set[str]] = {}
        for k, (item, _) in enumerate(items):
            own = symbols[first[k] : first[k + 1]].tolist()
            width = min(window, len(own))
            for at in range(len(own) - width + 1 if own else 0):
                found.setdefault(tuple(own[at : at + width]), set()).add("null" if item is None else str(item))
        self.groups = []  # for each width: windows as rows of symbols, and the items of each
        for width in sorted({len(w) for w in found}):
            rows = [w for w in found if len(w) == width]
            self.groups.append((np.array(rows, np.int32), [sorted(found[w]) for w in rows]))
        self.shortest = min((g[0].shape[1] for g in self.groups), default=0)


class WaveletMatrix:
    """Ranks of numbers in a sequence, one level of counted bits for each binary digit."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.zeros, self.counts, self.bits = [], [], bits
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.counts.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        begin = np.zeros_like(end)
        for depth in range(self.bits):
            one = ((symbol >> (self.bits - 1 - depth)) & 1).astype(bool)
            ones, zeros = self.counts[depth], self.zeros[depth]
            ones_begin, ones_end = ones[begin], ones[end]
            begin = np.where(one, zeros + ones_begin, begin - ones_begin)
            end = np.where(one, zeros + ones_end, end - ones_end)
        return end - begin


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be unlike all others."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, width = rank.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, width = new, width * 2
        if rank.max() == n - 1 or width >= n:
            return order


class FMIndex:
    """Backward search over runs of symbols; runs end in symbol 0, words are 1 and more."""

    def __init__(self, symbols: np.ndarray, size: int, every: int = SAMPLE_EVERY) -> None:
        ends = symbols == 0
        # Each end is its own symbol while sorting, so no comparison runs past a run.
        keys = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + len(symbols))
        order = suffix_array(keys)
        before = np.roll(symbols, 1)
        self.bwt = before[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size + 1))])
        self.ranks = WaveletMatrix(self.bwt, max(1, int(size).bit_length()))
        # Sampled are every few positions, and the first of each run, so no walk leaves a run.
        sampled = (order % every == 0) | (self.bwt == 0)
        self.order, self.sampled = np.where(sampled, order, -1), sampled

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols the range of suffixes that begin with it."""
        begin = np.zeros(len(windows), np.int64)
        end = np.full(len(windows), len(self.bwt), np.int64)
        alive = np.arange(len(windows))
        for column in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[alive, column]
            begin[alive] = self.starts[symbol] + self.ranks.rank(symbol, begin[alive])
            end[alive] = self.starts[symbol] + self.ranks.rank(symbol, end[alive])
            alive = alive[begin[alive] < end[alive]]
            if not len(alive):
                break
        return begin, np.maximum(begin, end)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of these suffixes, walking left to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            at = rows[walking]
            symbol = self.bwt[at]
            rows[walking] = self.starts[symbol] + self.ranks.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.order[rows] + steps


def occurrences(phrases: Phrases, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[list[str]]]]:
    """For each width: places (numbers of words) with the window that begins there."""
    if not phrases.groups or not len(words):
        return
    at = np.minimum(np.searchsorted(phrases.vocabulary, words), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == words
    breaks = ~known
    # Runs of known words, cut at the beginnings of texts.
    begins = known.copy()
    begins[1:] &= breaks[:-1]
    text_starts = np.unique(first[:-1][first[:-1] < len(words)])
    begins[text_starts] = known[text_starts]
    run = np.cumsum(begins) - 1
    lengths = np.bincount(run[known], minlength=int(begins.sum()))
    kept = known.copy()
    kept[known] = lengths[run[known]] >= phrases.shortest
    place = np.flatnonzero(kept)
    if not len(place):
        return
    new_run = np.concatenate([[True], run[place][1:] != run[place][:-1]])
    slot = np.arange(len(place)) + np.cumsum(new_run) - 1
    symbols = np.zeros(int(slot[-1]) + 2, np.int32)
    symbols[slot] = at[place] + 1
    origin = np.zeros(len(symbols), np.int64)
    origin[slot] = place
    index = FMIndex(symbols, len(phrases.vocabulary))
    for windows, items in phrases.groups:
        begin, end = index.search(windows + 1)
        count = end - begin
        total = int(count.sum())
        if total:
            which = np.repeat(np.arange(len(windows)), count)
            rows = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
            yield origin[index.locate(rows)], which, windows.shape[1], items


def scan_texts(chunks: Callable[[], Iterable[Phrases]], column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set], tuple[int, int], np.ndarray, np.ndarray]]:
    """Shard by shard: first words, hit words, word bounds, items of each text, rows, bytes."""
    data, offsets = W.flat(column)
    for low, high in W.cuts(offsets, SHARD_BYTES):
        part, inner = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = W.find_words(part, inner, W.ALNUM)
        words = W.hash_words(part, starts, ends)
        change = np.zeros(len(words) + 1, np.int64)
        items: list[set] = [set() for _ in range(high - low)]
        for phrases in chunks():
            for places, which, width, names in occurrences(phrases, words, first):
                np.add.at(change, places, 1)
                np.add.at(change, places + width, -1)
                text = np.searchsorted(first, places, "right") - 1
                for t, w in set(zip(text.tolist(), which.tolist(), strict=True)):
                    items[t].update(names[w])
        hit = np.cumsum(change)[:-1] > 0
        yield starts, ends, first, hit, items, (low, high), part, inner


def _passes(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Phrases]:
    """The benchmark in chunks of bounded bytes; one empty chunk if there is no item."""
    chosen = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-int(total) // CHUNK_BYTES))
    chosen = chosen.withColumn("chunk", F.pmod(F.xxhash64("item", "text"), F.lit(chunks)))
    for chunk in range(chunks):
        rows = chosen.where(F.col("chunk") == chunk).drop("chunk").toArrow()
        yield Phrases(list(zip(rows["item"].to_pylist(), rows["text"].to_pylist(), strict=True)), window)


def _shared(docs: DataFrame, benchmark: DataFrame, item: str, text: str, window: int) -> list[Broadcast]:
    return [docs.sparkSession.sparkContext.broadcast(phrases) for phrases in _passes(benchmark, item, text, window)]


def _mapped(docs: DataFrame, shared: list[Broadcast], task, schema: str | T.StructType) -> DataFrame:
    def chunks() -> Iterator[Phrases]:
        for chunk in shared:
            yield chunk.value
            # Of several chunks none stays in memory; its file is read again for the next shard.
            if len(shared) > 1 and getattr(chunk, "_path", None):
                vars(chunk).pop("_value", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from task(chunks, batch)

    return docs.mapInArrow(run, schema)


_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _hits(chunks: Callable[[], Iterable[Phrases]], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids = pa.chunked_array([batch.column(0)])
    for _, _, first, hit, items, (low, high), _, _ in scan_texts(chunks, pa.chunked_array([batch.column(1)])):
        places = [np.flatnonzero(hit[first[k] : first[k + 1]]) for k in range(high - low)]
        yield pa.RecordBatch.from_arrays(
            [ids.slice(low, high - low).combine_chunks().cast(pa.int64()), pa.array(np.diff(first)),
             pa.array(places, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
            schema=_HITS,
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Per document: its words, the places of hit words, and the items found in it."""
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return _mapped(chosen, _shared(docs, benchmark, item, "text", window), _hits, "doc_id long, n_words long, hits array<long>, items array<string>")


def _cleaner(names: list[str], text: str):
    def task(chunks: Callable[[], Iterable[Phrases]], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        column = pa.chunked_array([batch.column(at)])
        valid = batch.column(at).is_valid().to_pylist()
        out: list[str | None] = []
        for starts, ends, first, hit, _, (low, high), part, inner in scan_texts(chunks, column):
            for k in range(high - low):
                own = hit[first[k] : first[k + 1]]
                if not valid[low + k]:
                    out.append(None)
                    continue
                if not own.any():
                    out.append(part[inner[k] : inner[k + 1]].tobytes().decode("utf-8", "replace"))
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                begin, end = starts[first[k] + edge[::2]], ends[first[k] + edge[1::2] - 1]
                marks = np.concatenate([[inner[k]], np.stack([begin, end], 1).reshape(-1), [inner[k + 1]]])
                kept = [part[a:b].tobytes() for a, b in zip(marks[::2], marks[1::2], strict=True)]
                out.append(b"".join(kept).decode("utf-8", "replace"))
        columns = [*batch.columns]
        columns[at] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return task


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents with every merged span of benchmark words cut out of their texts, all
    other columns as they are. Spans reach from the first to the last hit word of a run."""
    schema = T.StructType([T.StructField(f.name, f.dataType if f.name != text else T.StringType(), True) for f in docs.schema.fields])
    return _mapped(docs, _shared(docs, benchmark, item, "text", window), _cleaner(docs.columns, text), schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``contamination``."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))




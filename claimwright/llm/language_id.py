"""Language identification: known words first, then shorter and shorter character n-grams.

A word that the model knows adds its log frequency in each language. An unseen word is cut
into character n-grams with its bounds; of the longest kind of which the model knows any,
the mean log frequency counts. The text's language has the largest sum, its score is the
share of that language after a soft maximum over the languages.

The model is fitted on a sample of labelled rows of bounded size (``FIT_ROWS``, chosen by a
hash of the row) and keeps all words and n-grams of these rows, so what goes to the tasks is
bounded by the sample. The counts are made and added up on the cluster. Every text is scored whole, in one pass, without a
shuffle.

Defined cases: ``und`` with score 0 for a null text, one without any letter, and every text
if nothing could be learned; a text of letters of which nothing is known gets the language
with the most training words. Rows without language, text or id are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm import words as W
from claimwright.llm.blocks import held_out
from claimwright.llm.registry import query

#: Bound of the fit: labelled rows.
FIT_ROWS = 20_000
LONGEST = 4
#: Added to each count: little, so that a word seen once in one language tells something.
SMOOTH = 0.01
UNKNOWN = "und"
SLICE_BYTES = 2 << 20
_SPACE = 0x20

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, with a space where no letter stands, and the
    bounds of the texts; each text ends in a space."""
    texts = [data[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32) if texts else np.zeros(0, np.uint32)
    return np.where(letters()[points], points, _SPACE).astype(np.uint32), bounds


def letter_words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, and prefix sums for their hashes."""
    inside = points != _SPACE
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    values = W.mix(points.astype(np.uint64) + np.uint64(0x51ED27))
    return edges[::2], edges[1::2], W.prefix_sums(values)


def gram_places(starts: np.ndarray, ends: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all ``n``-grams of these words with a space before and after, and the
    number of the word of each."""
    low = np.maximum(starts - 1, 0)
    count = np.maximum(np.minimum(ends + 1, total) - low - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), count)
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + low[word]
    return place, word


class Model:
    """Sorted hashes with a row of log frequencies by language, for words and each n."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]], totals: dict[int, np.ndarray]) -> None:
        self.languages, self.tables = languages, {}
        for level, (keys, counts) in tables.items():
            order = np.argsort(keys)
            share = np.log((counts[order] + SMOOTH) / (totals[level] + SMOOTH * (len(keys) + 1)))
            self.tables[level] = (keys[order], share.astype(np.float32))
        words = totals.get(0, np.zeros(len(languages)))
        self.usual = int(np.argmax(words)) if len(languages) else -1

    def known(self, level: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, rows = self.tables.get(level, (np.zeros(0, np.uint64), None))
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, at

    def predict(self, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, k = len(valid), len(self.languages)
        points, bounds = code_points(data, offsets)
        starts, ends, sums = letter_words(points)
        first = np.searchsorted(starts, bounds)
        has_letter = (np.diff(first) > 0) & valid
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        per_word = np.zeros((len(starts), k), np.float32)
        found, at = self.known(0, W.range_hash(sums, starts, ends))
        if found.any():
            per_word[found] = self.tables[0][1][at[found]]
        rest = np.flatnonzero(~found)
        for level in range(LONGEST, 0, -1):
            if not len(rest):
                break
            place, word = gram_places(starts[rest], ends[rest], level, len(points))
            hit, at = self.known(level, W.range_hash(sums, place, place + level))
            if not hit.any():
                continue
            counts = np.bincount(word[hit], minlength=len(rest))
            rows = self.tables[level][1][at[hit]]
            mean = np.stack([np.bincount(word[hit], rows[:, c], len(rest)) for c in range(k)], 1) / np.maximum(counts, 1)[:, None]
            scored = counts > 0
            per_word[rest[scored]] = mean[scored]
            rest = rest[~scored]
        text = np.repeat(np.arange(n), np.diff(first))
        total = np.stack([np.bincount(text, per_word[:, c], n) for c in range(k)], 1)
        # A long text is not surer than twenty of its words would make it.
        total *= np.minimum(1.0, 20.0 / np.maximum(np.diff(first), 1))[:, None]
        share = np.exp(total - total.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = np.where(np.abs(total).sum(1) > 0, share.argmax(1), self.usual)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter, strict=True)]
        return names, np.where(has_letter, share[np.arange(n), best], 0.0)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (level 0) and n-grams by language, for each slice of the sample."""
    for batch in batches:
        languages = np.array(batch.column(1).to_pylist(), dtype=object)
        data, offsets = W.flat(pa.chunked_array([batch.column(0)]))
        for low, high in W.cuts(offsets, SLICE_BYTES):
            points, bounds = code_points(data, offsets[low : high + 1])
            starts, ends, sums = letter_words(points)
            owner = languages[low:high][np.searchsorted(bounds, starts, "right") - 1]
            for language in sorted(set(owner)):
                own = np.flatnonzero(owner == language)
                for level in range(LONGEST + 1):
                    if level:
                        place, _ = gram_places(starts[own], ends[own], level, len(points))
                        hashes = W.range_hash(sums, place, place + level)
                    else:
                        hashes = W.range_hash(sums, starts[own], ends[own])
                    keys, counts = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([language] * len(keys), pa.string()), pa.array(np.full(len(keys), level, np.int32)),
                         pa.array(keys.view(np.int64)), pa.array(counts)],
                        names=["lang", "level", "gram", "n"],
                    )


def fit(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from rows where ``train`` holds and text and language are there."""
    own = docs.where(train & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = own.count()
    if rows > fit_rows:
        share = int(fit_rows / rows * (1 << 30))
        own = own.where(F.pmod(F.xxhash64(F.col(key), F.lit("language")), F.lit(1 << 30)) < share)
    counts = own.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(_counter, "lang string, level int, gram long, n long")
    counts = counts.groupBy("level", "gram", "lang").agg(F.sum("n").alias("n")).persist()
    try:
        total_rows = counts.groupBy("level", "lang").agg(F.sum("n").alias("n")).collect()
        languages = sorted({r["lang"] for r in total_rows})
        totals = {level: np.zeros(len(languages)) for level in {r["level"] for r in total_rows}}
        for r in total_rows:
            totals[r["level"]][languages.index(r["lang"])] = r["n"]
        whole = counts.groupBy("level", "gram").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        tables = {}
        for level in sorted(totals):
            kept = whole.where(F.col("level") == level)
            found = kept.select("gram", *[F.coalesce(F.col("by")[x], F.lit(0)).alias(f"c{k}") for k, x in enumerate(languages)]).toArrow()
            if found.num_rows:
                tables[level] = (found["gram"].to_numpy().view(np.uint64), np.stack([found[f"c{k}"].to_numpy() for k in range(len(languages))], 1))
    finally:
        counts.unpersist()
    return Model(languages, tables, totals)


def identify(docs: DataFrame, model: Model, text: str = "text", added: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The documents with language and score under the ``added`` names, in place of columns
    of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*added)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            data, offsets = W.flat(pa.chunked_array([column]))
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            for low, high in W.cuts(offsets, SLICE_BYTES):
                found, score = shared.value.predict(data, offsets[low : high + 1], valid[low:high])
                kept = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string()), pa.array(score)], names=[*names, *added])

    return docs.mapInArrow(run, docs.withColumns({added[0]: F.lit(""), added[1]: F.lit(0.0)}).schema)


def accepted(docs: DataFrame, model: Model, text: str = "text", least_score: float = 0.5) -> DataFrame:
    """The documents whose language was found, with their own columns. Rejected are those
    of no language and those whose language is in doubt."""
    names = docs.columns
    found = identify(docs, model, text, ("_language", "_certainty"))
    return found.where((F.col("_language") != UNKNOWN) & (F.col("_certainty") >= least_score)).select(*names)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out("doc_id", 5))
    chosen = docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), "text")
    return identify(chosen, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))

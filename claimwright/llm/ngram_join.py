"""Jaccard join of documents on word n-grams, with groups of linked documents.

A document's set holds its distinct shingles of ``WORDS`` words (a shorter text is one
shingle, an empty one has none). Two documents link when 100 times their common shingles
reach 75 times those of either. The result is exact; equal sets are one class from the start.

1. Blocks ask shards how many documents hold each shingle. A document can only link if at
   least three quarters of its shingles occur elsewhere; all others are done here.
2. Shingles are ordered rarest first. Linked documents share one among the first quarter of
   each (prefix filter), so candidates meet under such shingles and never under a passage
   that many otherwise unlike documents have.
3. Under a shingle, first documents are compared with one centre, in a few rounds with other
   centres. Most groups of copies are then one component, and a further link within one adds
   nothing.
4. What remains under a shingle with several components goes into tiles of bounded size and
   of one size band. Tiles meet if their bands can link; in a pair of tiles, bit counts of
   hashed bitmap signatures bound the overlap from above, and only pairs that pass are
   emitted and compared exactly, as sorted arrays: first the most promising one of each
   document, then, where components still differ, all.
5. Components come from repeated least neighbours with pointer jumping.

Defined cases: null texts and texts without words have no shingles and link with nothing;
repeated rows and rows that share an id are separate members of their class; a row without
id keeps no id but can link others, and has the least id of its component; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimwright.llm import words as W
from claimwright.llm.blocks import block_count, in_blocks, kept, planes, saved, scratch, shard_cuts, table, unplanes
from claimwright.llm.graph import components
from claimwright.llm.registry import query

WORDS, PERCENT = 5, 75
#: Bits of a signature (about eight for each shingle, between these); documents of a tile, and members compared with one centre in a task.
LEAST_BITS, MOST_BITS, TILE, MEMBERS = 1024, 32768, 256, 512
#: Rounds of comparisons with centres; more rounds leave less for the tiles, never other results.
STARS = 1
#: Bytes of text in a block; a task holds some ten times as much in arrays.
BLOCK_BYTES = 6 << 20
#: Size bands grow by this factor, a little more than linked sizes can differ.
BAND = 1.34
_KEY_BYTES = 5

_ASK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary())])
_SETS = pa.schema(
    [("doc_id", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("alone", pa.int64()), ("cls", pa.int64()), ("shingles", pa.binary()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64()))]
)
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one text after the other, and bounds."""
    data, offsets = W.flat(column)
    starts, ends, first = W.find_words(data, offsets, W.NOT_BLANK)
    words = W.hash_words(data, starts, ends)
    grams = W.hash_grams(words, WORDS)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), np.maximum(count - WORDS + 1, 0))
    own = np.maximum(count - WORDS + 1, 0)
    place = np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[:-1], own)
    grams = grams[place]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        whole = np.array([W.hash_run(words[first[k] : first[k + 1]]) for k in short], np.uint64)
        text, grams = np.concatenate([text, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
    text, grams = text[new], grams[new]
    return grams, np.searchsorted(text, np.arange(len(count) + 1))


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """The fewest common shingles with which a set of ``n`` can link."""
    return -(-n * PERCENT // 100)


def _short_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]).tobytes()


def _long_keys(data: bytes) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, _KEY_BYTES)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :_KEY_BYTES] = short
    return out.view(np.uint64).reshape(-1)


def _asker(shards: int):
    def ask(group: pa.Table) -> pa.Table:
        grams, _ = shingle_sets(group["text"])
        keys, counts = np.unique(grams, return_counts=True)
        cut = shard_cuts(keys, shards)
        used = np.flatnonzero(np.diff(cut))
        return table(
            _ASK,
            {
                "shard": used, "block": [group["block"][0].as_py()] * len(used),
                "keys": [_short_keys(keys[cut[s] : cut[s + 1]]) for s in used],
                "counts": [planes(counts[cut[s] : cut[s + 1]].astype(np.uint32)) for s in used],
            },
        )

    return ask


def _answer(group: pa.Table) -> pa.Table:
    """Documents that hold each key. Keys are shortened: two may be taken for one, which
    keeps a document longer than needed and never loses one."""
    keys = [_long_keys(k) for k in group["keys"].to_pylist()]
    counts = np.concatenate([unplanes(c, np.uint32) for c in group["counts"].to_pylist()])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(inverse, counts).astype(np.uint32)[inverse]
    cut = np.cumsum([0] + [len(k) for k in keys])
    return table(_ANSWER, {"block": group["block"], "shard": group["shard"], "counts": [planes(sums[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]})


def signature(shingles: np.ndarray) -> bytes:
    """Bitmap with the bit of each shingle's lower digits set."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * len(shingles) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(shingles % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _set_maker(shards: int):
    def make(group: pa.Table, answers: pa.Table) -> pa.Table:
        grams, bounds = shingle_sets(group["text"])
        answers = answers.sort_by("shard")
        keys = np.unique(grams)
        counts = [unplanes(c, np.uint32) for c in answers["counts"].to_pylist()]
        spread = (np.concatenate(counts) if counts else np.zeros(0, np.uint32))[np.searchsorted(keys, grams)]
        size = np.diff(bounds)
        shared = np.concatenate([[0], np.cumsum(spread > 1)])
        shared = shared[bounds[1:]] - shared[bounds[:-1]]
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(grams * np.uint64(k)), dtype=np.uint64)]) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
        cls = W.mix(sum(W.mix(s[bounds[1:]] - s[bounds[:-1]] + np.uint64(k)) for k, s in enumerate(sums)) + size.astype(np.uint64)).view(np.int64)
        rows: dict[str, list] = {"shingles": [], "bits": [], "prefix": []}
        done: set[int] = set()
        for k in range(len(size)):
            carries = size[k] > 0 and shared[k] >= least_overlap(size[k]) and int(cls[k]) not in done
            if not carries:
                for name in rows:
                    rows[name].append(None)
                continue
            done.add(int(cls[k]))
            own, often = grams[bounds[k] : bounds[k + 1]], spread[bounds[k] : bounds[k + 1]]
            order = np.lexsort((own, often))[: size[k] - least_overlap(size[k]) + 1]
            rows["shingles"].append(own.tobytes())
            rows["bits"].append(signature(own))
            rows["prefix"].append(own[order][often[order] > 1].view(np.int64))
        return table(_SETS, {"doc_id": group["doc_id"], "block": group["block"], "n": size, "alone": size - shared, "cls": pa.array(cls, mask=size == 0), **rows})

    return make


def _folded(bits: bytes, size: int) -> bytes:
    """The signature with fewer bits: remainders of a power of two fall together."""
    if len(bits) == size:
        return bits
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), 0).tobytes()


def _bits(*columns: list[bytes]) -> list[np.ndarray]:
    """Signatures of several columns, all at the fewest bits that one of them has."""
    size = min(len(b) for c in columns for b in c)
    return [np.frombuffer(b"".join(_folded(b, size) for b in c), np.uint64).reshape(len(c), -1) for c in columns]


def overlap_bound(bits: np.ndarray, size: np.ndarray, other_bits: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Most common shingles that two sets can have: every differing bit is one more shingle
    in one of them only."""
    apart = np.bitwise_count(bits ^ other_bits).sum(-1, dtype=np.int64)
    return np.minimum((size + other_size - apart) // 2, np.minimum(size, other_size))


def links(common: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (size + other - common)


def _verify(members: pa.Table, centres: pa.Table) -> pa.Table:
    """Members that link with their centre, by exact intersection of sorted arrays."""
    found: dict[str, list] = {"a": [], "b": []}
    if not centres.num_rows:
        return table(_LINKS, found)
    centre = np.frombuffer(centres["shingles"][0].as_py(), np.uint64)
    centre_bits, name = centres["bits"][0].as_py(), centres["centre"][0].as_py()
    for at in range(members.num_rows):
        own = np.frombuffer(members["shingles"][at].as_py(), np.uint64)
        ours, theirs = _bits([members["bits"][at].as_py()], [centre_bits])
        most = overlap_bound(ours, len(own), theirs, len(centre))
        if not links(most, len(own), len(centre))[0]:
            continue
        place = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
        if links(int((centre[place] == own).sum()), len(own), len(centre)):
            found["a"].append(members["cls"][at].as_py())
            found["b"].append(name)
    return table(_LINKS, found)


def verified(pairs: DataFrame, sets: DataFrame, homes: DataFrame) -> DataFrame:
    """Those ``pairs`` (``cls``, ``centre``) that link. A centre meets its members in tasks
    of about ``MEMBERS`` each, and its set goes to each of those once."""
    parts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "centre").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("parts")
    carriers = sets.where(F.col("shingles").isNotNull()).select("cls", "block", "shingles", "bits")
    members = dealt.join(homes, "cls").join(carriers, ["cls", "block"]).select("centre", "part", "cls", "shingles", "bits")
    centres = dealt.select(F.col("centre").alias("cls"), "centre", "part").distinct().join(homes, "cls").join(carriers, ["cls", "block"]).select("centre", "part", "shingles", "bits")
    centres = centres.toDF(*centres.columns)  # columns of its own: both sides come from the same tables
    return members.groupBy("centre", "part").cogroup(centres.groupBy("centre", "part")).applyInArrow(_verify, "a long, b long")


def tile_pairs(left: tuple, right: tuple, same: bool, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of differing labels in two tiles (classes, sizes, labels, signatures) whose
    bitmaps leave a link possible; with ``best`` only the most promising one of each row.
    The documents of the commonest label are no rows but only columns of the others."""
    sides = [left, right]
    b1, b2 = _bits(left[3], right[3])
    names, counts = np.unique(np.concatenate([left[2], right[2]]), return_counts=True)
    common = names[counts.argmax()]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for one, other, own_bits, their_bits in ((0, 1, b1, b2), (1, 0, b2, b1))[: 1 if same else 2]:
        (c1, n1, l1, _), (c2, n2, l2, _) = sides[one], sides[other]
        for k in np.flatnonzero(l1 != common):
            # From the right tile only what the left rows have not met: their common label.
            ahead = (l2 == common) if one else (l2 != l1[k])
            if same:
                ahead &= (l2 == common) | (np.arange(len(c2)) > k)
            columns = np.flatnonzero(ahead)
            if not len(columns):
                continue
            most = overlap_bound(own_bits[k], n1[k], their_bits[columns], n2[columns])
            good = columns[links(most, n1[k], n2[columns])]
            if best and len(good) > 1:
                reach = most[links(most, n1[k], n2[columns])]
                good = good[[int((reach / (n1[k] + n2[good] - reach)).argmax())]]
            found.append((np.full(len(good), c1[k]), c2[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.minimum(a, b), np.maximum(a, b)


def _tile_task(best: bool):
    def run(batches):
        for batch in batches:
            for left, right, same in zip(batch["left"], batch["right"], batch["same"].to_pylist(), strict=True):
                sides = []
                for side in (left.values, right.values):
                    cls, n, label, bits = (side.field(k) for k in ("cls", "n", "label", "bits"))
                    sides.append((cls.to_numpy(), n.to_numpy(), label.to_numpy(), bits.to_pylist()))
                a, b = tile_pairs(*sides, same, best)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["cls", "centre"])

    return run


def _labelled(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries with the component that their class has under the links found so far."""
    roots = components(found).select(F.col("node").alias("cls"), F.col("root").alias("label"))
    return saved(entries.join(roots, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled")


def _met_in_tiles(labelled: DataFrame, signed: DataFrame, best: bool) -> DataFrame:
    """Pairs (``cls``, ``centre``) of different components that may link, by tiles of the
    documents under one shingle."""
    groups = labelled.groupBy("token").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("k"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("members")
    ).where("low != high")
    # Shingles of one passage gather the same documents: one of them is enough.
    groups = groups.groupBy("k", "members").agg(F.min("token").alias("token")).select("token")
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")
    rest = saved(labelled.join(groups, "token").withColumn("band", band), "rest")
    salts = rest.groupBy("token", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("salts"))
    tiles = (
        rest.join(salts, ["token", "band"]).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int")).join(signed, "cls")
        .groupBy("token", "band", "salt").agg(F.collect_list(F.struct("cls", "n", "label", "bits")).alias("tile"))
    )
    tiles = saved(tiles, "tiles")
    left = tiles.select("token", F.col("band").alias("own_band"), F.col("salt").alias("own_salt"), F.col("tile").alias("left"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    met = left.join(tiles.withColumnRenamed("tile", "right"), ["token", "band"]).where((F.col("own_band") < F.col("band")) | (F.col("own_salt") <= F.col("salt")))
    met = met.select("left", "right", ((F.col("own_band") == F.col("band")) & (F.col("own_salt") == F.col("salt"))).alias("same"))
    return saved(met.mapInArrow(_tile_task(best), "cls long, centre long").distinct(), "pairs")


def shingle_links(sets: DataFrame) -> DataFrame:
    """Links between classes that join all components: ``a``, ``b``."""
    carriers = sets.where(F.col("shingles").isNotNull())
    # A class may be carried by several blocks; one of them is its home.
    homes = saved(carriers.groupBy("cls").agg(F.min("block").alias("block")), "homes")
    entries = carriers.select("cls", "n", (F.col("alone") / F.col("n")).alias("edits"), F.explode("prefix").alias("token")).distinct()
    entries = saved(entries, "entries")
    labelled, tested, star_links = entries.withColumn("label", F.col("cls")), None, None
    for turn in range(STARS):
        # First the document with the fewest shingles of its own, the likely origin of copies;
        # then any. Only documents of other components are compared.
        order = F.struct("edits", "cls") if turn == 0 else F.struct(F.xxhash64("cls", F.lit(turn)).alias("edits"), "cls")
        centres = labelled.groupBy("token").agg(F.min_by(F.struct("cls", "n", "label"), order).alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        centres = centres.select("token", F.col("c.cls").alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.label").alias("centre_label"))
        near = labelled.join(centres, "token").where((F.col("label") != F.col("centre_label")) & (100 * F.least("centre_n", "n") >= PERCENT * F.greatest("centre_n", "n")))
        # One centre for each document: the one with which it shares most of its prefix.
        shared = near.groupBy("cls", "centre").agg(F.count("*").alias("k"))
        if tested is not None:
            shared = shared.join(tested, ["cls", "centre"], "left_anti")
        star = saved(shared.groupBy("cls").agg(F.max(F.struct("k", "centre")).alias("best")).select("cls", F.col("best.centre").alias("centre")), "star")
        tested = star if tested is None else tested.unionByName(star)
        new = saved(verified(star, sets, homes), "links")
        star_links = new if star_links is None else star_links.unionByName(new)
        labelled = _labelled(entries, star_links)
    signed = carriers.select("cls", "block", "bits").join(homes, ["cls", "block"]).select("cls", "bits")
    # The most promising pair of each document first: it joins most of what can be joined.
    met = _met_in_tiles(labelled, signed, best=True)
    first = star_links.unionByName(saved(verified(met, sets, homes), "links"))
    rest = _met_in_tiles(_labelled(entries, first), signed, best=False).join(met, ["cls", "centre"], "left_anti")
    return saved(first.unionByName(verified(saved(rest, "pairs"), sets, homes)), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles`` and ``component_id``, the least id that
    links lead to."""
    blocks = block_count(docs, text, BLOCK_BYTES)
    rows = in_blocks(docs, blocks, key, text)
    asked = rows.groupBy("block").applyInArrow(_asker(blocks), "shard int, block int, keys binary, counts binary")
    answers = asked.groupBy("shard").applyInArrow(_answer, "block int, shard int, counts binary")
    sets = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _set_maker(blocks), "doc_id long, block int, n long, alone long, cls long, shingles binary, bits binary, prefix array<long>"
    )
    sets = saved(sets, "sets")
    roots = components(shingle_links(sets))
    found = sets.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node", "cls")
    least = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return found.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that link to a smaller id; of equal rows one stays. Rows
    without an id stay."""
    own = F.col("doc_id") == F.col("component_id")
    with scratch(docs.sparkSession) as paths:
        found = near_duplicates(docs, key, text).where("doc_id is not null")
        ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.max(own).alias("_stays"), F.count("*").alias("_rows"))
        # Ids that go or repeat. The sets and links they come from are deleted here.
        special = kept(ids.where("not _stays or _rows > 1").select("_id", F.col("_stays").alias("_again")), "ids", paths)
    # Texts meet the ids that go or repeat once, and planned alike at every size. Rows of an id
    # are together then, so equal rows of one that repeats are found without another shuffle.
    names = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct("*").alias("_doc"), F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"))
    met = rows.join(special.hint("shuffle_hash"), F.col("_key") == F.col("_id"), "left").where("_id is null or _again")
    number = F.row_number().over(Window.partitionBy("_key", "_hash").orderBy(F.lit(0)))
    return met.withColumn("_number", number).where("_id is null or _number = 1").select(*names)


@query("op5_ngram_join")
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Blocks of whole documents, and questions that all blocks ask about each other's hashes.

A block is a bounded share of the documents, chosen by a hash of the row. Every task works
on one block with arrays. What a block must know about the others goes by shards: it sends
each shard one row with its hashes of that shard packed together, the shard answers in the
same order, and the answers meet the block again. A packed row never holds less than one
hash, so the rows are at most as many as with a row for each hash.
"""

from __future__ import annotations

import contextlib
import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.session import shared_path

#: Bytes of text in a block, on average.
BLOCK_BYTES = 16 << 20
#: Blocks at the least, so that small inputs use all cores.
LEAST_BLOCKS = 36


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for these documents, from the measured bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_BLOCKS, -(-int(total) // block_bytes))


def in_blocks(docs: DataFrame, blocks: int, key: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """``doc_id``, ``text``, ``block`` and more columns, with the rows of a block in one
    partition. The block hangs on id and text, so rows that share an id are spread too."""
    block = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).cast("int")
    chosen = [c.alias(n) for n, c in more.items()]
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), block.alias("block"), *chosen).repartition(blocks, "block")


#: Tables that the operators around a call have written so far.
_WRITTEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are saved inside are deleted at the end, but for those whose paths are taken
    out of the list. For steps whose result reads none of the others any more."""
    paths: list[str] = []
    _WRITTEN.append(paths)
    try:
        yield paths
    finally:
        _WRITTEN.remove(paths)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)
        # Spark deletes shuffle files when the driver has collected what refers to them.
        gc.collect()
        spark._jvm.System.gc()


def kept(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """``df`` saved for longer than the scratch tables in ``paths``."""
    out = saved(df, name)
    paths.pop()
    return out


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share, and read back."""
    path = shared_path(df.sparkSession, name)
    for paths in _WRITTEN:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planes(values: np.ndarray) -> bytes:
    """Bytes of a number array, all first bytes first, which packs small numbers well."""
    return zlib.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1) if len(values) else b""


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Strictly rising 64-bit numbers in about two bits each beyond the logarithm of their mean
    distance: low bits side by side, high parts as marks in a bitmap."""
    n = len(values)
    if not n:
        return b""
    rest = values - values[0]
    low = max(0, (int(rest[-1]) // n).bit_length() - 1)
    high = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
    marks = np.zeros(int(high[-1]) + 1, np.uint8)
    marks[high] = 1
    bits = np.unpackbits(rest.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - low :]
    head = np.array([n, low, values[0]], np.uint64)
    return b"".join((head.tobytes(), np.packbits(bits).tobytes(), np.packbits(marks).tobytes()))


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, low, first = np.frombuffer(data, np.uint64, 3)
    n, low = int(n), int(low)
    end = 24 + -(-n * low // 8)
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - low :] = np.unpackbits(np.frombuffer(data[24:end], np.uint8), count=n * low).reshape(n, low)
    rest = np.packbits(bits, axis=1).view(">u8").reshape(n).astype(np.uint64)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data[end:], np.uint8)))[:n] - np.arange(n)
    return rest + (high.astype(np.uint64) << np.uint64(low)) + first


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash, from its upper bits: sorted hashes come in the order of shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def held_out(key: str, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder; rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == 0, F.lit(True))


def shard_cuts(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted hashes, with the end as the last entry."""
    return np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1, dtype=np.uint64))


def table(schema: pa.Schema, columns: dict) -> pa.Table:
    return pa.table({n: pa.array(columns[n], schema.field(n).type) for n in schema.names}, schema=schema)


def ids_of(column: pa.ChunkedArray, null: int = 2**63 - 1) -> np.ndarray:
    """Integer ids as an array; null sorts last."""
    return column.cast(pa.int64()).fill_null(null).to_numpy()

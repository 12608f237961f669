"""Helpers the corpus operators share: blocks of Arrow text, word hashes, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at a time. A longer single text is a block of its own.
BLOCK_BYTES = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="opinionloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_table(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns alone: extra or clashing columns of the input never matter."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of `docs` has them."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


NO_ID = -(1 << 63)


def document_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """`docs` with two more columns that name a document, doc_id and a hash of the text, never null; their names."""
    names = free_names(docs, "key_id", "key_text")
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0))]
    return docs.withColumns(dict(zip(names, keys))), names


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows that hold about `limit` bytes together.

    Null texts have no bytes.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in batches of about `limit` bytes of a text column; empty batches as they are."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if not batch.num_rows:
            yield batch
        for first, end, _, _ in text_blocks(texts, limit):
            yield batch.slice(first, end - first)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64 over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_CODES = stream(11, 256)
BASE = np.uint64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64, for k up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, base in (("up", BASE), ("down", inverse)):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            _powers[key] = np.cumprod(column, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial sums over the bytes before each position; their differences identify substrings."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: equal spans have equal hashes wherever they lie."""
    _, down = powers(len(sums) - 1)
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the maximal runs of set bytes; no run crosses texts."""
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the words (runs of bytes other than white space)."""
    return runs(~SPACE[data], offsets)


def combine(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """One hash for a sequence of hashes."""
    out = np.full(len(parts[0]), seed, np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0xD1342543DE82EF95) + p)
    return out


def shingle_sets(texts: pa.Array, size: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row): `size` lower-cased words, all of them if there are fewer."""
    for first, end, data, offsets in text_blocks(texts, limit):
        data = LOWER[data]
        starts, ends, owner = words(data, offsets)
        hashes = span_hashes(prefix_hashes(data), starts, ends)
        counts = np.bincount(owner, minlength=end - first)
        at = np.concatenate([[0], np.cumsum(counts)])
        long = combine([hashes[k : len(hashes) - size + 1 + k] for k in range(size)], size) if len(hashes) >= size else hashes[:0]
        sets = []
        for k, n in enumerate(counts):
            if n >= size:
                own = np.sort(long[at[k] : at[k] + n - size + 1])
                sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif n:
                sets.append(combine([hashes[i : i + 1] for i in range(at[k], at[k] + n)], int(n)))
            else:
                sets.append(hashes[:0])
        yield first, sets


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array a row."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after another, from batches sorted by that key; keys may straddle batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]])
        if held:
            last = held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py()
            if last != column[0]:
                yield pa.Table.from_batches(held)
                held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < len(column):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)

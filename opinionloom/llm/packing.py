"""Sequence packing along a space-filling curve.

Every document's hashed token counts are projected to a few dimensions; the projections, scaled by their
mean and deviation over all documents, give a Hilbert key. Documents are range-sorted by it, and the stream
of their tokens in that order is cut every `capacity` tokens, so neighbours on the curve share sequences
and only the last sequence has padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import stored, stream, text_table
from .token_counts import Vocabulary, vocabulary_path

CAPACITY = 2048
BUCKETS = 256
DIMENSIONS = 4
BITS = 10
END_ID = 1
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The faster library's pattern gives up in a run of about a million white-space characters; texts with a run of
#: more than this many are cut into pieces by the transducer instead.
LONG_BLANK = 100_000
_BLANK = re.compile(r"\s+")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer file's merges in a faster library; tests hold its ids against the file's own library."""
    import tiktoken

    v = Vocabulary(path)
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens={s.decode(): i for s, i in v.special.items()})


def encode(path: str, text: str) -> np.ndarray:
    """Token ids of one text, special strings included, and the closing id."""
    if len(text) > LONG_BLANK and any(m.end() - m.start() > LONG_BLANK for m in _BLANK.finditer(text)):
        ids = encode_pieces(path, text)
    else:
        ids = encoder(path).encode(text, allowed_special="all")
    ids.append(END_ID)
    return np.array(ids, np.uint32)


def encode_pieces(path: str, text: str) -> list[int]:
    """Token ids of one text whose pieces are found without a pattern that backtracks."""
    library, ids = encoder(path), []
    for part in re.split("(" + "|".join(map(re.escape, sorted(library.special_tokens_set, key=len, reverse=True))) + ")", text):
        if part in library.special_tokens_set:
            ids.append(library.encode_single_token(part))
        elif part:
            whole = part.encode()
            starts, ends = pretokens.pieces(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))
            for a, b in zip(starts.tolist(), ends.tolist()):
                ids += library._encode_single_piece(whole[a:b])
    return ids


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    """Fixed Gaussian directions of the hash buckets."""
    u = (stream(3, 2 * BUCKETS * DIMENSIONS) >> np.uint64(11)).astype(np.float64) / 2**53
    half = BUCKETS * DIMENSIONS
    normal = np.sqrt(-2 * np.log(1 - u[:half])) * np.cos(2 * np.pi * u[half:])
    return normal.reshape(BUCKETS, DIMENSIONS)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points, one row a point, `bits` bits a dimension.

    From the highest bit down, each bit plane undoes the rotations of the planes above it; a Gray code then
    turns the planes into the position.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            turned = (x[i] >> b) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        carry ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def _tokenizing(name: str):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(name)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sizes, packed, points = [], [], []
                for text in part.column(1):
                    ids = encode(path, text.as_py() or "")
                    counts = np.bincount(ids[:-1] % BUCKETS, minlength=BUCKETS)
                    points.append(counts @ projection() / max(np.sqrt((counts**2).sum()), 1))
                    sizes.append(len(ids))
                    packed.append(pa.compress(ids.tobytes(), codec="zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.array([p.tolist() for p in points], pa.list_(pa.float64()))],
                    names=["doc_id", "n", "ids", "point"],
                )

    return tokenize


def _keying(centre: list[float], spread: list[float]):
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array(batch.column(3).to_pylist(), float).reshape(-1, DIMENSIONS)
            scaled = np.tanh((points - centre) / (2 * np.maximum(spread, 1e-9)))
            cells = np.clip((scaled + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hilbert_keys(cells))], names=["row", "doc_id", "n", "key"])

    return key


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each row within its sorted partition."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)], names=["row", "n", "part", "before"]
        )
        before = int(ends[-1]) if len(n) else before


def _cutting(capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for doc, n, packed, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "at"))):
                ids = pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True)
                start = 0
                while start < n:
                    length = min(n - start, capacity - (at + start) % capacity)
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(piece), n, (at + start) // capacity, (at + start) % capacity))
                    parts.append(piece)
                    start += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids"][: len(columns)])

    return cut


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Null and empty texts are the closing id alone. Repeated rows are packed as often as they are given; ties
    on the curve go by doc_id, so many equal documents are split over partitions. An empty table gives an
    empty table. Only doc_id and text are read. ids are unsigned little-endian 32-bit numbers.
    """
    spark = docs.sparkSession
    fields = "doc_id long, n long, ids binary, point array<double>"
    tokens = stored(text_table(docs).mapInArrow(_tokenizing(tokenizer), fields).withColumn("row", F.monotonically_increasing_id()), "tokens")
    axes = range(DIMENSIONS)
    shape = tokens.agg(*[f(F.col("point")[i]).alias(f"{n}{i}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for i in axes]).first()
    centre, spread = ([shape[f"{n}{i}"] or 0.0 for i in axes] for n in "ms")
    keyed = tokens.select("row", "doc_id", "n", "point").mapInArrow(_keying(centre, spread), "row long, doc_id long, n long, key long")
    order = ["key", "doc_id", "row"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("row", "n")
    placed = stored(ranged.mapInArrow(_running, "row long, n long, part int, before long"), "places")

    base, bases = 0, []
    for r in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a partition
        bases.append((r.part, base))
        base += r.n
    starts = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    at = placed.join(starts, "part").select("row", (F.col("base") + F.col("before")).alias("at"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.select("row", "doc_id", "n", "ids").join(at, "row").mapInArrow(_cutting(capacity, with_ids), kind + ", ids binary" * with_ids)

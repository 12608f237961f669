"""Removal of long byte strings that occur more than once anywhere in a corpus, exact to the byte.

1. Every window of `length` bytes is assigned to its anchor: the place of the least hash among the grams of
   150 bytes that begin in its front part. Equal windows have equal anchors, and the windows of one anchor are
   consecutive; the bytes they cover are a segment. A segment's row holds two hashes and its place only.
2. Anchors that occur once have no repeated window. Segments that are equal as a whole are repeated as a whole.
   Both are settled by counting hashes.
3. What is left are anchors with several different segments, where a shared passage begins or ends. One copy of
   each such segment is gathered by anchor; suffix sorting puts equal windows next to each other. Only these
   texts leave their documents.
4. Anchors with more than CELL different segments are split over several tasks; each sorts its own
   share, then the windows without a partner are counted by hash across the shares.

Hashes have 64 bits. Spans come back to the documents by (doc_id, hash of the text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_key, free_names, list_array, mix, prefix_hashes, sliced, sorted_runs, span_hashes, stored, text_blocks, text_table
from .suffix_groups import byte_suffix_order

LENGTH = 400
GRAM = 150
#: Different segments of one anchor that are sorted in one task, about 4 MB of text.
CELL = 8192
SORT_BYTES = 1 << 19


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, first window, bytes, anchor hash, content hash) of every segment, as arrays."""
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return empty, empty, empty, empty, empty
    sums = prefix_hashes(data)
    begins = np.arange(n - gram + 1)
    grams = span_hashes(sums, begins, begins + gram)
    low = np.uint64((1 << int(n).bit_length()) - 1)
    packed = (grams & ~low) | begins.astype(np.uint64)
    anchors = (sliding_least(packed, length - gram + 1) & low).astype(np.int64)
    windows = np.arange(n - length + 1)
    text = np.searchsorted(offsets, windows, "right") - 1
    inside = windows + length <= offsets[text + 1]
    windows, text, anchors = windows[inside], text[inside], anchors[inside]
    if not len(windows):
        return empty, empty, empty, empty, empty
    heads = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])]))
    tails = np.append(heads[1:], len(windows)) - 1
    first, end, anchor = windows[heads], windows[tails] + length, anchors[heads]
    content = mix(span_hashes(sums, first, end) + (anchor - first).astype(np.uint64))
    return text[heads], first - offsets[text[heads]], end - first, grams[anchor].view(np.int64), content.view(np.int64)


def _segmenting(length: int, gram: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, names = (batch.column(c).to_numpy() for c in ("doc", "name"))
            for row, _, data, offsets in text_blocks(batch.column(2)):
                text, first, size, anchor, content = segments(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (docs[row + text], names[row + text], first, size, anchor, content)],
                    names=["doc", "name", "first", "size", "anchor", "content"],
                )

    return cut


def _slicing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each document."""
    for batch in batches:
        names = ["cell", "hot", "doc", "name", "first", "segment"]
        for k in range(batch.num_rows):
            raw = batch.column(2)[k].as_buffer().to_pybytes()
            wanted = batch.column(3)[k].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w["cell"] for w in wanted], pa.int64()),
                    pa.array([w["hot"] for w in wanted], pa.bool_()),
                    pa.array([batch.column(0)[k].as_py()] * len(wanted), pa.int64()),
                    pa.array([batch.column(1)[k].as_py()] * len(wanted), pa.int64()),
                    pa.array([w["first"] for w in wanted], pa.int64()),
                    pa.array([raw[w["first"] : w["first"] + w["size"]] for w in wanted], pa.binary()),
                ],
                names=names,
            )


def repeated_windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts in suffix order, their hashes, and which of them have an equal neighbour."""
    order = byte_suffix_order(data, offsets)
    ends = offsets[1:][np.searchsorted(offsets, order, "right") - 1]
    order = order[order + length <= ends]
    hashes = span_hashes(prefix_hashes(data), order, order + length)
    same = hashes[1:] == hashes[:-1]
    return order, hashes, np.concatenate([[False], same]) | np.concatenate([same, [False]])


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that windows of `length` at the sorted starts cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cuts + 1)].tolist(), (starts[np.append(cuts, len(starts) - 1)] + length).tolist()))


def _sorting(length: int):
    def solve(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables)
        texts = table.column("segment").to_pylist()
        docs, names, first = (table.column(c).to_numpy() for c in ("doc", "name", "first"))
        hot = table.column("hot").to_numpy(zero_copy_only=False)
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        order, hashes, repeated = repeated_windows(data, offsets, length)
        owner = np.searchsorted(offsets, order, "right") - 1
        inside = order - offsets[owner]
        rows = []
        by_text = np.lexsort((inside, owner))
        bounds = np.searchsorted(owner[by_text], np.arange(len(texts) + 1))
        heads = np.concatenate([[True], hashes[1:] != hashes[:-1]])  # one of each class of equal windows
        for k in range(len(texts)):
            own = by_text[bounds[k] : bounds[k + 1]]
            for a, b in _runs(inside[own[repeated[own]]], length):
                rows.append((docs[k], names[k], first[k] + a, first[k] + b, np.zeros(0, np.int64), np.zeros(0, np.int64)))
            if hot[k] and (send := own[heads[own]]).size:
                rows.append((docs[k], names[k], 0, 0, hashes[send].view(np.int64), first[k] + inside[send]))
        return pa.RecordBatch.from_arrays(
            [
                *[pa.array([r[c] for r in rows], pa.int64()) for c in range(4)],
                list_array([r[4] for r in rows], pa.int64()),
                list_array([r[5] for r in rows], pa.int64()),
            ],
            names=["doc", "name", "begin", "end", "windows", "places"],
        )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in sorted_runs(batches, "cell"):
            held.append(table)
            size += table.nbytes
            if size >= SORT_BYTES:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    return sort


def _cleaning(with_text: bool):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, spans in zip(batch.column(1), batch.column(2)):
                raw = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                kept, at, runs = [], 0, 0
                for begin, end in sorted((s["begin"], s["end"]) for s in spans.as_py() or []):
                    if begin > at or not runs:
                        kept.append(raw[at:begin])
                        runs += 1
                        at = end
                    at = max(at, end)
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest(), left))
            columns = [batch.column(0), *[pa.array([o[c] for o in out], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.string()))]]
            if with_text:
                columns.append(pa.array([o[4].decode("utf-8", "ignore") for o in out], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: len(columns)])

    return clean


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, name, begin, end: byte spans to remove, for documents named by (doc, name); they may overlap."""
    keyed = docs.select("doc", "name", F.col("text").cast("binary").alias("raw"))
    fields = "doc long, name long, first long, size long, anchor long, content long"
    found = stored(keyed.where(F.octet_length("raw") >= length).mapInArrow(_segmenting(length, gram), fields), "segments")
    kinds = found.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc", "name", "first", "size")).alias("one"))
    kinds = stored(kinds, "kinds")
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("d"), F.sum("n").alias("n")).where("n > 1")
    whole = kinds.where("n > 1").select("anchor", "content")
    settled = found.join(whole, ["anchor", "content"]).select("doc", "name", F.col("first").alias("begin"), (F.col("first") + F.col("size")).alias("end"))

    open_kinds = kinds.join(anchors.where("d > 1").select("anchor", "d"), "anchor")
    share = F.pmod(F.col("content"), F.ceil(F.col("d") / CELL).cast("bigint"))
    wanted = open_kinds.select(
        F.col("one.doc").alias("doc"),
        F.col("one.name").alias("name"),
        F.struct(
            F.when(F.col("d") > CELL, F.xxhash64("anchor", share)).otherwise(F.col("anchor")).alias("cell"),
            (F.col("d") > CELL).alias("hot"),
            F.col("one.first").cast("bigint").alias("first"),
            F.col("one.size").cast("bigint").alias("size"),
        ).alias("want"),
    )
    wanted = wanted.groupBy("doc", "name").agg(F.collect_list("want").alias("wants"))
    texts = keyed.join(wanted, ["doc", "name"]).select("doc", "name", "raw", "wants")
    texts = texts.mapInArrow(_slicing, "cell long, hot boolean, doc long, name long, first long, segment binary")
    solved = stored(
        texts.repartition("cell").sortWithinPartitions("cell").mapInArrow(_sorting(length), "doc long, name long, begin long, end long, windows array<long>, places array<long>"),
        "solved",
    )
    spans = settled.union(solved.where("end > 0").select("doc", "name", "begin", "end"))
    if solved.where("size(windows) > 0").take(1):
        windows = solved.where("size(windows) > 0").select("doc", "name", F.explode(F.arrays_zip("windows", "places")).alias("w"))
        windows = windows.select("doc", "name", F.col("w.windows").alias("window"), F.col("w.places").alias("begin"))
        shared = windows.groupBy("window").count().where("count > 1").select("window")
        spans = spans.union(windows.join(shared, "window").select("doc", "name", "begin", (F.col("begin") + length).alias("end")))
    return spans


def _with_spans(docs: DataFrame, length: int, gram: int = GRAM) -> tuple[DataFrame, str]:
    """`docs` with one more column, the spans to remove (null if none), and its name."""
    keyed, keys = document_key(docs)
    (column,) = free_names(docs, "cut_spans")
    spans = repeated_spans(keyed.select(F.col(keys[0]).alias("doc"), F.col(keys[1]).alias("name"), F.col("text").cast("string").alias("text")), length, gram)
    spans = spans.groupBy(F.col("doc").alias(keys[0]), F.col("name").alias(keys[1])).agg(F.collect_list(F.struct("begin", "end")).alias(column))
    return keyed.join(spans, keys, "left").select(*[F.col(f"`{n}`") for n in docs.columns], column), column


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`, and kept_text if asked for.

    Null and empty texts have no bytes and lose none. Repeated rows are repeats of one another. With kept_text,
    bytes of characters that a span cuts in two are dropped from the text (not from the digest). An empty table
    gives an empty table. Only doc_id and text are read.
    """
    joined, spans = _with_spans(text_table(docs), length)
    joined = joined.select("doc_id", F.col("text").cast("binary").alias("raw"), spans)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(_cleaning(with_text), kind + ", kept_text string" * with_text)


def _shortening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before the last one, text without the spans in the last one."""
    clean = _cleaning(True)
    for batch in sliced(batches, "text"):
        at, spans = batch.schema.get_field_index("text"), batch.column(batch.num_columns - 1)
        raw = batch.column(at).cast(pa.binary())
        part = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), raw, spans], names=["doc_id", "raw", "spans"])
        left = next(clean(iter([part]))).column(5)
        text = pa.array([new if s.is_valid else old for new, old, s in zip(left.to_pylist(), batch.column(at).to_pylist(), spans)], pa.string())
        yield pa.RecordBatch.from_arrays([text if k == at else c for k, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`docs` with all rows and columns, texts without repeated strings.

    Documents without repeated strings are unchanged. One that consists of repeated strings keeps its row with
    what is left, an empty text at least. n_chars, where present, is that of the new text. gram: bytes of the strings
    that decide which windows meet, fewer than `length`; it changes no result.
    """
    joined, _ = _with_spans(docs, length, gram)
    kind = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    clean = joined.mapInArrow(_shortening, kind)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean

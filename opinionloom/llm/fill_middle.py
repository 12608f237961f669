"""Fill-in-middle documents, cut by a learned rank index.

A cut is a number of code points, a text is UTF-8 bytes. The index of a block of texts answers which byte a code
point starts at: straight segments are fitted to all boundary offsets of the block, none of them off by more than
ERROR, and what each boundary is off by is stored in one byte. A cut is predicted by its segment and put right by
its residual, so it is exact. Its memory is a byte a code point and 24 bytes a segment; the offsets themselves are
held for CHUNK bytes at a time, however long a text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_blocks

#: Most bytes that a segment may be off by; residuals fit one byte.
ERROR = 63
#: Bytes whose boundaries are worked out at a time.
CHUNK = 1 << 20
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")


class RankIndex:
    """Byte offsets of code points: `add` boundaries in order, then `offsets` of any ranks."""

    def __init__(self, error: int = ERROR):
        self.error, self.size = error, 0
        self.firsts: list[np.ndarray] = []
        self.bases: list[np.ndarray] = []
        self.slopes: list[np.ndarray] = []
        self.residuals: list[np.ndarray] = []

    def add(self, offsets: np.ndarray) -> None:
        """Fit segments to more boundaries (ascending byte offsets).

        From the first boundary of a segment, every further one narrows the slopes that keep within the error;
        the segment ends where none is left.
        """
        firsts, slopes, i, window = [], [], 0, 1024
        while i < len(offsets):
            j = min(len(offsets), i + window)
            steps = np.arange(1, j - i)
            rise = offsets[i + 1 : j] - offsets[i]
            low = np.maximum.accumulate((rise - self.error) / steps)
            high = np.minimum.accumulate((rise + self.error) / steps)
            crossed = low > high
            end = i + 1 + int(crossed.argmax()) if crossed.any() else j
            if end == j < len(offsets):
                window *= 2
                continue
            slopes.append((low[end - i - 2] + high[end - i - 2]) / 2 if end > i + 1 else 1.0)
            firsts.append(i)
            window, i = max(256, 2 * (end - i)), end
        if not firsts:
            return
        at, slope = np.array(firsts), np.array(slopes)
        lengths = np.diff(np.append(at, len(offsets)))
        inside = np.arange(len(offsets)) - np.repeat(at, lengths)
        predicted = np.repeat(offsets[at], lengths) + np.rint(inside * np.repeat(slope, lengths)).astype(np.int64)
        self.firsts.append(at + self.size)
        self.bases.append(offsets[at].astype(np.int64))
        self.slopes.append(slope)
        self.residuals.append((offsets - predicted).astype(np.int8))
        self.size += len(offsets)

    def close(self) -> RankIndex:
        for name in ("firsts", "bases", "slopes", "residuals"):
            parts = getattr(self, name)
            setattr(self, name, [np.concatenate(parts)] if parts else [np.zeros(0, np.int64)])
        return self

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The byte at which each code point starts, exactly."""
        firsts, bases, slopes, residuals = (x[0] for x in (self.firsts, self.bases, self.slopes, self.residuals))
        segment = np.searchsorted(firsts, ranks, "right") - 1
        predicted = bases[segment] + np.rint((ranks - firsts[segment]) * slopes[segment]).astype(np.int64)
        return predicted + residuals[ranks]


def index_of(data: np.ndarray, offsets: np.ndarray, error: int = ERROR) -> tuple[RankIndex, np.ndarray]:
    """The index of the texts that `offsets` cut out of `data`, and the rank of each text's begin and of the end."""
    index, ranks = RankIndex(error), []
    for begin in range(0, len(data), CHUNK):
        end = min(begin + CHUNK, len(data))
        opens = (data[begin:end] & 0xC0) != 0x80
        inner = offsets[(offsets >= begin) & (offsets < end)]
        opens[inner - begin] = True  # a text begins a code point, whatever its first byte
        found = np.flatnonzero(opens) + begin
        ranks.append(index.size + np.searchsorted(found, inner))
        index.add(found)
    total = index.size
    index.add(np.array([len(data)]))
    ends = np.full(int((offsets == len(data)).sum()), total)
    return index.close(), np.concatenate([*ranks, ends]).astype(np.int64)


def _cutting(marks: tuple[str, str, str]):
    before, after, inside = (m.encode() for m in marks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(0)):
                forms = batch.column(1).slice(first, end - first).to_pylist()
                draws = [batch.column(c).slice(first, end - first).to_numpy() for c in (2, 3)]
                index, ranks = index_of(data, offsets)
                n = np.diff(ranks)
                low, high = (f(draws[0] % (n + 1), draws[1] % (n + 1)) for f in (np.minimum, np.maximum))
                at = index.offsets(np.concatenate([ranks[:-1] + low, ranks[:-1] + high])).reshape(2, -1)
                raw, out = data.tobytes(), []
                for k, form in enumerate(forms):
                    a, b, c, d = (int(x) for x in (offsets[k], at[0, k], at[1, k], offsets[k + 1]))
                    if form == "psm":
                        out.append(b"".join((before, raw[a:b], after, raw[c:d], inside, raw[b:c])))
                    elif form == "spm":
                        out.append(b"".join((after, raw[c:d], before, raw[a:b], inside, raw[b:c])))
                    else:
                        out.append(raw[a:d])
                whole = pa.array([f == "plain" for f in forms], pa.bool_())
                cuts = [pa.array(x, mask=whole.to_numpy(zero_copy_only=False)) for x in (low, high - low)]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(first, end - first) for c in batch.columns[4:]], pa.array(n), pa.array(forms, pa.string()), *cuts, pa.array(out, pa.large_binary())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return cut


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first groups of the SHA-256 of `seed:doc_id`."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(name, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = 1, changed_percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, output for every row of `docs`.

    Two numbers drawn from the doc_id cut a text in prefix, middle and suffix. Form psm is prefix, suffix, middle,
    spm is suffix, prefix, middle, each after its mark. A text that is empty or null, holds a mark, or is among the
    rest of the percentage stays as it is: form plain, cuts null. A null doc_id draws as an empty one. Rows with one
    doc_id are cut by the same numbers, each row by itself; either cut may be empty. Extra columns are ignored.
    """
    text, u = F.coalesce(F.col("text").cast("string"), F.lit("")), draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for m in marks:
        marked = marked | text.contains(m)
    plain = (text == "") | marked | (u[2] % 100 >= changed_percent)
    form = F.when(plain, "plain").when(u[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(text.alias("text"), form.alias("form"), u[0].alias("one"), u[1].alias("two"), F.col("doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    return rows.mapInArrow(_cutting(marks), fields).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text an output was made of. No mark is in the text of a changed output, so its marks cut it into its parts."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)

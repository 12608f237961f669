"""Words that differ by one code point, found with an index of variable-length grams, and their common forms.

1. Grams of MIN_GRAM to MAX_GRAM code points are counted over the distinct words. The dictionary is pruned by
   frequency: a gram is taken one code point longer only where it occurs in more than a threshold of words, so
   common beginnings are told apart by longer grams and rare ones stay short. Only the grams above the threshold
   are broadcast: at most POSITIONS of each length, whatever the number of words.
2. A word has one gram from each position. One edit affects at most as many of them as cover one place: the
   word's bound. Near words share all grams that the edit leaves, at the same place or one further.
3. So of any `bound + 1` grams of a word at least one is left by the edit, and near words share one among the
   `bound + 1` rarest of each. Only those grams' lists are merged, by gram, position and length.
   A list of a gram below the threshold is no longer than three times the threshold. A gram above it is listed by
   what is before it and by what is after it instead, one of which an edit elsewhere leaves as it is.
4. The members of a list are compared code point by code point in the task that holds the list; only verified
   pairs leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import combine, mix, powers, span_hashes, stored

MIN_GRAM, MAX_GRAM = 2, 8
#: The threshold is 1/POSITIONS of all gram positions, FEWEST at least.
POSITIONS = 100_000
FEWEST = 32
#: Words taken apart at a time, and code points compared at a time.
WORDS = 20_000
CELLS = 8 << 20
#: Most steps from a word to its root: each step multiplies a 64-bit count by 10 at least, so 19 are not reached.
DOUBLINGS = 5


def longest(base: np.ndarray) -> np.ndarray:
    """The longest grams by which words of `base` code points are compared with words of as many or one more.

    About half a word: an edit affects fewer grams of a word than it has, and the commonest lists are left out.
    """
    return np.clip(base // 2, 4, MAX_GRAM)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in one row, and the offsets of the words."""
    words = column.to_pylist()
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _hashes(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Of each length, the hashes of the grams from every position; they may cross words."""
    out, h = {}, mix(codes.astype(np.uint64) + np.uint64(1))
    for q in range(2, MAX_GRAM + 1):
        h = mix(h[: max(len(codes) - q + 1, 0)] * np.uint64(0x9E3779B97F4A7C15) + codes[q - 1 :].astype(np.uint64))
        if q >= MIN_GRAM:
            out[q] = h
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, WORDS):
            yield batch.slice(first, WORDS)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _blocks(batches):
        codes, offsets = _codes(batch.column(0))
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(codes))
        for q, h in _hashes(codes).items():
            grams, n = np.unique(h[left[: len(h)] >= q].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), q)), pa.array(grams), pa.array(n)], names=["size", "gram", "n"])


def frequent_grams(words: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length the sorted grams above the threshold and their counts."""
    positions = words.agg(F.sum(F.length("word"))).first()[0] or 0
    threshold = max(FEWEST, positions // POSITIONS)
    counts = words.select("word").mapInArrow(_gram_counts, "size long, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))
    table = counts.where(F.col("n") > threshold).toArrow()  # at most POSITIONS rows a length
    size, gram, n = (table.column(c).to_numpy() for c in ("size", "gram", "n"))
    out = {}
    for q in range(MIN_GRAM, MAX_GRAM + 1):
        own = gram[size == q].view(np.uint64)
        order = np.argsort(own)
        out[q] = own[order], n[size == q][order]
    return out


def decompose(codes: np.ndarray, offsets: np.ndarray, most: np.ndarray, frequent: dict) -> tuple[np.ndarray, ...]:
    """Of each gram: its position in `codes`, its word, hash, length, count (0 below the threshold); of each word: its bound.

    most: code points of the longest grams of each word.
    """
    end = np.repeat(offsets[1:], np.diff(offsets))
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(end - np.arange(len(codes)) >= MIN_GRAM)
    word, end = word[at], end[at]
    length, gram, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    grows, most = np.ones(len(at), bool), most[word]
    for q, h in _hashes(codes).items():
        grows &= (end - at >= q) & (q <= most)
        own = h[at[grows]]
        known, n = frequent[q]
        place = np.searchsorted(known, own)
        hit = place < len(known)
        hit[hit] = known[place[hit]] == own[hit]
        length[grows], gram[grows] = q, own
        count[grows] = np.where(hit, n[np.minimum(place, len(n) - 1)] if len(n) else 0, 0)
        grows[grows] = hit
    # A gram that only the end of its word keeps from growing is affected by a letter put there.
    covered = at + length + ((at + length == end) & (length < most) & (count > 0))
    spans = np.zeros(len(codes) + len(offsets) + 1, np.int64)  # one place more a word
    np.add.at(spans, at + word, 1)
    np.add.at(spans, covered + word, -1)
    bound = np.maximum.reduceat(np.cumsum(spans), offsets[:-1] + np.arange(len(offsets) - 1)) if len(offsets) > 1 else at
    return at, word, gram, length, count, bound


def _part_hashes(codes: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes names any part of a word."""
    up, _ = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(17)) * up[: len(codes)], dtype=np.uint64, out=sums[1:])
    return sums


def _postings(held, shortest: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        for batch in _blocks(batches):
            if not batch.num_rows:
                continue
            codes, offsets = _codes(batch.column(0))
            sizes = np.diff(offsets)
            sums = _part_hashes(codes)
            for as_longer in (False, True):
                base = sizes - as_longer
                at, word, gram, length, count, bound = decompose(codes, offsets, longest(base), frequent)
                order = np.lexsort((gram, count, word))
                first = np.searchsorted(word[order], np.arange(len(sizes)))
                rank = np.empty(len(at), np.int64)
                rank[order] = np.arange(len(at)) - first[word[order]]
                # A gram that is among the rarest of its word is listed at all its places there.
                token = np.unique(combine([gram, word.astype(np.uint64)], 5), return_inverse=True)[1]
                listed = np.zeros(len(at), bool)
                listed[token[rank <= bound[word]]] = True
                chosen = np.flatnonzero(listed[token] & (base[word] >= shortest))
                at, word, gram, length, count = (x[chosen] for x in (at, word, gram, length, count))
                place = at - offsets[word]
                none = np.zeros(len(at), np.uint64)
                before, after = span_hashes(sums, offsets[word], at), span_hashes(sums, at + length, offsets[word + 1])
                # (rows, shift of the place in the shorter word, kind of list, what an edit elsewhere leaves)
                parts = [(count == 0, 0, 0, none), (count > 0, 0, 1, before), (count > 0, 0, 2, after)]
                if as_longer:
                    moved = place > 0
                    parts = [*parts[:2], ((count == 0) & moved, 1, 0, none), ((count > 0) & moved, 1, 2, after)]
                for rows, shift, kind, rest in parts:
                    rows = np.flatnonzero(rows)
                    spot = (place[rows] - shift).astype(np.uint64) << np.uint64(32) | base[word[rows]].astype(np.uint64)
                    key = combine([gram[rows], spot, rest[rows], np.full(len(rows), kind, np.uint64)], 9)
                    taken = batch.take(pa.array(word[rows]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.full(len(rows), as_longer)), *taken.columns], names=["key", "longer", "word", "n"]
                    )

    return post


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a key ends, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or held and held[-1].column(0)[-1].as_py() != keys[0]:
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pairs(keys: np.ndarray, each: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with one key, about CELLS / each at a time."""
    many = np.searchsorted(keys, keys, "right") - np.arange(len(keys)) - 1
    done, most = np.concatenate([[0], np.cumsum(many)]), CELLS // each
    for begin in range(0, int(done[-1]), most):
        end = min(begin + most, int(done[-1]))
        first, last = np.searchsorted(done, [begin, end - 1], "right") - 1
        rows = np.arange(first, last + 1)
        left = np.repeat(rows, np.minimum(done[rows + 1], end) - np.maximum(done[rows], begin))
        yield left, left + 1 + np.arange(begin, end) - done[left]


def one_apart(short: np.ndarray, long: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether rows of code points (0 after the end) are one replaced (same length) or one inserted code point apart."""
    differ = short != long
    out = differ.sum(axis=1) == 1
    rows = np.flatnonzero(~same)
    if len(rows):
        start = differ[rows].argmax(axis=1)
        moved = short[rows, :-1] != long[rows, 1:]
        out[rows] = ~(moved & (np.arange(moved.shape[1]) >= start[:, None])).any(axis=1)
    return out


def _letter_parity(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each word a bit a letter (64 of them), set where it occurs an odd number of times: a replaced letter flips at most two."""
    bits = np.uint64(1) << (codes.astype(np.uint64) & np.uint64(63))
    out = np.zeros(len(offsets) - 1, np.uint64)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.bitwise_xor.reduceat(bits, offsets[filled])
    return out


def _table(codes: np.ndarray, offsets: np.ndarray, rows: np.ndarray, wide: int) -> np.ndarray:
    """The code points of the words `rows`, one word a row, 0 after its end."""
    cells = offsets[rows][:, None] + np.arange(wide)
    out = codes[np.minimum(cells, len(codes) - 1)]
    out[cells >= offsets[rows + 1][:, None]] = 0
    return out


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _whole_lists(batches):
        keys, longer = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        alone = np.ones(len(keys), bool)
        alone[1:] &= keys[1:] != keys[:-1]
        alone[:-1] &= keys[1:] != keys[:-1]
        batch = batch.take(pa.array(np.flatnonzero(~alone)))
        keys, longer = keys[~alone], longer[~alone]
        codes, offsets = _codes(batch.column(2))
        sizes = np.diff(offsets)
        level = np.frexp((sizes - longer).astype(float))[1]  # words of a list have one length or one more
        marks = _letter_parity(codes, offsets)
        for width in np.unique(level):
            own = np.flatnonzero(level == width)
            wide = int(sizes[own].max()) + 1
            step = max(1, CELLS // wide)
            for left, right in _pairs(keys[own], 16):
                left, right = own[left], own[right]
                swap = longer[left]
                left, right = np.where(swap, right, left), np.where(swap, left, right)
                flips = np.bitwise_count(marks[left] ^ marks[right])
                fit = ~longer[left] & (flips <= 2 - (sizes[left] != sizes[right]))
                left, right = left[fit], right[fit]
                for k in range(0, len(left), step):
                    a, b = left[k : k + step], right[k : k + step]
                    near = one_apart(_table(codes, offsets, a, wide), _table(codes, offsets, b, wide), sizes[a] == sizes[b])
                    a, b = a[near], b[near]
                    if len(a):
                        one, two = batch.take(pa.array(np.concatenate([a, b]))), batch.take(pa.array(np.concatenate([b, a])))
                        yield pa.RecordBatch.from_arrays([one.column(2), two.column(2), two.column(3)], names=["word", "near", "near_n"])


def near_words(words: DataFrame, shortest: int) -> DataFrame:
    """word, near, near_n: both ways of every pair of `words` (word, n; distinct) that are one code point apart.

    shortest: the least length of the words, 6 at least, so that each has more grams than an edit affects.
    """
    if shortest - MIN_GRAM + 1 <= longest(np.array(shortest)):
        raise ValueError(f"words of {shortest} code points may share no gram with near ones")
    held = words.sparkSession.sparkContext.broadcast(frequent_grams(words))
    lists = words.select("word", "n").mapInArrow(_postings(held, shortest), "key long, longer boolean, word string, n long")
    found = lists.repartition("key").sortWithinPartitions("key").mapInArrow(_merging, "word string, near string, near_n long")
    return found.repartition("word").dropDuplicates(["word", "near"])


def word_counts(docs: DataFrame, every: int = 31, shortest: int = 7, least: int = 2) -> DataFrame:
    """word, n: words of the texts with at least `shortest` code points and `least` occurrences.

    Words are runs of ASCII and Latin-1 letters, A-Z lower-cased. Where `every` divides the crc32 of `doc_id:run`,
    the run loses one code point, so that copies of one word vary as in badly read text.
    """
    text = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.filter(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0)), lambda w: F.length(w) >= shortest)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut: Column = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    found = found.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return found.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the last of the forms, by doubling the steps taken at once."""
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = stored(reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if reached.where("moved").isEmpty():
            break
        reached = reached.drop("moved")
    return reached.select("word", "root")


def variants(words: DataFrame, shortest: int = 7, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of `words` (word, n).

    form: the near word (one code point inserted, deleted or replaced) of largest n, the smallest on a tie, if its n
    is `times` that of the word at least; form_n its n. root: the end of the forms, the word itself without a form.
    n_near: near words, 0 if there are none. Null words must not be in `words`.
    """
    near = near_words(words, shortest).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    joined = words.join(near, "word", "left")
    has = F.coalesce(-F.col("best.m") >= times * F.col("n"), F.lit(False))
    rated = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.w")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")), "variants")
    ends = roots(rated.where("form IS NOT NULL").select("word", "form"))
    return rated.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    """`variants` of the words of `docs` (doc_id, text).

    Null and empty texts have no words; a null doc_id counts as an empty one. Rows that share a doc_id, and repeated
    rows, count each by itself. Texts and words of any length are whole. Without words the result is empty. Extra
    columns are ignored.
    """
    return variants(stored(word_counts(docs, shortest=shortest, least=least), "words"), shortest, times)

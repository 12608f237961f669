"""Text scores of a class-based bigram model (Brown clustering by exchange).

1. All training tokens are counted. The KNOWN most frequent words have numbers and travel as sorted arrays of fixed
   size; every other word keeps its 64-bit hash, and what belongs to it is joined by that.
2. The bigrams among the SEEDS most frequent words are counted over all training texts, all other words taken
   together. Exchange clustering of the seeds: each word in turn moves to the class with which the bigram
   likelihood of the classes is largest, until no move gains or ROUNDS are over.
3. All other words, however rare, go to the class with the most likely neighbours: the classes before and after each of
   their occurrences are counted, and each word is exchanged once against the classes of the seeds.
4. Classes are counted over all training tokens. A token's probability is that of its class after the class before
   it, smoothed by the class's own frequency (Witten and Bell), times that of the word in its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, prefix_hashes, remainder, span_hashes, stored, text_blocks, words

CLASSES = 64
SEEDS = 1024
KNOWN = 1 << 18
ROUNDS = 12
#: Added to the count of each word and of one unknown word.
ADDED = 0.1
#: Distinct keys a task holds before it passes their counts on.
HELD = 1_000_000
#: Class 0: words that training texts do not have; while seeds are exchanged, all words but the seeds. Class 1: the end.
UNKNOWN, END = 0, 1
#: The end of a text as a word; no other word has this hash but by a collision.
END_HASH = np.int64(-0x5EED5EED5EED5EED)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token and where each text's tokens begin; each text ends with END_HASH."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(owner, minlength=n)
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(begins[-1], np.int64)
    out[begins[1:] - 1] = END_HASH
    out[np.arange(len(starts)) + owner] = span_hashes(prefix_hashes(data), starts, ends).view(np.int64)
    return out, begins


class Counter:
    """Counts of 64-bit keys, merged when too many are held; `drain` yields them."""

    def __init__(self, limit: int = HELD):
        self.limit, self.keys, self.counts, self.size = limit, [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        """True if more distinct keys are held than allowed."""
        found, n = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.counts.append(n)
        self.size += len(found)
        if self.size > 2 * self.limit:
            self._merge()
        return self.size > self.limit and len(self.keys) == 1

    def _merge(self) -> None:
        found, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(self.counts), minlength=len(found)).astype(np.int64)
        self.keys, self.counts, self.size = [found], [n], len(found)

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys:
            self._merge()
        out = (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.keys, self.counts, self.size = [], [], 0
        return out


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Counter()
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column(0)):
            if held.add(tokens(data, offsets)[0]):
                yield _counted(*held.drain())
    yield _counted(*held.drain())


def _counted(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["word", "n"])


def frequent(vocabulary: DataFrame, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, at most `room` of them, the most frequent first.

    Down to a count that is chosen by its logarithm, in steps of a sixteenth.
    """
    step, least = F.floor(16 * F.log2("n")).cast("int"), 1 << 30
    left = room
    for r in vocabulary.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 16 rows an octave
        left -= r["count"]
        if left < 0:
            break
        least = r.step
    table = vocabulary.where(step >= least).select("word", "n").toArrow()
    found, n = table.column("word").to_numpy(), table.column("n").to_numpy()
    order = np.lexsort((found, -n))
    return found[order], n[order]


def _numbering(held):
    """Texts as numbers of known words, -1 for any other word, whose hash is in a list."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = held.value
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(0)):
                found, begins = tokens(data, offsets)
                at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                hit = known[at] == found if len(known) else np.zeros(len(found), bool)
                numbers = np.where(hit, places[at] if len(known) else 0, -1).astype(np.int32)
                rest = np.flatnonzero(~hit)
                cuts = np.searchsorted(rest, begins)
                ids = pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer((begins * 4).astype(np.int32)), pa.py_buffer(numbers)])
                others = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found[rest]))
                columns = [*[c.slice(first, end - first) for c in batch.columns[1:]], ids, others]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "ids", "others"])

    return number


def _numbers(column: pa.Array, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column in one row, and where each row begins."""
    buffers = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(buffers[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return data[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // size


def _slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes in a binary column; a longer single row is a slice of its own."""
    for batch in batches:
        sizes = _numbers(batch.column(column), np.uint8)[1]
        first = 0
        while first < batch.num_rows:
            end = max(int(np.searchsorted(sizes, sizes[first] + limit, "right")) - 1, first + 1)
            end = min(end, batch.num_rows)
            yield batch.slice(first, end - first)
            first = end


def _before(values: np.ndarray, begins: np.ndarray, start: int) -> np.ndarray:
    """The value of the token before each token; `start` before the first one of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[begins[:-1]] = start
    return out


def _seed_bigrams(size: int):
    """Counts of pairs of seeds: `size` stands for the end, `size` + 1 for all other words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in _slices(batches, 0):
            ids, begins = _numbers(batch.column(0))
            seeds = np.where((ids >= 0) & (ids < size), ids, size + 1).astype(np.int64)
            seeds[begins[1:] - 1] = size
            if held.add(_before(seeds, begins, size) * (size + 2) + seeds):
                yield _counted(*held.drain())
        yield _counted(*held.drain())

    return count


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each of the words that `bigrams` counts in rows and columns; its last two are the end and all other words.

    At first each of the most frequent words is a class. In turn, the most frequent first, each word moves to the class
    with the largest likelihood, the sum of n log n over pairs of classes less that over single classes; ties go to
    the smaller class. The end and all other words stay where they are.
    """
    size = len(bigrams) - 2
    own = np.minimum(np.arange(size + 2) + 2, classes)
    own[size:] = END, UNKNOWN
    late = np.flatnonzero(own == classes)  # not in a class until their first turn
    own[late] = UNKNOWN
    hot = np.zeros((size + 2, classes))
    hot[np.arange(size + 2), own] = 1
    table = hot.T @ bigrams @ hot
    choices = np.arange(2, min(classes, size + 2))
    for _ in range(rounds):
        moved = 0
        for w in range(size):
            a = own[w]
            right = np.bincount(own, weights=bigrams[w], minlength=classes)
            left = np.bincount(own, weights=bigrams[:, w], minlength=classes)
            twice = bigrams[w, w]
            right[a] -= twice
            left[a] -= twice
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= twice
            rows, columns = table.sum(1), table.sum(0)
            gain = (_xlogx(table[choices] + right) - _xlogx(table[choices])).sum(1) + (_xlogx(table[:, choices] + left[:, None]) - _xlogx(table[:, choices])).sum(0)
            corner = table[choices, choices]  # gets both, and the word's pairs with itself
            gain += _xlogx(corner + right[choices] + left[choices] + twice) + _xlogx(corner) - _xlogx(corner + right[choices]) - _xlogx(corner + left[choices])
            total = right.sum() + twice, left.sum() + twice
            gain -= _xlogx(rows[choices] + total[0]) - _xlogx(rows[choices]) + _xlogx(columns[choices] + total[1]) - _xlogx(columns[choices])
            best = int(choices[gain.argmax()])
            if a in choices and gain[a - 2] >= gain[best - 2] - 1e-9 * abs(gain[best - 2]):
                best = a
            table[best] += right
            table[:, best] += left
            table[best, best] += twice
            moved += best != a
            own[w] = best
        if not moved:
            break
    return own


def _contexts(held, classes: int):
    """Of each word but the seeds: the classes before and after its occurrences, with counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, known = held.value
        chunk, size = [], 0
        for batch in _slices(batches, 0):
            chunk.append(batch)
            size += len(_numbers(batch.column(0))[0])
            if size > 4 << 20:
                yield _chunk_contexts(chunk, seeds, known, classes)
                chunk, size = [], 0
        if chunk:
            yield _chunk_contexts(chunk, seeds, known, classes)

    return count


def _chunk_contexts(chunk: list[pa.RecordBatch], seeds: np.ndarray, known: np.ndarray, classes: int) -> pa.RecordBatch:
    found, cells = [], []
    for batch in chunk:
        ids, begins = _numbers(batch.column(0))
        others = batch.column(1).flatten().to_numpy()
        own = seeds[np.where((ids >= 0) & (ids < len(seeds) - 2), ids, len(seeds) - 1)]
        own[begins[1:] - 1] = END
        word = known[ids] if len(known) else np.zeros(len(ids), np.int64)
        word[ids < 0] = others
        after = np.empty_like(own)
        after[:-1] = own[1:]
        after[begins[1:] - 1] = END
        rest = np.flatnonzero(own == UNKNOWN)
        found.append(word[rest])
        cells.append(_before(own, begins, END)[rest].astype(np.int64) * classes + after[rest])
    names, number = np.unique(np.concatenate(found), return_inverse=True)
    keys, n = np.unique(number * classes**2 + np.concatenate(cells), return_counts=True)
    columns = [pa.array(names[keys // classes**2]), pa.array((keys % classes**2).astype(np.int32)), pa.array(n)]
    return pa.RecordBatch.from_arrays(columns, names=["word", "cell", "n"])


def _placing(table: np.ndarray):
    """The class of each word from its rows (word, cell, n), sorted by word: the likeliest for its neighbours."""
    classes = len(table)
    smooth = table + 0.5
    rows, columns = smooth.sum(1), smooth.sum(0)
    after = np.log(smooth / rows[:, None]).T  # class after the word by class of the word
    before = np.log(smooth / columns)  # class before the word by class of the word

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_word, held_gain = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            word, cell, n = (batch.column(k).to_numpy() for k in range(3))
            first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            gains = np.empty((len(first), classes))
            for k in range(0, len(first), 4096):
                a, b = first[k], first[k + 4096] if k + 4096 < len(first) else len(word)
                m = min(4096, len(first) - k)
                own = np.repeat(np.arange(m), np.diff(np.append(first[k : k + m], b)))
                weights = n[a:b].astype(float)
                left = np.bincount(own * classes + cell[a:b] // classes, weights, m * classes).reshape(m, classes)
                right = np.bincount(own * classes + cell[a:b] % classes, weights, m * classes).reshape(m, classes)
                gains[k : k + m] = left @ before + right @ after
            distinct = word[first]
            if held_word is not None and held_word == distinct[0]:
                gains[0] += held_gain
            elif held_word is not None:
                yield _placed(np.array([held_word]), held_gain[None])
            held_word, held_gain = distinct[-1], gains[-1].copy()
            yield _placed(distinct[:-1], gains[:-1])
        if held_word is not None:
            yield _placed(np.array([held_word]), held_gain[None])

    def _placed(word: np.ndarray, gains: np.ndarray) -> pa.RecordBatch:
        best = 2 + gains[:, 2:].argmax(1)
        return pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(best.astype(np.int16))], names=["word", "class"])

    return place


def _tagging(held):
    """Of each text: the classes of its tokens, how many are known, the log10 of its words in their classes and of its base."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, ends, inside, total = held.value
        for batch in _slices(batches, 0):
            ids, begins = _numbers(batch.column(0))
            texts = np.repeat(np.arange(batch.num_rows), np.diff(begins))
            tags, n = own[ids].astype(np.uint8), counts[ids].astype(float)
            rare = np.flatnonzero(ids < 0)
            column = batch.column(1)
            place, other, times = (column.flatten().field(k).to_numpy() for k in range(3))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            tags[rare], n[rare] = UNKNOWN, 0
            nth = np.searchsorted(rare, begins[:-1])  # of each text's first word that is not among the known ones
            at = rare[nth[owner] + place]
            tags[at], n[at] = other, times
            if ends:
                tags[begins[1:] - 1], n[begins[1:] - 1] = END, ends
            emitted = np.log10((n + ADDED) / inside[tags])
            sums = [np.bincount(texts, weights=x, minlength=batch.num_rows) for x in (emitted, np.log10((n + ADDED) / total))]
            seen = np.bincount(texts, weights=n > 0, minlength=batch.num_rows).astype(np.int64)
            line = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(tags)])
            columns = [line, *[c for c in batch.columns[2:]], pa.array(np.diff(begins)), pa.array(seen), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["tags", *batch.schema.names[2:], "n_tokens", "n_known", "emitted", "base"])

    return tag


def _class_bigrams(classes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in _slices(batches, 0):
            tags, begins = _numbers(batch.column(0), np.uint8)
            total += np.bincount(_before(tags, begins, END).astype(np.int64) * classes + tags, minlength=classes * classes)
        cells = np.flatnonzero(total)
        yield _counted(cells, total[cells])

    return count


def _scoring(logs: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 0):
            tags, begins = _numbers(batch.column(0), np.uint8)
            texts = np.repeat(np.arange(batch.num_rows), np.diff(begins))
            moves = np.bincount(texts, weights=logs[_before(tags, begins, END), tags], minlength=batch.num_rows)
            columns = [*batch.columns[1:], pa.array(moves)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "moves"])

    return score


def transitions(pairs: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 of the probability of a class (column) after a class (row).

    pairs: counts of classes after classes; kinds: distinct words of each class, 1 for the unknown one. Rows sum to 1.
    """
    counts = pairs.sum(0) + ADDED * kinds
    alone = counts / counts.sum()
    after, distinct = pairs.sum(1), (pairs > 0).sum(1)
    mixed = (pairs + distinct[:, None] * alone) / np.maximum(after + distinct, 1)[:, None]
    mixed[after == 0] = alone
    return np.log10(np.maximum(mixed, 1e-300))


def word_classes(lines: DataFrame, known: np.ndarray, classes: int = CLASSES, seeds: int = SEEDS) -> DataFrame:
    """word, class of every word of the training lines (ids, others) but the end; known: hashes of the numbered words."""
    spark, size = lines.sparkSession, min(seeds, len(known))
    found = lines.select("ids").mapInArrow(_seed_bigrams(size), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((size + 2) ** 2)  # as many rows as that at most
    pairs[found.column("word").to_numpy()] = found.column("n").to_numpy()
    pairs = pairs.reshape(size + 2, size + 2)
    own = exchange(pairs, classes)
    one = np.eye(classes)[own]
    contexts = lines.mapInArrow(_contexts(spark.sparkContext.broadcast((own.astype(np.uint8), known)), classes), "word long, cell int, n long")
    placed = contexts.repartition("word").sortWithinPartitions("word").mapInArrow(_placing(one.T @ pairs @ one), "word long, class short")
    return placed.unionByName(spark.createDataFrame([(int(w), int(c)) for w, c in zip(known[:size], own)], "word long, class short"))


def score_texts(docs: DataFrame, taught: Column | None = None, classes: int = CLASSES, seeds: int = SEEDS, room: int = KNOWN) -> DataFrame:
    """doc_id, taught, n_tokens, n_known, train_tokens, base_score, score for every row of `docs` (doc_id, text).

    taught: condition on doc_id of the rows that are learned from; by default remainders of 10 other than 0. Rows where
    it is null, as for a null doc_id, are not learned from. A null or empty text is its end alone. score is the log10
    of the text's probability, its end included. room: words that are broadcast; which ones are, changes no score. Without training texts every word is unknown and all probabilities
    are 1. Rows that share a doc_id, and repeated rows, count each by itself. Texts of any length are whole, extra
    columns are ignored.
    """
    if not 3 <= classes <= 256:
        raise ValueError("3 to 256 classes")
    taught = remainder(F.col("doc_id"), 10) != 0 if taught is None else taught
    spark = docs.sparkSession
    keep = f"taught boolean, doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(taught, F.lit(False)).alias("taught"), "doc_id")
    counted = texts.where("taught").select("text").mapInArrow(_counting, "word long, n long")
    vocabulary = stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    is_end = F.col("word") == F.lit(int(END_HASH))
    size = vocabulary.agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum(F.when(is_end, F.col("n"))).alias("ends")).first()
    train, ends = int(size.n or 0), int(size.ends or 0)
    known, counts = frequent(vocabulary.where(~is_end), room)
    order = np.argsort(known)
    numbering = _numbering(spark.sparkContext.broadcast((known[order], order.astype(np.int32))))
    numbered = texts.mapInArrow(numbering, f"{keep}, ids binary, others array<long>")
    lines = stored(numbered.withColumn("row", F.monotonically_increasing_id()), "lines")
    listed = stored(word_classes(lines.where("taught").select("ids", "others"), known, classes, seeds).join(vocabulary, "word"), "classes")

    kinds, inside = np.zeros(classes), np.zeros(classes)
    kinds[UNKNOWN], kinds[END], inside[END] = 1, ends > 0, ends
    for r in listed.groupBy("class").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect():  # one row a class
        kinds[r["class"]], inside[r["class"]] = r.kinds, r.n
    own = np.full(len(known) + 1, UNKNOWN, np.uint8)  # the last is for -1
    if len(known):
        mine = listed.where(F.col("n") >= int(counts[-1])).select("word", "class").toArrow()  # the known words
        at = np.searchsorted(known[order], mine.column("word").to_numpy())
        own[order[at]] = mine.column("class").to_numpy()
    weights = inside + ADDED * np.maximum(kinds, 1)
    held = spark.sparkContext.broadcast((own, np.append(counts, 0), ends, weights, train + ADDED * (size.kinds + 1)))
    rare = lines.select("row", F.posexplode("others").alias("place", "word")).where(~is_end)
    rare = rare.join(listed, "word").groupBy("row").agg(F.collect_list(F.struct("place", "class", "n")).alias("others"))
    none = F.array().cast("array<struct<place:int,class:smallint,n:bigint>>")
    joined = lines.drop("others").join(rare, "row", "left").select("ids", F.coalesce("others", none).alias("others"), "taught", "doc_id")
    fields = f"{keep}, n_tokens long, n_known long, emitted double, base double"
    rows = stored(joined.mapInArrow(_tagging(held), f"tags binary, {fields}"), "tags")
    pairs = np.zeros(classes * classes)
    moved = rows.where("taught").select("tags").mapInArrow(_class_bigrams(classes), "word long, n long")
    for r in moved.groupBy("word").agg(F.sum("n").alias("n")).collect():  # at most classes squared
        pairs[r.word] = r.n
    scored = rows.mapInArrow(_scoring(transitions(pairs.reshape(classes, classes), kinds)), f"{fields}, moves double")
    return scored.select(
        "doc_id", "taught", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("emitted") + F.col("moves")).alias("score"),
    )

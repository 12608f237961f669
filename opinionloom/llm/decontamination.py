"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words are read into one automaton whose states stand for the word sequences that occur in items.
Every document is streamed through it: the state and the length of the longest match that ends at the current
word tell which item windows end there. A window is `window` consecutive words of an item, or a whole item of
fewer words. Documents are read once per block of items and never shuffled when one block holds them all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, document_key, free_names, sliced, text_table

WINDOW = 10
#: Words of items in one automaton; more items make more blocks, each with an automaton of its own.
BLOCK_WORDS = 100_000
#: A document with a larger share of hit words is dropped by `decontaminate`.
COVERAGE = 0.5

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return _WORD.findall(raw.translate(_LOWER))


class ItemAutomaton:
    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        lists = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        for words in lists:
            last = 0
            for w in words:
                last = self._extend(last, w)
        holds: list[set[int]] = [set() for _ in self.next]
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(lists):
            state = 0
            for w in words:
                state = self.next[state][w]
                holds[state].add(k)
            if 0 < len(words) < window:
                ends.setdefault(state, []).append((len(words), k))
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for v in by_length:
            if self.length[self.link[v]] >= window:
                holds[self.link[v]] |= holds[v]
        #: For each state, the state of its suffixes of `window` words, and the items that hold those.
        self.at_window = list(range(len(self.next)))
        self.short: list[tuple] = [()] * len(self.next)
        for v in reversed(by_length):
            up = self.link[v]
            if self.length[up] >= window:
                self.at_window[v] = self.at_window[up]
            self.short[v] = (*ends.get(v, ()), *self.short[up])
        self.holds = {v: frozenset(h) for v, h in enumerate(holds) if self.length[v] >= window and self.at_window[v] == v}

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of exactly the sequences of p followed by w."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w)
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit word ranges (merged, half open), items with occurring windows, longest match."""
        moves, links, lengths, window, short = self.next, self.link, self.length, self.window, self.short
        state = matched = longest = 0
        ranges: list[tuple[int, int]] = []
        items: set[int] = set()
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = matched = 0
                continue
            to = moves[state].get(w)
            while to is None and state:
                state = links[state]
                matched = lengths[state]
                to = moves[state].get(w)
            if to is None:
                continue
            state = to
            matched += 1
            if matched > longest:
                longest = matched
            if matched >= window:
                items |= self.holds[self.at_window[state]]
                _add(ranges, i + 1 - window, i + 1)
            for n, item in short[state]:
                if n <= matched:
                    items.add(item)
                    _add(ranges, i + 1 - n, i + 1)
        return ranges, items, longest


def _add(ranges: list[tuple[int, int]], begin: int, end: int) -> None:
    """Append a range that ends no earlier than the last one, merged with those that it meets."""
    while ranges and ranges[-1][1] >= begin:
        begin = min(begin, ranges.pop()[0])
    ranges.append((begin, end))


_built: dict[tuple[str, int], ItemAutomaton] = {}


def _automaton(block, name: str, window: int) -> ItemAutomaton:
    """The automaton of a block, built once per worker."""
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = ItemAutomaton(block.value, window)
    return _built[name, window]


HITS = "array<struct<begin:bigint,end:bigint>>"


def _scanning(block, name: str, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block, name, window)
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                out = []
                for text in part.column(2):
                    words = words_of(text.as_py())
                    ranges, items, longest = automaton.scan(words)
                    out.append((len(words), longest, [{"begin": a, "end": b} for a, b in ranges], sorted({automaton.names[k] for k in items} - {None})))
                found = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), kind, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found], names=["doc_id", "name", "n_words", "longest", "hits", "items"])

    return scan


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The distinct items that have words, also those without an item_id, in blocks of about `block_words` words; the driver holds one block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))  # a word and the gap behind it take two bytes at least
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r.item_id, words) for r in part.orderBy("item_id", "text").collect() if (words := words_of(r.text))]


def item_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, name (hash of the text), n_words, longest, hits (word ranges), items for every row of `docs`.

    With one block of items this is one pass without a shuffle. With several, each block is a pass that
    returns its hits, and a grouping by document joins them.
    """
    spark = docs.sparkSession
    keyed = text_table(docs).select("doc_id", F.xxhash64("text").alias("name"), "text")
    passes = []
    for block in item_blocks(benchmark, block_words):
        name = hashlib.sha256(repr(block).encode()).hexdigest()
        held = spark.sparkContext.broadcast(block)
        passes.append(keyed.mapInArrow(_scanning(held, name, window), f"doc_id long, name long, n_words long, longest long, hits {HITS}, items array<string>"))
    first, *rest = passes
    if not rest:
        return first
    found = first
    for more in rest:
        found = found.union(more)
    found = found.where("longest > 0").groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "name").agg(
        F.max("longest").alias("longest"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    base = first.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "name", "n_words")
    return base.join(found, ["doc", "name"], "left").select(
        "doc_id", "name", "n_words", F.coalesce("longest", F.lit(0)).alias("longest"),
        F.coalesce("hits", F.array().cast(HITS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def merged(hits: Column) -> Column:
    """Ranges joined where they overlap or touch."""
    start = F.struct(F.array().cast(HITS).alias("done"), F.lit(-1).cast("long").alias("begin"), F.lit(-1).cast("long").alias("end"))
    def step(acc, h):
        apart = h["begin"] > acc["end"]
        closed = F.when(apart & (acc["end"] > 0), F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end"))))).otherwise(acc["done"])
        return F.struct(closed.alias("done"), F.when(apart, h["begin"]).otherwise(acc["begin"]).alias("begin"), F.when(apart, h["end"]).otherwise(F.greatest(acc["end"], h["end"])).alias("end"))
    def finish(acc):
        return F.when(acc["end"] > 0, F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end"))))).otherwise(acc["done"])
    return F.aggregate(F.array_sort(hits), start, step, finish)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, hits, items for every row of `docs`.

    Null, empty and wordless texts have no words and no hits; items with a null text or without words match
    nothing; an empty benchmark matches nothing. An item with a null item_id counts in the hits, but has no name to be listed by. Items that repeat an item_id count once. Extra columns are ignored.
    """
    found = item_hits(docs, benchmark, window, block_words).withColumn("hits", merged(F.col("hits")))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["end"] - h["begin"])
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest", "hits", "items", "name",
    )


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without the bytes from the first to the last word of each hit range."""
    for batch in sliced(batches, "text"):
        at = batch.schema.get_field_index("text")
        texts = []
        for text, hits in zip(batch.column(at), batch.column(batch.num_columns - 1)):
            raw, ranges = text.as_py(), hits.as_py()
            if ranges:
                raw = raw.encode()
                spans = [m.span() for m in _WORD.finditer(raw.translate(_LOWER))]
                kept, done = [], 0
                for r in ranges:
                    kept.append(raw[done : spans[r["begin"]][0]])
                    done = spans[r["end"] - 1][1]
                raw = b"".join([*kept, raw[done:]]).decode()
            texts.append(raw)
        columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """`docs` without hit spans, and without the documents of which more than `coverage` of the words is hit.

    All columns are kept; n_chars, where present, is that of the new text. Documents without a hit are unchanged.
    """
    names = docs.columns
    keyed, keys = document_key(docs)
    drop, hits = free_names(docs, "drop_it", "hit_ranges")
    found = contamination(docs, benchmark, window).where("contaminated").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias(keys[0]), F.coalesce("name", F.lit(0)).alias(keys[1]),
        (F.col("n_hit") > coverage * F.col("n_words")).alias(drop), F.col("hits").alias(hits),
    ).dropDuplicates(keys)
    joined = keyed.join(found, keys, "left").where(F.coalesce(~F.col(drop), F.lit(True)))
    kind = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    clean = joined.select(*[F.col(f"`{n}`") for n in names], hits).mapInArrow(_cutting, kind)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else clean

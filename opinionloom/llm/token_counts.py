"""Token counts by finite-state transducers: one finds the pieces, one counts the tokens of a piece.

The second transducer reads the bytes of a piece. After each prefix, BPE has a unique last token, and the
last tokens of two prefixes decide whether a longer token may follow the shorter one: it may if merging
the two tokens alone gives the two tokens back. A state is the list of places from which a token may still
begin: the node of the vocabulary's trie that was reached from there, the last token before it, and its
count relative to the current one. That is finite, since a token's length is. A transition is annotated
with the change of the token count. States are compiled on first use; the automaton is dropped and begun
anew when it exceeds a documented size, so its memory is bounded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import prefix_hashes, span_hashes, text_blocks, text_table

#: Transitions that one worker keeps compiled, and counted pieces that it remembers.
MAX_TRANSITIONS = 500_000
MAX_PIECES = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        model = spec["model"]
        self.bytes_of = {
            i: bytes(symbols[c] for c in token) for token, i in model["vocab"].items() if token.encode() not in self.special
        }
        self.ids = {b: i for i, b in self.bytes_of.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(symbols[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])

    def merge(self, tokens: list[int]) -> list[int]:
        """Apply the merges in their order of rank."""
        while len(tokens) > 1:
            best = min((self.merges.get(p, (1 << 30, 0)) for p in zip(tokens, tokens[1:])))
            if best[0] == 1 << 30:
                break
            out, k = [], 0
            while k < len(tokens):
                if k + 1 < len(tokens) and self.merges.get((tokens[k], tokens[k + 1]), (None,))[0] == best[0]:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(tokens[k])
                    k += 1
            tokens = out
        return tokens


class CountingTransducer:
    """Counts the BPE tokens of a piece of bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in sorted(vocabulary.ids.items()):
            node = 0
            for byte in token:
                below = self.children[node].get(byte)
                if below is None:
                    below = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = below
            self.token_at[node] = i
        self.single = {b: vocabulary.ids[bytes([b])] for b in range(256)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states = [start]
        self.numbers = {start: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.fits = {}

    def may_follow(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        known = self.fits.get((left, right))
        if known is None:
            v = self.vocabulary
            both = [self.single[b] for b in v.bytes_of[left] + v.bytes_of[right]]
            known = self.fits[left, right] = v.merge(both) == [left, right]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the count; kept for the next time."""
        kept, last, change = [], None, 0
        for node, before, count in self.states[state]:
            below = self.children[node].get(byte)
            if below is None:
                continue
            token = self.token_at[below]
            if last is None and token >= 0 and self.may_follow(before, token):
                last, change = token, count + 1
            if self.children[below]:
                kept.append((below, before, count))
        target = (*((node, before, count - change) for node, before, count in kept), (0, last, 0))
        number = self.numbers.get(target)
        if number is None:
            number = self.numbers[target] = len(self.states)
            self.states.append(target)
        self.moves[state << 8 | byte] = (number, change)
        return number, change

    def begin_anew(self, state: int) -> int:
        """Drop the automaton but for one state; the state's new number."""
        kept = self.states[state]
        self.reset()
        if kept not in self.numbers:
            self.numbers[kept] = len(self.states)
            self.states.append(kept)
        return self.numbers[kept]

    def count(self, piece: bytes) -> int:
        state, total, moves = 0, 0, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(moves) >= MAX_TRANSITIONS:
                    state = self.begin_anew(state)
                    moves = self.moves
                move = self.compile(state, byte)
            state = move[0]
            total += move[1]
        return total


class TokenCounter:
    """Token counts of blocks of texts; distinct pieces are counted once and remembered by a 64-bit hash."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.special = sorted(vocabulary.special, key=len, reverse=True)
        self.transducer = CountingTransducer(vocabulary)
        self.known = np.zeros(0, np.uint64)
        self.sizes = np.zeros(0, np.int64)

    def cut_special(self, data: np.ndarray, offsets: np.ndarray):
        """Texts cut around special strings: bytes, offsets, the text of each part, specials in each text."""
        found = np.zeros(len(offsets) - 1, np.int64)
        owner = np.arange(len(offsets) - 1)
        whole = data.tobytes()
        if not any(s in whole for s in self.special):
            return data, offsets, owner, found
        parts, owner = [], []
        for k in range(len(offsets) - 1):
            rest = [whole[offsets[k] : offsets[k + 1]]]
            for s in self.special:
                split = [p.split(s) for p in rest]
                found[k] += sum(len(p) - 1 for p in split)
                rest = [x for p in split for x in p]
            parts += rest
            owner += [k] * len(rest)
        cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), cut, np.array(owner), found

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data, cuts, owner, total = self.cut_special(data, offsets)
        if not len(data):
            return total
        starts, ends = pretokens.pieces(data, cuts)
        hashes = span_hashes(prefix_hashes(data), starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = np.zeros(len(distinct), np.int64)
        at = np.searchsorted(self.known, distinct)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == distinct[hit]
        sizes[hit] = self.sizes[at[hit]]
        new = np.flatnonzero(~hit)
        whole, count = data.tobytes(), self.transducer.count
        sizes[new] = [count(whole[a:b]) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        if len(new):
            if len(self.known) > MAX_PIECES:
                self.known, self.sizes = self.known[:0], self.sizes[:0]
            at = np.searchsorted(self.known, distinct[new])
            self.known = np.insert(self.known, at, distinct[new])
            self.sizes = np.insert(self.sizes, at, sizes[new])
        text = owner[np.searchsorted(cuts, starts, "right") - 1]
        return total + np.bincount(text, weights=sizes[inverse], minlength=len(total)).astype(np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def vocabulary_path(name: str) -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _counting(name: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = counter(vocabulary_path(name))
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.diff(offsets)), pa.array(counting.counts(data, offsets))],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    return count


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`, as the tokenizer file's library counts.

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside a text are one token each.
    Repeated rows are counted as often as they are given. There is no shuffle. Only doc_id and text are read.
    """
    counted = text_table(docs).mapInArrow(_counting(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

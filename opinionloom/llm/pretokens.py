"""The pre-tokenizer of byte-level BPE as a deterministic transducer over character classes.

A transition may emit piece starts at the current character, at the one before, or at both. A block of
texts is one stream with an end mark after each text. Chunks of the stream are run from every state at
once; the chunk maps compose through a parallel prefix scan, which gives each chunk its entry state, and a
second run from there emits the piece starts. So a very long text is cut anywhere and still read right.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

END, LETTER, SHORT, R, V, L_, E_, NUMBER, QUOTE, OTHER, BLANK, WHITE = range(12)
CLASSES = 12
STATES = 13
START, WORD, DIGITS, MARKS, APOS, APOS_R, APOS_V, APOS_L, DONE, BLANK1, BLANK2, WHITE1, WHITE2 = range(STATES)
HERE, BEFORE = 1, 2
CHUNK = 128


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted starts for each state and class, flat.

    The pieces are 's 't 're 've 'm 'll 'd, then letters, numbers or other marks with one optional blank
    before them, then white space, of which the last character is left to what follows.
    """
    after = np.zeros((STATES, CLASSES), np.uint8)
    emit = np.zeros((STATES, CLASSES), np.uint8)
    letters = (LETTER, SHORT, R, V, L_, E_)
    fresh = {**dict.fromkeys(letters, WORD), NUMBER: DIGITS, QUOTE: APOS, OTHER: MARKS, BLANK: BLANK1, WHITE: WHITE1}
    joined = {**fresh, QUOTE: MARKS}
    for state in range(STATES):
        for c, target in fresh.items():
            after[state, c], emit[state, c] = target, HERE
    for state, own in ((WORD, letters), (DIGITS, (NUMBER,)), (MARKS, (QUOTE, OTHER)), (APOS, (QUOTE, OTHER))):
        for c in own:
            after[state, c], emit[state, c] = {WORD: WORD, DIGITS: DIGITS}.get(state, MARKS), 0
    for c, target in ((SHORT, DONE), (R, APOS_R), (V, APOS_V), (L_, APOS_L)):
        after[APOS, c], emit[APOS, c] = target, 0
    for state, closing in ((APOS_R, E_), (APOS_V, E_), (APOS_L, L_)):
        emit[state] = HERE | BEFORE
        emit[state, END] = BEFORE
        for c in letters:
            emit[state, c] = BEFORE
        after[state, closing], emit[state, closing] = DONE, 0
    for state in (BLANK1, BLANK2, WHITE1, WHITE2):
        blank, long = state in (BLANK1, BLANK2), state in (BLANK2, WHITE2)
        for c in (*letters, NUMBER, QUOTE, OTHER):
            if blank:
                after[state, c] = joined[c]
            emit[state, c] = (0 if blank else HERE) | (BEFORE if long else 0)
        after[state, BLANK], after[state, WHITE] = BLANK2, WHITE2
        emit[state, BLANK] = emit[state, WHITE] = 0
    return after.reshape(-1), emit.reshape(-1)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for begin in range(0, 0x110000, 0x800):  # few code points at a time: a worker keeps the memory it once took
        if 0xD800 <= begin < 0xE000:
            continue
        some = "".join(map(chr, range(begin, begin + 0x800)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
            for m in regex.finditer(pattern, some):
                table[begin + m.start() : begin + m.end()] = kind
    for char, kind in (("'", QUOTE), (" ", BLANK), ("r", R), ("v", V), ("l", L_), ("e", E_)):
        table[ord(char)] = kind
    for char in "stmd":
        table[ord(char)] = SHORT
    return table


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and class of each character of UTF-8 bytes."""
    table = class_table()
    high = data >= 0x80
    if not high.any():
        return np.arange(len(data)), table[data]
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    wide = np.concatenate([data, np.zeros(3, np.uint8)])
    one, two, three = (wide[at + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
    points = np.where(
        lead < 0x80,
        lead,
        np.where(lead < 0xE0, (lead & 0x1F) << 6 | one, np.where(lead < 0xF0, (lead & 0x0F) << 12 | one << 6 | two, (lead & 0x07) << 18 | one << 12 | two << 6 | three)),
    )
    return at, table[np.minimum(points, 0x10FFFF)]


def entry_states(chunks: np.ndarray) -> np.ndarray:
    """The state in which each chunk begins, from chunk maps composed by a parallel prefix scan.

    chunks: classes, one column a chunk, one row a step.
    """
    after, _ = transducer()
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks.shape[1], axis=1)
    for symbols in chunks:
        maps = after[maps * np.uint8(CLASSES) + symbols]
    reach = 1
    while reach < maps.shape[1]:
        maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach].astype(np.intp), axis=0)
        reach *= 2
    return np.concatenate([[START], maps[START, :-1]]).astype(np.uint8)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of the texts that `offsets` cuts `data` into."""
    after, emit = transducer()
    at, kinds = characters(data)
    cuts = np.searchsorted(at, offsets[1:])
    stream = np.insert(kinds, cuts, END)
    where = np.insert(at, cuts, offsets[1:])
    n = len(stream)
    width = -(-n // CHUNK)
    padded = np.zeros(width * CHUNK, np.uint8)
    padded[:n] = stream
    chunks = np.ascontiguousarray(padded.reshape(width, CHUNK).T)
    state = entry_states(chunks)
    emitted = np.empty_like(chunks)
    for t, symbols in enumerate(chunks):
        move = state * np.uint8(CLASSES) + symbols
        emitted[t] = emit[move]
        state = after[move]
    emitted = np.ascontiguousarray(emitted.T).reshape(-1)[:n]
    begins = (emitted & HERE) > 0
    begins[:-1] |= (emitted[1:] & BEFORE) > 0
    marks = begins | (stream == END)
    spots = np.flatnonzero(marks)
    first = np.flatnonzero(begins[spots])
    return where[spots[first]], where[spots[first + 1]]

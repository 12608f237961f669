"""Suffix sorting by grouping: linear construction without recursive renaming, and byte suffixes from it.

Phase 1 sorts suffixes into groups by their Lyndon prefix. Groups are taken in descending order; every
member's previous smaller suffix is found by following the pointers of groups already done, and those
suffixes move to new groups behind their old ones, the further the more members point at them. Phase 2
walks the suffix array from its start and places, for each suffix, the chain of suffixes that end before it.
"""

from __future__ import annotations

import numpy as np

#: Bytes that end a token: all but a-z, so tokens are short and none but a text's last is the front of another.
CLOSING = np.ones(256, bool)
CLOSING[97:123] = False


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `symbols` (integers >= 0) in lexicographic order; a shorter suffix goes first."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    text = np.append(np.asarray(symbols, np.int64) + 1, 0)
    n = len(text)
    order = np.argsort(text, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(text[order]) > 0]))
    sizes = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, sizes)
    size = np.zeros(n, np.int64)
    size[first] = sizes
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sa, group, size, place = order.tolist(), group.tolist(), size.tolist(), place.tolist()
    smaller = [-1] * n

    end = n - 1
    while end >= 0:
        start = group[sa[end]]
        members = sa[start : end + 1]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            most = max(pointed.values())
            if most == 1:
                levels = [list(pointed)]
            else:
                by_count: dict[int, list[int]] = {}
                for p, times in pointed.items():
                    by_count.setdefault(times, []).append(p)
                levels = [by_count[t] for t in sorted(by_count, reverse=True)]
            for moved in levels:
                for p in moved:
                    own = group[p]
                    size[own] -= 1
                    last, at = own + size[own], place[p]
                    other = sa[last]
                    sa[at], sa[last] = other, p
                    place[other], place[p] = at, last
                targets = [group[p] + size[group[p]] for p in moved]
                for p, target in zip(moved, targets):
                    group[p] = target
                    size[target] += 1
        end = start - 1

    front = group
    done = [False] * n
    head = list(range(n))
    result = [0] * n
    result[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        j = result[i] - 1
        while j >= 0 and not done[j]:
            own = front[j]
            result[head[own]] = j
            head[own] += 1
            done[j] = True
            j = smaller[j]
    return np.array(result[1:], np.int64)


def ranks(suffixes: np.ndarray) -> np.ndarray:
    out = np.empty(len(suffixes), np.int64)
    out[suffixes] = np.arange(len(suffixes))
    return out


def byte_suffix_order(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions of the texts in `data`, sorted by what follows them up to the end of their text.

    The texts are cut after every byte other than a-z. Tokens get ranks by their bytes, the token sequence is
    suffix-sorted, and a byte's place follows from the rest of its token and the rank of the next token's
    suffix. No token but the last of a text lies at the front of another, so this is the order of bytes.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    closes = CLOSING[data]
    last = np.zeros(n, bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    ends = np.flatnonzero(closes | last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    whole = data.tobytes()
    tokens = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    distinct = sorted(set(tokens))
    number = {t: k for k, t in enumerate(distinct)}
    symbols = np.fromiter((number[t] for t in tokens), np.int64, len(tokens))
    follows = np.append(ranks(suffix_array(symbols)), -1) + 1
    after = np.where(last[ends - 1], 0, follows[1:])

    tails = sorted({t[k:] for t in distinct for k in range(len(t))})
    tail_number = {t: k for k, t in enumerate(tails)}
    numbers = [np.fromiter((tail_number[t[k:]] for k in range(len(t))), np.int64, len(t)) for t in distinct]
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum([len(t) for t in distinct])])
    flat = np.concatenate(numbers)
    token_of = np.repeat(np.arange(len(tokens)), lengths)
    tail = flat[at[symbols[token_of]] + np.arange(n) - starts[token_of]]
    return np.argsort(tail * np.int64(len(tokens) + 1) + after[token_of], kind="stable")

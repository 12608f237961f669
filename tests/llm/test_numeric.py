"""The algorithms under the operators, without Spark."""

import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from opinionloom.llm import common, decontamination, near_dedup, packing, quality_classifier, suffix_groups, token_counts, toxicity
from opinionloom.llm.components import find, union

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(600):
        text = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 40))]
        assert suffix_groups.suffix_array(np.array(text, int)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_equal_prefixes_are_neighbours():
    rng = random.Random(2)
    for _ in range(200):
        texts = [bytes(rng.choices(b"ab \n\x00", k=rng.randint(0, 20))) for _ in range(rng.randint(1, 4))]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        suffixes = []
        for p in suffix_groups.byte_suffix_order(data, offsets).tolist():
            k = int(np.searchsorted(offsets, p, "right")) - 1
            suffixes.append(texts[k][p - offsets[k] :])
        for n in (1, 2, 3, 5):
            runs = [k for k, _ in itertools.groupby(s[:n] for s in suffixes if len(s) >= n)]
            assert len(runs) == len(set(runs))


def _counts(texts, limit=common.BLOCK_BYTES):
    out = []
    for _, _, data, offsets in common.text_blocks(pa.array(texts, pa.string()), limit):
        out += token_counts.counter(PATH).counts(data, offsets).tolist()
    return out


def test_token_counts_and_ids_equal_the_library():
    rng = random.Random(3)
    parts = ["'s", "'re", "'ve", "'ll", "'", "r", "v", "l", "e", "s", " ", "  ", "\n", "\t", " ", "é", "中", "１", "x", "hello", "ing", "!", "--", "😀", "<|endoftext|>", "12", " the"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(0, 60))) for _ in range(1000)]
    texts += ["".join(rng.choices("etaoinshrdlu", k=rng.randint(0, 200))) for _ in range(500)]
    texts += [None, "", "a" * 30_000, " " * 5000, "<|endoftext|>" * 3]
    library = Tokenizer.from_file(PATH)
    expected = [t.ids for t in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert _counts(texts) == [len(ids) for ids in expected]
    assert _counts(texts, 64) == [len(ids) for ids in expected]
    for text, ids in zip(texts, expected):
        assert packing.encode(PATH, text or "").tolist() == [*ids, 1]


def test_ids_of_very_long_white_space(monkeypatch):
    library = Tokenizer.from_file(PATH)
    texts = [" " * 3_000_000, "a" + "\n" * 2_000_000 + "b", "it's " + " \t\n" * 500_000 + " <|endoftext|>  é"]
    for text in texts:
        assert packing.encode(PATH, text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    monkeypatch.setattr(packing, "LONG_BLANK", 0)
    rng = random.Random(8)
    parts = ["'s", "'ll", "'", "v", " ", "  ", "\n", "\u3000", "é", "中", "１", "hello", "!", "😀", "<|endoftext|>", " the"]
    for text in ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(500)]:
        assert packing.encode(PATH, text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_transducer_begins_anew_when_it_is_full(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(token_counts, "MAX_PIECES", 3)
    counter = token_counts.TokenCounter(PATH)
    texts = ["some words here", "other words there", "indistinguishable"] * 3
    library = Tokenizer.from_file(PATH)
    for _ in range(2):
        for _, _, data, offsets in common.text_blocks(pa.array(texts), 16):
            counter.counts(data, offsets)
    got = [counter.counts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_transducer_stays_small_within_a_piece(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_TRANSITIONS", 50)
    transducer = token_counts.CountingTransducer(token_counts.Vocabulary(PATH))
    library, rng = Tokenizer.from_file(PATH), random.Random(10)
    for _ in range(3):
        piece = "".join(rng.choices("etaoinshrdlu", k=3000))
        assert transducer.count(piece.encode()) == len(library.encode(piece, add_special_tokens=False).ids)
        assert len(transducer.moves) <= 50 and len(transducer.states) <= 52


def test_hilbert_keys_visit_neighbours():
    for bits, dimensions in ((3, 3), (2, 4), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_automaton_equals_brute_force():
    rng = random.Random(4)
    for _ in range(800):
        alphabet, window = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)], rng.choice([2, 3, 5])
        items = [(str(k), rng.choices(alphabet, k=rng.randint(0, 9))) for k in range(rng.randint(0, 5))]
        words = rng.choices([*alphabet, b"z"], k=rng.randint(0, 30))
        automaton = decontamination.ItemAutomaton([i for i in items if i[1]], window)
        ranges, found, longest = automaton.scan(words)
        hit, names, best = set(), set(), 0
        for name, own in items:
            n = min(window, len(own))
            for k in range(len(words)):
                for j in range(len(own)):
                    m = 0
                    while k + m < len(words) and j + m < len(own) and words[k + m] == own[j + m]:
                        m += 1
                    best = max(best, m)
                    if n and m >= n:
                        names.add(name)
                        hit |= set(range(k, k + n))
        assert sum(b - a for a, b in ranges) == len(hit)
        assert {automaton.names[k] for k in found} == names and longest == best


def test_superminhash_estimates_similarity_and_ignores_order():
    rng = np.random.default_rng(5)
    base = rng.integers(1, 2**63, 400).astype(np.uint64)
    for shared in (100, 300, 400):
        other = np.concatenate([base[:shared], rng.integers(1, 2**63, 400 - shared).astype(np.uint64)])
        a, b = near_dedup.superminhash([np.sort(base), np.sort(other)], 128)
        assert abs((a == b).mean() - shared / (800 - shared)) < 0.15
        assert (near_dedup.superminhash([other[::-1]], 128)[0] == b).all()
    tiny = near_dedup.superminhash([base[:1], base[:0], base[:2]], 16)
    assert (tiny[0] < np.iinfo(np.uint64).max).all() and (tiny[1] == np.iinfo(np.uint64).max).all()


def test_union_find():
    parent = {}
    assert union(parent, 5, 3) and union(parent, 9, 5) and not union(parent, 9, 3)
    assert find(parent, 9) == 3 and find(parent, 4) == 4


def test_pooling_is_monotone_and_keeps_the_mean():
    values, weights = [0.2, 0.1, 0.4, 0.3, 0.9], [1.0, 3.0, 1.0, 1.0, 2.0]
    out = quality_classifier.pooled(values, weights)
    assert out == sorted(out) and np.dot(out, weights) == pytest.approx(np.dot(values, weights))


def test_statistics_of_odd_texts():
    for texts in (["", "a", "\n\n", "x" * 5000, "é 中 1\n1"], [""], ["\n"]):
        for _, _, data, offsets in common.text_blocks(pa.array(texts)):
            stats = quality_classifier.statistics(data, offsets)
            assert stats.shape == (len(texts), len(quality_classifier.NAMES)) and np.isfinite(stats).all()


def test_terms_do_not_depend_on_the_block():
    texts = ["Idiots talk, idiots!", "", "münchner", "ab"]
    alone = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        alone.append(set(toxicity.terms(data, np.array([0, len(data)]))[1].tolist()))
    for _, _, data, offsets in common.text_blocks(pa.array(texts)):
        owner, term = toxicity.terms(data, offsets)
        assert [set(term[owner == k].tolist()) for k in range(len(texts))] == alone

"""Spelling variants, class language model and fill-in-middle against brute force, on odd and on made tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionloom.llm import class_lm, fill_middle, queries, spelling_variants

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_operators import COLUMNS, SF, rows  # noqa: E402


@pytest.fixture(scope="module")
def odd(spark):
    table = spark.createDataFrame(rows(), COLUMNS).repartition(3).cache()
    yield table
    table.unpersist()


def one_apart(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out = {}
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        out[w] = best if best is not None and counts[best] >= 10 * n else None

    def root(w):
        return w if out[w] is None else root(out[w])

    return {(w, out[w], root(w), counts[w], len(near[w]), counts.get(out[w])) for w in counts}


def found_variants(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("alphabet,fewest", [("ab", 4), ("abcdé", 32), ("abcdefghijklmnopqß", 2), ("aé漢😀", 6)])
def test_variants_equal_brute_force(spark, monkeypatch, alphabet, fewest):
    monkeypatch.setattr(spelling_variants, "FEWEST", fewest)
    monkeypatch.setattr(spelling_variants, "POSITIONS", 10**9)
    rng, counts = random.Random(alphabet), {}
    while len(counts) < 500:
        w = "".join(rng.choices(alphabet, k=rng.randint(7, 13)))
        for _ in range(7):
            counts.setdefault(w, rng.choice([2, 2, 25, 300, 4000, 50_000]))
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]])
            if len(w) < 7:
                break
    counts["x" * 3000], counts["x" * 2999], counts["x" * 3001] = 5, 60, 60  # a tie: the smaller word is the form
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert found_variants(spelling_variants.variants(words)) == plain_variants(counts)


def test_pairs_are_cut_into_pieces_without_loss():
    keys = np.repeat([3, 5, 9], [4, 1, 40])
    pairs = [(int(a), int(b)) for left, right in spelling_variants._pairs(keys, spelling_variants.CELLS // 7) for a, b in zip(left, right)]
    want = [(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if keys[a] == keys[b]]
    assert sorted(pairs) == want and len(set(pairs)) == len(pairs)


def test_variants_of_odd_rows(spark, odd):
    counts = Counter()
    for r in odd.select("doc_id", "text").collect():
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")):
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert found_variants(spelling_variants.spelling_variants(odd)) == plain_variants(counts)
    assert spelling_variants.spelling_variants(odd.where("false")).collect() == []
    with pytest.raises(ValueError):
        spelling_variants.near_words(spark.createDataFrame([("abc", 2)], "word string, n long"), 3)


def likelihood(bigrams, own, classes):
    table = np.zeros((classes, classes))
    np.add.at(table, (own[:, None], own[None, :]), bigrams)

    def f(x):
        return float((x * np.log(np.maximum(x, 1))).sum())

    return f(table) - f(table.sum(0)) - f(table.sum(1))


def test_exchange_ends_where_no_single_move_gains():
    rng = np.random.default_rng(3)
    bigrams = rng.poisson(0.8, (32, 32)).astype(float)
    bigrams[:15, 15:30] += rng.poisson(6, (15, 15))  # two kinds of words, one after the other
    own = class_lm.exchange(bigrams, classes=6, rounds=50)
    best = likelihood(bigrams, own, 6)
    for w in range(30):
        for c in range(2, 6):
            moved = own.copy()
            moved[w] = c
            assert likelihood(bigrams, moved, 6) <= best + 1e-7 * abs(best)  # moves that gain next to nothing are not made
    assert list(own[30:]) == [class_lm.END, class_lm.UNKNOWN] and own[:30].min() >= 2


def test_class_probabilities_sum_to_one():
    pairs = np.array([[0, 0, 0, 0], [0, 0, 5, 2], [0, 3, 0, 1], [0, 0, 4, 0]], float)
    assert np.allclose((10 ** class_lm.transitions(pairs, np.array([1, 1, 7, 3]))).sum(1), 1)


def base_scores(docs):
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for k, t in docs.items()}
    counts = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {k: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for k, ws in tokens.items()}


@pytest.mark.parametrize("room", [300, 0])
def test_class_model_base_and_joined_words(spark, room):
    """The same scores whether words are broadcast or joined; the base equals brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r for r in class_lm.score_texts(docs, classes=8, seeds=200).collect()}
    some = {r.doc_id: r for r in class_lm.score_texts(docs, classes=8, seeds=200, room=room).collect()}
    want = base_scores({r.doc_id: r.text for r in docs.collect()})
    assert whole.keys() == some.keys() == want.keys()
    for k, r in some.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[k][:3]
        assert r.base_score == pytest.approx(want[k][3]) and r.score < 0
        if room:
            assert r.score == pytest.approx(whole[k].score)


def test_class_model_is_better_than_its_base_on_held_out_texts(spark):
    scored = queries.op12_class_bigrams(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > 0.99 * scored[1]


def test_class_model_of_odd_rows(spark, odd):
    scored = class_lm.score_texts(odd).collect()
    assert len(scored) == len(rows())
    for r in scored:
        assert r.score <= 0 and r.base_score < 0
        assert r.taught == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 != 0)
    assert [r.n_tokens for r in scored if r.doc_id == 5] == [1, 1]
    assert class_lm.score_texts(odd.where("false")).collect() == []
    untaught = class_lm.score_texts(odd, taught=F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known, round(r.score, 9), round(r.base_score, 9)) for r in untaught} == {(0, 0, 0.0, 0.0)}
    with pytest.raises(ValueError):
        class_lm.score_texts(odd, classes=2)


@pytest.mark.parametrize("error", [1, 7, 63])
def test_rank_index_is_exact(error, monkeypatch):
    monkeypatch.setattr(fill_middle, "CHUNK", 997)
    rng = random.Random(error)
    for _ in range(60):
        weights = [rng.random() ** 4 for _ in range(4)]
        text = "".join(c * rng.choice([1, 1, 1, rng.randint(1, 200)]) for c in rng.choices("aé漢😀", weights, k=rng.randint(0, 300)))
        cuts = sorted([0, len(text), *(rng.randint(0, len(text)) for _ in range(5))])
        parts = [text[a:b].encode() for a, b in zip(cuts, cuts[1:])]
        offsets = np.cumsum([0, *map(len, parts)])
        index, ranks = fill_middle.index_of(np.frombuffer(text.encode(), np.uint8), offsets, error)
        assert ranks.tolist() == cuts
        assert index.offsets(np.arange(len(text) + 1)).tolist() == np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()


def test_segments_are_few_where_texts_are_even():
    index, _ = fill_middle.index_of(np.frombuffer(("plain words " * 20_000).encode(), np.uint8), np.array([0, 240_000]))
    assert len(index.firsts[0]) == 2  # the text and its end


def plain_middle(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    u, t = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)], text or ""
    a, b = sorted((u[0] % (len(t) + 1), u[1] % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or u[2] % 100 >= 90:
        return (doc_id, len(t), "plain", None, None, t)
    if u[3] % 100 < 20:
        return (doc_id, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
    return (doc_id, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")


def test_middles_of_odd_rows(spark, odd):
    more = [(900 + k, t) for k, t in enumerate(["<P>", "a<M>b", "<S", "é", "漢字" * 700_000, "a\r\n😀", "<P<S<M"])]
    table = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    made = fill_middle.fill_in_middle(table).withColumn("again", fill_middle.restored(F.col("output"), F.col("form")))
    texts = [(r.doc_id, r.text) for r in table.collect()]
    found = made.collect()
    key = repr
    assert sorted((tuple(r[:6]) for r in found), key=key) == sorted((plain_middle(*r) for r in texts), key=key)
    assert sorted(r.again for r in found) == sorted(t or "" for _, t in texts)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(odd.where("false")).collect() == []
    own = fill_middle.fill_in_middle(table, seed=5, changed_percent=100, spm_percent=50, marks=("[a]", "[b]", "[c]"))
    assert sorted(r[0] for r in own.select(fill_middle.restored(F.col("output"), F.col("form"), ("[a]", "[b]", "[c]"))).collect()) == sorted(t or "" for _, t in texts)

"""Every corpus operator on odd rows, against brute force on small tables, and the registered queries."""

import hashlib
import importlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from opinionloom.llm import (
    chat_formatting,
    components,
    decontamination,
    language_id,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    queries,
    repeated_spans,
    token_counts,
    toxicity,
)

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle  # noqa: E402

SF, SF_TRAIN = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, name string, doc string, row int, key int, hits int, spans int, n int, cell int, label int, keys int, score int, key_id int, cut_spans int, drop_it int"
EXTRA = ("x", "y", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)


def rows():
    rng = random.Random(7)
    prose = [" ".join("".join(rng.choices("aeionst", k=rng.randint(2, 8))) for _ in range(120)) for _ in range(6)]
    near = prose[0].split()
    near[60] = "changed"
    passage = " ".join(rng.choices(prose[5].split(), k=90))
    texts = [
        *prose[:3], prose[0], " ".join(near), None, "", "  \n\t ", "###", "word", "five words are in here", "ÀÉ ça va bien",
        "x" * 1500, "ab" * 700, "one two " * 400, "<|endoftext|> a <|endoftext|>", prose[3] + " " + passage, passage + " " + prose[4],
        " ".join(prose) * 20, "a\n\nb\n\nb\n", "中文" * 300,
    ]
    out = [(k, t, ["en", "de", None][k % 3], None, None, *EXTRA) for k, t in enumerate(texts)]
    return [*out, out[1], out[5], out[6], (None, prose[2], "en", "s", 1, *EXTRA), (None, None, None, None, None, *EXTRA)]


@pytest.fixture(scope="module")
def odd(spark):
    table = spark.createDataFrame(rows(), COLUMNS).repartition(3).cache()
    yield table
    table.unpersist()


def plain(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 1


def test_language_of_odd_rows(odd):
    got = language_id.identify(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        text = next((t for i, t in plain(odd) if i == r.doc_id), None) if r.doc_id is not None else "?"
        assert 0 <= r.score <= 1
        if text != "?":
            letters = any(c.isalpha() for c in text or "")
            assert (r.lang_pred == "und") == (not letters) and (letters or r.rejected)
    assert language_id.identify(odd.limit(0)).count() == 0
    untaught = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


def test_kneser_ney_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("abc abd abc bca", "en")], "text string, lang string")
    counts = docs.mapInArrow(language_id._counting, "lang string, gram long, n long")
    values = language_id.probabilities(counts).where("part = 4").collect()
    by_context = defaultdict(float)
    for r in values:
        by_context[r.gram >> 16] += r.value
    assert values and all(0 < total <= 1 + 1e-9 for total in by_context.values())


def test_held_out_languages(spark):
    got = queries.QUERIES["op1_kneser_ney"](spark, SF_TRAIN).join(queries.table(spark, SF_TRAIN, "documents").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert got.where("rejected").count() <= 2


@pytest.mark.parametrize("size", [0, 16_000, 1 << 20])
def test_every_gram_has_its_own_score(spark, monkeypatch, size):
    monkeypatch.setattr(language_id, "MODEL_BYTES", size)
    rng = random.Random(9)
    texts = ["".join(rng.choices(("aeinrst ", "aouklmt ", "日月火水木金土人 ")[k % 3], k=300)) for k in range(30)]
    texts += ["the quick brown fox", "日本語 text", "", None, "zzzz", texts[0]]
    docs = spark.createDataFrame([(k, t, ["en", "fi", "zh"][k % 3]) for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    taught = docs.where("doc_id < 24 AND text IS NOT NULL").select("text", "lang")
    counts = taught.mapInArrow(language_id._counting, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = {(r.lang, r.part, r.gram): np.log(r.value) for r in language_id.probabilities(counts).collect()}

    def score(lang, gram, n=4):
        own = gram & (1 << 16 * n) - 1
        if n == 0:
            return -np.log(65536)
        if (lang, n, own - (1 << 64) * (own >> 63)) in model:
            return model[lang, n, own - (1 << 64) * (own >> 63)]
        return model.get((lang, 10 + n, own >> 16), 0.0) + score(lang, gram, n - 1)

    got = {r.doc_id: r for r in language_id.identify(docs, F.col("doc_id") < 24).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        data = (t or "").encode()
        keys = [g & (1 << 64) - 1 for g in language_id.grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()]
        if keys:
            entropy = {lang: -np.mean([score(lang, g) for g in keys]) for lang in ("en", "fi", "zh")}
            assert got[k].lang_pred == min(entropy, key=entropy.get) and abs(got[k].entropy - min(entropy.values())) < 1e-4
        else:
            assert got[k].lang_pred == "und"


# 2


def test_snapshots(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "other"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (4, 1, "assistant", "other"),
        (5, None, None, None), (None, 0, "user", "lost"), (6, 0, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit(1)).withColumn("n", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat_formatting.format_chats(df).collect()}
    assert {k: v[:2] for k, v in got.items()} == {2: (3, 1), 3: (2, 2), 5: (1, 1), 6: (1, 1)}
    assert got[5][2] == "<|unknown|>\n\n<|end|>\n"
    assert chat_formatting.format_chats(df.limit(0)).count() == 0
    assert "Python" not in chat_formatting.format_chats(df)._jdf.queryExecution().toString()


# 3


def test_packing_of_odd_rows(odd):
    check_pieces(plain(odd), packing.pack(odd, with_ids=True).collect())
    assert packing.pack(odd.limit(0)).count() == 0


def check_pieces(docs, pieces, capacity=2048):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, text in docs:
        expected[i, np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        if "ids" in p:
            assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for (i, ids), times in expected.items():
        own = [p for p in by_doc[i] if p.doc_tokens == len(ids) // 4]
        assert sum(p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) for p in own) >= times
    assert sum(p.length for p in pieces) == sum(t * len(ids) // 4 for (_, ids), t in expected.items())
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for k, spans in sequences.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == capacity or k == max(sequences)


# 4


def test_rules_equal_brute_force(odd):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality_rules.digests(odd).collect())
    expected = Counter()
    for i, text in plain(odd):
        own = words(text)
        windows = Counter(tuple(own[k : k + 3]) for k in range(len(own) - 2))
        hit = {p for k in range(len(own) - 2) if windows[tuple(own[k : k + 3])] > 1 for p in range(k, k + 3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        base = len(own) < 50 or 100 * len(hit) > 50 * len(own)
        expected[i, len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), base] += 1
    assert got == expected
    assert quality_rules.apply_rules(odd).columns == [*odd.columns, "failed_rule"]
    assert quality_rules.digests(odd.limit(0)).count() == 0


def test_later_rules_are_not_asked_of_rejected_documents(odd):
    own = quality_rules.measures(F.coalesce("text", F.lit("")))
    raises = quality_rules.Rule("raises", lambda m: F.raise_error(F.lit("asked")).cast("boolean"), ())
    always = quality_rules.Rule("always", lambda m: m["n_words"] >= 0, ("n_words",))
    assert odd.select(quality_rules.first_failure(own, [always, raises]).alias("r")).where("r = 'always'").count() == odd.count()
    with pytest.raises(Exception, match="asked"):
        odd.select(quality_rules.first_failure(own, [raises, always]).alias("r")).collect()


def test_cascade_order_is_counted_not_timed(odd):
    order = [r.name for r in quality_rules.plan(odd)]
    assert all([r.name for r in quality_rules.plan(odd.repartition(k))] == order for k in (1, 5))
    long = odd.sparkSession.createDataFrame([(i, ("word " * 300)) for i in range(20)], "doc_id long, text string")
    # Only repeated windows reject here; the rules that reject nothing follow by name.
    assert [r.name for r in quality_rules.plan(long)][:2] == ["repeated_words", "duplicate_lines"]


def test_cascade_order_changes_no_verdict(odd):
    own = quality_rules.measures(F.coalesce("text", F.lit("")))
    orders = [list(quality_rules.RULES), list(reversed(quality_rules.RULES))]
    a, b = (Counter(tuple(r) for r in odd.select("doc_id", quality_rules.first_failure(own, o).isNull().alias("kept")).collect()) for o in orders)
    assert a == b
    assert {r.name for r in quality_rules.plan(odd)} == {r.name for r in quality_rules.RULES}


# 5 and 7


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality_classifier.quality])
def test_classifiers_on_odd_rows(spark, odd, operator):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(3, None), (None, 1), (3, 1)], "doc_id long, label int")
    for marks in (labels, labels.limit(0), labels.withColumn("label", F.lit(1))):
        got = operator(odd, marks).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        by_text = defaultdict(set)
        for r in got:
            if r.doc_id is not None:
                by_text[r.doc_id].add(round(r.score, 9))
        assert all(len(s) == 1 for s in by_text.values())
    assert operator(odd.limit(0), labels).count() == 0


@pytest.mark.parametrize("name, label, least", [("op5_factorization_machine", "toxic", 0.94), ("op7_fourier_features", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF_TRAIN).join(queries.table(spark, SF_TRAIN, "labels"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] > least


# 6


def brute_groups(docs, size=5, percent=75):
    sets = {}
    for i, text in docs:
        own = folded(text).encode()
        own = re.findall(rb"[^\x20\x09-\x0D]+", own)
        sets[i] = {tuple(own[k : k + size]) for k in range(max(1, len(own) - size + 1))} if own else set()
    parent = {}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                components.union(parent, a, b)
    return {i: (len(sets[i]), components.find(parent, i)) for i in ids}


def test_near_duplicates_of_odd_rows(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    docs = [(i, t) for i, t in plain(odd) if i is not None]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_groups(docs)
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_chains_of_near_copies_and_small_blocks(spark, monkeypatch):
    """Copies that drift apart: links between neighbours only, and buckets cut into blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(8)
    docs, own = [], [f"w{rng.random()}" for _ in range(80)]
    for k in range(60):
        docs.append((k, " ".join(own)))
        for _ in range(2):
            own[rng.randrange(80)] = f"w{rng.random()}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_groups(docs)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{k: 0 for k in range(1, 301)}, **{1000 + k: 1000 for k in range(1, 300)}}


# 8


def test_token_counts_of_odd_rows(odd):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter(tuple(r) for r in token_counts.count_tokens(odd).collect())
    expected = Counter()
    for i, text in plain(odd):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected[i, len((text or "").encode()), n, n > 512] += 1
    assert got == expected
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


# 9


def brute_spans(docs, length):
    starts = Counter(raw[p : p + length] for _, raw in docs for p in range(len(raw) - length + 1))
    out = Counter()
    for i, raw in docs:
        hit = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if starts[raw[p : p + length]] > 1:
                hit[p : p + length] = True
        left = bytes(b for b, h in zip(raw, hit) if not h)
        out[i, len(raw), int(hit.sum()), int((hit[1:] > hit[:-1]).sum() + hit[0]), hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize("cell", [8192, 2])
def test_repeats_of_odd_rows(odd, cell, monkeypatch):
    monkeypatch.setattr(repeated_spans, "CELL", cell)
    got = Counter(tuple(r) for r in repeated_spans.remove_repeats(odd).collect())
    assert got == brute_spans([(i, (t or "").encode()) for i, t in plain(odd)], 400)
    assert repeated_spans.remove_repeats(odd.limit(0)).count() == 0


def test_cut_texts_keep_all_columns(odd):
    cut = repeated_spans.cut_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    wanted = {r.doc_id: r.kept_text for r in repeated_spans.remove_repeats(odd, with_text=True).collect()}
    assert all((r.text or "") == wanted[r.doc_id] for r in cut.collect() if r.doc_id is not None)


# 10


def test_contamination_in_blocks(spark, odd):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join(rng.choices("ab", k=40))) for k in range(30)] + [(None, "a b"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(rng.choices("ab", k=rng.randint(1, 15)))) for k in range(30)] + [(None, "a"), (7, None), (8, "")], "item_id long, text string")
    one, many = (sorted(map(str, decontamination.contamination(docs, items, block_words=n).drop("longest").collect())) for n in (100_000, 40))
    assert one == many and len(one) == 33
    assert decontamination.contamination(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    quiet = spark.createDataFrame([(1, "no such words anywhere")], "item_id long, text string")
    kept = decontamination.decontaminate(odd, quiet)
    assert kept.columns == odd.columns and kept.count() == odd.count()


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 4])
def test_items_without_a_name_and_repeated_items(spark, block_words):
    items = [(None, "p q r s t u v w x y"), ("k", "aa bb cc"), (None, None), *[("hot", "one two three four five six")] * 50]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, "z p q r s t u v w x y z"), (2, "aa bb cc p q"), (3, "no hit")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"]) for r in decontamination.contamination(docs, benchmark, block_words=block_words).collect()}
    assert got == {1: (10, 0, []), 2: (3, 1, ["k"]), 3: (0, 0, [])}
    blocks = list(decontamination.item_blocks(benchmark, block_words))
    assert sum(map(len, blocks)) == 3 and (block_words == 4 or len(blocks) == 1)


def test_spans_are_cut_and_leaks_dropped(spark):
    item = " ".join(f"i{k}" for k in range(12))
    other = " ".join(f"o{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"Start. {item.upper()}! {other}"), (2, item), (3, other)], "doc_id long, text string")
    items = spark.createDataFrame([("t", item)], "item_id string, text string")
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items).collect()}
    assert got == {1: f"Start. ! {other}", 3: other}


# the pipeline and the registered queries


def test_pipeline_stages(spark):
    docs = queries.table(spark, SF, "documents")
    items = [(r.item_id, decontamination.words_of(r.text)) for r in queries.table(spark, SF, "benchmark").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = corpus_pipeline.stored(stage(spark, kept, SF), "test")
        after = {r.doc_id: r.text for r in kept.collect()}
        assert kept.columns == docs.columns and set(after) <= set(before)
        if name == "language_id":
            assert len(after) == len(before)
        if name == "near_dedup":
            groups = brute_groups(list(before.items()))
            assert set(after) == {i for i, (_, root) in groups.items() if root == i}
        if name == "suffix_dedup":
            removed = {k[0]: k[2] for k in brute_spans([(i, t.encode()) for i, t in before.items()], corpus_pipeline.REPEAT_BYTES)}
            assert set(after) == set(before) and all((after[i] == before[i]) == (not removed[i]) for i in after)
        if name == "decontamination":
            automaton = decontamination.ItemAutomaton(items)
            clean = {i for i, t in before.items() if not automaton.scan(decontamination.words_of(t))[0]}
            assert clean <= set(after) and all(after[i] == before[i] for i in clean) and clean != set(before)
    check_pieces([(r.doc_id, r.text) for r in kept.collect()], packing.pack(kept).collect())


def test_rows_that_share_an_id_or_have_none_stay(spark):
    words = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(5)]
    table = [(1, words[0]), (1, words[1]), (None, words[2]), (None, words[3]), (2, words[2]), (3, words[4]), (None, words[4] + " end"), (1, words[0]), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in table], "doc_id long, text string, row_number int")
    got = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, words[0]), (1, words[1]), (2, words[2]), (None, words[3]), (3, words[4]), (None, None), (4, "")]))


def test_pipeline_on_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "odd")
        assert docs.columns == odd.columns
    assert docs.count() > 0
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    problem = oracle.compare(spark, oracle.connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert problem is None or "'BOOLEAN'" in problem and "rows" not in problem


def test_entry_has_the_corpus_queries():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {m[0] for x in names if (m := re.match(r"op\d+_", x))} and "pipeline" in names
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
    assert duckdb.__version__

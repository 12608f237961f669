"""Learned sentence boundaries against a plain version, and the golden cases of abbreviations, initials and numbers."""

import random
import re

import pytest

from opinionloom.functions.text import SentenceModel
from opinionloom.operators import boundaries, shaping

MODEL = SentenceModel(("dr", "e.g", "etc", "approx"), ("the", "we", "then"))


def split(spark, model, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")
    df = shaping.split_sentences(rows, model)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    out = [[] for _ in texts]
    for r in sorted(df.collect(), key=lambda r: (r.review_id, r.sent_idx)):
        out[r.review_id].append(r.sentence)
    return out


def test_golden_cases(spark):
    cases = {
        "Dr. Smith paid 3.50 e.g. here.": ["Dr. Smith paid 3.50 e.g. here."],
        "Rice, fish, etc. The rest was cold. (Dr. Who?) Yes.": ["Rice, fish, etc.", "The rest was cold.", "(Dr. Who?) Yes."],
        "J. K. Rowling ate. We left.": ["J. K. Rowling ate.", "We left."],
        "Plan B. Then home.": ["Plan B.", "Then home."],
        "On the 3. of May. In 1999. Done!": ["On the 3. of May.", "In 1999.", "Done!"],
        "Wait... dr. \n\n X?  Really!": ["Wait...", "dr. \n\n X?", "Really!"],
        "approx. 5 pieces. APPROX. 6": ["approx. 5 pieces.", "APPROX. 6"],
        "No end": ["No end"],
        "   ": [],
        "e.g.": ["e.g."],
    }
    assert split(spark, MODEL, *cases) == list(cases.values())
    assert split(spark, MODEL, None) == [[]]


def plain_split(text, model):
    pieces = re.findall(r"(?s).*?[.!?]\s+|.+$", text.strip())
    out = [""]
    for k, p in enumerate(pieces):
        out[-1] += p
        if k + 1 == len(pieces):
            break
        last = re.sub(r"[^\w.]+$", "", re.sub(r"^[^\w]+", "", p.split()[-1].lower()))
        follower = pieces[k + 1].split()[0]
        begins = re.sub(r"[^\w]+$", "", re.sub(r"^[^\w]+", "", follower.lower()))
        capital = re.match(r"[^\w]*[A-Z]", follower) is not None
        word, new = re.sub(r"\.$", "", last), capital and begins in model.starters
        stays = word in model.abbreviations and not new or re.fullmatch("[a-z]", word) and capital and not new or re.fullmatch("[0-9]+", word) and re.match("[a-z]", follower)
        if not (re.search(r"[^.]\.$", last) and stays):
            out.append("")
    return [s.strip() for s in out if s.strip()]


@pytest.mark.parametrize("seed", [1, 2])
def test_splitting_equals_plain_version(spark, seed):
    rng = random.Random(seed)
    bits = ["Dr.", "dr.", "The", "we", "A.", "b.", "12.", "of", "etc.", "(etc.)", "end.", "what?", "wow!", "..", "e.g.", "X", "3.5", "Then,", "the"]
    texts = [rng.choice([" ", "  ", "\n"]).join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(300)]
    assert split(spark, MODEL, *texts) == [plain_split(t, MODEL) for t in texts]
    no_model = split(spark, None, *texts)
    assert split(spark, SentenceModel(), "One. Two? Three! 4") == [["One.", "Two?", "Three!", "4"]] and len(no_model) == 300


def test_abbreviations_and_starters_are_learned(spark):
    rng = random.Random(5)
    names, verbs, starts = ["Smith", "Jones", "Weber"], ["paid", "ate", "left", "sang"], ["The", "We", "They"]
    texts = []
    for _ in range(400):
        how = ["well", "late", "much"]
        said = [f"{rng.choice(starts)} saw Dr. {rng.choice(names)} who {rng.choice(how)} {rng.choice(verbs)} {rng.choice(how)}.",
                f"{rng.choice(starts)} {rng.choice(how)} {rng.choice(verbs)} approx. five {rng.choice(how)}."]
        texts.append(" ".join(rng.choices(said, k=4)))
    rows = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")
    learned = boundaries.learn_boundaries(rows)
    found = {r.word: r for r in learned.collect()}
    assert found["dr"].is_abbreviation and not found["well"].is_abbreviation and not found["paid"].is_abbreviation
    model = boundaries.sentence_model(learned)
    assert "dr" in model.abbreviations and {"the", "we", "they"} <= set(model.starters) and "smith" not in model.starters
    assert split(spark, model, "We saw Dr. Smith who ate well. They left.") == [["We saw Dr. Smith who ate well.", "They left."]]


def test_counts_leave_out_starts_behind_abbreviations(spark):
    texts = ["Dr. Smith came. The end! (The) etc. The 3. The A. The x... The Dr. The", None, "The the. THE. Dr.", "We left.\nDr. The"]
    reviews = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")

    def plain(abbreviations):
        counts = {}
        for toks in (t.split() for t in texts if t):
            for before, token in zip([None, *toks], toks):
                core, last = (re.sub(r"[^\w.]+$", "", re.sub(r"^[^\w]+", "", (t or "").lower())) for t in (token, before))
                name, word = re.sub(r"\.$", "", last), re.sub(r"\.+$", "", core)
                goes_on = re.search(r"[^.]\.$", last) and (name in abbreviations or re.fullmatch("[a-z]|[0-9]+", name))
                starts = before and before[-1] in ".!?" and not goes_on and re.match(r"[^\w]*[A-Z]", token)
                dotted = re.search(r"[^.]\.$", core) is not None
                if re.search("[a-z]", word):
                    c = counts.setdefault(word, [0, 0, 0])
                    c[0], c[1], c[2] = c[0] + dotted, c[1] + (not dotted), c[2] + bool(starts)
        return sorted((w, *c) for w, c in counts.items())

    for abbreviations in ((), ("dr", "etc")):
        counted = boundaries.boundary_counts(reviews, abbreviations)
        assert sorted(tuple(r) for r in counted.collect()) == plain(abbreviations)


def test_texts_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    reviews = spark.createDataFrame([(1, "Dr. Smith came. We left.")], "review_id long, text string").mapInPandas(read, "review_id long, text string")
    assert {r.word for r in boundaries.learn_boundaries(reviews).collect()} == {"dr", "smith", "came", "we", "left"}
    assert reads.value == 1


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([(1, None), (2, " "), (3, "12 34. !!")], "review_id long, text string")
    learned = boundaries.learn_boundaries(empty)
    assert learned.collect() == [] and boundaries.sentence_model(learned) == SentenceModel()

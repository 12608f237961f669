"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition over measures of the text. On a sample of documents, the work of every rule (characters read
and comparisons made by its measures) and its share of rejections are counted; the cascade asks the rules in order of
rejections per work, and a rule is asked only of documents that all earlier ones kept. The verdict doesn't depend on
the order, and the order depends on the documents alone: a repeated run asks in the same one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents that costs and selectivities are estimated on, about; which ones is decided by a hash of doc_id.
SAMPLE = 2000
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """`fails` gives the condition, over the measures of a text, under which the text is rejected; `needs` names those it reads."""

    name: str
    fails: Callable[[dict[str, Column]], Column]
    needs: tuple[str, ...]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def n_words(text: Column) -> Column:
    """Words are counted by their last character, without building them."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1)).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted next to their equals, so it takes n log n steps; the places of windows with an equal
    neighbour, and the two words behind them, are counted once.
    """
    own = words(text)

    def count(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(w) - 2)
        windows = F.array_sort(F.transform(places, lambda i: F.struct(F.array_join(F.slice(w, i, 3), " ").alias("s"), i.alias("i"))))

        def repeats(all_windows: Column) -> Column:
            names, at = all_windows.getField("s"), all_windows.getField("i")
            last = F.size(names)
            before = F.concat(F.array(F.lit("")), F.slice(names, 1, last - 1))
            after = F.concat(F.slice(names, 2, last - 1), F.array(F.lit("")))
            rows = F.arrays_zip(at.alias("at"), names.alias("n"), before.alias("b"), after.alias("a"))
            hits = F.filter(rows, lambda r: (r["n"] == r["b"]) | (r["n"] == r["a"]))
            return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda r: F.sequence(r["at"], r["at"] + 2)))))

        return F.when(F.size(w) < 4, 0).otherwise(_with(windows, repeats))

    return _with(own, count).cast("long")


def _with(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


MEASURES = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_lines": n_lines,
}


def measures(text: Column) -> dict[str, Column]:
    return {name: of(text) for name, of in MEASURES.items()}


RULES = (
    Rule("too_few_words", lambda m: m["n_words"] < MIN_WORDS, ("n_words",)),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], ("n_repeat_words", "n_words")),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"]), ("word_chars", "n_words")),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"], ("n_symbols", "n_words")),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"], ("n_dup_lines", "n_lines")),
)

#: Work of a measure on a text: how often its characters are read, and how often its three-word windows are sorted.
WORK = {"n_words": (1, 0), "word_chars": (2, 0), "n_symbols": (2, 0), "n_dup_lines": (3, 0), "n_repeat_words": (4, 1), "n_lines": (1, 0)}


def work(text: Column, needs: tuple[str, ...]) -> Column:
    """Characters read, and comparisons of sorted windows, to work out these measures of a text."""
    reads, sorts = (sum(WORK[name][i] for name in needs) for i in (0, 1))
    out = F.char_length(text).cast("double") * reads
    if sorts:
        n = n_words(text).cast("double")
        out = out + n * F.log2(n + 2) * sorts
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejections per work, counted on about `sample` documents that a hash of doc_id chooses; ties by name."""
    n, text = docs.count(), F.col("text")
    own = measures(text)
    part = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = part.where(F.pmod(F.xxhash64(F.lit("rules"), "doc_id"), F.lit(max(1, n))) < sample).repartition(4)
    hits = [F.count_if(r.fails(own)).alias(f"hits{i}") for i, r in enumerate(rules)]
    # Whole numbers, so that the sums don't depend on the order of the rows.
    costs = [F.sum(work(text, r.needs).cast("long")).alias(f"work{i}") for i, r in enumerate(rules)]
    counted = part.agg(*hits, *costs).first()
    worth = [(-counted[f"hits{i}"] / max(counted[f"work{i}"] or 0, 1), r.name, r) for i, r in enumerate(rules)]
    return [rule for _, _, rule in sorted(worth, key=lambda w: w[:2])]


def first_failure(own: dict[str, Column], rules: list[Rule]) -> Column:
    """Name of the first rule that rejects by these measures, null if none does; later rules aren't asked."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fails(own), F.lit(rule.name)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """All columns of `docs` with `failed_rule` (null where the document is kept).

    Null and empty texts have no words and fail the word count. Repeated rows are judged as often as they are
    given. An empty table gives an empty table. A column failed_rule of the input is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("failed_rule", first_failure(measures(text), plan(docs, rules, sample)))


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the measures of every text, base_failed, kept and failed_rule for every row of `docs`.

    The returned measures are worked out for every document; what only rules read is worked out in the cascade, for
    documents that it comes to.
    """
    ordered = plan(docs, rules, sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    returned = [name for name in MEASURES if name != "n_lines"]
    measured = docs.select("doc_id", text.alias("text")).select("doc_id", "text", *[MEASURES[name](F.col("text")).alias(name) for name in returned])
    own = {name: F.col(name) for name in returned} | {"n_lines": n_lines(F.col("text"))}
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = first_failure(own, ordered)
    return measured.select(
        "doc_id", *returned, base.alias("base_failed"),
        F.when(base, F.lit(False)).otherwise(failed.isNull()).alias("kept"), failed.alias("failed_rule"),
    )

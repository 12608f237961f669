"""Sentence boundaries learned from the texts: abbreviations, and words that begin sentences.

Counts are grouped aggregates over all words; the scores are those of Kiss and Strunk (Unsupervised Multilingual
Sentence Boundary Detection, 2006). What is learned is a table; the splitting itself works inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lookup import MAX_INLINE, is_listed
from ..functions.text import SentenceModel
from ..session import scratch

# Published thresholds of the two scores.
ABBREVIATION, STARTER = 0.3, 30.0
_LEAST = 1e-12


def _token_pairs(reviews: DataFrame) -> DataFrame:
    """token, before (the token before it, if . ! or ? ends that one) and n, their number: far fewer rows than tokens."""
    # Cutting at white space costs a tenth of finding runs of all other characters.
    raw = F.filter(F.split("text", f"[{text.SPACES}]+"), lambda t: t != "")

    def pair(toks: Column, token: Column, i: Column) -> Column:
        before = F.get(toks, i - 1)
        ended = F.endswith(before, F.lit(".")) | F.endswith(before, F.lit("!")) | F.endswith(before, F.lit("?"))
        return F.struct(token.alias("token"), F.when(ended, before).alias("before"))

    pairs = text.bind(raw, lambda toks: F.transform(toks, lambda t, i: pair(toks, t, i)))
    return reviews.select(F.explode(pairs).alias("p")).groupBy("p.token", "p.before").agg(F.count("*").alias("n"))


def _start_counts(reviews: DataFrame) -> DataFrame:
    """word (lower case, without its dot), after, n_dotted, n_plain, n_start, of words with a letter.

    after is the name of the word before where a sentence starts behind a single dot that may belong to an abbreviation, else null.
    """
    token, before = F.col("token"), F.col("before")
    last = text.word_core(before)
    name = F.regexp_replace(last, r"\.$", "")
    # Behind the dot of a single letter or of a number a sentence goes on.
    dot, goes_on = last.rlike(r"[^.]\.$"), name.rlike(r"^(\p{L}|\p{N}+)$")
    core = text.word_core(token)
    facts = _token_pairs(reviews).select(
        F.regexp_replace(core, r"\.+$", "").alias("word"), core.rlike(r"[^.]\.$").alias("dotted"),
        F.coalesce(before.isNotNull() & text.is_capital(token) & ~(dot & goes_on), F.lit(False)).alias("starts"),
        F.when(dot, name).alias("name"), "n",
    ).where(F.col("word").rlike(r"\p{L}"))

    def number(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0))

    return facts.groupBy("word", F.when(F.col("starts"), F.col("name")).alias("after")).agg(
        number(F.col("dotted")).alias("n_dotted"), number(~F.col("dotted")).alias("n_plain"), number(F.col("starts")).alias("n_start")
    )


def _counts_without(starts: DataFrame, abbreviations: Sequence[str]) -> DataFrame:
    """The counts of each word, without the starts behind one of the abbreviations."""
    real = ~F.coalesce(is_listed(F.col("after"), abbreviations), F.lit(False))
    return starts.groupBy("word").agg(
        F.sum("n_dotted").alias("n_dotted"), F.sum("n_plain").alias("n_plain"), F.sum(F.when(real, F.col("n_start")).otherwise(0)).alias("n_start")
    )


def boundary_counts(reviews: DataFrame, abbreviations: Sequence[str] = ()) -> DataFrame:
    """word, n_dotted (with one final dot), n_plain, n_start (with a capital where a sentence has ended), of words with a letter.

    No sentence ends after the dot of one of the abbreviations, of a single letter or of a number.
    """
    return _counts_without(_start_counts(reviews), abbreviations)


def _binomial(k: Column, n: Column, p: Column) -> Column:
    return k * F.ln(F.greatest(p, F.lit(_LEAST))) + (n - k) * F.ln(F.greatest(1 - p, F.lit(_LEAST)))


def _with_totals(counts: DataFrame) -> DataFrame:
    totals = counts.agg(F.sum(F.col("n_dotted") + F.col("n_plain")).alias("_all"), F.sum("n_dotted").alias("_dots"), F.sum("n_start").alias("_starts"))
    return counts.join(F.broadcast(totals))


def _abbreviation_score() -> Column:
    n, dotted = F.col("n_dotted") + F.col("n_plain"), F.col("n_dotted")
    ratio = -2 * (_binomial(dotted, n, F.col("_dots") / F.col("_all")) - _binomial(dotted, n, F.lit(0.99)))
    size = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - size
    return ratio * F.exp(-size) * (inner + 1) * F.pow(size, -F.col("n_plain"))


def _starter_score() -> Column:
    n, starts = F.col("n_dotted") + F.col("n_plain"), F.col("n_start")
    before, rest = F.col("_starts"), F.col("_all") - F.col("_starts")
    own, chance, other = F.try_divide(starts, before), n / F.col("_all"), F.try_divide(n - starts, rest)
    gain = -2 * (_binomial(starts, before, chance) + _binomial(n - starts, rest, chance) - _binomial(starts, before, own) - _binomial(n - starts, rest, other))
    return F.coalesce(F.when(own > chance, gain), F.lit(0.0))


def learn_boundaries(reviews: DataFrame) -> DataFrame:
    """boundary_counts with abbreviation and starter (scores), is_abbreviation and is_starter.

    A word is an abbreviation when its dot is far more usual than that of all words; long words and words that also
    occur without a dot score less, inner dots score more. A starter follows the end of a sentence far more often
    than by chance; where sentences end is known with the abbreviations. The texts are read once: starts are counted by
    the word before them in a table of the shared folder, and those behind abbreviations are then left out.
    """
    spark, folder = reviews.sparkSession, scratch(reviews.sparkSession, "starts")
    _start_counts(reviews).write.parquet(folder)
    starts = spark.read.parquet(folder)
    scored = _with_totals(_counts_without(starts, ())).withColumn("is_abbreviation", _abbreviation_score() >= ABBREVIATION)
    counts = _counts_without(starts, _listed(scored, "is_abbreviation"))
    out = _with_totals(counts).withColumns({"abbreviation": _abbreviation_score(), "starter": _starter_score()})
    short = F.col("abbreviation") >= ABBREVIATION
    return out.withColumns({"is_abbreviation": short, "is_starter": (F.col("starter") >= STARTER) & ~short}).drop("_all", "_dots", "_starts")


def _listed(learned: DataFrame, flag: str) -> tuple[str, ...]:
    """The words with a flag, a bounded list."""
    rows = learned.where(flag).select("word").orderBy("word").limit(MAX_INLINE + 1).collect()
    if len(rows) > MAX_INLINE:
        raise ValueError(f"more than {MAX_INLINE} words with {flag}: raise the threshold of its score")
    return tuple(r.word for r in rows)


def sentence_model(learned: DataFrame) -> SentenceModel:
    """The words that merge and split sentences, from the table that learn_boundaries gives."""
    return SentenceModel(_listed(learned, "is_abbreviation"), _listed(learned, "is_starter"))

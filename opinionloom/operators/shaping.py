"""Text shaping: reviews(review_id, text) -> sentences, tokens, phrases and clauses."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import resources
from ..functions import text
from ..functions.joins import lookup_join
from ..functions.lookup import MAX_INLINE, inline_or_none, is_listed, word_value
from ..functions.text import SentenceModel


def split_sentences(reviews: DataFrame, model: SentenceModel | None = None) -> DataFrame:
    """(review_id, sent_idx, sentence); a model (see operators.boundaries) knows abbreviations, initials and numbers."""
    return reviews.select("review_id", F.posexplode(text.sentences("text", model)).alias("sent_idx", "sentence"))


def tokenize(reviews: DataFrame, stop_words: Iterable[str] = resources.STOP_WORDS, model: SentenceModel | None = None) -> DataFrame:
    found = split_sentences(reviews, model).select(
        "review_id", "sent_idx", F.posexplode(text.tokens("sentence")).alias("tok_idx", "token")
    )
    token = F.col("token")
    return found.select(
        "*",
        text.is_alpha(token).alias("is_alpha"),
        is_listed(F.lower(token), stop_words).alias("is_stop"),
        text.is_punct(token).alias("is_punct"),
    )


def annotate_tokens(tokens: DataFrame, pos_lexicon: DataFrame) -> DataFrame:
    """Add lemma, pos and tag from pos_lexicon(token, lemma, pos, tag); unknown words get pos X."""
    keyed = tokens.withColumn("_word", F.lower("token"))
    entries = pos_lexicon.select(F.col("token").alias("_word"), "lemma", "pos", "tag")
    spread = ["review_id", "sent_idx", "tok_idx"]
    return lookup_join(keyed, entries, ["_word"], spread, "left").select(
        *tokens.columns,
        F.coalesce("lemma", "_word").alias("lemma"),
        F.coalesce("pos", F.lit("X")).alias("pos"),
        F.coalesce("tag", F.lit("")).alias("tag"),
    )


ADJECTIVE, NOUN = 1, 2


def pos_codes(toks: Column, pos: Mapping[str, int]) -> Column:
    """One letter per token: J adjective, N noun, x anything else."""

    def letter(token: Column) -> Column:
        code = word_value(F.lower(token), pos)
        return F.when(code == ADJECTIVE, "J").when(code == NOUN, "N").otherwise("x")

    return F.array_join(F.transform(toks, letter), "")


def phrase_runs(codes: Column) -> Column:
    """struct(adjectives, nouns, opens) per token: what follows from it on, in its run of adjectives and then nouns.

    The codes are cut once into runs that each pass over the string only once (the patterns never go back); the lengths of a
    run give the numbers of all its tokens. Zero nouns: no phrase starts here. `opens` marks the first token of a run.
    """
    cut = F.regexp_extract_all(codes, F.lit("J*+N++|J++|x++"), F.lit(0))
    lengths = F.transform(cut, lambda run: F.struct(F.length(run).alias("n"), F.instr(run, "N").alias("noun")))

    def tokens_of(run: Column) -> Column:
        def token(k: Column) -> Column:
            adjectives = F.greatest(run["noun"] - 1 - k, F.lit(0))
            nouns = F.when(run["noun"] > 0, run["n"] - k - adjectives).otherwise(0)
            return F.struct(adjectives.alias("adjectives"), nouns.alias("nouns"), (k == 0).alias("opens"))

        return F.transform(F.sequence(F.lit(0), run["n"] - 1), token)

    return F.flatten(F.transform(lengths, tokens_of))


def phrase_spans(toks: Column, codes: Column, max_words: int | None = None) -> Column:
    """Every span of ADJ* NOUN+ as struct(start, n_words, maximal, phrase).

    Costs the length of the sentence and of the spans that are produced. `max_words` bounds the span length; pass it
    only when longer phrases are of no use, such as beyond the longest entry of a dictionary the spans are looked up in.
    """
    none = F.array().cast("array<int>")

    def from_start(run: Column, i: Column) -> Column:
        whole = run["adjectives"] + run["nouns"]
        last = whole if max_words is None else F.least(whole, F.lit(max_words))
        lengths = F.when((run["nouns"] > 0) & (last > run["adjectives"]), F.sequence(run["adjectives"] + 1, last)).otherwise(none)

        def span(n: Column) -> Column:
            maximal = run["opens"] & (n == whole)
            return F.struct(
                i.alias("start"), n.alias("n_words"), maximal.alias("maximal"), text.joined(toks, i, n).alias("phrase")
            )

        return F.transform(lengths, span)

    return F.flatten(F.transform(phrase_runs(codes), from_start))


def _with_listed_codes(sentences: DataFrame, pos: DataFrame) -> DataFrame:
    """Add `toks` and `codes` to rows with `sentence` from a table pos(token, code) of any size, rows of equal tokens looked up once.

    The key of a sentence is a hash of its tokens, so a stage that runs again finds the same rows. Of a word's entries the
    smallest code counts.
    """
    entries = pos.groupBy(F.col("token").alias("_word")).agg(F.min("code").alias("_code"))
    # The sentence moves as it is and is cut again behind the join: its tokens take twice the bytes.
    keyed = sentences.withColumn("_key", F.unhex(F.sha2(F.array_join(text.tokens("sentence"), "\x1f"), 256)))
    words = keyed.select("_key", F.posexplode(text.tokens("sentence")).alias("_i", "_word")).select("_key", "_i", F.lower("_word").alias("_word"))
    known = lookup_join(words, entries.where(F.col("_code").isin(ADJECTIVE, NOUN)), ["_word"], ["_key", "_i"], "inner")
    # A place and its code travel as one number, those of a sentence in one row; equal sentences give equal numbers.
    numbers = known.select("_key", F.when(F.col("_code") == NOUN, F.col("_i") * 2 + 1).otherwise(F.col("_i") * 2).alias("_n"))
    listed = numbers.groupBy("_key").agg(F.array_sort(F.collect_set("_n")).alias("_listed"))
    found = keyed.join(listed.where(F.exists("_listed", lambda n: n % 2 == 1)), "_key", "inner")
    found = found.withColumn("toks", text.tokens("sentence"))

    def place(n: Column) -> Column:
        return F.shiftright(n, 1)

    def piece(n: Column, j: Column) -> Column:
        before = F.coalesce(place(F.get(F.col("_listed"), j - 1)), F.lit(-1))
        return F.concat(F.repeat(F.lit("x"), place(n) - before - 1), F.when(n % 2 == 1, "N").otherwise("J"))

    end = F.repeat(F.lit("x"), F.size("toks") - 1 - place(F.element_at("_listed", -1)))
    codes = F.concat(F.array_join(F.transform("_listed", piece), ""), end)
    return found.withColumn("codes", codes).select(*sentences.columns, "toks", "codes")


def noun_phrases(
    reviews: DataFrame, pos: Mapping[str, int] | DataFrame, max_words: int | None = None, max_inline: int = MAX_INLINE
) -> DataFrame:
    """All ADJ* NOUN+ spans per sentence; `is_chunk` marks the maximal ones.

    `pos` maps a lower-case word to ADJECTIVE or NOUN, as a value or as a table (token, code). A value, or a table of up
    to `max_inline` words, works inside the row; larger tables are joined with the words. Rows may repeat.
    """
    sentences = split_sentences(reviews)
    if isinstance(pos, DataFrame):
        rows = inline_or_none(pos.groupBy("token").agg(F.min("code").alias("code")), max_inline)
        coded = _with_listed_codes(sentences, pos) if rows is None else None
        pos = {r["token"]: r["code"] for r in rows or [] if r["token"] is not None}
    else:
        coded = None
    if coded is None:
        tagged = sentences.select("review_id", "sent_idx", text.tokens("sentence").alias("toks"))
        coded = tagged.withColumn("codes", pos_codes(F.col("toks"), pos))
    coded = coded.where(F.col("codes").contains("N"))
    spans = F.explode(phrase_spans(F.col("toks"), F.col("codes"), max_words)).alias("span")
    return coded.select("review_id", "sent_idx", spans).select(
        "review_id",
        "sent_idx",
        F.col("span.start").alias("tok_idx"),
        F.col("span.n_words").alias("n_words"),
        F.lower("span.phrase").alias("phrase"),
        F.col("span.maximal").alias("is_chunk"),
    )


def meaningful_sentences(reviews: DataFrame, model: SentenceModel | None = None) -> DataFrame:
    return reviews.select("review_id", F.posexplode(text.scoring_units("text", model)).alias("unit_idx", "unit"))


def emotion_clauses(reviews: DataFrame) -> DataFrame:
    return reviews.select("review_id", F.posexplode(text.emotion_clauses("text")).alias("clause_idx", "clause"))


def contrast_clauses(review_aspects: DataFrame) -> DataFrame:
    """review_aspects(review_id, text, aspect) -> one row per clause that mentions the aspect.

    A text without 'but' is its own clause; an aspect found in no clause keeps one
    row without a clause.
    """
    parts = text.contrast_clauses("text")
    needle = F.lower("aspect")
    mentioning = F.filter(F.col("_parts"), lambda c: F.lower(c).contains(needle))
    chosen = F.when(F.size("_parts") <= 1, F.array(F.col("text"))).otherwise(mentioning)
    split = review_aspects.withColumn("_parts", parts)
    return split.select("review_id", "aspect", F.posexplode_outer(chosen).alias("clause_idx", "clause")).withColumn(
        "clause_idx", F.coalesce("clause_idx", F.lit(0))
    )


def normalize_text(reviews: DataFrame, model: SentenceModel | None = None) -> DataFrame:
    return reviews.select("review_id", text.normalized("text", model).alias("text"))


def strip_punct(reviews: DataFrame) -> DataFrame:
    return reviews.select("review_id", text.strip_trailing_punct("text").alias("text"))

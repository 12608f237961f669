"""Aspect-based sentiment: find aspects, score them, give their context and roll them up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import resources
from ..functions import labels, text
from ..functions.cues import mentions_any
from ..functions.joins import lookup_join
from ..functions.lookup import MAX_INLINE, inline_or_none, is_listed
from ..functions.ranking import first_best
from .scoring import argmax_label
from .shaping import phrase_spans, pos_codes

_NO_STRINGS = "array<string>"


def _candidates(longest: int, pos: Mapping[str, int] | None) -> Column:
    """Lower-cased phrases of up to `longest` words of one text.

    Without a part-of-speech dictionary every run of words is a candidate; with one
    only ADJ* NOUN+ spans inside a sentence are. Phrases beyond the longest
    dictionary entry cannot match it, so the bound loses nothing.
    """

    def runs(toks: Column) -> Column:
        def of_length(n: int) -> Column:
            # concat_ws skips the NULLs beyond the end: shorter runs again, which do no harm.
            return F.transform(toks, lambda t, i: F.concat_ws(" ", t, *[F.get(toks, i + d) for d in range(1, n)]))

        return toks if longest == 1 else F.flatten(F.array(toks, *[of_length(n) for n in range(2, longest + 1)]))

    def tagged(toks: Column) -> Column:
        spans = text.bind(pos_codes(toks, pos or {}), lambda codes: phrase_spans(toks, codes, longest))
        return F.transform(spans, lambda s: s["phrase"])

    in_sentence = runs if pos is None else tagged
    per_sentence = F.transform(
        text.sentences("text"), lambda s: text.bind(text.tokens(F.lower(s)), in_sentence)
    )
    return F.flatten(per_sentence)


def aspect_array(aspects: Sequence[str] = resources.ASPECTS, pos: Mapping[str, int] | None = None) -> Column:
    """Distinct dictionary aspects of the column `text`, inside the row."""
    longest = max((len(a.split()) for a in aspects), default=1)
    # No token reaches beyond a sentence, so single tokens need no sentences, and dictionary words no punctuation marks.
    if longest != 1 or pos is not None:
        candidates = _candidates(longest, pos)
    elif all(a.isascii() and a.isalnum() for a in aspects):
        candidates = text.words("text")
    else:
        candidates = text.tokens(F.lower("text"))
    found = F.filter(candidates, lambda p: is_listed(p, aspects))
    return F.coalesce(F.array_distinct(found), F.array().cast(_NO_STRINGS))


def extract_aspects(
    reviews: DataFrame,
    aspects: Sequence[str] | DataFrame = resources.ASPECTS,
    pos: Mapping[str, int] | None = None,
    max_inline: int = MAX_INLINE,
    longest: int | None = None,
) -> DataFrame:
    """(review_id, aspect), one row per distinct aspect of a review.

    A dictionary table beyond `max_inline` rows is joined with the phrases instead
    of travelling inside the plan; its longest entry is measured by Spark. `longest`
    can only widen the phrases that are looked up.
    """
    if isinstance(aspects, DataFrame):
        rows = inline_or_none(aspects.select("aspect").distinct(), max_inline)
        if rows is None:
            longest = max(longest or 1, aspects.agg(F.max(F.size(F.split("aspect", " ")))).first()[0] or 1)
            phrases = reviews.select("review_id", F.explode(F.array_distinct(_candidates(longest, pos))).alias("aspect"))
            return lookup_join(phrases, aspects.select("aspect").distinct(), ["aspect"], ["review_id"], "left_semi")
        aspects = [r["aspect"] for r in rows]
    return reviews.select("review_id", F.explode(aspect_array(aspects, pos)).alias("aspect"))


def add_aspect_arrays(reviews: DataFrame, aspects: Sequence[str] | DataFrame, pos: Mapping[str, int] | None = None,
                      max_inline: int = MAX_INLINE) -> DataFrame:
    """Add `found`, the distinct dictionary aspects of each review(review_id, text), empty where there is none.

    With a dictionary beyond `max_inline` rows, review_id must be a key of the reviews.
    """
    if isinstance(aspects, DataFrame):
        rows = inline_or_none(aspects.select("aspect").distinct(), max_inline)
        if rows is None:
            pairs = extract_aspects(reviews, aspects, pos, max_inline=max_inline)
            arrays = pairs.groupBy("review_id").agg(F.collect_set("aspect").alias("found"))
            joined = reviews.join(arrays, "review_id", "left")
            return joined.withColumn("found", F.coalesce("found", F.array().cast(_NO_STRINGS)))
        aspects = [r["aspect"] for r in rows]
    return reviews.withColumn("found", aspect_array(aspects, pos))


def exploded_contexts(found: DataFrame, window: int = resources.CONTEXT_WINDOW) -> DataFrame:
    """(review_id, aspect, context_phrase) of reviews with `found`; the text is tokenised once per review and stays in its row.

    The context is a column of its own behind the explode: who asks for the aspects alone pays for no tokens. There is always an
    aspect; a plain explode would add a filter on its array, which finds the aspects again for every use of them.
    """
    kept = found.select("review_id", text.tokens("text").alias("_toks"), aspects_or_overall(without_singulars(F.col("found"))).alias("_kept"))
    each = kept.select("review_id", "_toks", F.explode_outer("_kept").alias("aspect"))
    return each.select("review_id", "aspect", text.context_windows(F.col("_toks"), F.col("aspect"), window).alias("context_phrase"))


def without_singulars(found: Column) -> Column:
    """Drop an aspect when its plural in -s, or in -es after a hissing sound, was found too."""

    def stays(a: Column) -> Column:
        es = a.rlike("(sh|ch|s|x|z)$") & F.array_contains(found, F.concat(a, F.lit("es")))
        return ~(F.array_contains(found, F.concat(a, F.lit("s"))) | es)

    return F.filter(found, stays)


def aspects_or_overall(found: Column) -> Column:
    """The aspects of `found`, which holds no NULL, in order."""
    return text.bind(found, lambda kept: F.when(F.size(kept) > 0, F.sort_array(kept)).otherwise(F.array(F.lit("overall"))))


def prefer_plural(reviews: DataFrame, aspects: Sequence[str] = resources.ASPECTS, pos: Mapping[str, int] | None = None) -> DataFrame:
    found = reviews.select("review_id", aspect_array(aspects, pos).alias("found"))
    return found.select("review_id", F.explode(without_singulars(F.col("found"))).alias("aspect"))


def prefer_plural_rows(review_aspects: DataFrame) -> DataFrame:
    """prefer_plural for a table (review_id, aspect): anti join with the singular forms of its plurals."""
    plural = F.col("aspect")
    singular_s = F.when(plural.endswith("s"), F.expr("left(aspect, length(aspect) - 1)"))
    stem = F.when(plural.endswith("es"), F.expr("left(aspect, length(aspect) - 2)"))
    singular_es = F.when(stem.rlike("(sh|ch|s|x|z)$"), stem)
    covered = (
        review_aspects.select("review_id", F.explode(F.array(singular_s, singular_es)).alias("aspect"))
        .where(F.col("aspect").isNotNull())
    )
    return review_aspects.join(covered, ["review_id", "aspect"], "left_anti")


def default_overall(reviews: DataFrame, aspects: Sequence[str] = resources.ASPECTS, pos: Mapping[str, int] | None = None) -> DataFrame:
    """Aspects of every review in order; `overall` where none is found."""
    found = reviews.select("review_id", aspect_array(aspects, pos).alias("found"))
    kept = aspects_or_overall(without_singulars(F.col("found")))
    return found.select("review_id", F.posexplode(kept).alias("aspect_idx", "aspect"))


def aspect_units(reviews: DataFrame, aspects: Sequence[str] | DataFrame = resources.ASPECTS, separator: str = " [SEP] ",
                 pos: Mapping[str, int] | None = None) -> DataFrame:
    """One classifier input per (review, aspect); blank text gives none."""
    usable = add_aspect_arrays(reviews.where(~text.is_blank("text")), aspects, pos)
    kept = aspects_or_overall(without_singulars(F.col("found")))
    exploded = usable.select("review_id", "text", F.explode(kept).alias("aspect"))
    return exploded.select("review_id", "aspect", F.concat_ws(separator, text.strip("text"), "aspect").alias("unit"))


def label_columns(label: Column, score: Column) -> dict[str, Column]:
    """sentiment_label, sentiment_score and confidence of one best (label, score)."""
    name = F.when(score.isNull(), "neutral").otherwise(labels.aspect_label(label))
    # A LABEL_ without a number can't be read: neutral without confidence.
    malformed = F.coalesce(labels.has_label_prefix(label) & labels.class_index(label).isNull(), F.lit(False))
    confidence = F.when(malformed, 0.0).otherwise(F.coalesce(score, F.lit(0.0)))
    return {
        "sentiment_label": name,
        "sentiment_score": labels.signed(labels.aspect_direction(name), confidence),
        "confidence": confidence,
    }


def aspect_sentiment(aspect_scores: DataFrame) -> DataFrame:
    """aspect_scores(review_id, aspect, pos, label, score), or (review_id, aspect, scores) with one array per
    unit -> one labelled row per (review, aspect)."""
    keys = ["review_id", "aspect"]
    best = argmax_label(aspect_scores, keys).select(*keys, F.struct("label", "score").alias("best"))
    label, score = F.col("best.label"), F.col("best.score")
    return best.select(
        "review_id",
        "aspect",
        *[c.alias(name) for name, c in label_columns(label, score).items()],
        label.alias("raw_label"),
    )


def aspect_context(review_aspects: DataFrame, window: int = resources.CONTEXT_WINDOW) -> DataFrame:
    """Add context_phrase to (review_id, text, aspect). Works inside the row."""
    with_tokens = review_aspects.withColumn("_toks", text.tokens("text"))
    phrase = text.context_windows(F.col("_toks"), F.col("aspect"), window)
    return with_tokens.withColumn("context_phrase", phrase).drop("_toks")


def aspect_signals(details: DataFrame) -> DataFrame:
    """Aspect counts and means of the reviews with details."""
    return details.groupBy("review_id").agg(
        F.count_if(F.col("sentiment_label") == "positive").alias("num_pos_aspects"),
        F.count_if(F.col("sentiment_label") == "negative").alias("num_neg_aspects"),
        F.avg("sentiment_score").alias("avg_aspect_score"),
        F.avg("confidence").alias("avg_aspect_confidence"),
    )


def add_rollup(df: DataFrame, details: DataFrame) -> DataFrame:
    """Add aspect counts and means; zeros where a review has no detail."""
    zero = {"num_pos_aspects": 0, "num_neg_aspects": 0, "avg_aspect_score": 0.0, "avg_aspect_confidence": 0.0}
    return df.join(aspect_signals(details), "review_id", "left").fillna(zero)


def absa_rollup(reviews: DataFrame, details: DataFrame) -> DataFrame:
    return add_rollup(reviews.select("review_id"), details)


def map_categories(details: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows of the aspect table; aspects without a category are left out.

    Of several categories for one aspect the one with the largest id counts.
    `aspect_confidence` holds the signed score, as stored by the original schema;
    the plain confidence is kept beside it.
    """
    ids = categories.groupBy(F.lower("aspect").alias("_aspect")).agg(F.max("category_id").alias("category_id"))
    keyed = details.withColumn("_aspect", F.lower("aspect"))
    return lookup_join(keyed, ids, ["_aspect"], ["review_id"], "inner").select(
        "review_id",
        "category_id",
        F.col("aspect").alias("span_text"),
        F.col("sentiment_label").alias("aspect_sentiment"),
        F.col("sentiment_score").alias("aspect_confidence"),
        "confidence",
    )


def unmapped_aspects(details: DataFrame, categories: DataFrame) -> DataFrame:
    """How often each aspect without a category was found."""
    known = categories.select(F.lower("aspect").alias("_aspect")).distinct()
    counts = details.groupBy(F.lower("aspect").alias("_aspect")).agg(F.count("*").alias("n_rows"))
    return counts.join(known, "_aspect", "left_anti").withColumnRenamed("_aspect", "aspect")


def clause_aspect_sentiment(clauses: DataFrame, clause_scores: DataFrame) -> DataFrame:
    """clauses(review_id, aspect, clause_idx, clause) with the best label of each clause.

    clause_scores(review_id, aspect, clause_idx, pos, label, score). Rows without a
    clause or without scores are neutral.
    """
    keys = ["review_id", "aspect", "clause_idx"]
    order = F.coalesce("score", F.lit(0.0))
    best = clause_scores.groupBy(*keys).agg(first_best(F.struct("label", "score"), order, F.col("pos")).alias("best"))
    has_clause = F.col("clause").isNotNull()
    label = F.when(has_clause, F.col("best.label"))
    score = F.when(has_clause, F.col("best.score"))
    return clauses.join(best, keys, "left").select(
        *keys, "clause", *[c.alias(name) for name, c in label_columns(label, score).items()]
    )


def aggregate_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions of one aspect -> mean score and confidence, label by the sign of the mean."""
    grouped = mentions.groupBy("review_id", "aspect").agg(
        F.avg("sentiment_score").alias("sentiment_score"),
        F.avg("confidence").alias("confidence"),
        F.count_if(F.col("sentiment_label") == "positive").alias("pos_mentions"),
        F.count_if(F.col("sentiment_label") == "negative").alias("neg_mentions"),
    )
    score = F.col("sentiment_score")
    label = F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")
    return grouped.withColumn("sentiment_label", label)


def flip_sarcastic_aspect(
    details: DataFrame,
    sarcastic: Sequence[str] = resources.FLIP_SARCASTIC,
    negative: Sequence[str] = resources.FLIP_NEGATIVE,
) -> DataFrame:
    """A positive aspect whose context holds a sarcastic and a negative cue becomes negative."""
    context = F.col("context_phrase")
    flip = (F.col("sentiment_label") == "positive") & mentions_any(context, sarcastic) & mentions_any(context, negative)
    return details.withColumns(
        {
            "sentiment_label": F.when(flip, "negative").otherwise(F.col("sentiment_label")),
            "sentiment_score": F.when(flip, -F.col("sentiment_score")).otherwise(F.col("sentiment_score")),
        }
    )

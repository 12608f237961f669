"""Rule sentiment: word scores -> unit scores -> one polarity and label per review."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import resources
from ..functions import cues, labels, text
from ..functions.joins import lookup_join
from ..functions.lookup import MAX_INLINE, inline_or_none, is_listed, number_list, word_value
from ..resources import Lexicon

# Named constants of the published compound score.
NEGATION_PERCENT = -74
EXCLAMATION_MILLI = 292
MAX_EXCLAMATIONS = 4
ALPHA = 15.0
# Weight in percent of a booster one, two or three words before the scored word.
BOOSTER_DECAY = {1: 100, 2: 95, 3: 90}
# What capitals add to a word or a booster, and the percentages before and after a word of contrast.
CAPITALS_MILLI = 733
CONTRAST_PERCENT = (50, 150)
# Raw sums are kept as integers of this unit, so they do not depend on order.
RAW_UNIT = 10_000_000


def _chosen_idioms(words: Column, idioms: Mapping[str, int]) -> Column:
    """array of struct(start, n, v): from the left the longest idiom at each place, none inside another one."""
    listed = {" ".join(k.lower().split()): v for k, v in idioms.items()}
    sizes = sorted({len(k.split()) for k in listed}, reverse=True)
    firsts = {k.split()[0]: 1 for k in listed}
    marks = F.transform(words, lambda w, i: F.when(word_value(w, firsts).isNotNull(), i))

    def longest(i: Column) -> Column:
        def of_size(n: int) -> Column:
            value = F.when(i + n <= F.size(words), word_value(text.joined(words, i, F.lit(n)), listed))
            return F.when(value.isNotNull(), F.struct(i.alias("start"), F.lit(n).alias("n"), value.alias("v")))

        return F.coalesce(*[of_size(n) for n in sizes])

    found = F.filter(F.transform(F.filter(marks, lambda i: i.isNotNull()), longest), lambda c: c.isNotNull())

    def keep(kept: Column, c: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        free = F.coalesce(last["start"] + last["n"] <= c["start"], F.lit(True))
        return F.when(free, F.array_append(kept, c)).otherwise(kept)

    return F.aggregate(found, F.array().cast("array<struct<start:int,n:int,v:int>>"), keep)


def _reading(unit: Column, lexicon: Lexicon) -> Column:
    """struct of the unit's lower-cased words and of what the lexicon's rules have to know about them."""

    def rules(words: Column, cased: Column | None) -> Column:
        parts = [words.alias("words")]
        if cased is not None:
            flags = F.transform(cased, lambda w: (w == F.upper(w)) & (w != F.lower(w)))
            mixed = F.exists(flags, lambda x: x) & F.exists(flags, lambda x: ~x)
            parts.append(F.when(mixed, flags).alias("caps"))
        if lexicon.contrast:
            turns = F.transform(words, lambda w, i: F.when(is_listed(w, lexicon.contrast), i))
            parts.append(F.array_min(turns).alias("turn"))
        if lexicon.idioms:
            parts.append(_chosen_idioms(words, lexicon.idioms).alias("idioms"))
        return F.struct(*parts)

    if not lexicon.capitals:
        return text.bind(text.words(unit), lambda words: rules(words, None))
    cased = F.coalesce(F.regexp_extract_all(unit, F.lit(text.WORD), F.lit(0)), F.array().cast("array<string>"))
    return text.bind(cased, lambda c: text.bind(F.transform(c, F.lower), lambda words: rules(words, c)))


def _modifiers(read: Column, i: Column, lexicon: Lexicon) -> tuple[Column, Column]:
    """(booster, factor) of word i: booster in 1e-5, factor 100 or NEGATION_PERCENT, times the share of its side of a contrast."""
    words = read["words"]

    def shouted(place: Column) -> Column:
        return F.coalesce(F.get(read["caps"], place), F.lit(False))

    boost = F.when(shouted(i), CAPITALS_MILLI * 100).otherwise(0) if lexicon.capitals else F.lit(0)
    for distance, weight in BOOSTER_DECAY.items():
        own = F.coalesce(word_value(F.get(words, i - distance), lexicon.boosters), F.lit(0))
        if lexicon.capitals:
            louder = F.signum(own).cast("int") * CAPITALS_MILLI
            own = own + F.when(shouted(i - distance), louder).otherwise(0)
        boost = boost + own * weight
    negated = F.lit(False)
    for distance in BOOSTER_DECAY:
        before = F.get(words, i - distance)
        negated = negated | F.coalesce(is_listed(before, lexicon.negators) | before.endswith("n't"), F.lit(False))

    def weighed(factor: int) -> Column:
        if not lexicon.contrast:
            return F.lit(factor)
        less, more = (factor * share // 100 for share in CONTRAST_PERCENT)
        return F.when(i < read["turn"], less).when(i > read["turn"], more).otherwise(factor)

    return boost, F.when(negated, weighed(NEGATION_PERCENT)).otherwise(weighed(100))


def _is_free(read: Column, i: Column, lexicon: Lexicon) -> Column:
    """Whether word i counts by itself, being part of no idiom."""
    if not lexicon.idioms:
        return F.lit(True)
    return ~F.exists(read["idioms"], lambda c: (c["start"] <= i) & (i < c["start"] + c["n"]))


def _idiom_raw(read: Column, lexicon: Lexicon) -> Column:
    """Sum over the idioms, each modified as its first word would be."""
    zero = F.lit(0).cast("bigint")
    if not lexicon.idioms:
        return zero
    return F.aggregate(read["idioms"], zero, lambda acc, c: acc + _raw(c["v"], *_modifiers(read, c["start"], lexicon)))


def _raw(valence: Column, boost: Column, factor: Column) -> Column:
    towards = F.when(valence > 0, 1).when(valence < 0, -1).otherwise(0)
    return ((valence * 100 + towards * boost) * factor).cast("bigint")


def _compound(raw: Column, exclamations: Column) -> Column:
    towards = F.when(raw > 0, 1).when(raw < 0, -1).otherwise(0)
    emphasis = F.least(exclamations, F.lit(MAX_EXCLAMATIONS)) * (EXCLAMATION_MILLI * 10_000)
    s = (raw + towards * emphasis) / F.lit(float(RAW_UNIT))
    return s / F.sqrt(s * s + F.lit(ALPHA))


def unit_score(unit: Column, lexicon: Lexicon) -> Column:
    """struct(valence, polarity) of one text unit, inside the row.

    valence is the compound score in [-1, 1], polarity the mean of the matched
    words (0 without a match). The words are looked up once; what follows only
    touches the few that were found.
    """
    entries = list(dict.fromkeys([*lexicon.valence, *lexicon.polarity]))
    number = {word: i for i, word in enumerate(entries)}
    valences = number_list(lexicon.valence.get(w, 0) for w in entries)
    polarities = number_list(lexicon.polarity.get(w, 0) for w in entries)
    rated = number_list(int(w in lexicon.polarity) for w in entries)

    def totals(read: Column) -> Column:
        numbered = F.transform(read["words"], lambda w, i: F.struct(i.alias("i"), word_value(w, number).alias("e")))
        hits = F.filter(numbered, lambda hit: hit["e"].isNotNull())

        def add(acc: Column, hit: Column) -> Column:
            boost, factor = _modifiers(read, hit["i"], lexicon)
            valence = F.get(valences, hit["e"])
            if lexicon.idioms:
                valence = F.when(_is_free(read, hit["i"], lexicon), valence).otherwise(0)
            return F.struct(
                (acc["raw"] + _raw(valence, boost, factor)).alias("raw"),
                (acc["total"] + F.get(polarities, hit["e"])).alias("total"),
                (acc["n"] + F.get(rated, hit["e"])).alias("n"),
            )

        start = F.struct(_idiom_raw(read, lexicon).alias("raw"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("n"))
        return F.aggregate(hits, start, add)

    def finish(t: Column) -> Column:
        polarity = F.when(t["n"] > 0, t["total"] / (t["n"] * 1000.0)).otherwise(0.0)
        return F.struct(_compound(t["raw"], cues.count_char(unit, "!")).alias("valence"), polarity.alias("polarity"))

    return text.bind(text.bind(_reading(unit, lexicon), totals), finish)


def unit_scores(units: DataFrame, lexicon: Lexicon = resources.DEFAULT_LEXICON) -> DataFrame:
    """units(review_id, unit_idx, unit) -> (review_id, unit_idx, valence, polarity)"""
    scored = units.select("review_id", "unit_idx", unit_score(F.col("unit"), lexicon).alias("s"))
    return scored.select("review_id", "unit_idx", "s.valence", "s.polarity")


def valence_score(units: DataFrame, lexicon: Lexicon = resources.DEFAULT_LEXICON) -> DataFrame:
    return unit_scores(units, lexicon).drop("polarity")


def polarity_score(units: DataFrame, lexicon: Lexicon = resources.DEFAULT_LEXICON) -> DataFrame:
    return unit_scores(units, lexicon).drop("valence")


def one_entry_per_word(entries: DataFrame) -> DataFrame:
    """entries(token, valence_milli, polarity_milli) with each word once; of repeated ones the largest values count."""
    return entries.groupBy("token").agg(F.max("valence_milli").alias("valence_milli"), F.max("polarity_milli").alias("polarity_milli"))


def unit_scores_joined(units: DataFrame, entries: DataFrame, modifiers: Lexicon) -> DataFrame:
    """unit_scores for a lexicon table entries(token, valence_milli, polarity_milli) of any size."""
    keyed = units.select(F.monotonically_increasing_id().alias("_row"), "review_id", "unit_idx", "unit")
    scored = _unit_scores_joined(keyed, one_entry_per_word(entries), modifiers, ["review_id", "unit_idx"], ["_row"])
    return scored.select("review_id", "unit_idx", "valence", "polarity")


def _unit_scores_joined(units: DataFrame, entries: DataFrame, modifiers: Lexicon, carried: list[str], keys: list[str]) -> DataFrame:
    """valence and polarity per `keys`, with the carried columns, which are the same for all rows of a key.

    One row per word is joined with the table. The words of a unit come from one
    input row, so the sums are formed before the shuffle. They are sums of whole
    numbers, so both ways of scoring give the same bits.
    """

    def with_modifiers(read: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            boost, factor = _modifiers(read, i, modifiers)
            free = _is_free(read, i, modifiers)
            return F.struct(i.alias("i"), word.alias("token"), boost.alias("boost"), factor.alias("factor"), free.alias("free"))

        return F.struct(_idiom_raw(read, modifiers).alias("idiom_raw"), F.transform(read["words"], one).alias("all"))

    exploded = units.select(
        *keys,
        *carried,
        cues.count_char(F.col("unit"), "!").alias("exclamations"),
        text.bind(_reading(F.col("unit"), modifiers), with_modifiers).alias("read"),
    ).select(*keys, *carried, "exclamations", "read.idiom_raw", F.explode_outer("read.all").alias("word"))
    exploded = exploded.select(*keys, *carried, "exclamations", "idiom_raw", "word.*")
    joined = lookup_join(exploded, entries, ["token"], [*keys, "i"], "left")
    raw = F.when(F.col("free"), _raw(F.col("valence_milli"), F.col("boost"), F.col("factor")))
    sums = joined.groupBy(*keys).agg(
        (F.coalesce(F.sum(raw), F.lit(0).cast("bigint")) + F.max("idiom_raw")).alias("raw"),
        F.sum("polarity_milli").alias("total"),
        F.count("polarity_milli").alias("matched"),
        F.max("exclamations").alias("exclamations"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carried],
    )
    return sums.select(
        *keys,
        *carried,
        _compound(F.col("raw"), F.col("exclamations")).alias("valence"),
        F.when(F.col("matched") > 0, F.col("total") / (F.col("matched") * 1000.0)).otherwise(0.0).alias("polarity"),
    )


def rule_aggregate(scores: DataFrame) -> DataFrame:
    """unit scores -> mean valence, polarity and their mid value per review, added up in the order of the text."""
    ordered = F.array_sort(F.collect_list(F.struct("unit_idx", "valence", "polarity")))
    per_review = scores.groupBy("review_id").agg(ordered.alias("_units"))
    return _means(per_review).select("review_id", "valence_score", "polarity_score", "rule_polarity")


def rule_label(df: DataFrame, cutoff: float = resources.RULE_CUTOFF) -> DataFrame:
    polarity = F.col("rule_polarity")
    return df.withColumns(
        {
            "rule_score": labels.rule_score(polarity, cutoff),
            "rule_label": labels.rule_label(polarity, cutoff),
        }
    )


def inlined(entries: DataFrame, modifiers: Lexicon | None = None, max_inline: int = MAX_INLINE) -> Lexicon | None:
    """A lexicon table as a value of the plan, or None when it has more than `max_inline` words."""
    rules = modifiers or Lexicon({}, {})
    rows = inline_or_none(one_entry_per_word(entries), max_inline)
    if rows is None:
        return None
    return replace(
        rules,
        valence={r["token"]: r["valence_milli"] for r in rows if r["valence_milli"] is not None},
        polarity={r["token"]: r["polarity_milli"] for r in rows if r["polarity_milli"] is not None},
    )


def rule_sentiment(reviews: DataFrame, lexicon: Lexicon | DataFrame = resources.DEFAULT_LEXICON,
                   modifiers: Lexicon | None = None, max_inline: int = MAX_INLINE) -> DataFrame:
    """One row per row of reviews, also when no word matches."""
    return add_rule(reviews.select("review_id", "text"), lexicon, modifiers=modifiers, max_inline=max_inline).drop("text")


def _means(df: DataFrame) -> DataFrame:
    """Means over `_units`, an array of (valence, polarity) in the order of the text."""

    def mean(pick: Callable[[Column], Column]) -> Column:
        return F.aggregate("_units", F.lit(0.0), lambda acc, u: acc + pick(u)) / F.size("_units")

    return df.withColumns(
        {
            "valence_score": mean(lambda u: u["valence"]),
            "polarity_score": mean(lambda u: u["polarity"]),
            "rule_polarity": mean(lambda u: (u["valence"] + u["polarity"]) / 2),
        }
    )


def _with_means(df: DataFrame, cutoff: float) -> DataFrame:
    return rule_label(_means(df).drop("_units"), cutoff)


def add_rule(reviews: DataFrame, lexicon: Lexicon | DataFrame = resources.DEFAULT_LEXICON, cutoff: float = resources.RULE_CUTOFF,
             modifiers: Lexicon | None = None, max_inline: int = MAX_INLINE) -> DataFrame:
    """Add the rule columns to reviews(…, text).

    With an inlined lexicon every review is scored inside its row: no shuffle at all. A
    lexicon table beyond `max_inline` words is joined instead, with the same answers;
    rows keep their identity, whether their review_id repeats or not.
    """
    if isinstance(lexicon, DataFrame):
        value = inlined(lexicon, modifiers, max_inline)
        if value is None:
            return _add_rule_joined(reviews, one_entry_per_word(lexicon), modifiers or Lexicon({}, {}), cutoff)
        lexicon = value
    units = F.transform(text.scoring_units("text"), lambda u: unit_score(u, lexicon))
    return _with_means(reviews.withColumn("_units", units), cutoff)


def _add_rule_joined(reviews: DataFrame, entries: DataFrame, modifiers: Lexicon, cutoff: float) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in reviews.columns])
    rows = reviews.select(F.monotonically_increasing_id().alias("_row"), whole.alias("_whole"), text.scoring_units("text").alias("_texts"))
    units = rows.select("_row", "_whole", F.posexplode("_texts").alias("unit_idx", "unit"))
    # The row itself travels with its first unit only.
    units = units.withColumn("_whole", F.when(F.col("unit_idx") == 0, F.col("_whole")))
    scored = _unit_scores_joined(units, entries, modifiers, ["_whole"], ["_row", "unit_idx"])
    ordered = F.array_sort(F.collect_list(F.struct("unit_idx", "valence", "polarity")))
    per_row = scored.groupBy("_row").agg(F.first("_whole", ignorenulls=True).alias("_whole"), ordered.alias("_units"))
    return _with_means(per_row.select("_whole.*", "_units"), cutoff)

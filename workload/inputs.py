"""Review sets and score tables derived from the given tables, in Spark and in SQL.

The prose tables hold invented words, so their dictionaries are made of frequent
pieces of that prose. Real English opinions come from sentence fragments chosen
by the order key. Classifier scores are whole-number arithmetic on the keys, so
that both engines get the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionloom import resources
from opinionloom.functions import text as text_functions
from opinionloom.operators import aspects as absa
from opinionloom.operators import shaping
from opinionloom.resources import Lexicon
from opinionloom.session import scratch, shared_root
from opinionloom.sources.reviews import read_reviews

OPENERS = [
    "The food was amazing, but the waiter was rude.",
    "Great atmosphere and friendly staff!",
    "The burgers were juicy. The fries were cold.",
    "Oh great, another long wait!!!",
    "The dish was fine and the dishes came hot.",
    "Service was adequate.",
    "Not a bad place for lunch",
    "I can't recommend the pasta. It was very bland.",
    "Wonderful service?",
    "The price is fair, the portions are generous.",
    "They measure the butter by hand, which is clearly special.",
    "Meh.",
    "Café décor is lovely – truly lovely.",
]
MIDDLES = [
    "",
    "The waitress and the waitresses were polite, but the check was slow.",
    "You get what you pay for.",
    "However, the music was too loud!",
    "The sandwich was extremely tasty, but the soup was salty, but nobody cared.",
    "We waited 45 minutes for a table.",
    "The sauce reminds me of.*if.*lost recipes.",
    "Not great, not terrible.",
    "The chef tries really hard; the sauces are hardly fresh.",
    "The food was good but the food was also cold.",
    "So glad we came!! Never again!!",
]
CLOSERS = [
    "",
    "Highly recommend.",
    "Is that perfect? Perfect?",
    "Unfortunately the bill was wrong.",
    "Overall a nice experience!",
    "👍 5/5",
    "The dish is certainly present",
]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(quoted(x) for x in items) + "]"


def pick(items: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), index.cast("int") + 1)


def div(value: Column, by: int) -> Column:
    return F.floor(value / by)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_STORED: set[str] = set()


def session_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """One fresh folder per session, input directory and name."""
    key = (spark.sparkContext.applicationId, shared_root(spark), str(sf_dir), name)
    if key not in _FOLDERS:
        _FOLDERS[key] = scratch(spark, name)
    return _FOLDERS[key]


_FOLDERS: dict[tuple[str, str, str, str], str] = {}


def stored(build: Callable[[SparkSession, str], DataFrame], deal: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """Write the derived table to the shared folder on first use and read it from there.

    Reviews and classifier scores are stored tables in practice: the queries should
    scan and prune columns, not derive their input again at every use.
    """

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = session_folder(spark, sf_dir, build.__name__)
        if path in _STORED:
            try:
                return spark.read.parquet(path)
            except AnalysisException:  # the folder was cleaned up since
                pass
        derived = build(spark, sf_dir)
        if deal:
            derived = derived.repartition(spark.sparkContext.defaultParallelism, "review_id")
        derived.write.mode("overwrite").parquet(path)
        _STORED.add(path)
        return spark.read.parquet(path)

    read.__name__ = build.__name__
    read.__doc__ = build.__doc__
    return read


def stored_in_place(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The same for rows made of a table that is dealt out over the cores already: they are written where they are made."""
    return stored(build, deal=False)


def spread_table(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """A given table over all cores; each is one file of one row group here."""
    return load(spark, sf_dir, table).repartition(spark.sparkContext.defaultParallelism, key)


# --- review sets -----------------------------------------------------------------------------


#: Documents in one task, so that what is sorted or grouped there fits its memory whatever the size of the table.
TASK_DOCUMENTS = 4000


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    tasks = max(spark.sparkContext.defaultParallelism, -(-documents.count() // TASK_DOCUMENTS))
    return read_reviews(documents, "doc_id", "text", partitions=tasks)


PROSE = "prose AS (SELECT doc_id AS review_id, text FROM documents)"


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("review_id"), "text")


DIALOGUE = (
    "dialogue AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS review_id, text "
    "FROM conversations WHERE role = 'user')"
)


def opinion_text(key: Column) -> Column:
    body = F.concat_ws(
        " ", pick(OPENERS, key % 13), pick(MIDDLES, div(key, 13) % 11), pick(CLOSERS, div(key, 143) % 7)
    )
    return F.when(key % 97 == 5, F.lit(None)).when(key % 89 == 7, F.lit("  \n ")).otherwise(body)


@stored_in_place
def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One English review per order; some texts are NULL or blank."""
    orders = spread_table(spark, sf_dir, "orders", "o_orderkey")
    return orders.select(F.col("o_orderkey").alias("review_id"), opinion_text(F.col("o_orderkey")).alias("text"))


OPINIONS = f"""opinions AS (
  SELECT o_orderkey AS review_id,
         CASE WHEN o_orderkey % 97 = 5 THEN NULL
              WHEN o_orderkey % 89 = 7 THEN E'  \\n '
              ELSE concat_ws(' ', list_extract({sql_list(OPENERS)}, o_orderkey % 13 + 1),
                                  list_extract({sql_list(MIDDLES)}, o_orderkey // 13 % 11 + 1),
                                  list_extract({sql_list(CLOSERS)}, o_orderkey // 143 % 7 + 1)) END AS text
  FROM orders)"""


# --- dictionaries of the prose ------------------------------------------------------------------

PROSE_LEXICON = Lexicon(
    valence={"tion": 2000, "ing": 1500, "ther": 1000, "thon": 500, "ble": -2000, "ou": -1500, "wh": -1000, "sh": -500,
             "de": 700, "und": -900, "que": 1200},
    polarity={"tion": 600, "ing": 400, "the": 50, "ble": -500, "ou": -300, "la": 100, "der": -100},
    boosters={"with": 293, "from": -293, "en": 293},
    negators=("is", "was"),
)
PROSE_ASPECTS = ["the", "thes", "thth", "anea", "erin", "thed", "thre", "than", "of the"]
PROSE_POS = {"the": shaping.ADJECTIVE, "of": shaping.ADJECTIVE, "de": shaping.ADJECTIVE, "and": shaping.NOUN,
             "to": shaping.NOUN, "la": shaping.NOUN, "in": shaping.NOUN, "der": shaping.ADJECTIVE, "die": shaping.NOUN}


def lexicon_sql(lexicon: Lexicon) -> str:
    def values(d) -> str:
        return ", ".join(f"({quoted(w)}, {v})" for w, v in d.items())

    negators = ", ".join(f"({quoted(w)})" for w in lexicon.negators)
    return (
        f"val(w, v) AS (VALUES {values(lexicon.valence)}), pol(w, p) AS (VALUES {values(lexicon.polarity)}), "
        f"boost(w, b) AS (VALUES {values(lexicon.boosters)}), neg(w) AS (VALUES {negators})"
    )


# --- SQL building blocks ------------------------------------------------------------------------

SPACES_SQL = quoted(text_functions.SPACES)
_WS = text_functions._WS
WORD_SQL = quoted(text_functions.WORD)
TOKEN_SQL = quoted(text_functions.TOKEN)


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {SPACES_SQL})"


def blank_sql(expr: str) -> str:
    return f"coalesce({strip_sql(expr)} = '', true)"


def sentence_list_sql(expr: str) -> str:
    """List of sentences; NULL text gives an empty list."""
    marked = f"regexp_replace({strip_sql(expr)}, {quoted('([.!?])' + _WS + '+')}, '\\1' || chr(1), 'g')"
    return f"coalesce(list_filter(string_split({marked}, chr(1)), lambda s: s <> ''), []::VARCHAR[])"


def two_words_sql(expr: str) -> str:
    return f"len(list_filter(string_split_regex({expr}, {quoted(_WS + '+')}), lambda w: w <> '')) >= 2"


def sentences_sql(source: str) -> str:
    """sent(review_id, sent_idx, sentence)"""
    return f"""sent_lists AS (SELECT review_id, {sentence_list_sql('text')} AS l FROM {source}),
sent AS (SELECT review_id, unnest(l) AS sentence, (generate_subscripts(l, 1) - 1)::INT AS sent_idx FROM sent_lists)"""


def units_sql(source: str) -> str:
    """units(review_id, unit_idx, unit): sentences of two words, or the whole text"""
    return f"""unit_lists AS (
  SELECT review_id, coalesce(text, '') AS text,
         list_filter({sentence_list_sql('text')}, lambda s: {two_words_sql('s')}) AS l FROM {source}),
unit_lists2 AS (SELECT review_id, CASE WHEN len(l) = 0 THEN [text] ELSE l END AS l FROM unit_lists),
units AS (SELECT review_id, unnest(l) AS unit, (generate_subscripts(l, 1) - 1)::INT AS unit_idx FROM unit_lists2)"""


def unit_scores_sql(lexicon: Lexicon) -> str:
    """unit_scores(review_id, unit_idx, valence, polarity) from units"""
    return f"""{lexicon_sql(lexicon)},
word_lists AS (SELECT review_id, unit_idx, unit, regexp_extract_all(lower(unit), {WORD_SQL}) AS l FROM units),
words AS (SELECT review_id, unit_idx, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM word_lists),
marked AS (
  SELECT words.*, v, p, coalesce(b, 0) AS b,
         CASE WHEN neg.w IS NOT NULL OR words.w LIKE '%n''t' THEN 1 ELSE 0 END AS n
  FROM words LEFT JOIN val ON words.w = val.w LEFT JOIN pol ON words.w = pol.w
             LEFT JOIN boost ON words.w = boost.w LEFT JOIN neg ON words.w = neg.w),
near AS (
  SELECT *, coalesce(lag(b, 1) OVER o, 0) * 100 + coalesce(lag(b, 2) OVER o, 0) * 95
            + coalesce(lag(b, 3) OVER o, 0) * 90 AS boosted,
         greatest(coalesce(lag(n, 1) OVER o, 0), coalesce(lag(n, 2) OVER o, 0), coalesce(lag(n, 3) OVER o, 0)) AS negated
  FROM marked WINDOW o AS (PARTITION BY review_id, unit_idx ORDER BY i)),
sums AS (
  SELECT review_id, unit_idx,
         sum((v * 100 + CASE WHEN v > 0 THEN boosted ELSE -boosted END) * CASE WHEN negated = 1 THEN -74 ELSE 100 END) AS raw,
         avg(p) / 1000.0 AS polarity
  FROM near GROUP BY review_id, unit_idx),
emphasised AS (
  SELECT w.review_id, w.unit_idx, coalesce(polarity, 0.0) AS polarity,
         (coalesce(raw, 0) + sign(coalesce(raw, 0)) * least(4, length(unit) - length(replace(unit, '!', ''))) * 2920000)
           / 10000000.0 AS s
  FROM word_lists w LEFT JOIN sums USING (review_id, unit_idx)),
unit_scores AS (
  SELECT review_id, unit_idx, (s / sqrt(s * s + 15.0))::DOUBLE AS valence, polarity::DOUBLE AS polarity FROM emphasised)"""


RULE_SQL = """rule AS (
  SELECT review_id, avg(valence) AS valence_score, avg(polarity) AS polarity_score,
         avg((valence + polarity) / 2) AS rule_polarity
  FROM unit_scores GROUP BY review_id)"""


def aspects_sql(source: str, aspects: list[str]) -> str:
    """found, kept, and listed(review_id, aspect_idx, aspect) of single-word and two-word dictionaries"""
    entries = ", ".join(f"({quoted(a)})" for a in dict.fromkeys(aspects))
    return f"""dictionary(aspect) AS (VALUES {entries}),
{sentences_sql(source)},
aspect_tokens AS (SELECT review_id, sent_idx, regexp_extract_all(lower(sentence), {TOKEN_SQL}) AS l FROM sent),
aspect_words AS (SELECT review_id, sent_idx, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM aspect_tokens),
grams AS (
  SELECT review_id, w AS phrase FROM aspect_words
  UNION ALL
  SELECT review_id, w || ' ' || lead(w) OVER (PARTITION BY review_id, sent_idx ORDER BY i) FROM aspect_words),
found AS (SELECT DISTINCT review_id, phrase AS aspect FROM grams JOIN dictionary ON phrase = aspect),
kept AS (
  SELECT review_id, aspect FROM found f
  WHERE NOT EXISTS (SELECT 1 FROM found p WHERE p.review_id = f.review_id AND p.aspect = f.aspect || 's')
    AND NOT (regexp_matches(f.aspect, '(sh|ch|s|x|z)$')
             AND EXISTS (SELECT 1 FROM found p WHERE p.review_id = f.review_id AND p.aspect = f.aspect || 'es'))),
listed AS (
  SELECT review_id, aspect, (row_number() OVER (PARTITION BY review_id ORDER BY aspect) - 1)::INT AS aspect_idx
  FROM (SELECT * FROM kept
        UNION ALL
        SELECT review_id, 'overall' FROM {source} WHERE review_id NOT IN (SELECT review_id FROM kept)))"""


# --- score tables --------------------------------------------------------------------------------


def level(n: Column) -> Column:
    """Whole number -> one of 0.0, 0.1 .. 1.0, so that ties happen."""
    return (F.floor((n % 101) / 10) / 10.0).cast("double")


def level_sql(n: str) -> str:
    return f"(({n}) % 101 // 10)::DOUBLE / 10"


TWO_WAY = "siebert/sentiment-roberta-large-english"
REVERSED = "dnzblgn/Sentiment-Analysis-Customer-Reviews"
FIVE_WAY = "pig4431/YELP_roBERTa_5E"
UNLISTED = "example/unlisted"
CLASSES: list[tuple[str, int, str | None]] = [
    (TWO_WAY, 0, "LABEL_0"), (TWO_WAY, 1, "LABEL_1"),
    (REVERSED, 0, "LABEL_0"), (REVERSED, 1, "label_1"),
    (FIVE_WAY, 0, "Very Negative"), (FIVE_WAY, 1, "LABEL_1"), (FIVE_WAY, 2, "2"), (FIVE_WAY, 3, "pos"),
    (FIVE_WAY, 4, "very_positive"),
    (UNLISTED, 0, "LABEL_x"), (UNLISTED, 1, "mixed"), (UNLISTED, 2, None), (UNLISTED, 3, "Neg"),
]
MODELS = [TWO_WAY, REVERSED, FIVE_WAY, UNLISTED]


@stored_in_place
def sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of four models for every order that is not pending (status P has none)."""
    key = F.col("o_orderkey")
    classes = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(p).alias("pos"), F.lit(label).cast("string").alias("label"))
            for m, p, label in CLASSES
        ]
    )
    rows = (
        spread_table(spark, sf_dir, "orders", "o_orderkey")
        .where(F.col("o_orderstatus") != "P")
        .select(key.alias("review_id"), F.lit(0).alias("unit_id"), F.explode(classes).alias("c"))
        .select("review_id", "unit_id", "c.*")
    )
    k, p = F.col("review_id"), F.col("pos")
    score = F.when((k + p) % 29 != 0, level(k * 31 + p * 17 + F.length("model") * 7))
    return rows.withColumn("score", score)


def _class_values() -> str:
    return ", ".join(f"({quoted(m)}, {p}, {'NULL' if x is None else quoted(x)})" for m, p, x in CLASSES)


SENTIMENT_SCORES = f"""classes(model, pos, label) AS (VALUES {_class_values()}),
scores AS (
  SELECT o_orderkey AS review_id, 0 AS unit_id, model, pos, label,
         CASE WHEN (o_orderkey + pos) % 29 <> 0
              THEN {level_sql('o_orderkey * 31 + pos * 17 + length(model) * 7')} END AS score
  FROM orders, classes WHERE o_orderstatus <> 'P'),
best AS (
  SELECT review_id, unit_id, model, label, score
  FROM (SELECT *, row_number() OVER (PARTITION BY review_id, unit_id, model
                                     ORDER BY coalesce(score, 0) DESC, pos) AS rn FROM scores)
  WHERE rn = 1)"""

_MAP_VALUES = ", ".join(
    f"({quoted(m)}, {i}, {quoted(x)})" for m, (classes, _, _) in resources.MODELS.items() for i, x in enumerate(classes)
)
NORMALIZED = f"""label_map(model, idx, mapped) AS (VALUES {_MAP_VALUES}),
indexed AS (
  SELECT *, TRY_CAST(regexp_extract(label, '(?i)^(?:label_)?\\s*([+-]?\\d+)\\s*$', 1) AS INT) AS n FROM best),
normalized AS (
  SELECT i.review_id, i.unit_id, i.model, i.label, i.score,
         CASE WHEN i.label IS NULL THEN 'neutral'
              WHEN n IS NOT NULL THEN coalesce(mapped, 'neutral')
              WHEN lower(i.label) IN ('pos', 'positive', 'pos_sentiment') THEN 'positive'
              WHEN lower(i.label) IN ('neg', 'negative', 'neg_sentiment') THEN 'negative'
              WHEN lower(i.label) IN ('neu', 'neutral', 'neu_sentiment') THEN 'neutral'
              WHEN lower(i.label) IN ('very positive', 'very_positive') THEN 'very_positive'
              WHEN lower(i.label) IN ('very negative', 'very_negative') THEN 'very_negative'
              ELSE lower(i.label) END AS text_label,
         CASE WHEN i.label IS NULL THEN 0.3 WHEN n IS NOT NULL THEN 1.0
              WHEN upper(i.label) LIKE 'LABEL#_%' ESCAPE '#' THEN 0.5 ELSE 1.0 END::DOUBLE AS mapping_conf
  FROM indexed i LEFT JOIN label_map m ON i.model = m.model AND i.n = m.idx)"""


def sentiment_sql(model: str) -> str:
    """sentiment(review_id, sentiment, confidence) of one model, for all opinions"""
    usable = f"NOT {blank_sql('text')} AND score IS NOT NULL"
    return f"""sentiment AS (
  SELECT o.review_id,
         CASE WHEN {usable} THEN CASE WHEN text_label IN ('positive', 'very_positive') THEN 1
                                      WHEN text_label IN ('negative', 'very_negative') THEN -1 ELSE 0 END
              ELSE 0 END::INT AS sentiment,
         CASE WHEN {usable} THEN score * mapping_conf ELSE 0.0 END::DOUBLE AS confidence
  FROM opinions o LEFT JOIN (SELECT * FROM normalized WHERE model = {quoted(model)}) n ON o.review_id = n.review_id)"""


ASPECT_LABELS = [
    ["LABEL_0", "LABEL_1", "LABEL_2"],
    ["Negative", "Neutral", "Positive"],
    ["label_2", "LABEL_7", "negative"],
    ["", "mixed", "positive"],
]


@stored_in_place
def opinion_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, text, aspect) of all opinions with text."""
    reviews = opinions(spark, sf_dir).where(~text_functions.is_blank("text"))
    found = reviews.withColumn("found", absa.aspect_array())
    kept = absa.aspects_or_overall(absa.without_singulars(F.col("found")))
    return found.select("review_id", "text", F.explode(kept).alias("aspect"))


@stored_in_place
def aspect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, pos = F.col("review_id"), F.col("pos")
    names = F.array(*[F.array(*[F.lit(x) for x in row]) for row in ASPECT_LABELS])
    rows = opinion_aspects(spark, sf_dir).select("review_id", "aspect", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    label = F.get(F.get(names, (key % 4).cast("int")), pos)
    score = F.when((key + pos) % 23 != 0, level(key * 31 + pos * 17 + F.length("aspect") * 7))
    return rows.select("review_id", "aspect", "pos", label.alias("label"), score.alias("score"))


OPINION_ASPECTS = f"""{OPINIONS},
worded AS (SELECT * FROM opinions WHERE NOT {blank_sql('text')}),
{aspects_sql('worded', resources.ASPECTS)}"""

ASPECT_SCORES = f"""{OPINION_ASPECTS},
aspect_scores AS (
  SELECT review_id, aspect, pos,
         list_extract(list_extract([{', '.join(sql_list(r) for r in ASPECT_LABELS)}], review_id % 4 + 1), pos + 1) AS label,
         CASE WHEN (review_id + pos) % 23 <> 0
              THEN {level_sql('review_id * 31 + pos * 17 + length(aspect) * 7')} END AS score
  FROM listed, (VALUES (0), (1), (2)) p(pos))"""


def aspect_sentiment_sql(source: str, keys: str, out: str) -> str:
    """Best label per unit of `source`, as label, signed score and confidence"""
    return f"""{out}_best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(score, 0) DESC, pos) AS rn
                 FROM {source}) WHERE rn = 1),
{out}_named AS (
  SELECT *, CASE WHEN score IS NULL OR label IS NULL THEN 'neutral'
                 WHEN upper(label) = 'LABEL_0' THEN 'negative' WHEN upper(label) = 'LABEL_2' THEN 'positive'
                 WHEN lower(label) IN ('positive', 'negative') THEN lower(label) ELSE 'neutral' END AS sentiment_label
  FROM {out}_best),
{out} AS (
  SELECT {keys}, label AS raw_label, sentiment_label, coalesce(score, 0.0) AS confidence,
         CASE sentiment_label WHEN 'positive' THEN coalesce(score, 0.0) WHEN 'negative' THEN -coalesce(score, 0.0)
              ELSE 0.0 END + 0.0 AS sentiment_score
  FROM {out}_named)"""


ASPECT_SENTIMENT = f"{ASPECT_SCORES},\n{aspect_sentiment_sql('aspect_scores', 'review_id, aspect', 'rated')}"


def context_sql(source: str, window: int) -> str:
    """contexts(review_id, aspect, context_phrase) of source(review_id, text, aspect)"""
    return f"""ctx_lists AS (
  SELECT review_id, regexp_extract_all(text, {TOKEN_SQL}) AS l FROM (SELECT DISTINCT review_id, text FROM {source})),
ctx_tokens AS (SELECT review_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM ctx_lists),
ctx_hits AS (
  SELECT s.review_id, s.aspect, k.i AS hit FROM {source} s JOIN ctx_tokens k USING (review_id)
  WHERE s.aspect <> '' AND contains(lower(k.t), lower(s.aspect))),
ctx_words AS (
  SELECT h.review_id, h.aspect, h.hit, k.i, k.t FROM ctx_hits h
  JOIN ctx_tokens k ON h.review_id = k.review_id AND k.i BETWEEN h.hit - {window} AND h.hit + {window}
  WHERE NOT regexp_full_match(k.t, '\\p{{P}}+')),
contexts AS (
  SELECT s.review_id, s.aspect, coalesce(c.context_phrase, '') AS context_phrase
  FROM {source} s LEFT JOIN (SELECT review_id, aspect, string_agg(t, ' ' ORDER BY hit, i) AS context_phrase
                             FROM ctx_words GROUP BY review_id, aspect) c
  ON s.review_id = c.review_id AND s.aspect = c.aspect)"""


DETAILS = f"""{ASPECT_SENTIMENT},
pairs AS (SELECT review_id, text, aspect FROM listed JOIN worded USING (review_id)),
{context_sql('pairs', resources.CONTEXT_WINDOW)},
details AS (SELECT review_id, aspect, sentiment_label, sentiment_score, confidence, context_phrase
            FROM rated JOIN contexts USING (review_id, aspect))"""


EMOTION_LABELS = ["sadness", "Joy", "love", "ANGER", "fear", "surprise", "disgust"]


@stored_in_place
def emotion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of 0.2 and more per clause of every opinion; one label is unknown."""
    clauses = shaping.emotion_clauses(opinions(spark, sf_dir))
    labels = F.array(*[F.lit(x) for x in EMOTION_LABELS])
    rows = clauses.select("review_id", "clause_idx", F.posexplode(labels).alias("pos", "label"))
    n = F.col("review_id") * 31 + F.col("clause_idx") * 13 + F.col("pos") * 17
    return rows.select("review_id", "clause_idx", "label", ((n % 101) / 100.0).alias("score")).where("score >= 0.2")


def clauses_sql(source: str) -> str:
    """clauses(review_id, clause_idx, clause)"""
    def strip_list(x):
        return f"list_filter(list_transform({x}, lambda q: {strip_sql('q')}), lambda q: q <> '')"

    after_but = "substr(p, strpos(p, ', but ') + 6)"
    before_but = "substr(p, 1, strpos(p, ', but ') - 1)"
    halves = f"CASE WHEN contains(p, ', but ') THEN {strip_list(f'[{before_but}, {after_but}]')} ELSE [p] END"
    return f"""clause_parts AS (
  SELECT review_id, {strip_sql('text')} AS whole, {sentence_list_sql('text')} AS s,
         {strip_list(f"string_split({strip_sql('text')}, '. ')")} AS parts FROM {source}),
clause_pieces AS (
  SELECT review_id, whole, s,
         list_filter(flatten(list_transform(parts, lambda p: {halves})), lambda q: {two_words_sql('q')}) AS pieces
  FROM clause_parts),
clause_lists AS (
  SELECT review_id, CASE WHEN coalesce(whole, '') = '' THEN [] WHEN len(s) > 1 THEN s
                         WHEN len(pieces) > 0 THEN pieces ELSE [whole] END AS l FROM clause_pieces),
clauses AS (SELECT review_id, unnest(l) AS clause, (generate_subscripts(l, 1) - 1)::INT AS clause_idx FROM clause_lists)"""


EMOTION_SCORES = f"""{OPINIONS},
{clauses_sql('opinions')},
emotion_scores AS (
  SELECT review_id, clause_idx, label, ((review_id * 31 + clause_idx * 13 + pos * 17) % 101)::DOUBLE / 100 AS score
  FROM clauses, (SELECT unnest({sql_list(EMOTION_LABELS)}) AS label, unnest(range({len(EMOTION_LABELS)})) AS pos)),
pooled AS (
  SELECT review_id, lower(label) AS label, max(score) AS score FROM emotion_scores
  WHERE score >= 0.2 AND lower(label) <> 'disgust' GROUP BY 1, 2),
emotion_labels AS (SELECT unnest({sql_list(resources.EMOTIONS)}) AS label, unnest(range(6)) AS label_pos),
filled AS (
  SELECT o.review_id, label_pos, l.label, coalesce(score, 0.0) AS score
  FROM opinions o CROSS JOIN emotion_labels l LEFT JOIN pooled p ON p.review_id = o.review_id AND p.label = l.label)"""

EMOTION_TOTALS = """emotion AS (
  SELECT review_id, sum(score) AS emotion_score, sum(score) / 6 AS emotion_confidence,
         CASE WHEN count(*) FILTER (score > 0.1) > 1
              THEN -sum(score / t * ln(score / t)) FILTER (score > 0.1) / ln(6) ELSE 0.0 END AS emotion_distribution
  FROM (SELECT *, sum(score) FILTER (score > 0.1) OVER (PARTITION BY review_id) AS t FROM filled) GROUP BY review_id)"""


SARCASM_LABELS = [["LABEL_0", "LABEL_1"], [" Sarcastic ", "Not Sarcastic"], ["NOT_SARCASTIC", "sarcastic"], ["ironic", "label_1"]]


@stored_in_place
def sarcasm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores per order that is not pending."""
    key = F.col("review_id")
    names = F.array(*[F.array(*[F.lit(x) for x in row]) for row in SARCASM_LABELS])
    rows = (
        spread_table(spark, sf_dir, "orders", "o_orderkey")
        .where(F.col("o_orderstatus") != "P")
        .select(F.col("o_orderkey").alias("review_id"), F.posexplode(F.array(F.lit(0), F.lit(1))).alias("pos", "_p"))
    )
    label = F.get(F.get(names, (key % 4).cast("int")), F.col("pos"))
    return rows.select("review_id", "pos", label.alias("label"), level(key * 13 + F.col("pos") * 37).alias("score"))


SARCASM_SCORES = f"""sarcasm_scores AS (
  SELECT o_orderkey AS review_id, pos,
         list_extract(list_extract([{', '.join(sql_list(r) for r in SARCASM_LABELS)}], o_orderkey % 4 + 1), pos + 1) AS label,
         {level_sql('o_orderkey * 13 + pos * 37')} AS score
  FROM orders, (VALUES (0), (1)) p(pos) WHERE o_orderstatus <> 'P'),
sarcasm_best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY score DESC, pos) AS rn FROM sarcasm_scores)
  WHERE rn = 1),
sarcasm AS (
  SELECT o.o_orderkey AS review_id,
         CASE WHEN upper(trim(label)) IN ('LABEL_1', 'SARCASTIC') THEN 'sarcastic' ELSE 'not_sarcastic' END AS sarcasm_label,
         CASE WHEN upper(trim(label)) IN ('LABEL_1', 'SARCASTIC') THEN 1 ELSE 0 END::INT AS sarcasm_score,
         coalesce(score, 0.0) AS sarcasm_confidence
  FROM orders o LEFT JOIN sarcasm_best b ON o.o_orderkey = b.review_id)"""


# --- results and labelled rows -----------------------------------------------------------------


def fused_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, fused_label, fused_confidence) of every order."""
    status = F.col("o_orderstatus")
    label = F.when(status == "F", "positive").when(status == "O", "negative").otherwise("neutral")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("review_id"),
        label.alias("fused_label"),
        ((F.col("o_orderkey") * 37 % 101) / 100.0).alias("fused_confidence"),
    )


FUSED = """fused AS (
  SELECT o_orderkey AS review_id,
         CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'negative' ELSE 'neutral' END AS fused_label,
         (o_orderkey * 37 % 101)::DOUBLE / 100 AS fused_confidence
  FROM orders)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, text, label) of the documents with a quality label; toxic ones are negative."""
    marks = load(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    rows = marks.select(F.col("doc_id").alias("review_id"), label.alias("label"))
    return prose(spark, sf_dir).join(rows, "review_id")


LABELLED = """labelled AS (
  SELECT doc_id AS review_id, text,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label
  FROM documents JOIN labels USING (doc_id))"""

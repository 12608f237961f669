"""Aspect-based sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinionloom.operators import aspects as absa
from opinionloom.operators import shaping

from . import inputs as I
from .registry import query, rounded
from .text_queries import CLAUSES_OF_ASPECT

_PROSE_FOUND = f"{I.PROSE}, {I.aspects_sql('prose', I.PROSE_ASPECTS)}"


@query(f"WITH {_PROSE_FOUND} SELECT review_id, aspect FROM found")
def extract_aspects(spark, sf_dir):
    return absa.extract_aspects(I.prose(spark, sf_dir), I.PROSE_ASPECTS)


@query(f"WITH {_PROSE_FOUND} SELECT review_id, aspect FROM found")
def extract_aspects_joined(spark, sf_dir):
    """The dictionary as a table that is joined instead of travelling in the plan."""
    table = spark.createDataFrame([(a,) for a in I.PROSE_ASPECTS], "aspect string")
    return absa.extract_aspects(I.prose(spark, sf_dir), table, max_inline=0)


@query(f"WITH {_PROSE_FOUND} SELECT review_id, aspect FROM kept")
def prefer_plural(spark, sf_dir):
    return absa.prefer_plural(I.prose(spark, sf_dir), I.PROSE_ASPECTS)


@query(f"WITH {_PROSE_FOUND} SELECT review_id, aspect_idx, aspect FROM listed")
def default_overall(spark, sf_dir):
    return absa.default_overall(I.prose(spark, sf_dir), I.PROSE_ASPECTS)


@query(f"""WITH {I.OPINION_ASPECTS}
SELECT review_id, aspect, {I.strip_sql('text')} || ' [SEP] ' || aspect AS unit FROM listed JOIN worded USING (review_id)""")
def aspect_units(spark, sf_dir):
    return absa.aspect_units(I.opinions(spark, sf_dir))


@query(f"WITH {I.ASPECT_SENTIMENT} SELECT review_id, aspect, sentiment_label, sentiment_score, confidence, raw_label FROM rated")
def aspect_sentiment(spark, sf_dir):
    return absa.aspect_sentiment(I.aspect_scores(spark, sf_dir))


@query(f"""WITH {I.OPINION_ASPECTS}, pairs AS (SELECT review_id, text, aspect FROM listed JOIN worded USING (review_id)),
{I.context_sql('pairs', 10)} SELECT review_id, aspect, context_phrase FROM contexts""")
def aspect_context(spark, sf_dir):
    return absa.aspect_context(I.opinion_aspects(spark, sf_dir)).select("review_id", "aspect", "context_phrase")


@query(f"""WITH {_PROSE_FOUND}, pairs AS (SELECT review_id, text, aspect FROM listed JOIN prose USING (review_id)),
{I.context_sql('pairs', 3)} SELECT review_id, aspect, context_phrase FROM contexts""")
def prose_aspect_context(spark, sf_dir):
    """Contexts of frequent words in whole prose texts."""
    listed = I.prose(spark, sf_dir).withColumn("found", absa.aspect_array(I.PROSE_ASPECTS))
    kept = absa.aspects_or_overall(absa.without_singulars(F.col("found")))
    pairs = listed.select("review_id", "text", F.explode(kept).alias("aspect"))
    return absa.aspect_context(pairs, 3).select("review_id", "aspect", "context_phrase")


ROLLUP = """absa AS (
  SELECT o.review_id, count(*) FILTER (sentiment_label = 'positive') AS num_pos_aspects,
         count(*) FILTER (sentiment_label = 'negative') AS num_neg_aspects,
         coalesce(avg(sentiment_score), 0.0) AS avg_aspect_score, coalesce(avg(confidence), 0.0) AS avg_aspect_confidence
  FROM opinions o LEFT JOIN rated USING (review_id) GROUP BY o.review_id)"""


@query(f"""WITH {I.ASPECT_SENTIMENT}, {ROLLUP}
SELECT review_id, num_pos_aspects, num_neg_aspects, round(avg_aspect_score, 9) AS avg_aspect_score,
       round(avg_aspect_confidence, 9) AS avg_aspect_confidence FROM absa""")
def absa_rollup(spark, sf_dir):
    details = absa.aspect_sentiment(I.aspect_scores(spark, sf_dir))
    return rounded(absa.absa_rollup(I.opinions(spark, sf_dir), details))


CATEGORY_WORDS = ["Food", "service", "fries", "dishes", "WAITER", "table", "bill", "price", "experience", "soup"]


def categories(spark, sf_dir):
    """One category per part; its aspect is chosen by the part key, its industry is the part size."""
    key = F.col("p_partkey")
    return I.load(spark, sf_dir, "part").select(
        key.cast("int").alias("category_id"), F.col("p_type").alias("category"),
        I.pick(CATEGORY_WORDS, key % len(CATEGORY_WORDS)).alias("aspect"), F.col("p_size").alias("industry_id"),
    )


CATEGORIES = f"""categories AS (
  SELECT p_partkey::INT AS category_id, p_type AS category,
         list_extract({I.sql_list(CATEGORY_WORDS)}, p_partkey % {len(CATEGORY_WORDS)} + 1) AS aspect, p_size AS industry_id
  FROM part)"""


@query(f"""WITH {I.ASPECT_SENTIMENT}, {CATEGORIES},
ids AS (SELECT lower(aspect) AS a, max(category_id) AS category_id FROM categories GROUP BY 1)
SELECT review_id, category_id, aspect AS span_text, sentiment_label AS aspect_sentiment, sentiment_score AS aspect_confidence, confidence
FROM rated JOIN ids ON lower(aspect) = a""")
def map_categories(spark, sf_dir):
    details = absa.aspect_sentiment(I.aspect_scores(spark, sf_dir))
    return absa.map_categories(details, categories(spark, sf_dir))


@query(f"""WITH {I.ASPECT_SENTIMENT}, {CATEGORIES}
SELECT aspect, count(*) AS n_rows FROM rated WHERE aspect NOT IN (SELECT lower(aspect) FROM categories) GROUP BY aspect""")
def unmapped_aspects(spark, sf_dir):
    details = absa.aspect_sentiment(I.aspect_scores(spark, sf_dir))
    return absa.unmapped_aspects(details, categories(spark, sf_dir))


def _clause_scores(clauses):
    k, c, p = F.col("review_id"), F.col("clause_idx"), F.col("pos")
    rows = clauses.select("review_id", "aspect", "clause_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos"))
    label = F.concat(F.lit("LABEL_"), p.cast("string"))
    score = F.when((k + c) % 19 != 0, I.level(k * 31 + p * 17 + c * 41))
    return rows.select("review_id", "aspect", "clause_idx", "pos", label.alias("label"), score.alias("score"))


MENTIONS = f"""{I.OPINION_ASPECTS},
pairs AS (SELECT review_id, text, aspect FROM listed JOIN worded USING (review_id)), {CLAUSES_OF_ASPECT},
clause_scores AS (
  SELECT review_id, aspect, clause_idx, clause, pos, CASE WHEN clause IS NOT NULL THEN 'LABEL_' || pos END AS label,
         CASE WHEN clause IS NOT NULL AND (review_id + clause_idx) % 19 <> 0
              THEN {I.level_sql('review_id * 31 + pos * 17 + clause_idx * 41')} END AS score
  FROM aspect_clauses, (VALUES (0), (1), (2)) p(pos)),
{I.aspect_sentiment_sql('clause_scores', 'review_id, aspect, clause_idx, clause', 'mentions')}"""


@I.stored
def clauses(spark, sf_dir):
    return shaping.contrast_clauses(I.opinion_aspects(spark, sf_dir))


@I.stored
def clause_scores(spark, sf_dir):
    return _clause_scores(clauses(spark, sf_dir))


def _mentions(spark, sf_dir):
    return absa.clause_aspect_sentiment(clauses(spark, sf_dir), clause_scores(spark, sf_dir))


@query(f"WITH {MENTIONS} SELECT review_id, aspect, clause_idx, clause, sentiment_label, sentiment_score, confidence FROM mentions")
def clause_aspect(spark, sf_dir):
    return _mentions(spark, sf_dir)


@query(f"""WITH {MENTIONS}, means AS (
  SELECT review_id, aspect, avg(sentiment_score) AS s, avg(confidence) AS c,
         count(*) FILTER (sentiment_label = 'positive') AS pos_mentions, count(*) FILTER (sentiment_label = 'negative') AS neg_mentions
  FROM mentions GROUP BY review_id, aspect)
SELECT review_id, aspect, round(s, 9) AS sentiment_score, round(c, 9) AS confidence, pos_mentions, neg_mentions,
       CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM means""")
def aggregate_mentions(spark, sf_dir):
    return rounded(absa.aggregate_mentions(_mentions(spark, sf_dir)))


@I.stored
def details(spark, sf_dir):
    """Aspect details as an earlier run stored them."""
    contexts = absa.aspect_context(I.opinion_aspects(spark, sf_dir)).drop("text")
    rated = absa.aspect_sentiment(I.aspect_scores(spark, sf_dir)).drop("raw_label")
    return rated.join(contexts, ["review_id", "aspect"])


FLIP_SARCASTIC, FLIP_NEGATIVE = ["oh great", "wonderful", "so glad"], ["slow", "wait", "never", "rude"]


def _any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {I.quoted(p)})" for p in phrases) + ")"


@query(f"""WITH {I.DETAILS}, flagged AS (
  SELECT *, sentiment_label = 'positive' AND {_any('context_phrase', FLIP_SARCASTIC)} AND {_any('context_phrase', FLIP_NEGATIVE)} AS flip FROM details)
SELECT review_id, aspect, confidence, context_phrase, CASE WHEN flip THEN 'negative' ELSE sentiment_label END AS sentiment_label,
       CASE WHEN flip THEN -sentiment_score ELSE sentiment_score END + 0.0 AS sentiment_score FROM flagged""")
def flip_sarcastic(spark, sf_dir):
    return rounded(absa.flip_sarcastic_aspect(details(spark, sf_dir), FLIP_SARCASTIC, FLIP_NEGATIVE))

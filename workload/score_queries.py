"""Classifier scores: argmax, label rules, calibration and comparison."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from opinionloom import resources
from opinionloom.operators import scoring, training

from . import inputs as I
from .registry import query, rounded


def _normalized(spark, sf_dir):
    best = scoring.argmax_label(I.sentiment_scores(spark, sf_dir))
    return scoring.normalize_labels(best, scoring.catalog_label_map(spark))


@query(f"WITH {I.SENTIMENT_SCORES} SELECT review_id, unit_id, model, label, score FROM best")
def argmax_label(spark, sf_dir):
    return scoring.argmax_label(I.sentiment_scores(spark, sf_dir))


_NORMALIZED = f"{I.OPINIONS}, {I.SENTIMENT_SCORES}, {I.NORMALIZED}"


@query(f"WITH {_NORMALIZED} SELECT review_id, unit_id, model, label, score, text_label, mapping_conf FROM normalized")
def normalize_labels(spark, sf_dir):
    return _normalized(spark, sf_dir)


@query(f"""WITH {_NORMALIZED}, {I.sentiment_sql(I.FIVE_WAY)}
SELECT review_id, sentiment, round(confidence, 9) AS confidence, {I.quoted(I.FIVE_WAY)} AS model_used FROM sentiment""")
def sentiment_result(spark, sf_dir):
    return rounded(scoring.sentiment_result(I.opinions(spark, sf_dir), _normalized(spark, sf_dir), I.FIVE_WAY))


@query(f"""WITH {_NORMALIZED}, {I.sentiment_sql(I.REVERSED)}
SELECT review_id, sentiment, round(confidence, 9) AS confidence, round(sentiment * confidence, 9) + 0.0::DOUBLE AS sentiment_score
FROM sentiment""")
def signed_score(spark, sf_dir):
    results = scoring.sentiment_result(I.opinions(spark, sf_dir), _normalized(spark, sf_dir), I.REVERSED)
    return rounded(scoring.signed_score(results).drop("model_used"))


@query(f"""WITH {I.SENTIMENT_SCORES},
probes AS (SELECT doc_id AS review_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS expected FROM labels),
seen AS (
  SELECT model, b.review_id, expected,
         CASE WHEN upper(label) LIKE 'LABEL#_%' ESCAPE '#' THEN TRY_CAST(substr(label, 7) AS INT)
              WHEN lower(label) LIKE '%pos%' THEN 1 WHEN lower(label) LIKE '%neg%' THEN 0 END AS idx,
         CASE WHEN upper(label) LIKE 'LABEL#_%' ESCAPE '#' THEN expected
              WHEN lower(label) LIKE '%pos%' THEN 'positive' ELSE 'negative' END AS name
  FROM best b JOIN probes USING (review_id))
SELECT model, idx, name AS label
FROM (SELECT *, row_number() OVER (PARTITION BY model, idx ORDER BY review_id DESC) AS rn FROM seen WHERE idx IS NOT NULL)
WHERE rn = 1""")
def calibrate_label_map(spark, sf_dir):
    """Labelled documents as probes, with the scores filed under the same keys."""
    probes = I.labelled(spark, sf_dir).select(F.col("review_id").alias("probe_id"), F.col("label").alias("expected"))
    return scoring.calibrate_label_map(I.sentiment_scores(spark, sf_dir), probes)


@query(f"""WITH {I.SENTIMENT_SCORES},
names AS (SELECT model, label, min(pos) AS pos, TRY_CAST(regexp_extract(label, '(?i)^(?:label_)?(\\d+)$', 1) AS INT) AS n
          FROM scores GROUP BY model, label),
facts AS (SELECT model, count(*) AS c, bool_or(upper(label) LIKE 'LABEL#_%' ESCAPE '#') AS numbered, min(n) AS lo, max(n) AS hi FROM names GROUP BY model)
SELECT model, lo AS idx, 'negative' AS label FROM facts WHERE numbered AND c = 2
UNION ALL SELECT model, hi, 'positive' FROM facts WHERE numbered AND c = 2
UNION ALL SELECT model, i, x FROM facts, (VALUES (0, 'negative'), (1, 'neutral'), (2, 'positive')) t(i, x) WHERE numbered AND c <> 2
UNION ALL SELECT model, pos, CASE WHEN lower(label) LIKE '%pos%' THEN 'positive' WHEN lower(label) LIKE '%neg%' THEN 'negative' ELSE 'neutral' END
FROM names JOIN facts USING (model) WHERE NOT numbered""")
def infer_label_map(spark, sf_dir):
    return scoring.infer_label_map(I.sentiment_scores(spark, sf_dir))


def _compare_sql() -> str:
    parts = []
    for i, m in enumerate(I.MODELS, 1):
        cte = re.sub(r"^sentiment AS", f"s{i} AS", I.sentiment_sql(m))
        parts.append(cte)
    cols = ", ".join(f"s{i}.sentiment AS sentiment_{i}, round(s{i}.confidence, 9) AS confidence_{i}" for i in range(1, 5))
    joins = " ".join(f"JOIN s{i} ON s{i}.review_id = s1.review_id" for i in range(2, 5))
    distinct = ", ".join(f"s{i}.sentiment" for i in range(1, 5))
    return f"WITH {_NORMALIZED}, {', '.join(parts)} SELECT s1.review_id, {cols}, len(list_distinct([{distinct}]))::INT AS n_opinions FROM s1 {joins}"


@query(_compare_sql())
def compare_models(spark, sf_dir):
    return rounded(scoring.compare_models(I.opinions(spark, sf_dir), _normalized(spark, sf_dir), I.MODELS))


_CATALOG = ", ".join(f"({I.quoted(m)}, {len(c)}, {int(p)}, {I.quoted(', '.join(c))})" for m, (c, p, _) in resources.MODELS.items())


@query(f"""WITH {I.SENTIMENT_SCORES}, catalog(model, num_classes, uses_label_prefix, classes) AS (VALUES {_CATALOG})
SELECT c.model, num_classes, uses_label_prefix, classes, count(b.review_id) AS n_scored
FROM catalog c LEFT JOIN best b USING (model) GROUP BY ALL""")
def model_catalog(spark, sf_dir):
    """The catalogue with the number of reviews each model has scored."""
    used = scoring.argmax_label(I.sentiment_scores(spark, sf_dir)).groupBy("model").agg(F.count("*").alias("n_scored"))
    return scoring.model_catalog(spark).join(used, "model", "left").select(
        "model",
        "num_classes",
        F.col("uses_label_prefix").cast("int").alias("uses_label_prefix"),
        F.array_join(F.map_values("label_mapping"), ", ").alias("classes"),
        F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
    )


@query(f"""WITH {I.LABELLED}
SELECT doc_id AS review_id, (SELECT count(DISTINCT label) FROM labelled) AS n_scores, 1.0::DOUBLE AS total FROM documents""")
def score_units(spark, sf_dir):
    """Scores of a classifier trained on the labelled documents, for every document: one per class, 1 in sum."""
    model, classes, _ = training.train_text_classifier(I.labelled(spark, sf_dir))
    units = I.prose(spark, sf_dir).withColumn("unit_id", F.lit(0))
    scores = scoring.score_units(units, model, "tfidf-logistic", classes)
    return scores.groupBy("review_id").agg(F.count("*").alias("n_scores"), F.round(F.sum("score"), 6).alias("total"))


@query("""WITH turns AS (SELECT conv_id, turn, role, least(4, length(text) - length(replace(text, '!', '')))::DOUBLE / 4 AS s FROM conversations)
SELECT conv_id, turn, 'exclamation' AS model, 0 AS pos, 'calm' AS label, 1 - coalesce(s, 0) AS score FROM turns
UNION ALL SELECT conv_id, turn, 'exclamation', 1, 'excited', coalesce(s, 0) FROM turns""")
def score_units_batches(spark, sf_dir):
    """The same contract served by a batch function, loaded once per partition, for every turn, by keys of its own."""
    turns = I.load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return scoring.score_units(turns, exclamation_scorer, "exclamation", keys=("conv_id", "turn"))


_UNITS = """units AS (SELECT l_orderkey AS review_id, l_linenumber::INT AS unit_id, l_returnflag, CASE WHEN l_quantity % 7 <> 0 THEN (l_quantity % 5)::DOUBLE / 10 END AS score FROM lineitem),
top AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY coalesce(score, 0) DESC, unit_id, score IS NULL,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 2 ELSE 1 END) AS rn FROM units)"""


@query(f"""WITH {_UNITS}
SELECT o_orderkey AS review_id, CASE WHEN score IS NULL THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 ELSE 0 END::INT AS sentiment,
       coalesce(score, 0.0)::DOUBLE AS confidence FROM orders LEFT JOIN (SELECT * FROM top WHERE rn = 1) t ON t.review_id = o_orderkey""")
def units_to_review(spark, sf_dir):
    """Line items as the scored units of their order: one row per order, from its best unit."""
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    normalized = I.load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").cast("int").alias("unit_id"), F.lit("units").alias("model"),
        F.when(flag == "A", "positive").when(flag == "R", "negative").otherwise("neutral").alias("text_label"),
        F.when(quantity % 7 != 0, (quantity % 5).cast("double") / 10).alias("score"), F.lit(1.0).alias("mapping_conf"),
    )
    orders = I.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.lit("text").alias("text"))
    return rounded(scoring.sentiment_result(orders, normalized, "units").drop("model_used"))


def exclamation_scorer():
    def score(texts):
        share = texts.fillna("").str.count("!").clip(upper=4) / 4
        return [[("calm", 1.0 - s), ("excited", s)] for s in share]

    return score

"""Sources, result tables and the feedback loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinionloom import schemas
from opinionloom.operators import feedback
from opinionloom.sinks import tables
from opinionloom.sources import feedback as feedback_source
from opinionloom.sources import reviews as review_source

from . import inputs as I
from .aspect_queries import CATEGORIES, categories
from .registry import query, rounded
from .signal_queries import FEATURE_TABLES, FEATURES_SQL, stored_signals


@query("SELECT doc_id AS review_id, text FROM documents")
def read_reviews(spark, sf_dir):
    return review_source.read_reviews(I.load(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id AS review_id, text FROM documents ORDER BY doc_id LIMIT 100")
def first_reviews(spark, sf_dir):
    """The limit option of the review source: the first ids in order."""
    return review_source.read_reviews(I.load(spark, sf_dir, "documents"), "doc_id", "text", limit=100)


@query(f"WITH {I.OPINIONS} SELECT review_id, text FROM opinions WHERE review_id > (SELECT coalesce(max(c_custkey), 0) FROM customer)")
def incremental_reviews(spark, sf_dir):
    """Orders as reviews, customers as the keys of the results stored so far."""
    results = I.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("review_id"))
    return review_source.incremental_reviews(I.opinions(spark, sf_dir), results)


@query("SELECT doc_id AS review_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_reviews(spark, sf_dir):
    results = I.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"))
    return review_source.unprocessed_reviews(I.prose(spark, sf_dir), results)


@query(f"WITH {CATEGORIES} SELECT * FROM categories")
def aspect_categories(spark, sf_dir):
    return review_source.read_aspect_categories(categories(spark, sf_dir))


@query(f"WITH {CATEGORIES} SELECT * FROM categories WHERE industry_id = 7")
def industry_categories(spark, sf_dir):
    return review_source.read_aspect_categories(categories(spark, sf_dir), 7)


# --- feedback ------------------------------------------------------------------------------------


def log_lines(spark, sf_dir):
    """One JSON line per order: complete, with the older name of the fused output, without
    fusion signals, or broken."""
    k = F.col("o_orderkey")
    polarity = F.format_string("%.2f", (k * 7 % 201 - 100) / 100)
    confidence = F.format_string("%.2f", (k * 37 % 101) / 100)
    name = F.when(k % 3 == 0, "fused_output").otherwise("fused")
    fed = F.concat(
        F.lit('"signals_fed_to_fusion":{"rule_polarity":'), polarity, F.lit(',"num_pos_aspects":'), (k % 5).cast("string"),
        F.lit("},"),
    )
    line = F.concat(
        F.lit('{"timestamp":"2024-05-01T10:00:00Z","review_id":'), k.cast("string"), F.lit(',"text":"order '),
        k.cast("string"), F.lit('","signals":{'), F.when(k % 7 != 2, fed).otherwise(""), F.lit('"'), name,
        F.lit('":{"fused_label":"positive","fused_confidence":'), confidence, F.lit("}}}"),
    )
    cut = F.when(k % 11 == 4, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line)
    return I.spread_table(spark, sf_dir, "orders", "o_orderkey").select(cut.alias("value"))


_RECORDS = """records AS (
  SELECT o_orderkey AS k, o_orderkey::VARCHAR AS review_id, 'order ' || o_orderkey AS text,
         ((o_orderkey * 7 % 201) - 100)::DOUBLE / 100 AS rule_polarity, (o_orderkey % 5)::DOUBLE AS num_pos_aspects,
         (o_orderkey * 37 % 101)::DOUBLE / 100 AS fused_confidence
  FROM orders WHERE o_orderkey % 7 <> 2 AND o_orderkey % 11 <> 4)"""


@query(f"""WITH {_RECORDS}
SELECT '2024-05-01T10:00:00Z' AS timestamp, review_id, text, rule_polarity, num_pos_aspects,
       CASE WHEN k % 3 = 0 THEN NULL ELSE fused_confidence END AS fused, CASE WHEN k % 3 = 0 THEN fused_confidence END AS fused_output
FROM records""")
def feedback_log(spark, sf_dir):
    records = feedback_source.parse_feedback(log_lines(spark, sf_dir))
    fed = "signals.signals_fed_to_fusion."
    return records.select(
        "timestamp", "review_id", "text", f"{fed}rule_polarity", f"{fed}num_pos_aspects",
        F.col("signals.fused.fused_confidence").alias("fused"),
        F.col("signals.fused_output.fused_confidence").alias("fused_output"),
    )


_EXPORT = ", ".join(
    f if f in ("rule_polarity", "num_pos_aspects") else f"0.0::DOUBLE AS {f}" for f in schemas.FEATURES
)


@query(f"""WITH {_RECORDS}
SELECT review_id, text, {_EXPORT}, 'positive' AS fused_label, fused_confidence, '' AS label FROM records""")
def feedback_to_training(spark, sf_dir):
    return feedback.feedback_to_training(feedback_source.parse_feedback(log_lines(spark, sf_dir)))


@query(f"""WITH {_RECORDS},
votes AS (SELECT (l_orderkey)::VARCHAR AS review_id, l_shipdate AS labelled_at,
                 CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS label FROM lineitem),
latest AS (SELECT review_id, label FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY labelled_at DESC, label DESC) AS rn FROM votes) WHERE rn = 1)
SELECT review_id, text, {_EXPORT}, 'positive' AS fused_label, fused_confidence, label FROM records JOIN latest USING (review_id)""")
def labelled_feedback(spark, sf_dir):
    """Line items as repeated human labels of their order."""
    flag = F.col("l_returnflag")
    votes = I.load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("review_id"),
        F.when(flag == "A", "positive").when(flag == "R", "negative").otherwise("neutral").alias("label"),
        F.col("l_shipdate").alias("labelled_at"),
    )
    return feedback.labelled_feedback(feedback_to_training(spark, sf_dir), votes)


@query(f"WITH {I.FUSED} SELECT * FROM fused WHERE fused_confidence < 0.6")
def low_confidence(spark, sf_dir):
    return feedback.low_confidence(I.fused_results(spark, sf_dir))


_FED = ", ".join(f"round(f.{c}, 9) + 0.0::DOUBLE AS {c}" for c in schemas.FEATURES)


@query(f"""WITH {FEATURE_TABLES}, {FEATURES_SQL}
SELECT f.review_id, text, {_FED}, 'neutral' AS fused_label, c.sarcasm_label,
       CASE WHEN f.rule_score > 0 THEN 'positive' WHEN f.rule_score < 0 THEN 'negative' ELSE 'neutral' END AS rule_label
FROM features f JOIN opinions o ON o.review_id = f.review_id JOIN sarcasm c ON c.review_id = f.review_id""")
def feedback_record(spark, sf_dir):
    signals = stored_signals(spark, sf_dir).join(I.opinions(spark, sf_dir), "review_id")
    records = feedback.feedback_record(feedback.low_confidence(signals))
    fed = [F.col(f"signals.signals_fed_to_fusion.{c}").alias(c) for c in schemas.FEATURES]
    return rounded(records.select(
        "review_id", "text", *fed, "signals.fused.fused_label", "signals.sarcasm_output.sarcasm_label", "signals.rule_output.rule_label",
    ))


# --- result tables --------------------------------------------------------------------------------


def _stored(spark, sf_dir):
    """Results of an earlier run: one per customer key."""
    k = F.col("c_custkey")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return I.load(spark, sf_dir, "customer").select(
        k.alias("review_id"), F.lit("old").alias("fusion_label"), (k % 101 / 100.0).alias("fusion_confidence"),
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )


def _fresh(spark, sf_dir):
    """A batch with several rows per key: the last one by date and key counts."""
    when = F.col("o_orderdate").cast("timestamp")
    return I.load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("review_id"), F.col("o_orderstatus").alias("fusion_label"),
        (F.col("o_orderkey") % 101 / 100.0).alias("fusion_confidence"), when.alias("created_at"), when.alias("updated_at"),
        F.col("o_orderkey").alias("pos"),
    )


@query("""WITH fresh AS (
  SELECT o_custkey AS review_id, o_orderstatus AS fusion_label, (o_orderkey % 101)::DOUBLE / 100 AS fusion_confidence,
         min(o_orderdate) OVER (PARTITION BY o_custkey) AS created_at, o_orderdate AS updated_at,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
new AS (SELECT * FROM fresh WHERE rn = 1)
SELECT coalesce(n.review_id, c_custkey) AS review_id, coalesce(fusion_label, 'old') AS fusion_label,
       coalesce(fusion_confidence, (c_custkey % 101)::DOUBLE / 100) AS fusion_confidence,
       strftime(CASE WHEN c_custkey IS NOT NULL THEN TIMESTAMP '2024-01-01' ELSE created_at END, '%Y-%m-%d %H:%M:%S') AS created_at,
       strftime(coalesce(updated_at, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM new n FULL JOIN customer ON c_custkey = n.review_id""")
def upsert_results(spark, sf_dir):
    merged = tables.upsert_results(_stored(spark, sf_dir), _fresh(spark, sf_dir), "pos")
    return merged.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in tables.AUDIT})


@query("""WITH existing AS (SELECT l_orderkey AS review_id, l_partkey AS category_id, l_returnflag AS span_text FROM lineitem),
new AS (SELECT o_orderkey AS review_id, o_custkey AS category_id, o_orderstatus AS span_text FROM orders WHERE o_orderstatus = 'F'),
processed AS (SELECT o_orderkey AS review_id FROM orders WHERE o_orderstatus <> 'P')
SELECT * FROM existing WHERE review_id NOT IN (SELECT review_id FROM processed) UNION ALL SELECT * FROM new""")
def replace_aspects(spark, sf_dir):
    """Line items as stored aspect rows; orders in status O are processed but find no aspect any more."""
    existing = I.load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("review_id"), F.col("l_partkey").alias("category_id"), F.col("l_returnflag").alias("span_text")
    )
    orders = I.load(spark, sf_dir, "orders")
    new = orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("category_id"), F.col("o_orderstatus").alias("span_text")
    )
    processed = orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("review_id"))
    return tables.replace_aspects(existing, new, processed)

"""Report aggregates and text cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinionloom.operators import reporting, sarcasm, scoring

from . import inputs as I
from .aspect_queries import details
from .registry import query, rounded
from .signal_queries import FEATURE_TABLES, TOP_EMOTION, filled, stored_signals, top_emotion


@query(f"""WITH {I.FUSED}
SELECT count(*) AS n_reviews, round(avg(fused_confidence), 9) AS mean_confidence,
       count(*) FILTER (fused_confidence >= 0.8) AS n_high, round(100.0 * count(*) FILTER (fused_confidence >= 0.8) / count(*), 9) AS pct_high,
       count(*) FILTER (fused_confidence < 0.6) AS n_low, round(100.0 * count(*) FILTER (fused_confidence < 0.6) / count(*), 9) AS pct_low
FROM fused""")
def report_overview(spark, sf_dir):
    return rounded(reporting.report_overview(I.fused_results(spark, sf_dir)))


@query(f"""WITH {I.FUSED} SELECT fused_label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM fused), 9) AS pct
FROM fused GROUP BY fused_label""")
def sentiment_distribution(spark, sf_dir):
    return rounded(reporting.sentiment_distribution(I.fused_results(spark, sf_dir)))


@query(f"""WITH {I.ASPECT_SENTIMENT},
counts AS (SELECT aspect, count(*) AS n, count(*) FILTER (sentiment_label = 'positive') AS n_pos,
                  count(*) FILTER (sentiment_label = 'negative') AS n_neg, count(*) FILTER (sentiment_label = 'neutral') AS n_neutral,
                  min(review_id) AS first_review FROM rated GROUP BY aspect)
SELECT aspect, n, n_pos, n_neg, n_neutral, round(n_pos * 100.0 / n, 9) AS pct_pos, round(n_neg * 100.0 / n, 9) AS pct_neg
FROM counts ORDER BY n DESC, first_review, aspect LIMIT 5""")
def top_aspects(spark, sf_dir):
    return rounded(reporting.top_aspects(details(spark, sf_dir)))


@query(f"""WITH {I.DETAILS}
SELECT aspect, rn::INT AS sample_idx, review_id, substr(context_phrase, 1, 50) AS sample
FROM (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY review_id) AS rn FROM details WHERE context_phrase <> '')
WHERE rn <= 2""")
def aspect_samples(spark, sf_dir):
    return reporting.aspect_samples(details(spark, sf_dir))


@query(f"""WITH {I.SARCASM_SCORES} SELECT count(*) FILTER (sarcasm_label = 'sarcastic') AS n_sarcastic,
round(count(*) FILTER (sarcasm_label = 'sarcastic') * 100.0 / count(*), 9) AS pct_sarcastic FROM sarcasm""")
def sarcasm_rate(spark, sf_dir):
    best = scoring.argmax_label(I.sarcasm_scores(spark, sf_dir), ("review_id",))
    return rounded(reporting.sarcasm_rate(sarcasm.sarcasm_result(I.opinions(spark, sf_dir), best)))


@query(f"""WITH {I.EMOTION_SCORES}, {TOP_EMOTION}
SELECT emotion_label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM top_emotion), 9) AS pct
FROM top_emotion GROUP BY emotion_label ORDER BY n DESC, min(review_id), emotion_label LIMIT 3""")
def top_emotions(spark, sf_dir):
    return rounded(reporting.top_emotions(top_emotion(spark, sf_dir)))


@query(f"""WITH {I.FUSED} SELECT *, CASE WHEN fused_confidence < 0.6 THEN 'low' WHEN fused_confidence >= 0.9 THEN 'high' ELSE 'none' END AS confidence_flag
FROM fused""")
def confidence_flag(spark, sf_dir):
    return reporting.confidence_flag(I.fused_results(spark, sf_dir))


_SYMBOL = "CASE {} WHEN 'positive' THEN '😊' WHEN 'negative' THEN '😞' WHEN 'neutral' THEN '😐' ELSE '❓' END"
_BAR = ("'[' || repeat('█', floor({c} * {w})::INT) || repeat('░', {w} - floor({c} * {w})::INT) || '] ' || printf('%.1f%%', {c} * 100)")


@query(f"WITH {I.FUSED} SELECT *, {_BAR.format(c='fused_confidence', w=20)} AS bar, {_SYMBOL.format('fused_label')} AS symbol FROM fused")
def confidence_bar(spark, sf_dir):
    return reporting.confidence_bar(I.fused_results(spark, sf_dir))


@query(f"""WITH {I.DETAILS}
SELECT review_id, aspect, '│ ' || rpad(aspect, 15, ' ') || ' │ ' || rpad(sentiment_label, 9, ' ') || ' │ ' || printf('%+6.2f', sentiment_score)
  || ' ' || {_SYMBOL.format('sentiment_label')} || ' │ '
  || rpad(CASE WHEN length(context_phrase) > 31 THEN substr(context_phrase, 1, 28) || '...' ELSE context_phrase END, 31, ' ') || ' │' AS row
FROM details""")
def aspect_table_rows(spark, sf_dir):
    return reporting.aspect_table_rows(details(spark, sf_dir))


@query(f"""WITH {I.EMOTION_SCORES}
SELECT review_id, rn::INT AS rank, label, score
FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY score DESC, label_pos) AS rn FROM filled) WHERE rn <= 5""")
def emotion_top5(spark, sf_dir):
    return reporting.emotion_top5(filled(spark, sf_dir))


@query(f"""WITH {FEATURE_TABLES}
SELECT review_id, 'classifier' AS source, CASE sentiment WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS label,
       round(confidence, 9) AS confidence FROM sentiment
UNION ALL
SELECT review_id, 'rule', CASE WHEN rule_polarity >= 0.05 THEN 'positive' WHEN rule_polarity <= -0.05 THEN 'negative' ELSE 'neutral' END,
       round(abs(rule_polarity), 9) FROM rule""")
def signals_summary(spark, sf_dir):
    return rounded(reporting.signals_summary(stored_signals(spark, sf_dir)))


def report_blocks(spark, sf_dir, ordered=False):
    with_text = stored_signals(spark, sf_dir).join(I.opinions(spark, sf_dir), "review_id")
    return reporting.review_report(with_text, details(spark, sf_dir), ordered=ordered)


_LINES = f"""lines AS (
  SELECT review_id, string_agg('  ' || upper(aspect) || ': ' || sentiment_label || ' (score ' || printf('%+.3f', sentiment_score) || ', confidence '
           || printf('%.3f', confidence) || ') "' || context_phrase || '"', chr(10) ORDER BY aspect) AS details
  FROM details GROUP BY review_id)"""


@query(f"""WITH {I.DETAILS}, {_LINES}
SELECT o.review_id, '== Review ' || o.review_id || ' ==' AS head, 'Result: NEUTRAL 😐' AS result, '  low confidence: have a person look at it' AS note,
       coalesce(l.details, '  no aspects detected') AS aspects
FROM opinions o LEFT JOIN lines l ON l.review_id = o.review_id""")
def review_report(spark, sf_dir):
    """The parts of every review's block that SQL can say: heading, result, note and aspect details."""
    lines = F.split("report", "\n")
    aspects = F.filter(lines, lambda x: x.rlike("^  [^a-z]+: [a-z]+ \\(score ") | (x == "  no aspects detected"))
    return report_blocks(spark, sf_dir).select(
        "review_id", F.get(lines, 0).alias("head"), F.element_at(F.filter(lines, lambda x: x.startswith("Result: ")), 1).alias("result"),
        F.element_at(F.filter(lines, lambda x: x.startswith("  low confidence")), 1).alias("note"), F.array_join(aspects, "\n").alias("aspects"),
    )

"""Training of the fusion forest and the text classifier."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opinionloom import resources, schemas
from opinionloom.operators import epochs, feedback, fusion, training
from opinionloom.plans import train
from opinionloom.sinks import files
from opinionloom.session import scratch
from opinionloom.sources import training as training_source

from . import inputs as I
from .registry import query, rounded
from .signal_queries import fitted, training_rows

_NUMBERS = ["plain", "minus", "broken"]


def _written_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    minus = F.concat(F.lit("−"), F.format_string("%.2f", k % 300 / 100))
    broken = F.when(k % 5 == 0, "abc").when(k % 5 == 1, "NaN").when(k % 5 == 2, F.lit(None)).otherwise(F.lit("1e1"))
    return I.load(spark, sf_dir, "orders").select(
        k.alias("review_id"), F.col("o_totalprice").cast("string").alias("plain"), minus.alias("minus"), broken.alias("broken")
    )


@query("""SELECT o_orderkey AS review_id, o_totalprice AS plain, -(o_orderkey % 300)::DOUBLE / 100 + 0.0 AS minus,
CASE WHEN o_orderkey % 5 < 3 THEN 0.0 ELSE 10.0 END::DOUBLE AS broken FROM orders""")
def clean_numeric(spark, sf_dir):
    cleaned = training.clean_numeric(_written_numbers(spark, sf_dir), _NUMBERS)
    return cleaned.withColumn("minus", F.col("minus") + F.lit(0.0))


@query("SELECT 0::BIGINT AS plain, 0::BIGINT AS minus, count(*) FILTER (o_orderkey % 5 < 3) AS broken FROM orders")
def bad_values(spark, sf_dir):
    return training.bad_values(_written_numbers(spark, sf_dir), _NUMBERS)


@query(f"""WITH {I.LABELLED} SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labelled)::DOUBLE, 9) AS share
FROM labelled GROUP BY label""")
def label_distribution(spark, sf_dir):
    return rounded(training.label_distribution(I.labelled(spark, sf_dir)))


@query(f"""WITH {I.LABELLED}
SELECT review_id, label,
       ((row_number() OVER (PARTITION BY label ORDER BY md5(review_id::VARCHAR || '#42'), review_id) - 1) % 5)::INT AS fold
FROM labelled""")
def stratified_folds(spark, sf_dir):
    return training.stratified_folds(I.labelled(spark, sf_dir).select("review_id", "label"))


@query(f"""WITH {I.LABELLED}, per AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)
SELECT review_id, label, round((SELECT count(*) FROM labelled)::DOUBLE / ((SELECT count(*) FROM per) * n), 9) AS weight
FROM labelled JOIN per USING (label)""")
def balanced_weights(spark, sf_dir):
    return rounded(training.balanced_weights(I.labelled(spark, sf_dir).select("review_id", "label")))


def _guesses(spark, sf_dir):
    """Predictions made of line item flags: label from the return flag, guess from the line status and number."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    guess = F.when(k % 4 == 0, "R").when(F.col("l_linestatus") == "F", "A").otherwise("N")
    return I.load(spark, sf_dir, "lineitem").select(
        (k % 5).cast("int").alias("fold"), F.col("l_returnflag").alias("label"), guess.alias("prediction")
    )


_GUESSES = """guesses AS (
  SELECT ((l_orderkey + l_linenumber) % 5)::INT AS fold, l_returnflag AS label,
         CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN 'R' WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END AS prediction
  FROM lineitem)"""


@query(f"""WITH {_GUESSES},
classes AS (SELECT fold, label AS class FROM guesses UNION SELECT fold, prediction FROM guesses),
counts AS (
  SELECT c.fold, c.class, count(*) FILTER (label = class) AS support, count(*) FILTER (prediction = class) AS predicted,
         count(*) FILTER (label = class AND prediction = class) AS tp
  FROM classes c JOIN guesses g ON c.fold = g.fold GROUP BY c.fold, c.class),
rates AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0)::DOUBLE AS p, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS r FROM counts),
scored AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0)::DOUBLE AS f FROM rates),
rows AS (
  SELECT fold, class, p, r, f, support FROM scored
  UNION ALL SELECT fold, 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM scored GROUP BY fold
  UNION ALL SELECT fold, 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM scored GROUP BY fold
  UNION ALL SELECT fold, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support)
  FROM scored GROUP BY fold)
SELECT fold, class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support::BIGINT AS support FROM rows""")
def classification_report(spark, sf_dir):
    return rounded(training.classification_report(_guesses(spark, sf_dir), ["fold"]))


@query(f"""WITH {_GUESSES}, acc AS (SELECT fold, avg((label = prediction)::INT) AS a FROM guesses GROUP BY fold)
SELECT round(avg(a), 9) AS mean_accuracy, round(stddev_pop(a), 9) AS std_accuracy FROM acc""")
def cv_summary(spark, sf_dir):
    return rounded(training.cv_summary(training.fold_accuracy(_guesses(spark, sf_dir))))


def _in_range(report):
    """1 where precision, recall and F1 lie between 0 and 1."""
    fair = [F.col(m).between(0.0, 1.0) for m in ("precision", "recall", "f1")]
    return report.withColumn("in_range", (fair[0] & fair[1] & fair[2]).cast("int"))


@query("""WITH rows AS (SELECT o_orderkey AS review_id, CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'negative' ELSE 'neutral' END AS label FROM orders),
folded AS (SELECT label, ((row_number() OVER (PARTITION BY label ORDER BY md5(review_id::VARCHAR || '#42'), review_id) - 1) % 5)::INT AS fold FROM rows),
per AS (SELECT fold, label AS class, count(*) AS support FROM folded GROUP BY ALL)
SELECT fold, class, support, 1 AS in_range FROM per
UNION ALL SELECT fold, m, sum(support)::BIGINT, 1 FROM per, (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) t(m) GROUP BY fold, m""")
def cross_validate(spark, sf_dir):
    """Support of every class in every fold; the forest's measures lie in their range."""
    predictions = training.cross_validate(training_rows(spark, sf_dir), k=5)
    return _in_range(training.classification_report(predictions, ["fold"])).select("fold", "class", "support", "in_range")


@query(f"SELECT unnest({I.sql_list(schemas.FEATURES)}) AS feature, 1.0::DOUBLE AS total, 1 AS in_order")
def feature_importance(spark, sf_dir):
    """Every feature once; importances sum to 1 and fall with the rank."""
    model, _ = fitted(spark, sf_dir)
    ranked = training.feature_importance(spark, model)
    every = Window.partitionBy()  # over 13 rows
    falls = F.coalesce(F.lag("importance").over(every.orderBy("rank")) >= F.col("importance"), F.lit(True))
    return ranked.select("feature", F.round(F.sum("importance").over(every), 6).alias("total"), falls.cast("int").alias("in_order"))


@query(f"""WITH {I.LABELLED}, test AS (SELECT label FROM labelled WHERE ('0x' || substr(md5(review_id::VARCHAR || '#42'), 1, 4))::INT < 13107)
SELECT label AS class, count(*) AS support, 1 AS in_range FROM test GROUP BY label
UNION ALL SELECT m, count(*), 1 FROM test, (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) t(m) GROUP BY m""")
def text_classifier(spark, sf_dir):
    """Support of the held-out classes; the measures lie in their range."""
    _, _, predictions = training.train_text_classifier(I.labelled(spark, sf_dir))
    report = _in_range(training.classification_report(predictions))
    return report.where("support > 0").select("class", "support", "in_range")


@query(f"""WITH {I.LABELLED}, test AS (SELECT label FROM labelled WHERE ('0x' || substr(md5(review_id::VARCHAR || '#42'), 1, 4))::INT < 13107)
SELECT epoch::INT AS epoch, count(*) AS n, 1 AS above_majority FROM test, range(1, 4) e(epoch) GROUP BY 1""")
def epoch_accuracy(spark, sf_dir):
    """Three epochs, stopped after the first one; the accuracy of each beats the share of the most frequent label."""
    train_rows, test = training.held_out(I.labelled(spark, sf_dir))
    shares = training.label_distribution(test)
    setup = epochs.Setup(tuple(sorted(training.class_counts(train_rows))), n_features=1 << 14, batches=4)
    folder = scratch(spark, "epochs")
    epochs.train_epochs(train_rows, test, setup, folder, 1)
    measured = epochs.train_epochs(train_rows, test, setup, folder, 3)
    above = F.col("accuracy") > F.col("share")
    return measured.join(F.broadcast(shares.agg(F.max("share").alias("share")))).select("epoch", "n", above.cast("int").alias("above_majority"))


@query("SELECT 'positive' AS label, 1.0::DOUBLE AS total UNION ALL SELECT 'negative', 1.0 UNION ALL SELECT 'neutral', 1.0")
def training_run(spark, sf_dir):
    """The training entry on the logged feedback of every order with human labels, its model published and loaded again."""
    folder = scratch(spark, "training-run")
    rows = training_rows(spark, sf_dir)
    record = feedback.feedback_record(rows.withColumns({"text": F.lit("t"), "fused_label": F.lit("neutral"), "fused_confidence": F.lit(0.1)}))
    files.append_feedback(record, f"{folder}/log", "run")
    human = rows.select(F.col("review_id").cast("string").alias("review_id"), "label", F.lit(1).alias("labelled_at"))
    train.run_training(spark, "feedback", f"{folder}/models", "v1", feedback_log=f"{folder}/log", labels=human, k=2)
    model, classes = files.load_latest_model(spark, f"{folder}/models")
    fused = fusion.fuse(rows.drop("label"), model, classes)
    fair = F.avg(F.col("fused_label").isin(classes).cast("double")).alias("total")
    return fused.agg(fair).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"), "total")


def _sample_sql() -> str:
    def uniform(digest: str, start: int) -> str:
        return f"((('0x' || substr({digest}, {start}, 8))::BIGINT + 1) / 4294967297.0::DOUBLE)"

    columns = []
    for i, f in enumerate(schemas.FEATURES):
        base = ", ".join(f"{float(values[i])}::DOUBLE" for _, values, _ in resources.SAMPLE_ROWS)
        value = f"list_extract([{base}], i % 5 + 1)"
        if f in resources.SAMPLE_NOISE_RANGE:
            low, high = resources.SAMPLE_NOISE_RANGE[f]
            sigma = 0.1 if "confidence" in f or "distribution" in f else 0.05
            digest = f"md5(i::VARCHAR || '#{f}#42')"
            noise = f"sqrt(-2 * ln({uniform(digest, 1)})) * cos(2 * pi() * {uniform(digest, 9)}) * {sigma}::DOUBLE"
            value = f"least(greatest({value} + {noise}, {low}), {high})"
        columns.append(f"round({value}, 9) + 0.0::DOUBLE AS {f}")
    names = I.sql_list([label for _, _, label in resources.SAMPLE_ROWS])
    h = "md5(i::VARCHAR || '#id#42')"
    uid = f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"
    return (
        f"SELECT {uid} AS review_id, 'Generated sample review ' || {uid} AS text, {', '.join(columns)}, "
        f"list_extract({names}, i % 5 + 1) AS label FROM (SELECT o_orderkey AS i FROM orders)"
    )


@query(_sample_sql())
def sample_training_data(spark, sf_dir):
    """One noisy sample per order key."""
    ids = I.spread_table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("i"))
    return rounded(training_source.expand_samples(ids))


@query(_sample_sql())
def training_table(spark, sf_dir):
    """The same rows after a round trip through a CSV file."""
    path = scratch(spark, "training-table")
    sample_training_data(spark, sf_dir).write.option("header", True).csv(path)
    return rounded(training_source.read_training_table(spark, path))

"""Classifier scores: from model_scores(review_id, unit_id, model, pos, label, score)
to one sentiment and confidence per review."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import resources, schemas
from ..functions import labels, text
from ..functions.chosen import chosen_ids
from ..functions.joins import MAX_BROADCAST_ROWS, lookup_join

Scorer = Callable[[], Callable[[pd.Series], list]]


def score_units(units: DataFrame, scorer: PipelineModel | Scorer, model: str, class_labels: Sequence[str] = (),
                keys: Sequence[str] = ("review_id", "unit_id"), as_array: bool = False) -> DataFrame:
    """All class scores of units(*keys, text): a long score table (*keys, model, pos, label, score), or
    with as_array one row per unit (*keys, model, scores), which needs no regrouping later.

    `scorer` is a fitted Spark ML pipeline with a `probability` column, or a
    function that loads a model and returns a batch function
    texts -> [[(label, score), ...], ...]; it is loaded once per partition.
    """
    if isinstance(scorer, PipelineModel):
        scored = scorer.transform(units.select(*keys, "text")).select(
            *keys, F.posexplode(vector_to_array("probability")).alias("pos", "score")
        )
        names = F.array(*[F.lit(x) for x in class_labels])
        if as_array:
            probabilities = vector_to_array("probability")
            pairs = F.transform(probabilities, lambda p, i: F.struct(F.get(names, i).alias("label"), p.alias("score")))
            return scorer.transform(units.select(*keys, "text")).select(*keys, F.lit(model).alias("model"), pairs.alias("scores"))
        label = F.element_at(names, F.col("pos") + 1)
        return scored.select(*keys, F.lit(model).alias("model"), "pos", label.alias("label"), "score")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for batch in batches:
            rows = batch[list(keys)].assign(scores=score(batch["text"]))
            if as_array:
                arrays = [[{"label": label, "score": float(s)} for label, s in row] for row in rows["scores"]]
                yield rows[list(keys)].assign(model=model, scores=arrays)
                continue
            rows = rows.explode("scores").dropna(subset=["scores"])
            pos = rows.groupby(level=0).cumcount()
            yield pd.DataFrame(
                {
                    **{k: rows[k] for k in keys},
                    "model": model,
                    "pos": pos,
                    "label": [s[0] for s in rows["scores"]],
                    "score": [float(s[1]) for s in rows["scores"]],
                }
            )

    kinds = ", ".join(f"{k} {units.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{kinds}, model string, " + (f"scores {schemas.SCORE_ARRAY}" if as_array else "pos int, label string, score double")
    return units.select(*keys, "text").mapInPandas(run, out)


def long_scores(scores: DataFrame) -> DataFrame:
    """One row per class (…, pos, label, score) of a table with score arrays; long tables as they are."""
    if "scores" not in scores.columns:
        return scores
    rest = [c for c in scores.columns if c != "scores"]
    exploded = scores.select(*rest, F.posexplode("scores").alias("pos", "_s"))
    return exploded.select(*rest, "pos", "_s.label", "_s.score")


def best_of_array(scores: Column) -> Column:
    """struct(label, score) of the largest score, the first one on a tie; a missing score counts as 0."""
    ranked = F.transform(scores, lambda s, i: F.struct(F.coalesce(s["score"], F.lit(0.0)).alias("v"), (-i).alias("p"), s.alias("s")))
    return F.array_max(ranked)["s"]


def argmax_label(model_scores: DataFrame, keys: Sequence[str] = ("review_id", "unit_id", "model")) -> DataFrame:
    """Best label per key; a missing score counts as 0. On a tie the lowest unit_id wins, if that
    is a column but no key, then the lowest pos: this is the roll-up from units to reviews."""
    rolled = "unit_id" in model_scores.columns and "unit_id" not in keys
    if "scores" in model_scores.columns:
        # Score arrays hold a unit in a row: no shuffle unless units are rolled up.
        units = model_scores.withColumn("_best", best_of_array(F.col("scores")))
        best = units.select(*keys, *(["unit_id"] if rolled else []), "_best.label", "_best.score").withColumn("pos", F.lit(0))
        return argmax_label(best, keys) if rolled else best.drop("pos")
    score = F.coalesce("score", F.lit(0.0))
    before = F.struct(-F.coalesce("unit_id", F.lit(0)), -F.col("pos")) if rolled else -F.col("pos")
    best = F.max_by(F.struct("label", "score"), F.struct(score, before))
    return model_scores.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, F.col("_best.label").alias("label"), F.col("_best.score").alias("score")
    )


def catalog_label_map(spark: SparkSession) -> DataFrame:
    rows = [(m, i, label) for m, (classes, _, _) in resources.MODELS.items() for i, label in enumerate(classes)]
    return spark.createDataFrame(rows, "model string, idx int, label string")


def normalize_labels(best: DataFrame, label_map: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Add text_label and mapping_conf; label_map(model, idx, label) has one row per class.

    A map of more than max_rows rows is shuffled; classes that hold many units are shared by several tasks."""
    names = label_map.select("model", F.col("idx").alias("_idx"), F.col("label").alias("_mapped"))
    raw = F.col("label")
    keyed = best.withColumn("_idx", labels.class_index(raw))
    joined = lookup_join(keyed, names, ["model", "_idx"], best.columns, "left", max_rows)
    by_index = F.col("_idx").isNotNull()
    text_label = F.when(raw.isNull(), "neutral").when(by_index, F.coalesce("_mapped", F.lit("neutral")))
    conf = F.when(raw.isNull(), 0.3).when(by_index, 1.0).when(labels.has_label_prefix(raw), 0.5).otherwise(1.0)
    return joined.select(
        *best.columns,
        text_label.otherwise(labels.canonical(raw)).alias("text_label"),
        conf.alias("mapping_conf"),
    )


def best_units(normalized: DataFrame) -> DataFrame:
    """One row per review and model: of several units the one with the largest score, the lowest unit_id on a tie.

    A missing score counts as 0 and stands behind a real one. Rows of one unit with one score go by their other columns."""
    if "unit_id" not in normalized.columns:
        return normalized
    rest = [c for c in normalized.columns if c not in ("review_id", "model")]
    order = F.struct(F.coalesce("score", F.lit(0.0)), -F.coalesce("unit_id", F.lit(0)), F.col("score").isNotNull(), *rest)
    return normalized.groupBy("review_id", "model").agg(F.max_by(F.struct(*rest), order).alias("_best")).select("review_id", "model", "_best.*")


def add_sentiment(df: DataFrame, normalized: DataFrame, model: str, blank: Column) -> DataFrame:
    """Add sentiment and confidence of one model; a blank text or no score gives 0 / 0.0."""
    best = best_units(normalized.where(F.col("model") == model)).select("review_id", "text_label", "score", "mapping_conf")
    usable = ~blank & F.col("score").isNotNull()
    return df.join(best, "review_id", "left").select(
        *[df[c] for c in df.columns],
        F.when(usable, labels.sentiment_of(F.col("text_label"))).otherwise(0).alias("sentiment"),
        F.when(usable, F.col("score") * F.col("mapping_conf")).otherwise(0.0).alias("confidence"),
    )


def sentiment_signals(normalized: DataFrame, model: str) -> DataFrame:
    """sentiment and confidence of the reviews that the model scored, for a join that fills in the rest."""
    best = best_units(normalized.where(F.col("model") == model)).where("score IS NOT NULL")
    confidence = F.col("score") * F.col("mapping_conf")
    return best.select("review_id", labels.sentiment_of(F.col("text_label")).alias("sentiment"), confidence.alias("confidence"))


def sentiment_result(reviews: DataFrame, normalized: DataFrame, model: str) -> DataFrame:
    """One row per review with sentiment, confidence and the model used."""
    blank = reviews.select("review_id", text.is_blank("text").alias("_blank"))
    rated = add_sentiment(blank, normalized, model, F.col("_blank"))
    return rated.select("review_id", "sentiment", "confidence", F.lit(model).alias("model_used"))


def signed_score(results: DataFrame) -> DataFrame:
    return results.withColumn("sentiment_score", labels.signed(F.col("sentiment"), F.col("confidence")))


def calibrate_label_map(probe_scores: DataFrame, probes: DataFrame) -> DataFrame:
    """Label map of models outside the catalogue.

    probes(probe_id, expected), probe_scores as model_scores with review_id = probe_id.
    The class the model gives to a probe gets the expected name; on a clash the
    probe with the larger id wins. A worded label holding 'pos' or 'neg' is class 1 or 0.
    """
    # Only the scores of the probes are ranked, however many other texts the table holds.
    asked = chosen_ids(probes.select(F.col("probe_id").alias("review_id"))).rows_of(probe_scores)
    best = argmax_label(asked, ("review_id", "model")).withColumnRenamed("review_id", "probe_id")
    low = F.lower("label")
    word_idx = F.when(low.contains("pos"), 1).when(low.contains("neg"), 0)
    numbered = labels.has_label_prefix(F.col("label"))
    seen = best.join(probes, "probe_id").select(
        "model",
        "probe_id",
        F.when(numbered, labels.class_index(F.col("label"))).otherwise(word_idx).alias("idx"),
        F.when(numbered, F.col("expected"))
        .when(word_idx == 1, "positive")
        .when(word_idx == 0, "negative")
        .alias("label"),
    )
    return (
        seen.where(F.col("idx").isNotNull())
        .groupBy("model", "idx")
        .agg(F.max_by("label", "probe_id").alias("label"))
    )


def infer_label_map(model_labels: DataFrame) -> DataFrame:
    """Label map from the label names alone: model_labels(model, pos, label).

    The distinct labels of a model are reduced before the per-model window, so the
    window only sees a handful of rows per model.
    """
    raw = F.col("label")
    distinct = model_labels.groupBy("model", "label").agg(F.min("pos").alias("pos"))
    index = labels.class_index(raw)
    facts = distinct.groupBy("model").agg(
        F.count("*").alias("n_classes"),
        F.bool_or(labels.has_label_prefix(raw)).alias("numbered"),
        F.min(index).alias("low"),
        F.max(index).alias("high"),
    )
    low = F.lower("label")
    named = F.when(low.contains("pos"), "positive").when(low.contains("neg"), "negative").otherwise("neutral")
    entry = lambda idx, label: F.struct(idx.alias("idx"), label.alias("label"))
    two = F.array(entry(F.col("low"), F.lit("negative")), entry(F.col("high"), F.lit("positive")))
    three = F.array(*[entry(F.lit(i), F.lit(name)) for i, name in enumerate(("negative", "neutral", "positive"))])
    by_number = (
        facts.where("numbered")
        .select("model", F.explode(F.when(F.col("n_classes") == 2, two).otherwise(three)).alias("e"))
        .select("model", "e.idx", "e.label")
    )
    by_name = distinct.join(facts.where("not numbered").select("model"), "model", "left_semi").select(
        "model", F.col("pos").alias("idx"), named.alias("label")
    )
    return by_number.unionByName(by_name)


def compare_models(reviews: DataFrame, normalized: DataFrame, models: Sequence[str]) -> DataFrame:
    """Sentiment and confidence of every listed model per review, and how many classes they disagree over."""
    listed = best_units(normalized.where(F.col("model").isin(list(models))))
    picked = listed.select(
        "review_id",
        "model",
        labels.sentiment_of(F.col("text_label")).alias("sentiment"),
        (F.col("score") * F.col("mapping_conf")).alias("confidence"),
    ).where(F.col("confidence").isNotNull())
    wide = picked.groupBy("review_id").pivot("model", list(models)).agg(
        F.first("sentiment").alias("sentiment"), F.first("confidence").alias("confidence")
    )
    blank = reviews.select("review_id", text.is_blank("text").alias("_blank"))
    columns, seen = [], []
    for i, m in enumerate(models, 1):
        usable = ~F.col("_blank")
        sentiment = F.when(usable, F.coalesce(F.col(f"`{m}_sentiment`"), F.lit(0))).otherwise(0)
        confidence = F.when(usable, F.coalesce(F.col(f"`{m}_confidence`"), F.lit(0.0))).otherwise(0.0)
        columns += [sentiment.alias(f"sentiment_{i}"), confidence.alias(f"confidence_{i}")]
        seen.append(sentiment)
    return blank.join(wide, "review_id", "left").select(
        "review_id", *columns, F.size(F.array_distinct(F.array(*seen))).alias("n_opinions")
    )


def model_catalog(spark: SparkSession) -> DataFrame:
    rows = [
        (name, len(classes), {i: c for i, c in enumerate(classes)}, prefix, note)
        for name, (classes, prefix, note) in resources.MODELS.items()
    ]
    return spark.createDataFrame(
        rows, "model string, num_classes int, label_mapping map<int,string>, uses_label_prefix boolean, description string"
    )


def model_info(spark: SparkSession, model: str) -> DataFrame:
    return model_catalog(spark).where(F.col("model") == model)

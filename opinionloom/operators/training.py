"""Training of the fusion forest and of a text classifier."""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, HashingTF, IDF, RegexTokenizer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.joins import lookup_join
from ..functions.lookup import inline_or_none
from ..session import digest, hex_number, scratch
from . import pruning
from .forests import Forest

MAX_CLASSES = 10_000
# Ranges of a feature that a forest can tell apart, and how far the share below a range's end may be off.
BINS = 32
QUANTILE_ERROR = 0.001
# Rows of a task that writes or answers coded rows.
ROWS_A_TASK = 50_000


def _number(name: str) -> Column:
    return F.replace(F.col(name).cast("string"), F.lit("−"), F.lit("-")).try_cast("double")


def clean_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to number with U+2212 read as a minus; what is no number becomes 0."""
    return df.withColumns(
        {c: F.coalesce(F.nanvl(_number(c), F.lit(None).cast("double")), F.lit(0.0)) for c in columns if c in df.columns}
    )


def bad_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many values of each column clean_numeric replaces."""
    bad = [F.count_if(_number(c).isNull() | F.isnan(_number(c))).alias(c) for c in columns if c in df.columns]
    return df.agg(*bad)


def label_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row per label
    return counts.select("label", "n", (F.col("n") / total).alias("share"))


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = "review_id") -> DataFrame:
    """Add fold 0..k-1: rows of a label in hashed order, dealt out in turn.

    A label may hold most rows, so it is never ranked as one group: ranks are taken
    inside 4096 hash ranges per label and shifted by the size of the ranges before.
    """
    keyed = df.withColumn("_hash", digest(F.col(id_col), seed))
    keyed = keyed.withColumn("_range", hex_number(F.col("_hash"), 1, 3).cast("int"))
    before = Window.partitionBy("label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("label", "_range")
        .agg(F.count("*").alias("_n"))
        .select("label", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("label", "_range").orderBy("_hash", id_col)
    ranked = keyed.withColumn("_rank", F.row_number().over(inside))
    same_range = ranked["label"].eqNullSafe(offsets["label"]) & (ranked["_range"] == offsets["_range"])
    joined = ranked.join(offsets, same_range)
    fold = ((F.col("_offset") + F.col("_rank") - 1) % k).cast("int")
    return joined.select(*[ranked[c] for c in df.columns], fold.alias("fold"))


def labelled_rows(df: DataFrame, unlabelled: str = "error") -> DataFrame:
    """The rows with a label. Others raise an error with their number, or are left out with "drop"."""
    absent = F.col("label").isNull() | (F.trim("label") == "")
    if unlabelled == "error":
        n = df.where(absent).count()
        if n:
            raise ValueError(f"{n} rows have no label; label them or pass unlabelled='drop'")
        return df
    if unlabelled != "drop":
        raise ValueError(f"unknown way with unlabelled rows {unlabelled!r}: use error or drop")
    return df.where(~absent)


def class_counts(df: DataFrame) -> dict[str, int]:
    """Rows per label, for the bounded set of classes of a classifier."""
    rows = inline_or_none(df.groupBy("label").count(), MAX_CLASSES)
    if rows is None:
        raise ValueError(f"more than {MAX_CLASSES} different labels: this is no classification table")
    return {r["label"]: r["count"] for r in rows}


def _weights(counts: dict[str, int]) -> dict[str, float]:
    n = sum(counts.values())
    return {label: n / (len(counts) * count) for label, count in counts.items() if count}


def _weight_column(weights: dict[str, float]) -> Column:
    pairs = [F.lit(x) for item in weights.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("label")), F.lit(1.0))


def balanced_weights(df: DataFrame) -> DataFrame:
    """weight = n / (n_classes * n_label), for any number of labels; a row without a label weighs 1."""
    counts = df.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("_n"))
    totals = Window.partitionBy()  # over one row per label
    weights = counts.select("label", (F.sum("_n").over(totals) / (F.count("*").over(totals) * F.col("_n"))).alias("weight"))
    joined = lookup_join(df, weights, ["label"], [c for c in df.columns if c != "label"][:1] or ["label"], "left")
    return joined.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def _label_index(classes: Sequence[str]) -> StringIndexerModel:
    return StringIndexerModel.from_labels(list(classes), inputCol="label", outputCol="label_idx", handleInvalid="skip")


def _classifier(trees: int, depth: int, seed: int, weighted: bool) -> Forest:
    classifier = RandomForestClassifier(
        featuresCol="features",
        labelCol="label_idx",
        numTrees=trees,
        maxDepth=depth,
        maxBins=BINS,
        featureSubsetStrategy="sqrt",
        seed=seed,
    )
    return Forest(classifier.setWeightCol("weight") if weighted else classifier)


def forest(classes: Sequence[str], trees: int = 100, depth: int = 10, seed: int = 42, weighted: bool = True) -> Pipeline:
    """Assembler, label index in alphabetical order and the fusion forest.

    It is grown down to single rows; `pruning.with_least_split` closes the nodes that were too small to split.
    """
    assembler = VectorAssembler(inputCols=schemas.FEATURES, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, _label_index(classes), _classifier(trees, depth, seed, weighted)])


def scoring_stages(model: PipelineModel) -> PipelineModel:
    """The fitted pipeline without the label index, for rows that have no label."""
    return PipelineModel([s for s in model.stages if not isinstance(s, StringIndexerModel)])


def fit_fusion(df: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42, unlabelled: str = "error",
               min_split: int = pruning.MIN_SPLIT) -> tuple[PipelineModel, list[str]]:
    """Fit on all labelled rows; returns the model for scoring and its classes in probability order."""
    # The fit reads its input several times; only label and features are kept. Rows of like features meet the same nodes one
    # after the other, so a task finds their counts in the processor's cache, however many nodes the trees have.
    rows = labelled_rows(df, unlabelled).select("label", *schemas.FEATURES).sortWithinPartitions(*schemas.FEATURES)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    counts = class_counts(rows)
    classes = sorted(counts)
    weighted = rows.withColumn("weight", _weight_column(_weights(counts)))
    *stages, grown = scoring_stages(forest(classes, trees, depth, seed).fit(weighted)).stages
    rows.unpersist()
    return PipelineModel([*stages, pruning.with_least_split(grown, min_split)]), classes


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    importances = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(schemas.FEATURES, map(float, importances), strict=True), key=lambda r: -r[1])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "rank int, feature string, importance double")


def quantile_codes(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """Add `features`, the vector of each column's quantile range as a number from 0; NULL and NaN have a range of their own.

    The ends of the ranges are values that occur, found in one pass over all columns. Equal values share a range.
    """
    shares = [i / (bins - 2) for i in range(1, bins - 2)]  # bins - 3 ends, bins - 2 ranges, and one for what is no number
    ends = df.approxQuantile(list(columns), shares, QUANTILE_ERROR)
    # A range holds what lies above the end before it, up to its own end.
    splits = [[-math.inf, *sorted({math.nextafter(e, math.inf) for e in found} or {0.0}), math.inf] for found in ends]
    given, coded = ([f"_{part}_{i}" for i in range(len(columns))] for part in ("given", "code"))
    numbers = df.withColumns({g: F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for g, c in zip(given, columns, strict=True)})
    ranges = Bucketizer(splitsArray=splits, inputCols=given, outputCols=coded, handleInvalid="keep")
    # The sum drops the mark of a category: a forest is to cut the codes in their order.
    numbered = ranges.transform(numbers).withColumns({c: F.col(c) + 0.0 for c in coded})
    return VectorAssembler(inputCols=coded, outputCol="features").transform(numbered).drop(*given, *coded)


def cross_validate(df: DataFrame, k: int = 5, trees: int = 100, depth: int = 10, seed: int = 42, id_col: str = "review_id",
                   unlabelled: str = "error", min_split: int = pruning.MIN_SPLIT, concurrent: int = 5) -> DataFrame:
    """Predictions of every labelled row by the forest that has not seen it: (fold, review_id, label, prediction).

    Features are reduced to quantile codes once, over all rows and without looking at labels, and every fold learns from
    the same coded table. Up to `concurrent` folds are fitted at a time, as their small jobs leave cores idle. Predictions
    are written to the shared folder fold by fold, so a lost executor costs no fit. An empty table has no predictions;
    a fold that leaves no rows to learn from is an error.
    """
    spark = df.sparkSession
    labelled = labelled_rows(df, unlabelled).select(id_col, "label", *[F.col(c).cast("double").alias(c) for c in schemas.FEATURES])
    folds = stratified_folds(labelled, k, seed, id_col).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {(r["label"], r["fold"]): r["count"] for r in folds.groupBy("label", "fold").count().collect()}  # classes x folds rows
    if not sizes:
        folds.unpersist()
        return folds.select("fold", id_col, "label", F.col("label").alias("prediction")).limit(0)
    classes = sorted({label for label, _ in sizes})
    held = sorted({fold for _, fold in sizes})
    if len(held) < 2:
        folds.unpersist()
        raise ValueError(f"{sum(sizes.values())} rows in one fold leave none to learn from")
    coded = _label_index(classes).transform(quantile_codes(folds, schemas.FEATURES)).select("fold", id_col, "label", "label_idx", "features")
    # By rows: a fit costs far more per byte than the sizes of a shuffle expect.
    parts = -(-sum(sizes.values()) // ROWS_A_TASK)
    coded = coded.repartition(parts, id_col).sortWithinPartitions(id_col).persist(StorageLevel.MEMORY_AND_DISK)
    coded.count()
    folds.unpersist()
    folder = scratch(spark, "folds")
    names = F.array(*[F.lit(c) for c in classes])

    def one(fold: int) -> None:
        counts = {c: sum(n for (label, f), n in sizes.items() if label == c and f != fold) for c in classes}
        train = coded.where(F.col("fold") != fold).withColumn("weight", _weight_column(_weights(counts)))
        model = pruning.with_least_split(_classifier(trees, depth, seed, True).fit(train), min_split)
        answers = model.transform(coded.where(F.col("fold") == fold)).select(
            "fold", id_col, "label", F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction")
        )
        answers.write.parquet(f"{folder}/{fold}")

    try:
        with ThreadPool(max(1, min(concurrent, len(held)))) as pool:
            pool.map(inheritable_thread_target(spark)(one), held)
    finally:
        coded.unpersist()
    return spark.read.parquet(*[f"{folder}/{fold}" for fold in held])


def _safe_ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def classification_report(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    The rows are first reduced to the confusion table; all that follows works on
    classes x classes rows.
    """
    keys = list(by)
    confusion = predictions.groupBy(*keys, "label", "prediction").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )
    per_class = (
        confusion.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, "s.class")
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp"))
        .withColumn("precision", _safe_ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _safe_ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    measures = ["precision", "recall", "f1"]
    support = F.sum("support")
    totals = per_class.groupBy(*keys).agg(
        support.alias("support"),
        _safe_ratio(F.sum("tp"), support).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_safe_ratio(F.sum(F.col(m) * F.col("support")), support).alias(f"weighted_{m}") for m in measures],
    )

    def row(name: str, columns: list[str]) -> Column:
        values = [F.col(c).alias(m) for m, c in zip(measures, columns, strict=True)]
        return F.struct(F.lit(name).alias("class"), *values)

    summary = totals.select(
        *keys,
        "support",
        F.explode(
            F.array(
                row("accuracy", ["accuracy"] * 3),
                row("macro avg", [f"macro_{m}" for m in measures]),
                row("weighted avg", [f"weighted_{m}" for m in measures]),
            )
        ).alias("r"),
    ).select(*keys, "r.*", "support")
    return per_class.select(*keys, "class", *measures, "support").unionByName(summary)


def fold_accuracy(predictions: DataFrame) -> DataFrame:
    right = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    return predictions.groupBy("fold").agg(right.alias("accuracy"))


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    return fold_metrics.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))


def held_out(df: DataFrame, share: float = 0.2, seed: int = 42, id_col: str = "review_id") -> tuple[DataFrame, DataFrame]:
    """(train, test) split by a hash of the id: stable across runs and lost tasks."""
    bucket = hex_number(digest(F.col(id_col), seed), 1, 4)
    cut = int(share * 16**4)
    return df.where(bucket >= cut), df.where(bucket < cut)


def train_text_classifier(df: DataFrame, seed: int = 42, n_features: int = 1 << 18, iterations: int = 20,
                          share: float = 0.2, unlabelled: str = "error") -> tuple[PipelineModel, list[str], DataFrame]:
    """Fit a sentiment classifier on (review_id, text, label) and measure it on held-out rows.

    Returns the model, its classes and the held-out predictions (label, prediction).
    """
    df = labelled_rows(df, unlabelled)
    train, test = held_out(df, share, seed)
    classes = sorted(class_counts(df))
    index = StringIndexerModel.from_labels(classes, inputCol="label", outputCol="label_idx", handleInvalid="skip")
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\p{L}+", gaps=False),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=n_features),
        IDF(inputCol="counts", outputCol="features"),
        index,
        LogisticRegression(featuresCol="features", labelCol="label_idx", maxIter=iterations, regParam=0.01),
    ]
    model = scoring_stages(Pipeline(stages=stages).fit(train))
    names = F.array(*[F.lit(c) for c in classes])
    predicted = model.transform(test).select(
        "review_id", "label", F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction")
    )
    return model, classes, predicted

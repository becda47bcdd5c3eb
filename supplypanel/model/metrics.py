"""Ranking and calibration metrics of scored rows.

Scored rows have a ``score`` and a 0/1 ``label``. Metrics read a histogram of
distinct scores, ranked without a single-task sort, so ties are exact and a
score shared by many rows costs one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplypanel.functions.columns import safe_ratio
from supplypanel.operators.order_statistics import quantiles_of_histogram, running_totals
from supplypanel.operators.ranking import ranked_top
from supplypanel.plans.mart import OFFER
from supplypanel.plans.risk import TEST, TRAIN

TOP_SIZES = (100, 500, 1000, 5000)
ROW_KEYS = ("reference_year", *OFFER)


def chronological_split(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, or an error if the split is not one by time."""
    split = F.col("split")
    years = {
        row["split"]: set(row["years"])
        for row in training.where(split.isin(TRAIN, TEST))
        .groupBy("split")
        .agg(F.collect_set("reference_year").alias("years"))
        .toLocalIterator()
    }
    train, test = years.get(TRAIN, set()), years.get(TEST, set())
    if not train or not test:
        raise ValueError("no training or no test rows")
    if train & test:
        raise ValueError(f"years in both training and test: {sorted(train & test)}")
    if min(test) <= max(train):
        raise ValueError("the split is not chronological: test years must come later")
    return training.where(split == TRAIN), training.where(split == TEST)


def score_histogram(scored: DataFrame) -> DataFrame:
    """Rows and events for each distinct score."""
    return scored.groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("events")
    )


def evaluate(scored: DataFrame, model_name: str, split: str) -> DataFrame:
    """One row: size, event rate, ROC AUC, average precision and Brier score.

    AUC counts tied pairs half. Average precision adds precision times the
    gain in recall over the distinct scores, without interpolation. The Brier
    score is null unless every score is a probability.
    """
    ranked = running_totals(score_histogram(scored), [], "score", ["n", "events"])
    c = F.col
    others = c("n") - c("events")
    others_below = c("before_n") - c("before_events")
    won = c("events").cast("double") * (others_below.cast("double") + others / F.lit(2.0))
    precision = safe_ratio(c("total_events") - c("before_events"), c("total_n") - c("before_n"))
    squared = c("events") * F.pow(c("score") - 1, 2) + others * F.pow(c("score"), 2)
    totals = ranked.agg(
        F.sum("n").alias("row_count"),
        F.sum("events").alias("_events"),
        F.sum(won).alias("_won"),
        F.sum(c("events") * precision).alias("_precision"),
        F.sum(squared).alias("_squared"),
        F.min("score").alias("_low"),
        F.max("score").alias("_high"),
    )
    pairs = c("_events").cast("double") * (c("row_count") - c("_events")).cast("double")
    return totals.select(
        F.lit(model_name).alias("model_name"),
        F.lit(split).alias("split"),
        "row_count",
        safe_ratio("_events", "row_count").alias("event_rate"),
        safe_ratio("_won", pairs).alias("roc_auc"),
        safe_ratio("_precision", "_events").alias("average_precision"),
        F.when((c("_low") >= 0) & (c("_high") <= 1), safe_ratio("_squared", "row_count")).alias(
            "brier_score"
        ),
    )


def precision_at_k(
    scored: DataFrame, model_name: str, split: str, sizes=TOP_SIZES, keys=ROW_KEYS
) -> DataFrame:
    """Event rate among the k highest scores; sizes above the row count drop out.

    Equal scores are ordered by key. The largest size may be any share of the rows.
    """
    top = ranked_top(scored.select("score", "label", *keys), "score", keys, max(sizes))
    inside = F.col("position") <= F.col("k")
    return (
        top.select("position", "label", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("k"))
        .groupBy("k")
        .agg(
            F.avg(F.when(inside, F.col("label").cast("double"))).alias("precision"),
            F.count(F.lit(1)).alias("_available"),
        )
        .where(F.col("_available") >= F.col("k"))
        .select(
            F.lit(model_name).alias("model_name"), F.lit(split).alias("split"), "k", "precision"
        )
        .orderBy("k")
    )


def calibration_table(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Predicted against observed rate in bins of equal size.

    Edges are exact quantiles, repeated edges merged; a bin includes its lower
    edge, the last one both. Bins without rows do not appear.
    """
    histogram = score_histogram(scored)
    fractions = [(i, bins) for i in range(bins + 1)]
    edges = quantiles_of_histogram(histogram, [], "score", "n", fractions).select(
        F.array_distinct("quantiles")
    ).scalar()
    located = histogram.withColumn("_edges", edges)
    at_or_below = F.size(F.filter("_edges", lambda edge: edge <= F.col("score")))
    last_bin = F.size("_edges") - 2
    return (
        located.where(F.size("_edges") >= 2)
        .withColumn("bin", F.greatest(F.least(at_or_below - 1, last_bin), F.lit(0)))
        .groupBy("bin")
        .agg(
            F.sum("n").alias("row_count"),
            safe_ratio(F.sum(F.col("score") * F.col("n")), F.sum("n")).alias("mean_predicted"),
            safe_ratio(F.sum("events"), F.sum("n")).alias("observed_rate"),
        )
        .orderBy("bin")
    )


def scale_scores(rows: DataFrame) -> DataFrame:
    """Ranks offers by nothing but their size, smallest first.

    What a score this simple reaches is arithmetic of the label and not
    something the model has learnt. Unknown sizes rank last.
    """
    size = -F.col("enrollments").cast("double")
    lowest = rows.agg(F.min(size)).scalar()
    return rows.withColumns(
        {"score": F.coalesce(size, lowest), "label": F.col("deteriorated").cast("int")}
    )


def union_all(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

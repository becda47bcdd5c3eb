"""Imputation, standardization and indicators, learnt from training rows.

What is learnt is a handful of numbers per feature: Spark computes them as
aggregates, and applying them is a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.operators.order_statistics import quantiles_of_histogram
from supplypanel.operators.ranking import top_per_group
from supplypanel.sources.tables import settled

# The model's inputs, in order.
NUMERIC = [
    "occupancy_rate",
    "occupancy_rate_lag1",
    "occupancy_change_1y",
    "applications_per_seat",
    "graduation_intensity",
    "low_occupancy_share_to_date",
    "current_low_occupancy_streak",
    "mean_occupancy_to_date",
    "demand_volatility_to_date",
    "enrollment_growth_1y",
    "enrollment_growth_2y",
    "seat_growth_1y",
    "years_observed_to_date",
    "offered_seats",
    "enrollments",
    "institution_offer_count",
    "institution_enrollment_hhi",
]
CATEGORICAL = ["teaching_modality", "education_network", "administrative_category"]
FEATURES = NUMERIC + CATEGORICAL

RARE_SHARE = 0.01


def feature_histogram(rows: DataFrame, by=(), features=FEATURES) -> DataFrame:
    """Rows for each feature and value (nulls too), in one scan: the state from which all statistics follow.

    Histograms add up. With ``by``, say the year, those of any window of years
    come from the same state.
    """
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features
    ]
    return rows.select(*by, F.inline(F.array(*pairs))).groupBy(*by, "feature", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def merged_windows(state: DataFrame, windows: dict[str, list[int] | None]) -> DataFrame:
    """The histogram of each window of years, from one state by ``reference_year``.

    ``windows`` are named lists of years, so their table is as small as a series is long. None stands for all rows.
    """
    members = [(name, year) for name, years in windows.items() for year in years or ()]
    table = state.sparkSession.createDataFrame(members, "window string, reference_year int")
    dealt = state.join(F.broadcast(table), "reference_year")
    for name in [n for n, years in windows.items() if years is None]:
        dealt = dealt.unionByName(state.withColumn("window", F.lit(name)))
    return dealt.groupBy("window", "feature", "value").agg(F.sum("n").alias("n"))


def numeric_summary(histogram: DataFrame, by=()) -> DataFrame:
    """Median of each numeric feature, and mean and spread after imputing it, from a settled histogram.

    The spread is the population standard deviation. A feature without any
    value has no row and is left out of the model.
    """
    keys = [*by, "feature"]
    numeric = histogram.where(F.col("feature").isin(*NUMERIC))
    known = numeric.where(F.col("value").isNotNull())
    medians = quantiles_of_histogram(known, keys, "value", "n", [(1, 2)], few_groups=True).select(
        *keys, F.col("quantiles")[0].alias("median")
    )
    here = F.when(F.col("value").isNotNull(), F.col("n"))
    totals = numeric.groupBy(*keys).agg(
        F.sum("n").cast("double").alias("_total"), F.sum(here).alias("present"),
        (F.sum(F.col("value") * here) / F.sum(here)).alias("_avg"),
    )
    # One row for each feature (and window): small whatever the rows.
    centred = known.join(F.broadcast(totals), keys)
    spread = centred.groupBy(*keys, "_total", "present", "_avg").agg(
        (F.sum(F.col("n") * F.pow(F.col("value") - F.col("_avg"), 2)) / F.col("present")).alias("_var")
    )
    # Adding `missing` copies of the median shifts mean and variance in closed form.
    missing = F.col("_total") - F.col("present")
    mean = (F.col("_avg") * F.col("present") + F.col("median") * missing) / F.col("_total")
    within = F.col("present") * (F.col("_var") + F.pow(F.col("_avg") - F.col("mean"), 2))
    between = missing * F.pow(F.col("median") - F.col("mean"), 2)
    return (
        spread.join(medians, keys)
        .withColumn("mean", mean)
        .withColumn("deviation", F.sqrt((within + between) / F.col("_total")))
        .select(*keys, "present", "median", "mean", "deviation")
    )


def category_summary(histogram: DataFrame, by=()) -> DataFrame:
    """Rows per categorical feature and level, nulls counted as the most frequent level.

    Among equally frequent levels the smallest takes the nulls.
    """
    keys = [*by, "feature"]
    levels = histogram.where(F.col("feature").isin(*CATEGORICAL)).withColumnsRenamed(
        {"value": "level", "n": "present"}
    )
    known = levels.where(F.col("level").isNotNull())
    here = F.when(F.col("level").isNotNull(), F.col("present")).otherwise(0)
    totals = levels.groupBy(*keys).agg(F.sum("present").alias("_total"), F.sum(here).alias("_known"))
    modes = top_per_group(known, keys, [F.desc("present"), "level"]).select(
        *keys, F.col("level").alias("_mode")
    )
    is_mode = F.col("level") == F.col("_mode")
    rows_with_nulls = F.col("present") + F.when(is_mode, F.col("_total") - F.col("_known")).otherwise(0)
    return known.join(totals, keys).join(modes, keys).select(
        *keys, "level", is_mode.alias("is_mode"), rows_with_nulls.alias("rows"),
        (rows_with_nulls < F.col("_total") * F.lit(RARE_SHARE)).alias("is_rare"),
    )


def numeric_statistics(rows: DataFrame) -> DataFrame:
    """``numeric_summary`` of rows."""
    return numeric_summary(settled(feature_histogram(rows, features=NUMERIC)))


def category_counts(rows: DataFrame) -> DataFrame:
    """``category_summary`` of rows."""
    return category_summary(settled(feature_histogram(rows, features=CATEGORICAL)))


@dataclass(frozen=True)
class Category:
    mode: float
    frequent: list[float]
    has_rare: bool

    @property
    def indicators(self) -> list[float | None]:
        """Levels with a column of their own; ``None`` stands for all rare ones.

        The first is the reference and has none.
        """
        levels: list[float | None] = [*self.frequent, *([None] if self.has_rare else [])]
        return levels[1:]


@dataclass(frozen=True)
class Preparation:
    numeric: dict[str, tuple[float, float, float]]
    categorical: dict[str, Category]
    names: list[str] = field(default_factory=list)

    def inputs(self) -> list[Column]:
        """The prepared value of each model input, in the order of ``names``."""
        columns = []
        for name, (median, mean, deviation) in self.numeric.items():
            value = F.coalesce(F.col(name).cast("double"), F.lit(median))
            columns.append((value - F.lit(mean)) / F.lit(deviation or 1.0))
        for name, category in self.categorical.items():
            value = F.coalesce(F.col(name).cast("double"), F.lit(category.mode))
            for level in category.indicators:
                hit = ~value.isin(*category.frequent) if level is None else value == level
                columns.append(hit.cast("double"))
        return columns

    def apply(self, rows: DataFrame, name: str = "inputs") -> DataFrame:
        return rows.withColumn(name, F.array(*self.inputs()))

    def steps(self) -> list[tuple]:
        """``inputs`` as plain values: feature, what stands for null, and how the value becomes an input."""
        found: list[tuple] = [
            (name, median, "scale", mean, deviation or 1.0)
            for name, (median, mean, deviation) in self.numeric.items()
        ]
        for name, category in self.categorical.items():
            for level in category.indicators:
                found.append((name, category.mode, "rare", tuple(category.frequent), None) if level is None
                             else (name, category.mode, "level", level, None))
        return found


def design_of(steps: list[tuple]):
    """A function from columns of numbers, by feature and with NaN for null, to the matrix of inputs.

    It is a closure over plain values, so workers need no copy of this package.
    """
    import numpy as np

    def design(columns: dict) -> np.ndarray:
        parts = []
        for name, default, kind, a, b in steps:
            value = np.where(np.isnan(columns[name]), default, columns[name])
            if kind == "scale":
                parts.append((value - a) / b)
            else:
                parts.append((value == a if kind == "level" else ~np.isin(value, a)).astype(float))
        # A line in memory for each input, a row for each row.
        return np.stack(parts).T if parts else np.empty((len(next(iter(columns.values()))), 0))

    return design


def _learnt(numeric: dict, categorical: dict) -> Preparation:
    numeric = {name: numeric[name] for name in NUMERIC if name in numeric}
    categorical = {name: categorical[name] for name in CATEGORICAL if name in categorical}
    names = [f"numeric__{name}" for name in numeric]
    for name, category in categorical.items():
        names += [
            f"categorical__{name}_{'infrequent' if level is None else level}"
            for level in category.indicators
        ]
    return Preparation(numeric, categorical, names)


def fit_preparations(
    rows: DataFrame, windows: dict[str, list[int] | None], histogram: DataFrame | None = None,
) -> dict[str, Preparation]:
    """The preparation of each window of years (None for all rows), from one scan of ``rows`` or their settled ``histogram`` by year.

    What comes back to the driver is bounded: for each window a row per numeric
    feature, and per category its mode and the levels that hold at least one row in a hundred.
    """
    state = settled(feature_histogram(rows, ["reference_year"])) if histogram is None else histogram
    return _fit(settled(merged_windows(state, windows)), list(windows))


def fit_preparation(rows: DataFrame) -> Preparation:
    """The preparation learnt from all ``rows``."""
    histogram = settled(feature_histogram(rows).withColumn("window", F.lit("all")))
    return _fit(histogram, ["all"])["all"]


def _fit(histogram: DataFrame, windows: list[str]) -> dict[str, Preparation]:
    numeric: dict[str, dict] = {w: {} for w in windows}
    categorical: dict[str, dict] = {w: {} for w in windows}
    for r in numeric_summary(histogram, ["window"]).collect():
        numeric[r.window][r.feature] = (r.median, r.mean, r.deviation)
    levels = category_summary(histogram, ["window"]).groupBy("window", "feature").agg(
        F.max(F.when(F.col("is_mode"), F.col("level"))).alias("mode"),
        F.array_sort(F.collect_list(F.when(~F.col("is_rare"), F.col("level")))).alias("frequent"),
        F.bool_or("is_rare").alias("has_rare"),
    )
    for r in levels.collect():
        categorical[r.window][r.feature] = Category(r.mode, r.frequent, r.has_rare)
    return {w: _learnt(numeric[w], categorical[w]) for w in windows}

"""Fitted models and what is read from them."""

from __future__ import annotations

from dataclasses import dataclass
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplypanel.model.boosting import Boosted, fit_boosted
from supplypanel.model.isotonic import isotonic_blocks, with_mean
from supplypanel.model.logistic import LogisticFit, fit_logistic
from supplypanel.model.metrics import ROW_KEYS
from supplypanel.model.preparation import FEATURES, Preparation, fit_preparation, fit_preparations
from supplypanel.operators.ranking import numbered_top, top_per_group
from supplypanel.plans.mart import OFFER

VALIDATION_PERCENT = 15
MIN_LEAF_ROWS = 20
#: Digits of log-odds that rank: beyond them equal rows may differ by the order of a sum.
RANK_DIGITS = 8


def _label() -> Column:
    return F.col("deteriorated").cast("int")


def _sigmoid(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


@dataclass(frozen=True)
class ReferenceModel:
    """Logistic regression over prepared inputs."""

    preparation: Preparation
    coefficients: list[float]
    intercept: float
    c: float = 1.0
    fit: LogisticFit | None = None

    def convergence(self, spark: SparkSession) -> DataFrame:
        """One row that proves the fit: rows, steps, and the largest entry of the mean loss's gradient."""
        if self.fit is None:
            raise ValueError("a model of stated weights was not fitted")
        return spark.createDataFrame(
            [(self.fit.n, self.fit.steps, self.fit.gradient_norm)], "n long, steps int, gradient_norm double")

    def log_odds(self) -> Column:
        total = F.lit(self.intercept)
        for weight, value in zip(self.coefficients, self.preparation.inputs()):
            total = total + F.lit(weight) * value
        return total

    def probability(self) -> Column:
        return _sigmoid(self.log_odds())

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``log_odds`` and the probability ``score``; label where known."""
        scored = rows.withColumn("log_odds", self.log_odds()).withColumn(
            "score", _sigmoid(F.col("log_odds"))
        )
        return scored.withColumn("label", _label()) if "deteriorated" in rows.columns else scored

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        """One row per input: its weight and odds ratio, largest effect first."""
        rows = list(zip(self.preparation.names, self.coefficients))
        return spark.createDataFrame(rows, "feature string, coefficient double").select(
            "feature", "coefficient", F.exp("coefficient").alias("odds_ratio")
        ).orderBy(F.desc(F.abs("coefficient")), "feature")

    def explain(self, rows: DataFrame, top_n: int = 5) -> DataFrame:
        """Splits each prediction into the contributions of its inputs.

        Exact, not approximate: the log-odds are the intercept plus the
        contributions. The largest ``top_n`` are kept, by magnitude.
        """
        parts = F.array(
            *[
                F.struct(
                    F.lit(name).alias("feature"),
                    value.alias("transformed_value"),
                    (F.lit(weight) * value).alias("contribution"),
                )
                for name, weight, value in zip(
                    self.preparation.names, self.coefficients, self.preparation.inputs()
                )
            ]
        )

        def larger_first(a, b):
            gap = F.abs(b["contribution"]) - F.abs(a["contribution"])
            by_name = F.when(a["feature"] < b["feature"], -1).otherwise(1)
            return F.when(gap == 0, by_name).otherwise(F.signum(gap).cast("int"))

        return self.score(rows).select(
            *rows.columns,
            F.col("score").alias("predicted_probability"),
            F.lit(self.intercept).alias("intercept"),
            "log_odds",
            F.slice(F.array_sort(parts, larger_first), 1, top_n).alias("top_contributions"),
        )


def fit_reference_model(
    rows: DataFrame, c: float = 1.0, together: ReferenceFits | None = None, name: str = "",
) -> ReferenceModel:
    """L2 logistic regression on standardized inputs, intercept unpenalized, the penalty stated for summed losses.

    With ``together`` it is the model ``name`` of these fits, whose window then holds just ``rows``.
    """
    if together is not None:
        return together[name]
    preparation = fit_preparation(rows)
    (fit,) = fit_logistic(rows, [(preparation, None)], c)
    return _reference(preparation, fit, c)


def fit_reference_models(
    rows: DataFrame, windows: dict[str, list[int] | None], c: float = 1.0, histogram: DataFrame | None = None,
) -> dict[str, ReferenceModel]:
    """One reference model for each window of years (None for all): one scan for all preparations, and one for all fits.

    ``histogram`` is the settled one of the rows by year, where it is known.
    """
    preparations = fit_preparations(rows, windows, histogram)
    fits = fit_logistic(rows, [(preparations[w], years) for w, years in windows.items()], c)
    return {w: _reference(preparations[w], fit, c) for w, fit in zip(windows, fits)}


class ReferenceFits:
    """Reference models of several windows of years of the same rows, fitted together when the first is asked for; for threads."""

    def __init__(self, rows: DataFrame, windows: dict[str, list[int] | None], histogram: DataFrame | None = None):
        self._inputs, self._lock, self._models = (rows, windows, histogram), Lock(), {}

    def __getitem__(self, name: str) -> ReferenceModel:
        with self._lock:
            if not self._models:
                rows, windows, histogram = self._inputs
                self._models = fit_reference_models(rows, windows, histogram=histogram)
        return self._models[name]


def _reference(preparation: Preparation, fit: LogisticFit, c: float) -> ReferenceModel:
    return ReferenceModel(preparation, fit.coefficients, fit.intercept, c, fit)


def penalised_gradient(model: ReferenceModel, rows: DataFrame) -> DataFrame:
    """feature and gradient of the mean penalised loss at the model's weights, by column expressions.

    All are zero for a model that was fitted to these rows; the intercept is the feature ``intercept``.
    """
    error = F.col("score") - F.col("label")
    scored = model.score(rows).withColumn("_inputs", F.array(*model.preparation.inputs(), F.lit(1.0)))
    names = [*model.preparation.names, "intercept"]
    penalty = F.array(*[F.lit(w / model.c) for w in model.coefficients], F.lit(0.0))
    sums = scored.select(F.posexplode("_inputs").alias("place", "value"), error.alias("_error")).groupBy("place").agg(
        F.sum(F.col("value") * F.col("_error")).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return sums.select(
        F.array(*[F.lit(n) for n in names])[F.col("place")].alias("feature"),
        ((F.col("_sum") + penalty[F.col("place")]) / F.col("_n")).alias("gradient"),
    )


@dataclass(frozen=True)
class ComparisonModel:
    """Boosted trees over raw values; missing ones go their own way at each split."""

    trees: Boosted

    def score(self, rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("score", _sigmoid(self.trees.log_odds()))
        return scored.withColumn("label", _label()) if "deteriorated" in rows.columns else scored


def fit_comparison_model(
    rows: DataFrame, max_iter: int = 300, learning_rate: float = 0.05, max_depth: int = 5,
    histogram: DataFrame | None = None,
) -> ComparisonModel:
    """Gradient boosting that stops when held-out rows no longer improve.

    A key hash holds out 15 % of the rows. Categories enter as numbers. ``histogram``
    is the settled one of the rows, by whatever keys, where it is known.
    """
    keys = [k for k in ROW_KEYS if k in rows.columns]
    held_out = F.pmod(F.xxhash64(*keys), F.lit(100)) < VALIDATION_PERCENT
    return ComparisonModel(fit_boosted(
        rows, _label(), held_out, FEATURES, max_iter, learning_rate, max_depth, least_rows=MIN_LEAF_ROWS,
        histogram=histogram))


@dataclass(frozen=True)
class CalibratedModel:
    """A fixed base model with one monotone map over its log-odds."""

    base: ReferenceModel
    blocks: DataFrame

    def score(self, rows: DataFrame) -> DataFrame:
        return with_mean(self.base.score(rows).drop("score"), "log_odds", self.blocks, "score")


def fit_calibrated_model(base: ReferenceModel, rows: DataFrame) -> CalibratedModel:
    """Isotonic calibration of a base model that is not fitted again."""
    histogram = base.score(rows).groupBy(F.col("log_odds").alias("value")).agg(
        F.sum(F.col("label").cast("long")).alias("events"), F.count(F.lit(1)).alias("n"))
    return CalibratedModel(base, isotonic_blocks(histogram))


def highest_risk(
    model: ReferenceModel, rows: DataFrame, n: int = 20, top_n: int = 5, keys=ROW_KEYS
) -> DataFrame:
    """The riskiest offers with their explanation and what then happened."""
    needed = list(dict.fromkeys([*keys, *FEATURES, "deteriorated"]))
    # Log-odds and not probabilities, which are all 1 from some size on.
    order = [F.desc(F.round("log_odds", RANK_DIGITS)), *keys]
    top = numbered_top(model.score(rows.select(*needed)), order, n).select("position", *needed)
    return model.explain(top, top_n).select(
        "position", *keys, "predicted_probability", "intercept", "log_odds", "top_contributions",
        F.col("deteriorated").alias("observed_deterioration"),
    ).orderBy("position")


def score_year(labelled: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """Risk of offers whose horizon is still open, from all labelled rows."""
    years = [
        {r.reference_year for r in part.select("reference_year").distinct().collect()}
        for part in (labelled, unlabelled)
    ]
    if not years[0] or not years[1]:
        raise ValueError("no labelled or no unlabelled rows")
    if years[0] & years[1]:
        raise ValueError(f"years both labelled and to be scored: {sorted(years[0] & years[1])}")
    return fit_reference_model(labelled).score(unlabelled).withColumnRenamed("score", "risk")


def audit_list(risks: DataFrame, institutions: DataFrame, year: int, n: int = 15) -> DataFrame:
    """The riskiest offer of each institution, riskiest institutions first."""

    ranked = F.round("log_odds", RANK_DIGITS) if "log_odds" in risks.columns else F.col("risk")
    order = [F.desc(ranked), *OFFER]
    names = institutions.where(F.col("census_year") == year).select(
        "institution_id", "institution_name", "institution_state"
    )
    one_each = top_per_group(risks, ["institution_id"], order)
    leading = one_each.orderBy(*order).limit(n)
    return leading.join(names, "institution_id", "left").orderBy(*order).select(
        *OFFER, "reference_year", "course_name", "institution_name", "institution_state",
        "enrollments", "occupancy_rate", "risk",
    )

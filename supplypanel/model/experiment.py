"""The out-of-time experiment and the stability of the model over windows."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplypanel.functions.columns import safe_ratio
from supplypanel.model.metrics import (
    ROW_KEYS, calibration_table, chronological_split, evaluate, precision_at_k, scale_scores,
    union_all,
)
from supplypanel.model.models import (
    ReferenceFits, fit_calibrated_model, fit_comparison_model, fit_reference_model, fit_reference_models, highest_risk,
)
from supplypanel.model.preparation import feature_histogram
from supplypanel.operators.comparison import jaccard
from supplypanel.operators.ranking import ranked_top
from supplypanel.plans.risk import TEST, TRAIN
from supplypanel.sources.tables import settled

# The names under which the models report.
REFERENCE, COMPARISON = "regressao_logistica", "gradient_boosting"
SHORT_FIT, CALIBRATED, SCALE_ONLY = "logistica_ajuste_curto", "logistica_calibrada", "apenas_escala"
CALIBRATION_YEAR = 2020


def _years(rows: DataFrame) -> list[int]:
    return sorted(r.reference_year for r in rows.select("reference_year").distinct().collect())


def _kept(scored: DataFrame) -> DataFrame:
    """Keys, score and label, computed once: every metric reads them again."""
    return settled(scored.select(*ROW_KEYS, "score", "label"))


def _together(spark: SparkSession, *tasks: Callable) -> list:
    """What the tasks return, in their order; their Spark jobs run at the same time. An error is that of the first task that fails."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [r.result() for r in running]


def _windows(years: list[int], window: int) -> dict[str, list[int]]:
    return {f"{years[i]}-{years[i + window - 1]}": years[i : i + window] for i in range(len(years) - window + 1)}


def calibrated_pair(train: DataFrame, calibration_year: int, together: ReferenceFits | None = None):
    """Base model fitted before the calibration year, and its calibrated form.

    ``None`` if either side of the calibration year has no rows. With ``together``
    the base model is the one of these fits named ``SHORT_FIT``.
    """
    fit_rows = train.where(F.col("reference_year") < calibration_year)
    calibration_rows = train.where(F.col("reference_year") == calibration_year)
    if fit_rows.isEmpty() or calibration_rows.isEmpty():
        return None
    base = fit_reference_model(fit_rows, together=together, name=SHORT_FIT)
    return base, fit_calibrated_model(base, calibration_rows)


def run_experiment(
    training: DataFrame,
    calibration_year: int = CALIBRATION_YEAR,
    window: int = 3,
    top_k: int = 1000,
    boosting_iterations: int = 300,
) -> dict[str, DataFrame]:
    """Fits on the training years, evaluates on the test years.

    Returns the report's sections, each a DataFrame. ``training`` is read by
    every fit, so hand in a written or persisted table. One histogram by year serves all fits, and the logistic ones,
    of whatever years, are fitted together; boosting and these do not depend on
    each other: their jobs run side by side, and each model is evaluated when it is fitted.
    """
    spark = training.sparkSession
    train, test = chronological_split(training)
    years = _years(train)
    before = [y for y in years if y < calibration_year]
    spans = {REFERENCE: None, **_windows(years, window)}
    if before and calibration_year in years:
        spans[SHORT_FIT] = before
    histogram = settled(feature_histogram(train, ["reference_year"]))
    together = ReferenceFits(train, spans, histogram)

    def reported(rows: DataFrame, name: str, split: str) -> dict[str, DataFrame]:
        found = {"evaluations": evaluate(rows, name, split), "precision_at_k": precision_at_k(rows, name, split)}
        if split == TEST and name != SCALE_ONLY:
            found["calibration"] = calibration_table(rows)
        return found

    def both_splits(model, name: str) -> list[dict]:
        return _together(spark, *[
            lambda rows=rows, split=split: reported(_kept(model.score(rows)), name, split)
            for split, rows in ((TRAIN, train), (TEST, test))
        ])

    def of_reference() -> tuple:
        model = fit_reference_model(train, together=together, name=REFERENCE)
        return (model.coefficient_table(spark), highest_risk(model, test)), both_splits(model, REFERENCE)

    def of_comparison() -> list[dict]:
        return both_splits(fit_comparison_model(train, max_iter=boosting_iterations, histogram=histogram), COMPARISON)

    def of_pair() -> list[dict]:
        pair = calibrated_pair(train, calibration_year, together)
        return [
            reported(_kept(model.score(test)), name, TEST) for name, model in zip((SHORT_FIT, CALIBRATED), pair or ())
        ]

    (read, reference), comparison, pair, scale, stability = _together(
        spark, of_reference, of_comparison, of_pair, lambda: reported(scale_scores(test), SCALE_ONLY, TEST),
        lambda: rolling_stability(training, window, top_k, together),
    )
    sections = {
        "reference_coefficients": read[0],
        "reference_calibration": reference[1]["calibration"],
        "comparison_calibration": comparison[1]["calibration"],
        "highest_risk_explanations": read[1],
    }
    sections.update(zip(("base_calibration", "calibrated_calibration"), [p["calibration"] for p in pair]))
    reports = [*reference, *comparison, *pair, scale]
    for section in ("evaluations", "precision_at_k"):
        sections[section] = union_all([r[section] for r in reports])
    return sections | stability


def rolling_stability(
    training: DataFrame, window: int = 3, top_k: int = 1000, together: ReferenceFits | None = None,
) -> dict[str, DataFrame]:
    """How the model changes as its window of training years slides.

    Sections: metrics per window, overlap of the ``top_k`` offers of
    neighbouring windows, coefficients per window, and the features whose sign
    flips or holds. With ``together`` the windows' models are those of these fits.
    """
    spark = training.sparkSession
    train, test = chronological_split(training)
    windows = _windows(_years(train), window)
    if len(windows) < 2:
        raise ValueError("stability needs at least two training windows")

    models = fit_reference_models(train, windows) if together is None else {w: together[w] for w in windows}
    # All windows score the test rows in one pass.
    scores = [
        F.struct(F.lit(name).alias("window"), model.probability().alias("score")) for name, model in models.items()
    ]
    scored = settled(test.select(
        *ROW_KEYS, F.col("deteriorated").cast("int").alias("label"), F.inline(F.array(*scores))))
    metrics, tops, coefficients = [], [], []
    for label, model in models.items():
        own = scored.where(F.col("window") == label).drop("window")
        at_k = precision_at_k(own, label, TEST, (top_k,)).select("precision")
        metrics.append(
            evaluate(own, label, TEST).select(
                F.col("model_name").alias("window"), "roc_auc", "average_precision",
                at_k.scalar().alias("precision_at_k"),
            )
        )
        tops.append((label, ranked_top(own, "score", ROW_KEYS, top_k).select(*ROW_KEYS)))
        coefficients.append(
            model.coefficient_table(spark).select("feature", F.lit(label).alias("window"), "coefficient")
        )

    overlaps = [
        jaccard(now, following, ROW_KEYS).select(
            F.lit(f"{label} vs {next_label}").alias("windows"), "jaccard"
        )
        for (label, now), (next_label, following) in zip(tops, tops[1:])
    ]
    by_window = reduce(DataFrame.unionByName, coefficients)
    return {
        "stability_windows": union_all(metrics),
        "stability_overlap": union_all(overlaps),
        "stability_coefficients": by_window,
        **sign_sections(by_window),
    }


def sign_sections(by_window: DataFrame, stable: int = 8) -> dict[str, DataFrame]:
    """Features whose coefficient changes its sign between windows, and the strongest that never do.

    ``by_window`` has feature, window and coefficient.
    """
    size = F.abs("coefficient")
    signs = by_window.groupBy("feature").agg(
        F.countDistinct(F.col("coefficient") > 0).alias("_signs"),
        F.max(size).alias("max_absolute_coefficient"),
        F.min(size).alias("min_absolute_coefficient"),
        F.array_sort(F.collect_list(F.struct("window", "coefficient"))).alias("coefficients"),
    )
    return {
        "sign_flipping_features": signs.where("_signs > 1")
        .select("feature", "max_absolute_coefficient", "coefficients")
        .orderBy(F.desc("max_absolute_coefficient"), "feature"),
        "sign_stable_features": signs.where("_signs = 1")
        .select("feature", "min_absolute_coefficient", "coefficients")
        .orderBy(F.desc("min_absolute_coefficient"), "feature")
        .limit(stable),
    }


def calibration_gaps(tables: dict[str, DataFrame]) -> DataFrame:
    """Mean calibration error of several calibration tables, weighted by rows."""
    gap = F.abs(F.col("mean_predicted") - F.col("observed_rate")) * F.col("row_count")
    return union_all(
        [
            table.agg(safe_ratio(F.sum(gap), F.sum("row_count")).alias("calibration_error")).select(
                F.lit(name).alias("model_name"), "calibration_error"
            )
            for name, table in tables.items()
        ]
    )

"""

The driver's tables stand in for the yearly editions: an adapter reads order
lines and suppliers as raw course and institution text, and everything else is
the library run on that. Reference-year parameters follow those data.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce
from hashlib import md5
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles  # noqa: E402
from supplypanel.functions.columns import typed  # noqa: E402
from supplypanel.model import (  # noqa: E402
    boosting, experiment, isotonic, logistic, metrics, models, preparation,
)
from supplypanel.operators import comparison, ranges, ranking  # noqa: E402
from supplypanel.plans import (  # noqa: E402
    checks, completion, mart, panel, portfolio, reports, risk, staging,
)
from supplypanel.sources import editions, layout, tables, versions  # noqa: E402
from supplypanel.sources import lineitem_census as census  # noqa: E402

try:  # the text operators come as a part that can be left out
    import corpus_pipeline  # noqa: E402
    from supplypanel.llm import queries as text_queries  # noqa: E402
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("supplypanel.llm", "corpus_pipeline")):
        raise
    corpus_pipeline = text_queries = None

FIRST, LAST = census.FIRST_YEAR, census.LAST_YEAR
LEAK_CUT = 1998
CALIBRATION_YEAR = census.TRAIN_YEARS[1]

# --- Inputs ---------------------------------------------------------------------


def _name(spark: SparkSession, folder: str, what: str) -> str:
    """A table name of this application for the tables of one folder."""
    key = f"{spark.sparkContext.applicationId} {Path(folder).resolve()}"
    return f"{what}_{md5(key.encode()).hexdigest()[:10]}"


_BUILT: set[str] = set()


def _raw(spark, folder):
    return census.raw_courses(spark, folder)


def _courses(spark, folder):
    return staging.stage_courses(_raw(spark, folder))


def _institutions(spark, folder):
    return staging.stage_institutions(census.raw_institutions(spark, folder))


def _supply(spark, folder):
    return mart.course_supply(_courses(spark, folder))


def _once(spark: SparkSession, table: str, build) -> DataFrame:
    """A table of this application, built the first time it is asked for.

    Only a finished build counts: one that failed half-way is done again.
    """
    if table not in _BUILT:
        build()
        _BUILT.add(table)
    return spark.table(table)


def _buckets(spark, folder):
    """Buckets of the tables made from the order lines: as many as keep the rows behind one of them bounded."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()  # from the files' footers
    return tables.bucket_count(spark, lines)


def _snapshot(spark, folder):
    table, buckets = _name(spark, folder, "supply_snapshot"), _buckets(spark, folder)
    return _once(
        spark, table,
        lambda: mart.supply_snapshot(
            mart.course_supply(_courses(spark, folder), buckets), table, buckets
        ),
    )


def _context(spark, folder):
    table = _name(spark, folder, "institution_context")
    return _once(
        spark, table,
        lambda: tables.materialize(
            risk.institution_context(_snapshot(spark, folder)), table, partition="census_year"
        ),
    )


def _state(spark, folder):
    table = _name(spark, folder, "portfolio_snapshot")
    return _once(
        spark, table,
        lambda: portfolio.portfolio_snapshot(
            portfolio.modality_portfolio_state(_snapshot(spark, folder)), table, _buckets(spark, folder)
        ),
    )


def _training_plan(spark, folder):
    return risk.training_set(
        _snapshot(spark, folder), LAST, _context(spark, folder), census.TRAIN_YEARS,
        census.TEST_YEARS,
    )


def _training(spark, folder):
    table = _name(spark, folder, "training_set")
    return _once(
        spark, table,
        lambda: tables.materialize(_training_plan(spark, folder), table, partition="reference_year"),
    )


def _panel(spark, folder):
    return panel.supply_panel(_snapshot(spark, folder))


def _persistence(spark, folder):
    return panel.course_persistence(_panel(spark, folder))


def _labels(spark, folder):
    return risk.deterioration_labels(_snapshot(spark, folder), LAST)


def _features(spark, folder):
    return risk.offer_features(_snapshot(spark, folder), _context(spark, folder))


def _transitions(spark, folder):
    return portfolio.modality_transitions(_state(spark, folder), _snapshot(spark, folder))


def _completion(spark, folder):
    return completion.lagged_completion(_snapshot(spark, folder))


def _mvp(spark, folder):
    return mart.mvp_course_mart(_raw(spark, folder))


def _rounded(df: DataFrame, *columns: str, digits: int = 10) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; ratios do not."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- Editions as files --------------------------------------------------------------


def _edition_source(spark, folder, year):
    """One edition's rows, chosen by the year before any text is made."""
    return census.as_edition(_raw(spark, folder).where(F.col("nu_ano_censo") == str(year)), year)


def _edition(spark, folder, year):
    """One edition read back from its own CSV files, written on first use."""
    base = tables.app_folder(spark, _name(spark, folder, "editions"))
    path = f"{base}/MICRODADOS_CADASTRO_CURSOS_{year}"
    if path not in _BUILT:
        editions.write_edition(_edition_source(spark, folder, year), path)
        _BUILT.add(path)
    return path, editions.read_edition(spark, path)


_YEARS: dict[str, list[int]] = {}


def _years(spark, folder):
    """The years that the raw table holds, from one column of it."""
    name = _name(spark, folder, "years")
    if name not in _YEARS:
        years = _raw(spark, folder).select("nu_ano_censo").distinct().collect()
        _YEARS[name] = sorted(int(r.nu_ano_censo) for r in years)
    return _YEARS[name]


def _editions(spark, folder):
    return {year: _edition(spark, folder, year)[1] for year in _years(spark, folder)}


def _layouts(spark, folder):
    """Layout rows from the headers of the edition files, with their row counts."""
    paths = [_edition(spark, folder, year)[0] for year in _years(spark, folder)]
    name = F.element_at(F.split("path", "/"), -1)
    # A row for each file, kept: what is built on it names it several times.
    return tables.settled(editions.profile_files(spark, paths).select(
        editions.edition_year(name).alias("year"),
        editions.edition_kind(name).alias("kind"),
        "data_row_count", "column_count", "columns",
    ))


def _layout_rows(spark, folder):
    return _layouts(spark, folder).select(
        "year", "kind", F.posexplode("columns").alias("position", "column_name")
    )


def edition_file_profile(spark, folder):
    return _layouts(spark, folder).select("year", "kind", "data_row_count", "column_count")


def _package(spark, folder, year):
    """A package as it is handed over: the year's two tables, and files that are neither; each as a folder of its name."""
    base = tables.app_folder(spark, _name(spark, folder, f"package_{year}"))
    if base not in _BUILT:
        courses = _edition_source(spark, folder, year)
        editions.write_edition(courses, f"{base}/MICRODADOS_CADASTRO_CURSOS_{year}.CSV")
        editions.write_edition(courses.limit(1), f"{base}/~$MICRODADOS_CADASTRO_CURSOS_{year}.CSV")
        editions.write_edition(courses.limit(2), f"{base}/LEIAME_{year}.csv")
        editions.write_edition(courses.limit(2), f"{base}/MICRODADOS_CADASTRO_CURSOS_{year}.TXT")
        institutions = _institution_source(spark, folder, year)
        editions.write_edition(institutions, f"{base}/MICRODADOS_ED_SUP_IES_{year}.CSV")
        if year == LAST:  # two candidates: neither is chosen
            editions.write_edition(institutions.limit(3), f"{base}/IES_COPIA_{year}.CSV")
        _BUILT.add(base)
    return base


def edition_file_selection(spark, folder):
    """Every file of the first and the last package, with the outcome of the selection; rows of the chosen ones."""
    found = []
    for year in (FIRST, LAST):
        base = _package(spark, folder, year)
        listed = editions.edition_choices(spark, base)
        chosen = [r.path for r in listed.where("outcome = 'chosen'").select("path").collect()]
        rows = editions.profile_files(spark, chosen).select("path", "data_row_count")
        found.append(listed.join(rows, "path", "left").drop("path").select(F.lit(year).alias("package_year"), "*"))
    return metrics.union_all(found)


def _institution_source(spark, folder, year):
    """One year's institutions in that year's layout: only the newest edition has the network."""
    rows = census.raw_institutions(spark, folder).where(F.col("nu_ano_censo") == str(year))
    rows = rows if year == LAST else rows.drop("tp_rede")
    return rows.toDF(*[c.upper() for c in rows.columns])


def _institution_edition(spark, folder, year):
    """Path and rows of one institutions file, written on first use."""
    path = f"{tables.app_folder(spark, _name(spark, folder, 'editions'))}/MICRODADOS_ED_SUP_IES_{year}"
    if path not in _BUILT:
        editions.write_edition(_institution_source(spark, folder, year), path)
        _BUILT.add(path)
    return path, editions.read_edition(spark, path)


def _institution_layouts(spark, folder):
    paths = [_institution_edition(spark, folder, year)[0] for year in range(FIRST, LAST + 1)]
    name = F.element_at(F.split("path", "/"), -1)
    return editions.profile_files(spark, paths).select(
        editions.edition_year(name).alias("year"), editions.edition_kind(name).alias("kind"),
        "data_row_count", "column_count", "columns")


def institution_file_profile(spark, folder):
    return _institution_layouts(spark, folder).select("year", "kind", "data_row_count", "column_count")


def institution_layout_drift(spark, folder):
    rows = _institution_layouts(spark, folder).select("year", "kind", F.posexplode("columns").alias("position", "column_name"))
    return layout.layout_drift(rows, ("ies",)).select(
        "kind", "year", "common_column_count", F.array_join("only_this_year", ",").alias("only_this_year"))


def institution_edition_series(spark, folder):
    """Institutions typed from the union of their edition files."""
    files = {year: _institution_edition(spark, folder, year)[1] for year in range(FIRST, LAST + 1)}
    return staging.stage_institutions(layout.union_editions(files))


def single_edition_sustainability(spark, folder):
    """The newest edition by itself: network and category come with the institution."""
    courses = staging.stage_courses(layout.one_edition(_edition(spark, folder, LAST)[1]), single_edition=True)
    institutions = layout.one_edition(_institution_edition(spark, folder, LAST)[1])
    return mart.course_sustainability(
        mart.course_supply(courses), staging.stage_institutions(institutions, single_edition=True))


def edition_csv_supply(spark, folder):
    """The mart from CSV editions with drifting layouts instead of one table."""
    return mart.course_supply(staging.stage_courses(layout.union_editions(_editions(spark, folder))))


def pruned_edition_read(spark, folder):
    """Two columns of every edition file, and no others."""
    found = []
    for year in _years(spark, folder):
        rows = editions.read_edition(spark, _edition(spark, folder, year)[0], ["CO_IES", "QT_MAT"])
        found.append(rows.agg(
            F.lit(year).alias("census_year"), F.count(F.lit(1)).alias("row_count"),
            F.countDistinct("CO_IES").alias("institutions"),
            F.coalesce(F.sum(typed("QT_MAT", "bigint")), F.lit(0)).alias("enrollments"),
        ))
    return metrics.union_all(found)


def union_editions(spark, folder):
    """What the union of editions holds, year by year."""
    joined = layout.union_editions(_editions(spark, folder))
    return joined.groupBy(F.col("nu_ano_censo").cast("int").alias("census_year")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("co_cine_rotulo").isNull()).alias("null_field_codes"),
        F.countDistinct("co_cine_rotulo").alias("field_codes"),
        F.sum(typed("qt_vg_total", "bigint")).alias("offered_seats"),
    )


def common_columns(spark, folder):
    return layout.common_columns(_layout_rows(spark, folder), "cursos").select(
        "column_name", F.col("position").cast("bigint").alias("position")
    )


def layout_drift(spark, folder):
    return layout.layout_drift(_layout_rows(spark, folder), ("cursos",)).select(
        "kind", "year", "common_column_count",
        F.array_join("only_this_year", ",").alias("only_this_year"),
    )


def dictionary_diff(spark, folder):
    """Every edition's header against the newest edition's as the dictionary."""
    rows = _layout_rows(spark, folder)
    newest = rows.where(F.col("year") == max(_years(spark, folder))).select("kind", F.col("column_name").alias("variable"))
    return layout.dictionary_diff(rows, newest)


def control_match(spark, folder):
    """Edition files against fingerprints of the tables they were written from."""
    manifest, control = [], []
    for year in _years(spark, folder):
        source = _edition_source(spark, folder, year)
        source = source.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in source.columns])
        manifest.append(comparison.fingerprint(_edition(spark, folder, year)[1], f"cursos_{year}"))
        control.append(comparison.fingerprint(source, f"CURSOS_{year}"))
    union = metrics.union_all
    return layout.control_match(union(manifest), union(control)).select(
        "table_name", "content_matches", "control_name", "name_matches"
    )


# --- Snapshots and sinks --------------------------------------------------------------


def snapshot_fingerprint(spark, folder):
    """The snapshot reloaded a second time against the mart it came from."""
    # Written, so that both reloads and the comparison read one computation of the mart.
    supply = tables.written(_supply(spark, folder), _name(spark, folder, "supply_source"))
    table = _name(spark, folder, "supply_reloaded")
    mart.supply_snapshot(supply, table, _buckets(spark, folder))
    again = mart.supply_snapshot(supply, table)
    columns = sorted(supply.columns)
    return comparison.compare_fingerprints(
        comparison.fingerprint(supply.select(*columns), "supply"),
        comparison.fingerprint(again.select(*columns), "supply"),
    )


def _edited_supply(spark, folder):
    """The mart with some cells, rows and offers changed, in two editions only."""
    supply = _snapshot(spark, folder).where(F.col("census_year") <= LAST)
    touched = (F.col("census_year") == LAST) & (F.col("institution_id") % 7 == 3)
    edited = supply.withColumns({
        "enrollments": F.when(touched & (F.col("course_id") % 5 == 1), F.coalesce("enrollments", F.lit(0)) + 1).otherwise(F.col("enrollments")),
        "course_name": F.when(touched & (F.col("course_id") % 4 == 2), F.lit("outro")).otherwise(F.col("course_name")),
    })
    gone = (F.col("census_year") == FIRST) & (F.col("course_id") % 9 == 4)
    more = supply.where((F.col("census_year") == FIRST) & (F.col("course_id") % 9 == 5)).withColumn(
        "course_id", F.col("course_id") + 10**9)
    return edited.where(~gone).unionByName(more)


def changed_cells(spark, folder):
    """What an edit of the mart changed, by key and column, from manifests of key ranges and the files that differ."""
    base = tables.app_folder(spark, _name(spark, folder, "ranges"))
    sides = {"old": _snapshot(spark, folder), "new": _edited_supply(spark, folder)}
    for name, rows in sides.items():
        if f"{base}/{name}" not in _BUILT:
            ranges.write_by_range(rows, f"{base}/{name}", mart.KEYS)
            _BUILT.add(f"{base}/{name}")
    manifests = [tables.settled(ranges.tree_manifest(
        spark.read.parquet(f"{base}/{name}").drop(ranges.RANGE), mart.KEYS)) for name in sides]
    found = ranges.changed_rows(
        spark, f"{base}/old", f"{base}/new", mart.KEYS, ranges.differing_leaves(*manifests))
    return found.withColumn("columns", F.array_join(F.array_sort("columns"), ","))


def edition_reload(spark, folder):
    """Which editions a reload wrote after an edit of two of them, and that the table then holds the edited rows."""
    table = _name(spark, folder, "supply_versions")
    mart.supply_snapshot(_snapshot(spark, folder), table)
    before = versions.manifest(spark, table)
    edited = _edited_supply(spark, folder)
    now = mart.supply_snapshot(edited, table)
    after = versions.manifest(spark, table)
    again = versions.manifest(spark, mart.supply_snapshot(edited, table) and table)
    rows = [(int(p), after[p][3] != before.get(p, (None,) * 4)[3], again[p] == after[p]) for p in after]
    written = spark.createDataFrame(rows, "census_year int, rewritten boolean, second_run_writes_nothing boolean")
    held = now.groupBy(F.col("census_year").cast("int").alias("census_year")).agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("enrollments"), F.lit(0)).alias("enrollments"))
    return written.join(held, "census_year")


def report_sink(spark, folder):
    """A report section written as JSON and read back."""
    section = reports.modality_series(_snapshot(spark, folder))
    path = tables.app_folder(spark, _name(spark, folder, "report_series"))
    tables.write_report(section, path)
    return spark.read.schema(section.schema).json(path)


# --- Model ------------------------------------------------------------------------------


def _split(spark, folder):
    return metrics.chronological_split(_training(spark, folder))


def chronological_split(spark, folder):
    train, test = _split(spark, folder)
    return metrics.union_all([train, test]).groupBy("split", "reference_year").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("deteriorated").alias("events")
    )


def _size_score(rows):
    """A probability that is a plain function of size: ties and extremes included."""
    return rows.withColumns(
        {
            "score": F.lit(20.0) / F.col("enrollments").cast("double"),
            "label": F.col("deteriorated").cast("int"),
        }
    )


def scale_ablation(spark, folder):
    _, test = _split(spark, folder)
    scored = metrics.evaluate(metrics.scale_scores(test), experiment.SCALE_ONLY, risk.TEST)
    return _rounded(scored, "roc_auc", "average_precision")


def ranking_metrics(spark, folder):
    parts = zip((risk.TRAIN, risk.TEST), _split(spark, folder))
    scored = metrics.union_all([metrics.evaluate(_size_score(p), "size", name) for name, p in parts])
    return _rounded(scored, "roc_auc", "average_precision", "brier_score")


def precision_at_k(spark, folder):
    parts = zip((risk.TRAIN, risk.TEST), _split(spark, folder))
    return _rounded(
        metrics.union_all([metrics.precision_at_k(_size_score(p), "size", name) for name, p in parts]),
        "precision",
    )


def calibration_table(spark, folder):
    _, test = _split(spark, folder)
    return _rounded(metrics.calibration_table(_size_score(test)), "mean_predicted", "observed_rate")


def top_k_overlap(spark, folder):
    """Shared offers among the largest and the most applied-for of the test rows."""
    _, test = _split(spark, folder)
    keys = list(metrics.ROW_KEYS)
    by_size = test.orderBy(F.desc("enrollments"), *keys).limit(100)
    by_seats = test.orderBy(F.desc_nulls_last("offered_seats"), *keys).limit(100)
    return comparison.jaccard(by_size, by_seats, keys)


def preprocessor_statistics(spark, folder):
    train, _ = _split(spark, folder)
    statistics = _rounded(preparation.numeric_statistics(train), "median")
    return _rounded(statistics, "mean", "deviation", digits=6)


def category_levels(spark, folder):
    train, _ = _split(spark, folder)
    return preparation.category_counts(train)


def reference_model_coefficients(spark, folder):
    train, _ = _split(spark, folder)
    return models.fit_reference_model(train).coefficient_table(spark)


def reference_model_evaluation(spark, folder):
    train, test = _split(spark, folder)
    model = models.fit_reference_model(train)
    return metrics.union_all(
        [
            metrics.evaluate(model.score(train), experiment.REFERENCE, risk.TRAIN),
            metrics.evaluate(model.score(test), experiment.REFERENCE, risk.TEST),
        ]
    )


_FITTED: dict[str, models.ReferenceModel] = {}


def _reference_model(spark, folder) -> models.ReferenceModel:
    """The reference model of one folder's training rows, fitted once for each application."""
    name = _name(spark, folder, "reference")
    if name not in _FITTED:
        _FITTED[name] = models.fit_reference_model(_split(spark, folder)[0])
    return _FITTED[name]


def reference_model_convergence(spark, folder):
    """What proves the fit: rows, a gradient that vanishes, and the number of steps."""
    return _reference_model(spark, folder).convergence(spark).select(
        "n", (F.col("gradient_norm") < 1e-9).alias("gradient_vanishes"), (F.col("steps") <= 25).alias("few_steps"))


def reference_model_gradient(spark, folder):
    """The gradient at the fitted weights by column expressions, for each input; 0.0 even where rounding leaves -0.0."""
    found = models.penalised_gradient(_reference_model(spark, folder), _split(spark, folder)[0])
    return found.select("feature", (F.round("gradient", 9) + F.lit(0.0)).alias("gradient"))


def size_model_coefficients(spark, folder):
    """The solver on two inputs of stated scale, step by step the same as in SQL."""
    chosen = {name: (middle, mean, deviation) for name, middle, mean, deviation, _ in oracles.SCORER[1:3]}
    inputs = preparation.Preparation(chosen, {}, [f"numeric__{n}" for n in chosen])
    (fit,) = logistic.fit_logistic(_split(spark, folder)[0], [(inputs, None)])
    rows = [*zip(inputs.names, fit.coefficients), ("intercept", fit.intercept)]
    return spark.createDataFrame(
        [(name, round(value, 7)) for name, value in rows], "feature string, coefficient double")


def window_statistics(spark, folder):
    """Numeric statistics of each window of training years, from one histogram by year."""
    train, _ = _split(spark, folder)
    state = tables.settled(preparation.feature_histogram(train, ["reference_year"]))
    merged = tables.settled(preparation.merged_windows(state, oracles.training_windows()))
    found = _rounded(preparation.numeric_summary(merged, ["window"]), "median")
    return _rounded(found, "mean", "deviation", digits=6)


def isotonic_fit(spark, folder):
    """The isotonic mean of each rounded log-odds of the calibration year."""
    rows = _fixed_scorer().score(_training(spark, folder).where(F.col("reference_year") == CALIBRATION_YEAR))
    points = rows.groupBy((F.floor(F.round("log_odds", 8) * 8) / 8).alias("value")).agg(
        F.sum("label").cast("bigint").alias("events"), F.count(F.lit(1)).alias("n"))
    blocks = isotonic.isotonic_blocks(points, slices=4)
    return _rounded(isotonic.with_mean(points.select("value"), "value", blocks, "mean"), "mean")


def large_top_ranks(spark, folder):
    """Half of the training rows in the order of their score."""
    train, _ = _split(spark, folder)
    scored = _size_score(train).select(*metrics.ROW_KEYS, "score")
    return ranking.ranked_top(scored, "score", metrics.ROW_KEYS, train.count() // 2).select(*metrics.ROW_KEYS, "position")


def boosted_first_split(spark, folder):
    """The first split that boosting finds over features of few values, and the values of its two leaves."""
    train, _ = _split(spark, folder)
    model = boosting.fit_boosted(
        train, F.col("deteriorated").cast("int"), F.lit(False), oracles.BOOSTED_FEATURES, max_iter=1, depth=1)
    tree = model.trees[0]
    feature = int(tree.feature[0])
    row = (model.features[feature], float(model.cuts[feature][tree.cut[0]]), bool(tree.missing_left[0]),
           round(float(tree.value[1]), 9), round(float(tree.value[2]), 9))
    return spark.createDataFrame(
        [row], "feature string, cut double, missing_left boolean, left_value double, right_value double")


def comparison_model_evaluation(spark, folder):
    train, test = _split(spark, folder)
    model = models.fit_comparison_model(train)
    return metrics.evaluate(model.score(test), experiment.COMPARISON, risk.TEST)


def isotonic_calibration(spark, folder):
    train, test = _split(spark, folder)
    base, calibrated = experiment.calibrated_pair(train, CALIBRATION_YEAR)
    return metrics.union_all(
        [
            metrics.evaluate(base.score(test), experiment.SHORT_FIT, risk.TEST),
            metrics.evaluate(calibrated.score(test), experiment.CALIBRATED, risk.TEST),
        ]
    )


def prediction_explanations(spark, folder):
    train, test = _split(spark, folder)
    keys = list(metrics.ROW_KEYS)
    explained = models.fit_reference_model(train).explain(test, top_n=5)
    return explained.select(
        *keys, "predicted_probability", "intercept", "log_odds",
        F.posexplode("top_contributions").alias("rank", "part"),
    ).select(
        *keys, "predicted_probability", "intercept", "log_odds", "rank",
        "part.feature", "part.transformed_value", "part.contribution",
    )


def highest_risk(spark, folder):
    train, test = _split(spark, folder)
    found = models.highest_risk(models.fit_reference_model(train), test)
    return found.select(
        "position", *metrics.ROW_KEYS, "predicted_probability", "log_odds",
        F.array_join(F.transform("top_contributions", lambda p: p["feature"]), ",").alias("drivers"),
        "observed_deterioration",
    )


def _fixed_scorer() -> models.ReferenceModel:
    """A model of stated weights, so that SQL can repeat what is read from a model."""
    numeric = {name: (middle, mean, deviation) for name, middle, mean, deviation, _ in oracles.SCORER}
    levels = {name: preparation.Category(1.0, [1.0, 2.0], False) for name, _ in oracles.SCORER_LEVELS}
    names = [f"numeric__{n}" for n in numeric] + [f"categorical__{n}_2.0" for n in levels]
    weights = [row[-1] for row in [*oracles.SCORER, *oracles.SCORER_LEVELS]]
    return models.ReferenceModel(
        preparation.Preparation(numeric, levels, names), weights, oracles.SCORER_INTERCEPT
    )


def fixed_scorer_explanations(spark, folder):
    _, test = _split(spark, folder)
    explained = _fixed_scorer().explain(test, top_n=3).select(
        *metrics.ROW_KEYS, "predicted_probability", "log_odds",
        F.posexplode("top_contributions").alias("rank", "part"),
    )
    return _rounded(
        explained.select(
            *metrics.ROW_KEYS, "predicted_probability", "log_odds", "rank",
            "part.feature", "part.transformed_value", "part.contribution",
        ),
        "predicted_probability", "log_odds", "transformed_value", "contribution", digits=8,
    ).withColumn("contribution", F.col("contribution") + F.lit(0.0))  # no minus before a zero


def fixed_scorer_highest_risk(spark, folder):
    _, test = _split(spark, folder)
    found = models.highest_risk(_fixed_scorer(), test).select(
        "position", *metrics.ROW_KEYS, "predicted_probability", "log_odds",
        F.array_join(F.transform("top_contributions", lambda p: p["feature"]), ",").alias("drivers"),
        "observed_deterioration",
    )
    return _rounded(found, "predicted_probability", "log_odds", digits=8)


def _fixed_risks(spark, folder):
    open_rows = risk.scoring_rows(_features(spark, folder), _snapshot(spark, folder), LAST)
    return _fixed_scorer().score(open_rows).withColumnRenamed("score", "risk")


def fixed_scorer_year(spark, folder):
    return _rounded(
        _fixed_risks(spark, folder).select(*metrics.ROW_KEYS, "course_name", "risk"), "risk", digits=8
    )


def fixed_scorer_audit_list(spark, folder):
    found = models.audit_list(_fixed_risks(spark, folder), _institutions(spark, folder), LAST)
    return _rounded(found, "occupancy_rate", "risk", digits=8)


def _stability(spark, folder, section):
    return experiment.rolling_stability(_training(spark, folder))[section]


def _signs(spark, folder, section):
    """The sign sections over coefficients that SQL can repeat: entrants less twice the graduates of each field and year."""
    excess = F.coalesce("entrants", F.lit(0)) - 2 * F.coalesce("graduates", F.lit(0))
    rows = _supply(spark, folder).groupBy(
        F.col("cine_label_code").alias("feature"), F.col("census_year").cast("string").alias("window")
    ).agg(F.sum(excess).cast("double").alias("coefficient"))
    listed = F.transform("coefficients", lambda x: F.concat_ws(":", x["window"], x["coefficient"].cast("long").cast("string")))
    return experiment.sign_sections(rows)[section].withColumn("coefficients", F.array_join(listed, ","))


_EXPERIMENTS: dict[str, dict[str, DataFrame]] = {}


def _experiment(spark, folder) -> dict[str, DataFrame]:
    """The experiment's sections; its models are fitted once for each folder and application."""
    name = _name(spark, folder, "experiment")
    if name not in _EXPERIMENTS:
        _EXPERIMENTS[name] = experiment.run_experiment(_training(spark, folder), CALIBRATION_YEAR)
    return _EXPERIMENTS[name]


def experiment_calibration_gaps(spark, folder):
    """Calibration error of each model of the experiment, before and after the isotonic map."""
    sections = _experiment(spark, folder)
    found = {n.removesuffix("_calibration"): s for n, s in sections.items() if n.endswith("_calibration")}
    return experiment.calibration_gaps(found)


def audit_list(spark, folder):
    snapshot = _snapshot(spark, folder)
    open_rows = risk.scoring_rows(_features(spark, folder), snapshot, LAST)
    risks = models.score_year(_training(spark, folder), open_rows)
    return models.audit_list(risks, _institutions(spark, folder), LAST)


# --- Checks -------------------------------------------------------------------------------


def raw_checks(spark, folder):
    return checks.raw_checks(
        _raw(spark, folder), census.raw_institutions(spark, folder), FIRST, LAST,
        census.ZERO_CONVENTION_YEAR,
    )


def staging_checks(spark, folder):
    return checks.staging_checks(
        _courses(spark, folder), _institutions(spark, folder), FIRST, LAST,
        census.ZERO_CONVENTION_YEAR,
    )


def _spoilt_raw(spark, folder):
    """Raw rows with a year gone, others wrong or blank, bad codes, and rows that stand twice."""
    institution, course = F.col("co_ies").cast("bigint"), F.col("co_curso").cast("bigint")
    none = F.lit(None).cast("string")

    def spoilt(column, condition, value=none):
        return F.when(condition, value).otherwise(F.col(column))

    rows = _raw(spark, folder).where("nu_ano_censo <> '1997'").withColumns(
        {
            "nu_ano_censo": F.when(course == 3, "1990").otherwise(spoilt("nu_ano_censo", (course == 8) & (F.col("tp_dimensao") == "1"))),
            "tp_dimensao": spoilt("tp_dimensao", institution % 4 == 1, F.lit("9")),
            "co_cine_rotulo": spoilt("co_cine_rotulo", course % 13 == 5),
            "tp_rede": spoilt("tp_rede", institution % 6 == 2),
            "qt_ing": spoilt("qt_ing", institution % 5 == 3),
            "qt_vg_total": spoilt("qt_vg_total", institution % 5 == 2),
        }
    )
    return rows.unionAll(rows.where(institution % 7 == 0))


def _spoilt_institutions(spark, folder):
    rows = census.raw_institutions(spark, folder)
    return rows.unionAll(rows.where(F.col("co_ies").cast("bigint") % 5 == 0))


def spoilt_raw_checks(spark, folder):
    return checks.raw_checks(
        _spoilt_raw(spark, folder), _spoilt_institutions(spark, folder), FIRST, LAST,
        census.ZERO_CONVENTION_YEAR,
    )


def spoilt_staging_checks(spark, folder):
    return checks.staging_checks(
        staging.stage_courses(_spoilt_raw(spark, folder)),
        staging.stage_institutions(_spoilt_institutions(spark, folder)), FIRST, LAST,
        census.ZERO_CONVENTION_YEAR,
    )


def spoilt_mart_checks(spark, folder):
    supply = _supply(spark, folder)
    modality = F.when(F.col("course_id") % 11 == 0, 9).otherwise(F.col("teaching_modality"))
    rows = supply.withColumn("teaching_modality", modality)
    return checks.mart_checks(rows.unionAll(rows.where("institution_id % 7 = 0")))


def persistence_checks(spark, folder):
    edition = _raw(spark, folder).where(F.col("nu_ano_censo") == str(LAST))
    newest = staging.stage_courses(edition, single_edition=True)
    return checks.persistence_checks(
        mart.offer_years(_courses(spark, folder)), _snapshot(spark, folder), mart.course_supply(newest),
        _panel(spark, folder), _persistence(spark, folder), FIRST, LAST,
    )


def feature_checks(spark, folder):
    return checks.feature_checks(
        _snapshot(spark, folder), _features(spark, folder), _labels(spark, folder),
        _training(spark, folder), FIRST, LAST, LEAK_CUT,
    )


def modality_checks(spark, folder):
    snapshot = _snapshot(spark, folder)
    return checks.modality_checks(
        snapshot, _state(spark, folder), _transitions(spark, folder),
        portfolio.modality_dependency(snapshot), _completion(spark, folder),
    )


def _spoilt(column: str, condition, value) -> dict:
    return {column: F.when(condition, F.lit(value)).otherwise(F.col(column))}


def spoilt_persistence_checks(spark, folder):
    """Offers lost from the snapshot and others added to it, an edition that differs, impossible histories."""
    snapshot, c = _snapshot(spark, folder), F.col
    lost = snapshot.where(~((c("institution_id") % 7 == 0) & (c("census_year") == 1997)))
    bad_snapshot = lost.unionByName(
        snapshot.where("institution_id % 11 = 3").withColumn("course_id", c("course_id") + 10**6))
    newest = snapshot.where(c("census_year") == LAST)
    edition = newest.withColumn(
        "enrollments", F.when(c("course_id") % 9 == 0, F.coalesce("enrollments", F.lit(0)) + 1).otherwise(c("enrollments")))
    history = _persistence(spark, folder).withColumns({
        "current_low_occupancy_streak": F.when(c("institution_id") % 5 == 1, c("measurable_years") + 1).otherwise(
            c("current_low_occupancy_streak")),
        **_spoilt("low_occupancy_share", c("institution_id") % 6 == 2, 1.5),
        **_spoilt("first_year", c("institution_id") % 8 == 3, 1990),
        **_spoilt("demand_volatility", c("institution_id") % 9 == 4, -1.0),
    })
    series = _panel(spark, folder).withColumns({
        **_spoilt("is_low_occupancy", c("institution_id") % 5 == 2, True),
        **_spoilt("has_measurable_occupancy", c("institution_id") % 5 == 2, False),
    })
    return checks.persistence_checks(
        mart.offer_years(_courses(spark, folder)), bad_snapshot, edition, series, history, FIRST, LAST)


def spoilt_feature_checks(spark, folder):
    """Features that look ahead, labels beyond the series or at odds with the counts, a split that is not one by time."""
    c = F.col
    features = _features(spark, folder).withColumns({
        "years_observed_to_date": F.when(c("institution_id") % 5 == 1, c("years_observed_to_date") + 20).otherwise(
            c("years_observed_to_date")),
        **_spoilt("institution_enrollment_hhi", c("institution_id") % 6 == 1, 2.0),
    })
    observable, gone = c("label_is_observable"), c("disappeared_from_census")
    grown = observable & ~gone & (c("base_enrollments") > 0) & (c("horizon_enrollments") >= c("base_enrollments"))
    labels = _labels(spark, folder).withColumn(
        "deteriorated",
        F.when((c("reference_year") > LAST - 2) & (c("institution_id") % 4 == 1), True)
        .when(observable & gone & (c("institution_id") % 4 == 2), False)
        .when(grown & (c("institution_id") % 4 == 3), True).otherwise(c("deteriorated")))
    training = _training(spark, folder).withColumns({
        **_spoilt("split", (c("reference_year") == 1998) & (c("institution_id") % 5 == 0), risk.TEST),
        "deteriorated": F.when(c("institution_id") % 7 != 3, c("deteriorated")),
    })
    return checks.feature_checks(_snapshot(spark, folder), features, labels, training, FIRST, LAST, LEAK_CUT)


def spoilt_modality_checks(spark, folder):
    """States of no name, transitions into the first year, shares beyond one, lags and eligibility that do not add up."""
    snapshot, c = _snapshot(spark, folder), F.col
    state = _state(spark, folder).withColumns(_spoilt("modality_state", c("institution_id") % 5 == 1, "outra"))
    transitions = _transitions(spark, folder).withColumns(_spoilt("census_year", c("institution_id") % 6 == 1, FIRST))
    dependency = portfolio.modality_dependency(snapshot).withColumns(
        _spoilt("ead_seat_share", c("census_year") % 2 == 1, 1.5))
    lagged = _completion(spark, folder).withColumns({
        **_spoilt("lag_years", c("institution_id") % 5 == 1, 9),
        "is_eligible": F.when(c("institution_id") % 6 == 1, ~c("is_eligible")).otherwise(c("is_eligible")),
    })
    return checks.modality_checks(snapshot, state, transitions, dependency, lagged)


def course_sustainability(spark, folder):
    return mart.course_sustainability(_supply(spark, folder), _institutions(spark, folder))


# --- Contract -------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Sustainability indicators of every offer-year, from raw text to ratios."""
    return course_sustainability(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on_snapshot(plan, *args, **kwargs):
        return lambda spark, folder: plan(_snapshot(spark, folder), *args, **kwargs)

    def on_state(plan, **kwargs):
        return lambda spark, folder: plan(_state(spark, folder), _snapshot(spark, folder), **kwargs)

    return {
        # Sources and layouts
        "edition_file_profile": edition_file_profile,
        "edition_file_selection": edition_file_selection,
        "edition_csv_supply": edition_csv_supply,
        "institution_file_profile": institution_file_profile,
        "institution_layout_drift": institution_layout_drift,
        "institution_edition_series": institution_edition_series,
        "single_edition_sustainability": single_edition_sustainability,
        "changed_cells": changed_cells,
        "edition_reload": edition_reload,
        "spoilt_persistence_checks": spoilt_persistence_checks,
        "spoilt_feature_checks": spoilt_feature_checks,
        "spoilt_modality_checks": spoilt_modality_checks,
        "union_editions": union_editions,
        "pruned_edition_read": pruned_edition_read,
        "common_columns": common_columns,
        "layout_drift": layout_drift,
        "dictionary_diff": dictionary_diff,
        "control_match": control_match,
        "snapshot_fingerprint": snapshot_fingerprint,
        "report_sink": report_sink,
        # Staging and mart
        "staged_courses": _courses,
        "staged_institutions": _institutions,
        "course_supply": _supply,
        "course_sustainability": course_sustainability,
        "institution_portfolio": lambda s, d: _rounded(
            mart.institution_portfolio(_supply(s, d)), "enrollment_hhi"
        ),
        "supply_snapshot": _snapshot,
        # Panel
        "supply_panel": _panel,
        "course_persistence": lambda s, d: _rounded(
            _persistence(s, d), "mean_occupancy_rate", "occupancy_stddev", "demand_volatility"
        ),
        "long_panel_persistence": lambda s, d: _rounded(
            panel.long_panel_persistence(_persistence(s, d), min_years=5, long_streak=2),
            "mean_low_share", "mean_volatility",
        ),
        # Risk
        "deterioration_labels": _labels,
        "offer_features": lambda s, d: _rounded(
            _features(s, d), "mean_occupancy_to_date", "demand_volatility_to_date",
            "institution_enrollment_hhi",
        ),
        "training_set": lambda s, d: _rounded(
            _training_plan(s, d), "mean_occupancy_to_date", "demand_volatility_to_date",
            "institution_enrollment_hhi",
        ),
        # Portfolios
        "modality_portfolio_state": on_snapshot(portfolio.modality_portfolio_state),
        "portfolio_snapshot": _state,
        "modality_transitions": _transitions,
        "modality_dependency": on_snapshot(portfolio.modality_dependency),
        "national_modality_shares": on_snapshot(portfolio.national_modality_shares),
        "portfolio_state_counts": on_state(portfolio.portfolio_state_counts),
        "latest_transition_counts": lambda s, d: portfolio.latest_transition_counts(
            _transitions(s, d), _snapshot(s, d)
        ),
        "surviving_panel": lambda s, d: _rounded(
            portfolio.surviving_panel(_state(s, d), _snapshot(s, d)), "seat_change_correlation"
        ),
        "surviving_panel_of_year": lambda s, d: _rounded(
            portfolio.surviving_panel(_state(s, d), _snapshot(s, d), year=LAST - 1),
            "seat_change_correlation",
        ),
        "largest_fields": lambda s, d: portfolio.largest_fields(
            portfolio.modality_dependency(_snapshot(s, d)), _snapshot(s, d)
        ),
        # Completion
        "lagged_completion": _completion,
        "lagged_completion_summary": lambda s, d: _rounded(
            completion.lagged_completion_summary(_completion(s, d)), "median_offer_ratio"
        ),
        "completion_coverage": lambda s, d: _rounded(
            completion.completion_coverage(
                completion.lagged_completion_summary(_completion(s, d)), _snapshot(s, d)
            ),
            "median_offer_ratio",
        ),
        "completion_coverage_of_lag": lambda s, d: _rounded(
            completion.completion_coverage(
                completion.lagged_completion_summary(_completion(s, d)), _snapshot(s, d),
                year=LAST, lag=4,
            ),
            "median_offer_ratio",
        ),
        # Reports
        "modality_series": on_snapshot(reports.modality_series),
        "top_unconverted_institutions": lambda s, d: reports.top_unconverted_institutions(
            _snapshot(s, d), _institutions(s, d), LAST
        ),
        "unconverted_concentration": on_snapshot(reports.unconverted_concentration, LAST),
        "capacity_totals": on_snapshot(reports.capacity_totals, LAST),
        "mvp_course_mart": _mvp,
        "mvp_by_modality": lambda s, d: reports.mvp_by_modality(_mvp(s, d)),
        "mvp_concentration": lambda s, d: reports.mvp_concentration(
            _mvp(s, d), census.raw_institutions(s, d)
        ),
        "mvp_idle": lambda s, d: reports.mvp_idle(_mvp(s, d), census.raw_institutions(s, d)),
        "mvp_overview": lambda s, d: reports.mvp_overview(_mvp(s, d)),
        "dimension_profile": lambda s, d: reports.dimension_profile(_raw(s, d)),
        "edition_profile": lambda s, d: reports.edition_profile(_raw(s, d)),
        "academic_level_counts": lambda s, d: reports.academic_level_counts(_raw(s, d)),
        # Checks
        "mart_checks": lambda s, d: checks.mart_checks(_supply(s, d)),
        "raw_checks": raw_checks,
        "spoilt_mart_checks": spoilt_mart_checks,
        "spoilt_raw_checks": spoilt_raw_checks,
        "spoilt_staging_checks": spoilt_staging_checks,
        "staging_checks": staging_checks,
        "persistence_checks": persistence_checks,
        "feature_checks": feature_checks,
        "modality_checks": modality_checks,
        # Model
        "chronological_split": chronological_split,
        "preprocessor_statistics": preprocessor_statistics,
        "category_levels": category_levels,
        "scale_ablation": scale_ablation,
        "ranking_metrics": ranking_metrics,
        "precision_at_k": precision_at_k,
        "calibration_table": calibration_table,
        "top_k_overlap": top_k_overlap,
        "reference_model_coefficients": reference_model_coefficients,
        "reference_model_convergence": reference_model_convergence,
        "reference_model_gradient": reference_model_gradient,
        "size_model_coefficients": size_model_coefficients,
        "window_statistics": window_statistics,
        "isotonic_fit": isotonic_fit,
        "large_top_ranks": large_top_ranks,
        "boosted_first_split": boosted_first_split,
        "reference_model_evaluation": reference_model_evaluation,
        "comparison_model_evaluation": comparison_model_evaluation,
        "isotonic_calibration": isotonic_calibration,
        "prediction_explanations": prediction_explanations,
        "highest_risk": highest_risk,
        "stability_windows": lambda s, d: _stability(s, d, "stability_windows"),
        "stability_overlap": lambda s, d: _stability(s, d, "stability_overlap"),
        "stability_coefficients": lambda s, d: _stability(s, d, "stability_coefficients"),
        "fixed_scorer_explanations": fixed_scorer_explanations,
        "fixed_scorer_highest_risk": fixed_scorer_highest_risk,
        "fixed_scorer_year": fixed_scorer_year,
        "fixed_scorer_audit_list": fixed_scorer_audit_list,
        "sign_flipping_features": lambda s, d: _signs(s, d, "sign_flipping_features"),
        "sign_stable_features": lambda s, d: _signs(s, d, "sign_stable_features"),
        "experiment_evaluations": lambda spark, folder: _experiment(spark, folder)["evaluations"],
        "experiment_precision_at_k": lambda spark, folder: _experiment(spark, folder)["precision_at_k"],
        "experiment_coefficients": lambda spark, folder: _experiment(spark, folder)["reference_coefficients"],
        "experiment_calibration_gaps": experiment_calibration_gaps,
        "audit_list": audit_list,
    } | ({**text_queries.QUERIES, "pipeline": corpus_pipeline.run} if text_queries else {})


def oracle_sql() -> dict[str, str]:
    found = oracles.all_queries()
    if text_queries:
        found |= text_queries.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found

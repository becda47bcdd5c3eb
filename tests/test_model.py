"""Model steps against brute force on small frames."""

import threading
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from supplypanel.model import boosting, experiment, isotonic, logistic, metrics, models, preparation
from supplypanel.operators import ranking
from supplypanel.plans.risk import TEST, TRAIN


def frame(years, rows_per_year=40, test_from=2021):
    """Skewed numeric features with gaps; the event follows two of them and one category."""
    draw = np.random.default_rng(90_125)
    n, width = len(years) * rows_per_year, len(preparation.NUMERIC)
    numeric = draw.gamma(1.7, 2.2, size=(n, width))
    network, scope = draw.integers(1, 3, n), draw.integers(1, 3, n)
    category = draw.choice([3.0, 5.0, 8.0, 9.0], n, p=[0.4, 0.3, 0.2, 0.1])
    pull = numeric[:, 1] - numeric[:, 4] + (category == 5.0) + draw.logistic(size=n)
    event = pull > np.quantile(pull, 0.7)
    missing = draw.random((n, width)) < 0.04
    return [
        (1, i % rows_per_year, year, TRAIN if year < test_from else TEST, bool(event[i]),
         *[None if gone else float(v) for v, gone in zip(numeric[i], missing[i])],
         float(network[i]), float(scope[i]), float(category[i]))
        for i, year in enumerate(np.repeat(years, rows_per_year).tolist())
    ]


def table(spark, rows):
    columns = [
        "institution_id int", "course_id bigint", "reference_year int", "split string",
        "deteriorated boolean", *[f"{c} double" for c in preparation.FEATURES],
    ]
    return spark.createDataFrame(rows, ", ".join(columns))


@pytest.fixture(scope="module")
def training(spark):
    return table(spark, frame([2019, 2020, 2021])).cache()


@pytest.fixture(scope="module")
def model(training):
    return models.fit_reference_model(training.where(F.col("split") == TRAIN))


def scored(spark, labels, scores):
    rows = [(2020, 1, i, 1, float(s), int(y)) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(
        rows,
        "reference_year int, institution_id int, course_id bigint, teaching_modality int, "
        "score double, label int",
    )


# --- Ranking metrics ------------------------------------------------------------------


@pytest.mark.parametrize("size", [5, 60])
def test_precision_at_k_matches_a_sort(spark, size):
    draw = np.random.default_rng(size)
    scores, labels = draw.permutation(size) / size, draw.integers(0, 2, size)
    wanted = (1, size // 2, size, size + 1)
    rows = scored(spark, labels, scores)
    found = {r.k: r.precision for r in metrics.precision_at_k(rows, "m", TEST, wanted).collect()}
    ordered = labels[np.argsort(-scores)]
    assert found == {k: pytest.approx(ordered[:k].mean()) for k in wanted if k <= size}


def test_brier_only_for_probabilities(spark):
    draw = np.random.default_rng(31)
    labels, scores = draw.integers(0, 2, 30), draw.random(30)
    chance = metrics.evaluate(scored(spark, labels, scores), "m", TEST).first()
    assert chance.brier_score == pytest.approx(np.mean((labels - scores) ** 2))
    shifted = metrics.evaluate(scored(spark, labels, 7 * scores - 3), "m", TEST).first()
    assert shifted.brier_score is None and shifted.roc_auc == pytest.approx(chance.roc_auc)


def brute_auc_and_precision(labels, scores):
    positive, negative = scores[labels == 1], scores[labels == 0]
    pairs = (positive[:, None] > negative).sum() + 0.5 * (positive[:, None] == negative).sum()
    average, recall = 0.0, 0.0
    for threshold in np.unique(scores)[::-1]:
        flagged = scores >= threshold
        gained = (labels[flagged].sum()) / labels.sum()
        average += (gained - recall) * labels[flagged].mean()
        recall = gained
    return pairs / (len(positive) * len(negative)), average


@pytest.mark.parametrize("distinct", [1, 3, 50, 100_000])
def test_metrics_match_brute_force_with_ties(spark, distinct):
    generator = np.random.default_rng(distinct)
    scores = generator.integers(0, distinct, 600) / distinct
    scores[:200] = scores[0]  # a third of all rows share one score
    labels = (generator.random(600) < 0.2 + 0.5 * scores).astype(int)
    row = metrics.evaluate(scored(spark, labels, scores), "m", TEST).first()
    auc, average = brute_auc_and_precision(labels, scores)
    assert row.roc_auc == pytest.approx(auc, abs=1e-12)
    assert row.average_precision == pytest.approx(average, abs=1e-12)
    assert row.brier_score == pytest.approx(((scores - labels) ** 2).mean(), abs=1e-12)
    assert (row.row_count, row.event_rate) == (600, labels.mean())


@pytest.mark.parametrize("bins,distinct", [(4, 10_000), (10, 10_000), (10, 6)])
def test_calibration_matches_brute_force(spark, bins, distinct):
    generator = np.random.default_rng(bins)
    scores = generator.integers(0, distinct, 500) / distinct
    labels = (generator.random(500) < scores).astype(int)
    ordered, edges = np.sort(scores), []
    for i in range(bins + 1):
        low, rest = divmod(i * 499, bins)
        high = min(low + 1, 499)
        edges.append(ordered[low] + (ordered[high] - ordered[low]) * (rest / bins))
    edges = sorted(set(edges))
    wanted = []
    for place, (low, high) in enumerate(zip(edges, edges[1:])):
        last = high == edges[-1]  # half-open intervals, but for the last
        inside = [i for i in range(500) if low <= scores[i] < high or last and scores[i] == high]
        if inside:
            wanted.append((place, len(inside), scores[inside].mean(), labels[inside].mean()))
    rows = metrics.calibration_table(scored(spark, labels, scores), bins).collect()
    assert [(r.bin, r.row_count) for r in rows] == [w[:2] for w in wanted]
    for r, (_, _, predicted, observed) in zip(rows, wanted):
        assert (r.mean_predicted, r.observed_rate) == (pytest.approx(predicted), pytest.approx(observed))


def test_calibration_bins_hold_every_row(spark):
    draw = np.random.default_rng(12)
    scores = np.sort(draw.beta(2, 5, 77))
    labels = np.arange(77) >= 60  # the largest scores are the events
    rows = metrics.calibration_table(scored(spark, labels.astype(int), scores), 5).collect()
    assert sum(r.row_count for r in rows) == 77
    assert rows[0].observed_rate == 0 and rows[-1].observed_rate == 1
    means = [r.mean_predicted for r in rows]
    assert means == sorted(means)


def test_unknown_size_ranks_last(spark, training):
    rows = training.withColumn("enrollments", F.when(F.col("course_id") > 3, F.col("enrollments")))
    lowest = metrics.scale_scores(rows).where("course_id <= 3").select("score").distinct().collect()
    assert len(lowest) == 1
    assert lowest[0].score == -rows.agg(F.max("enrollments")).first()[0]


# --- Splits ------------------------------------------------------------------------------


def test_split_guards(spark):
    rows = frame([2019, 2020, 2021])
    train, test = metrics.chronological_split(table(spark, rows))
    assert {r.reference_year for r in train.select("reference_year").distinct().collect()} == {2019, 2020}
    assert test.count() == 40
    shared = [(*r[:3], TEST if i < 5 else r[3], *r[4:]) for i, r in enumerate(rows)]
    with pytest.raises(ValueError, match="both training and test"):
        metrics.chronological_split(table(spark, shared))
    reversed_ = [(*r[:3], TEST if r[2] == 2019 else TRAIN, *r[4:]) for r in rows if r[2] != 2020]
    with pytest.raises(ValueError, match="not chronological"):
        metrics.chronological_split(table(spark, reversed_))
    with pytest.raises(ValueError, match="no training or no test"):
        metrics.chronological_split(table(spark, [r for r in rows if r[2] < 2021]))


# --- Preparation ---------------------------------------------------------------------------


def test_preparation_matches_brute_force(spark):
    rows = [list(r) for r in frame([2019], rows_per_year=301)]
    for i in range(0, 301, 7):
        rows[i][5] = None  # occupancy_rate
    for i in range(0, 301, 50):
        rows[i][-1] = None  # administrative_category
    rows[1][-1] = 4.0  # one row in 301 is rare
    df = table(spark, [tuple(r) for r in rows])
    fitted = preparation.fit_preparation(df)
    values = np.array([np.nan if r[5] is None else r[5] for r in rows])
    middle = np.nanmedian(values)
    filled = np.where(np.isnan(values), middle, values)
    assert fitted.numeric["occupancy_rate"] == pytest.approx((middle, filled.mean(), filled.std()))
    category = fitted.categorical["administrative_category"]
    levels = [r[-1] for r in rows if r[-1] is not None]
    counts = {v: levels.count(v) for v in set(levels)}
    mode = min(v for v in counts if counts[v] == max(counts.values()))
    assert (category.mode, category.frequent, category.has_rare) == (mode, [3.0, 5.0, 8.0, 9.0], True)
    assert category.indicators == [5.0, 8.0, 9.0, None]
    prepared = np.array([r.inputs for r in fitted.apply(df).orderBy("course_id").collect()])
    assert prepared.shape == (301, len(fitted.names))
    assert prepared[:, 0] == pytest.approx((filled - filled.mean()) / filled.std())
    rare = fitted.names.index("categorical__administrative_category_infrequent")
    assert prepared[:, rare].sum() == 1 and prepared[1, rare] == 1


def test_unknown_level_goes_to_the_rare_bucket_or_the_reference(spark, training, model):
    strange = training.limit(1).withColumn("administrative_category", F.lit(77.0))
    inputs = model.preparation.apply(strange).first().inputs
    columns = [i for i, n in enumerate(model.preparation.names) if "administrative" in n]
    assert not model.preparation.categorical["administrative_category"].has_rare
    assert [inputs[i] for i in columns] == [0.0, 0.0, 0.0]


def test_constant_and_empty_features(spark, training):
    odd = training.withColumns(
        {"seat_growth_1y": F.lit(3.0), "occupancy_rate_lag1": F.lit(None).cast("double")}
    )
    fitted = preparation.fit_preparation(odd)
    assert "occupancy_rate_lag1" not in fitted.numeric
    at = fitted.names.index("numeric__seat_growth_1y")
    assert fitted.apply(odd).first().inputs[at] == 0.0


# --- Reference model -------------------------------------------------------------------------


def newton_logistic(x, y, steps=50):
    """Penalized likelihood by Newton's method: half the squared weights plus losses."""
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.eye(design.shape[1])
    penalty[-1, -1] = 0.0
    weights = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ weights))
        gradient = design.T @ (p - y) + penalty @ weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        weights -= np.linalg.solve(hessian, gradient)
    return weights


def test_coefficients_match_newton(training, model):
    train = training.where(F.col("split") == TRAIN).orderBy("reference_year", "course_id")
    rows = model.preparation.apply(train).collect()
    weights = newton_logistic(
        np.array([r.inputs for r in rows]), np.array([float(r.deteriorated) for r in rows])
    )
    assert model.coefficients == pytest.approx(list(weights[:-1]), abs=1e-10)
    assert model.intercept == pytest.approx(weights[-1], abs=1e-10)
    proof = model.convergence(training.sparkSession).first()
    assert (proof.n, proof.gradient_norm < 1e-9, proof.steps < 15) == (80, True, True)
    gradient = models.penalised_gradient(model, train).collect()
    assert {r.feature for r in gradient} == {*model.preparation.names, "intercept"}
    assert max(abs(r.gradient) for r in gradient) < 1e-12
    moved = models.ReferenceModel(model.preparation, [w + 0.1 for w in model.coefficients], model.intercept)
    assert max(abs(r.gradient) for r in models.penalised_gradient(moved, train).collect()) > 1e-3


def test_a_fit_that_cannot_be_proved_raises(training, monkeypatch):
    train = training.where(F.col("split") == TRAIN)
    monkeypatch.setattr(logistic, "MAX_STEPS", 2)
    with pytest.raises(RuntimeError, match="did not converge"):
        models.fit_reference_model(train)
    with pytest.raises(ValueError, match="without rows"):
        logistic.fit_logistic(train, [(preparation.fit_preparation(train), [1900])])


def test_separable_rows_converge(spark):
    rows = [list(r) for r in frame([2019], rows_per_year=60)]
    for r in rows:
        r[4] = r[6] is not None and r[6] > 4
    fitted = models.fit_reference_model(table(spark, [tuple(r) for r in rows]))
    assert fitted.fit.gradient_norm < 1e-9


def test_windows_equal_separate_fits_and_share_a_scan(spark):
    df = table(spark, frame([2015, 2016, 2017, 2018], rows_per_year=60)).cache()
    windows = {"a": [2015, 2016], "b": [2016, 2017, 2018]}
    together = models.fit_reference_models(df, windows)
    for name, years in windows.items():
        alone = models.fit_reference_model(df.where(F.col("reference_year").isin(years)))
        assert together[name].preparation.names == alone.preparation.names
        assert together[name].preparation.categorical == alone.preparation.categorical
        for feature, numbers in alone.preparation.numeric.items():
            assert together[name].preparation.numeric[feature] == pytest.approx(numbers, rel=1e-12)
        assert together[name].coefficients == pytest.approx(alone.coefficients, abs=1e-9)
        assert together[name].fit.n == 60 * len(years)
    state = preparation.feature_histogram(df, ["reference_year"])
    plan = preparation.merged_windows(state, windows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 and "Scan" in plan


def test_design_equals_the_column_form(training, model):
    test = training.where(F.col("split") == TEST).withColumn(
        "administrative_category", F.when(F.col("course_id") > 3, F.col("administrative_category")))
    rows = model.preparation.apply(test).orderBy("course_id").collect()
    columns = {c: np.array([np.nan if r[c] is None else r[c] for r in rows], float) for c in preparation.FEATURES}
    found = preparation.design_of(model.preparation.steps())(columns)
    assert found == pytest.approx(np.array([r.inputs for r in rows]), abs=1e-12)


def test_categories_become_indicators(spark, model):
    names = [r.feature for r in model.coefficient_table(spark).collect()]
    assert "categorical__administrative_category" not in names
    assert len([n for n in names if n.startswith("categorical__administrative_category_")]) == 3
    assert {f"numeric__{n}" for n in preparation.NUMERIC} <= set(names)


def test_explanations_add_up(training, model):
    test = training.where(F.col("split") == TEST)
    probabilities = {r.course_id: r.score for r in model.score(test).collect()}
    for row in model.explain(test, top_n=99).collect():
        total = row.intercept + sum(part.contribution for part in row.top_contributions)
        assert total == pytest.approx(row.log_odds, abs=1e-9)
        assert row.predicted_probability == pytest.approx(probabilities[row.course_id], abs=1e-9)
    sizes = [abs(p.contribution) for p in model.explain(test, top_n=4).first().top_contributions]
    assert len(sizes) == 4 and sizes == sorted(sizes, reverse=True)


def test_highest_risk(training, model):
    test = training.where(F.col("split") == TEST)
    keys = ("reference_year", "institution_id", "course_id")
    rows = models.highest_risk(model, test, n=5, keys=keys).collect()
    best = sorted((r.score for r in model.score(test).collect()), reverse=True)[:5]
    assert [r.predicted_probability for r in rows] == pytest.approx(best)
    assert [r.position for r in rows] == [1, 2, 3, 4, 5]


def test_isotonic_map_is_monotone_and_leaves_the_base(training, model):
    calibrated = models.fit_calibrated_model(model, training.where("reference_year = 2020"))
    rows = calibrated.score(training.where(F.col("split") == TEST)).orderBy("log_odds").collect()
    scores = [r.score for r in rows]
    assert scores == sorted(scores) and 0 <= scores[0] and scores[-1] <= 1
    assert calibrated.base is model


def test_scoring_year_must_be_new(training):
    labelled = training.where("reference_year < 2021")
    risks = models.score_year(labelled, training.where("reference_year = 2021"))
    assert risks.where("risk > 0 and risk < 1").count() == 40
    with pytest.raises(ValueError, match="both labelled"):
        models.score_year(labelled, labelled)
    with pytest.raises(ValueError, match="no labelled"):
        models.score_year(labelled.where("false"), labelled)


def test_audit_list_has_one_offer_per_institution(spark):
    rows = [(i % 3, i, 1, 2024, f"c{i}", 30.0, 0.5, i / 10) for i in range(9)]
    risks = spark.createDataFrame(
        rows,
        "institution_id int, course_id bigint, teaching_modality int, reference_year int, "
        "course_name string, enrollments double, occupancy_rate double, risk double",
    )
    names = spark.createDataFrame(
        [(2024, 2, "Dois", "SP")],
        "census_year int, institution_id int, institution_name string, institution_state string",
    )
    found = models.audit_list(risks, names, 2024, n=2).collect()
    assert [(r.institution_id, r.course_id, r.institution_name) for r in found] == [
        (2, 8, "Dois"), (1, 7, None),
    ]


# --- Isotonic regression ------------------------------------------------------------------


def isotonic_by_min_max(events, n):
    """The largest of the least means: of all stretches that end at or after a place, among those that begin at or before it."""
    total = len(n)
    return [
        max(min(Fraction(sum(events[j : k + 1]), sum(n[j : k + 1])) for k in range(i, total)) for j in range(i + 1))
        for i in range(total)
    ]


@pytest.mark.parametrize("shape,slices", [
    ("random", 11), ("falling", 5), ("rising", 3), ("ties", 4), ("single", 2), ("random", 1)])
def test_isotonic_blocks_equal_the_min_max_formula(spark, shape, slices):
    draw = np.random.default_rng(len(shape) + slices)
    size = 1 if shape == "single" else 40
    n = draw.integers(1, 6, size).tolist()
    share = {"falling": np.linspace(1, 0, size), "rising": np.linspace(0, 1, size)}.get(shape, draw.random(size))
    if shape == "ties":
        share = np.round(share)
    events = [int(round(k * s)) for k, s in zip(n, share)]
    table_ = spark.createDataFrame([(i / 8, e, k) for i, (e, k) in enumerate(zip(events, n))], "value double, events long, n long")
    blocks = isotonic.isotonic_blocks(table_.repartition(5), slices).orderBy("low").collect()
    wanted = isotonic_by_min_max(events, n)
    found = [Fraction(b.events, b.n) for i in range(size) for b in blocks if b.low <= i / 8 <= b.high]
    assert found == wanted
    means = [Fraction(b.events, b.n) for b in blocks]
    assert means == sorted(set(means)) and sum(b.n for b in blocks) == sum(n)


def test_isotonic_map_reads_alike_from_arrays_and_along_the_order(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(float(v), int(e), int(k)) for v, e, k in zip(range(60), draw.integers(0, 4, 60), draw.integers(4, 7, 60))]
    blocks = isotonic.isotonic_blocks(spark.createDataFrame(rows, "value double, events long, n long"), 4)
    values = [*draw.uniform(-5, 65, 200).tolist(), *[7.0] * 300, *[float(i) for i in range(60)], None]
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    near = {r.id: r.mean for r in isotonic.with_mean(asked, "x", blocks, "mean").collect()}
    points = sorted({(p, b.events / b.n) for b in blocks.collect() for p in (b.low, b.high)})
    for i, v in enumerate(values):
        assert near[i] == (None if v is None else pytest.approx(np.interp(v, *zip(*points)), abs=1e-12))
    monkeypatch.setattr(isotonic, "HELD_BLOCKS", 1)
    monkeypatch.setattr(isotonic, "RANGE_ROWS", 50)
    far = {r.id: r.mean for r in isotonic.with_mean(asked, "x", blocks, "mean").collect()}
    assert far.keys() == near.keys() and all(far[i] == pytest.approx(near[i], abs=1e-12) for i in far if far[i] is not None)
    assert [i for i in far if far[i] is None] == [len(values) - 1]


# --- Top rows ------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 1500, 4000])
def test_top_ranks_equal_a_sort_and_no_task_holds_them(spark, monkeypatch, n):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 100)
    draw = np.random.default_rng(n)
    rows = [(i, float(s)) for i, s in enumerate(draw.integers(0, 50, 3000))]
    rows = [(i, 25.0 if i % 3 == 0 else None if i % 97 == 1 else s) for i, s in rows]  # a third share one score
    df = spark.createDataFrame(rows, "id long, score double").repartition(16)
    top = ranking.ranked_top(df, "score", ["id"], n)
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:n]
    assert [(r.id, r.score) for r in sorted(top.collect(), key=lambda r: r.position)] == wanted
    sizes = [r["count"] for r in top.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert n < 500 or max(sizes) < n / 2


# --- Comparison model, stability, experiment ------------------------------------------------


def test_trees_learn_what_is_there(spark):
    rows = [list(r) for r in frame([2019, 2020, 2021], rows_per_year=150)]
    for r in rows:
        r[4] = r[5] is not None and r[5] > 3  # the event is one feature beyond a threshold
    df = table(spark, [tuple(r) for r in rows])
    model = models.fit_comparison_model(df.where(F.col("split") == TRAIN), max_iter=5)
    row = metrics.evaluate(model.score(df.where(F.col("split") == TEST)), "m", TEST).first()
    assert row.roc_auc > 0.95 and row.brier_score is not None


def brute_splits(bins, g, h, least_rows):
    """The best split of some rows by trying each: (gain, feature, cut, missing to the left)."""
    best = (1e-9, None, None, None)
    one = 2.0**boosting.FRACTION_BITS

    def value(rows):
        return (g[rows].sum() / one) ** 2 / (h[rows].sum() / one)

    for f in range(bins.shape[1]):
        gone = bins[:, f] == boosting.MISSING
        for side in ((False, True) if gone.any() else (False,)):
            for cut in range(boosting.BINS - 1):
                left = (bins[:, f] <= cut) & ~gone | (gone & side)
                if min(left.sum(), (~left).sum()) < least_rows or min(h[left].sum(), h[~left].sum()) < 1e-3 * one:
                    continue
                gain = value(left) + value(~left) - value(slice(None))
                if gain > best[0]:
                    best = (gain, f, cut, side if gone.any() else bool(left.sum() > (~left).sum()))
    return best


def brute_boosting(bins, y, trees, depth, rate, least_rows):
    """Trees grown on whole-number gradients, row by row."""
    one = 2.0**boosting.FRACTION_BITS
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = np.rint((p - y) * one), np.rint(p * (1 - p) * one)
        nodes, splits = {0: np.ones(len(y), bool)}, {}
        for level in range(depth):
            for n in [n for n in nodes if 2**level - 1 <= n < 2 ** (level + 1) - 1]:
                rows = nodes[n]
                gain, f, cut, side = brute_splits(bins[rows], g[rows], h[rows], least_rows)
                if f is None:
                    continue
                splits[n] = (f, cut, side)
                gone = bins[:, f] == boosting.MISSING
                left = np.where(gone, side, bins[:, f] <= cut)
                nodes[2 * n + 1], nodes[2 * n + 2] = rows & left, rows & ~left
        for n, rows in nodes.items():
            if n not in splits:
                raw[rows] -= rate * (g[rows].sum() / one) / (h[rows].sum() / one)
        grown.append(splits)
    return grown, raw


def test_boosting_equals_brute_force_with_missing_values(spark):
    rows = [list(r) for r in frame([2019], rows_per_year=260)]
    draw = np.random.default_rng(2)
    for r in rows:
        if draw.random() < 0.3:
            r[6] = None
            r[4] = bool(draw.random() < 0.8)  # that a value is missing tells something
    df = table(spark, [tuple(r) for r in rows])
    features = preparation.NUMERIC[:4] + ["administrative_category"]
    fits = [
        boosting.fit_boosted(df.repartition(k), F.col("deteriorated").cast("int"), F.lit(False), features,
                             max_iter=4, rate=0.3, depth=3, least_rows=10) for k in (1, 7)
    ]
    model = fits[0]
    values = np.array([[np.nan if v is None else v for v in (*r[5:9], r[-1])] for r in rows], float)
    bins = np.array([[boosting.MISSING if np.isnan(v) else (model.cuts[f] < v).sum() for f, v in enumerate(x)] for x in values])
    y = np.array([float(r[4]) for r in rows])
    wanted, raw = brute_boosting(bins, y, 4, 3, 0.3, 10)
    for tree, splits in zip(model.trees, wanted):
        found = {n: (tree.feature[n], tree.cut[n], bool(tree.missing_left[n])) for n in range(7) if tree.feature[n] >= 0}
        assert found == splits
    assert any(s[2] for splits in wanted for s in splits.values())
    got = [r.raw for r in df.withColumn("raw", model.log_odds()).orderBy("course_id").collect()]
    assert got == pytest.approx(raw.tolist(), abs=1e-9)
    for a, b in zip(model.trees, fits[1].trees):  # the dealing of rows to tasks leaves no trace
        assert all((x == z).all() for x, z in zip((a.feature, a.cut, a.value), (b.feature, b.cut, b.value)))


def test_cut_points_are_values_or_exact_quantiles(spark):
    rows = spark.createDataFrame([(float(i % 7), float((i * 37) % 1000), None) for i in range(1000)], "a double, b double, c double")
    few, many, none = boosting.cut_points(rows, ["a", "b", "c"])
    assert few.tolist() == [0, 1, 2, 3, 4, 5] and len(none) == 0
    assert many.tolist() == [max(v for v in range(1000) if v * boosting.BINS // 1000 == k) for k in range(boosting.BINS - 1)]


def test_boosting_stops_when_held_out_rows_gain_nothing(spark):
    rows = [list(r) for r in frame([2019, 2020], rows_per_year=150)]
    draw = np.random.default_rng(3)
    for r in rows:
        r[4] = bool(draw.random() < 0.5)  # nothing to learn
    df = table(spark, [tuple(r) for r in rows])
    model = boosting.fit_boosted(df, F.col("deteriorated").cast("int"), F.col("course_id") % 3 == 0, max_iter=100, rate=0.3, depth=1)
    assert boosting.PATIENCE <= len(model.trees) < 100 and len(model.losses) == len(model.trees) + 1
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit_boosted(df, F.col("deteriorated").cast("int"), F.lit(True))


def test_boosting_runs_one_job_a_level(spark, monkeypatch):
    """Levels neither plan nor shuffle, the scores of a tree come with the next one's root, and kept blocks are let go."""
    monkeypatch.setattr(boosting, "PART_ROWS", 500)  # several tasks
    rows = spark.range(3000).selectExpr(
        "cast(id % 97 as double) a", "cast(id % 11 as double) b", "id % 97 > 40 or id % 11 = 3 as deteriorated", "id % 7 = 0 as held")
    context, before = spark.sparkContext, len(spark.sparkContext._jsc.getPersistentRDDs())

    def jobs(trees):
        scheduler = context._jsc.sc().dagScheduler()
        first = scheduler.numTotalJobs()
        model = boosting.fit_boosted(rows, F.col("deteriorated").cast("int"), F.col("held"), ["a", "b"], max_iter=trees, depth=2)
        assert len(model.trees) == trees
        return scheduler.numTotalJobs() - first

    assert jobs(9) - jobs(2) == 7 * 2
    assert len(context._jsc.getPersistentRDDs()) == before


def test_stability_finds_planted_flips(spark):
    """One feature drives the event up in the early years and down in the late ones, another always up."""
    draw, flips, holds = np.random.default_rng(44), 5, 7
    rows = [list(r) for r in frame([2011, 2012, 2013, 2014, 2015], rows_per_year=80, test_from=2015)]
    for r in rows:
        turn, steady = draw.normal(size=2)
        r[flips], r[holds] = float(turn), float(steady)
        r[4] = bool((2 if r[2] < 2013 else -2) * turn + 2 * steady + draw.logistic() > 0)
    df = table(spark, [tuple(r) for r in rows]).cache()
    sections = experiment.rolling_stability(df, window=2, top_k=25)
    assert [r.window for r in sections["stability_windows"].collect()] == ["2011-2012", "2012-2013", "2013-2014"]
    overlaps = [r.jaccard for r in sections["stability_overlap"].collect()]
    assert len(overlaps) == 2 and all(0 <= j <= 1 for j in overlaps)
    names = [f"numeric__{preparation.NUMERIC[k - 5]}" for k in (flips, holds)]
    flipping = {r.feature for r in sections["sign_flipping_features"].collect()}
    stable = sections["sign_stable_features"].collect()
    assert names[0] in flipping and names[1] == stable[0].feature
    sizes = [r.min_absolute_coefficient for r in stable]
    assert sizes == sorted(sizes, reverse=True) and not flipping & {r.feature for r in stable}
    with pytest.raises(ValueError, match="two training windows"):
        experiment.rolling_stability(df, window=4)


def test_experiment_sections(training):
    sections = experiment.run_experiment(
        training, calibration_year=2020, window=1, top_k=10, boosting_iterations=2
    )
    rows = [(r.model_name, r.split) for r in sections["evaluations"].collect()]
    assert rows == [
        ("regressao_logistica", TRAIN), ("regressao_logistica", TEST),
        ("gradient_boosting", TRAIN), ("gradient_boosting", TEST),
        ("logistica_ajuste_curto", TEST), ("logistica_calibrada", TEST), ("apenas_escala", TEST),
    ]
    assert sections["highest_risk_explanations"].count() == 20
    gaps = experiment.calibration_gaps(
        {n: sections[f"{n}_calibration"] for n in ("base", "calibrated")}
    )
    assert [r.model_name for r in gaps.collect()] == ["base", "calibrated"]


def test_experiment_fits_run_side_by_side(training, monkeypatch):
    """Boosting is held up until all other fits have begun; one after the other they never would."""
    begun, boosted = {"reference": threading.Event(), "pair": threading.Event(), "windows": threading.Event()}, experiment.fit_comparison_model

    def marked(fit, name):
        def run(*arguments, **named):
            begun[name].set()
            return fit(*arguments, **named)

        return run

    def waiting(*arguments, **named):
        assert all(event.wait(30) for event in begun.values()), "the fits run one after the other"
        return boosted(*arguments, **named)

    monkeypatch.setattr(experiment, "fit_reference_model", marked(experiment.fit_reference_model, "reference"))
    monkeypatch.setattr(experiment, "calibrated_pair", marked(experiment.calibrated_pair, "pair"))
    monkeypatch.setattr(experiment, "rolling_stability", marked(experiment.rolling_stability, "windows"))
    monkeypatch.setattr(experiment, "fit_comparison_model", waiting)
    sections = experiment.run_experiment(training, calibration_year=2020, window=1, top_k=10, boosting_iterations=1)
    assert sections["evaluations"].count() == 7


def test_level_sums_are_exact_and_narrow(spark):
    """Full blocks whose gradients and hessians are as large as they come; what a task sends takes as few bytes as hold it."""
    draw, n = np.random.default_rng(7), boosting.BLOCK_ROWS
    blocks = []
    for k in range(3):
        bins = draw.integers(0, 256, (2, n)).astype(np.uint8)
        bins[0] = 9  # all in one cell
        blocks.append((n - k, bins, np.ones(n), np.zeros(n) if k else draw.normal(size=n)))
    state = spark.sparkContext.parallelize(blocks, 2)
    sums, _, held = boosting._level_sums(state, 2, None, [0])
    one, want = 2.0**boosting.FRACTION_BITS, np.zeros((3, 1, 2, 256), np.int64)
    for own, bins, label, score in blocks:
        p = 1 / (1 + np.exp(-score[:own]))
        for f in range(2):
            for k, numbers in enumerate((np.rint((p - label[:own]) * one), np.rint(p * (1 - p) * one), np.ones(own))):
                np.add.at(want[k, 0, f], bins[f, :own], numbers.astype(np.int64))
    assert (sums == want).all() and held == 3
    narrow = boosting._narrow()
    for most, kind in ((2**15 - 1, np.int16), (2**15, np.int32), (2**31 - 1, np.int32), (2**31, np.int64)):
        assert narrow(np.array([-most, 3])).dtype == kind and narrow(np.array([-most, 3])).tolist() == [-most, 3]


def test_boosting_blocks_are_full_and_a_tree_keeps_scores_alone(spark):
    """Rows of many Arrow batches share a block, and what is kept after a tree is a number for each row."""
    rows = spark.range(1000).coalesce(1).selectExpr("cast(id % 7 as double) a", "if(id % 5 = 0, null, cast(id as double)) b", "id % 3 = 0 y", "id % 10 = 9 held")
    cuts, batch = [np.arange(6.0), np.array([250.0, 600.0])], "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 100)
    try:
        table = boosting._binned(rows, ["a", "b"], cuts, F.col("y"), F.col("held"))
        (row,) = table.collect()
        blocks = boosting._first_blocks(table, 3, 2)
        state = boosting._state(blocks, boosting._one_by_one(blocks.map(lambda block: np.full(len(block[2]), 0.5))))
        tree = boosting.Tree(np.array([1, 0, -1, -1, -1, -1, -1]), np.array([1, 2, 0, 0, 0, 0, 0]),
                             np.array([True] + [False] * 6), np.array([0, 0, 3.0, 1.0, 2.0, 0, 0]))
        (score,) = boosting._scored(state, tree).collect()
    finally:
        spark.conf.unset(batch)
    assert row.own == 900 and len(row.label) == 8 * 1000
    ids = np.array([i for i in range(1000) if i % 10 != 9] + list(range(9, 1000, 10)))
    left = (ids % 5 == 0) | (ids <= 600)
    assert score.tolist() == np.where(left, np.where(ids % 7 <= 2, 1.5, 2.5), 3.5).tolist()


def test_logistic_blocks_hold_the_numbers_exactly_in_few_bytes(spark):
    numbers = {
        "a": ([1, -127, None], np.float32), "b": ([1, 127, -5], np.int8), "c": ([300, -1, 0], np.int16), "d": ([70_000, 1, 2], np.int32),
        "e": ([0.5, None, 2.0], np.float32), "f": ([0.1, None, 2.0], np.float64), "g": ([2.0**40 + 1, 1.0, 3.0], np.float64),
        "h": ([float("inf"), 1.0, 1e300], np.float64), "i": ([None, None, None], np.float32),
    }
    rows = [(*(float(v[i]) if v[i] is not None else None for v, _ in numbers.values()), i == 1, 2019 + i) for i in range(3)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in numbers) + ", deteriorated boolean, reference_year int").coalesce(1)
    ((columns, label, year),) = logistic._blocks(df, list(numbers)).collect()
    for (values, kind), found in zip(numbers.values(), columns):
        assert found.dtype == kind
        assert [None if np.isnan(x) else float(x) for x in found.astype(float)] == [None if v is None else float(v) for v in values]
    assert label.tolist() == [0, 1, 0] and year.tolist() == [2019, 2020, 2021]


def test_rows_are_read_once_for_all_steps(training, monkeypatch):
    train = training.where(F.col("split") == TRAIN)
    train.count()  # the fixture is kept itself
    read, blocks, sums, steps = 0, logistic._blocks, logistic._sums, []

    def reading(rows, features):
        nonlocal read
        read += 1
        return blocks(rows, features)

    monkeypatch.setattr(logistic, "_blocks", reading)
    monkeypatch.setattr(logistic, "_sums", lambda *arguments: steps.append(1) or sums(*arguments))
    kept = len(training.sparkSession.sparkContext._jsc.getPersistentRDDs())
    fits = models.ReferenceFits(train, {"all": None, "first": [2019]})
    alone = models.fit_reference_model(train)
    assert read == 1 and len(steps) > 2
    assert fits["all"].coefficients == pytest.approx(alone.coefficients, abs=1e-9) and fits["first"].fit.n == 40
    assert read == 2 and fits["all"].preparation.names == alone.preparation.names
    assert len(training.sparkSession.sparkContext._jsc.getPersistentRDDs()) == kept


def test_experiment_counts_values_once(training, monkeypatch):
    counted = []

    def counting(*arguments, **named):
        counted.append(1)
        return histogram(*arguments, **named)

    histogram = preparation.feature_histogram
    for module in (preparation, boosting, experiment):
        monkeypatch.setattr(module, "feature_histogram", counting, raising=False)
    experiment.run_experiment(training, calibration_year=2020, window=1, top_k=10, boosting_iterations=1)
    assert len(counted) == 1

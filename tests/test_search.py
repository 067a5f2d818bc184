"""Exact AUC of tree prefixes, searches that share fits, searches that go on."""

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from renewlens.operators import metrics as M
from renewlens.plans import fold_store, tuning
from renewlens.plans import model as model_plan
from renewlens.plans.model import FEATURES_COL, LABEL_COL, fit_watched, first_trees, patience_stop, prefix_auc, prefix_counts, prefix_margins
from renewlens.plans.tuning import cross_validate, decode_candidate, grid_groups, list_groups, search


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(4)
    g, h = r.integers(0, 9, 360), r.integers(0, 40, 360)
    y = (r.random(360) < 0.15 + 0.08 * g).astype(int)
    data = [(str(i), "xyz"[i % 3], int(g[i]), float(h[i]), int(y[i])) for i in range(360)]
    return spark.createDataFrame(data, "user_id string, city string, grade int, house_price double, is_renewal int").repartition(3).checkpoint()


@pytest.fixture(scope="module")
def fitted(spark):
    from pyspark.ml.classification import GBTClassifier

    r = np.random.default_rng(3)
    x = r.integers(0, 6, (400, 3)).astype(float)  # crowded: many rows share every score
    y = (r.random(400) < 0.1 + 0.12 * x[:, 0]).astype(float)
    data = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], [FEATURES_COL, LABEL_COL])
    return GBTClassifier(featuresCol=FEATURES_COL, labelCol=LABEL_COL, maxIter=70, maxDepth=3, stepSize=0.2, subsamplingRate=0.7, seed=1).fit(data), data


def exact(score, y):
    low = (score[y == 1][:, None] > score[y == 0][None, :]).sum() + 0.5 * (score[y == 1][:, None] == score[y == 0][None, :]).sum()
    return low / ((y == 1).sum() * (y == 0).sum())


def test_prefix_auc_is_exact(spark, fitted):
    """Every prefix on tied and crowded scores, against pairs counted one by one; no Python in the plan."""
    model, data = fitted
    x, y = (np.array(c) for c in zip(*[(r[0].toArray(), r[1]) for r in data.collect()]))
    parts = np.array([[w * t.predict(Vectors.dense(v)) for t, w in zip(model.trees, model.treeWeights)] for v in np.unique(x, axis=0)])
    margin = {tuple(v): p for v, p in zip(np.unique(x, axis=0), np.cumsum(parts, axis=1))}
    per_row = np.array([margin[tuple(v)] for v in x])
    want = [exact(per_row[:, i], y) for i in range(70)]
    assert np.allclose(prefix_auc(model, data), want, atol=1e-12)
    assert np.allclose(prefix_auc(model, data, [70, 5, 33]), [want[69], want[4], want[32]], atol=1e-12)
    got = prefix_margins(model, data, [2, 70]).collect()
    assert np.allclose(sorted(r["margins"][1] for r in got), sorted(per_row[:, 69]), atol=1e-12)
    assert "Python" not in prefix_margins(model, data, [70])._jdf.queryExecution().executedPlan().toString()
    assert prefix_auc(model, data.where(F.col(LABEL_COL) == 1.0), [1, 2]) == [None, None]


def test_prefix_margins_walk_the_trees_once(spark, fitted):
    """The plan does not grow with the prefixes, each row's leaves are found once, gaps sum up the same."""
    model, data = fitted
    plan = lambda wanted: prefix_margins(model, data, wanted)._jdf.queryExecution().executedPlan().toString()
    few, many = plan([1, 60]), plan(list(range(1, 61)))
    assert few.count("zip_with(") == many.count("zip_with(") and many.count(" aggregate(") <= 1 and many.count("slice(") == 0
    assert few.count("UDF(") == many.count("UDF(")
    every = {tuple(r["margins"][n - 1] for n in (3, 40, 66, 70)) for r in prefix_margins(model, data, list(range(1, 71))).collect()}
    some = {tuple(r["margins"]) for r in prefix_margins(model, data, [3, 40, 66, 70]).collect()}
    assert np.allclose(sorted(every), sorted(some), atol=1e-12)


def test_counting_walks_no_row_twice(spark, fitted, monkeypatch):
    """One walk in the plan (no filter on the array's size does it again below), over combinations of
    leaves where the trees are few; the same counts as row by row, a row without label in none."""
    model, data = fitted
    few = first_trees(model, 10)
    odd = data.union(spark.createDataFrame([(Vectors.dense([1.0, 2.0, 3.0]), None)], data.schema)).checkpoint()
    plan = lambda m: prefix_counts(m, odd, [2, 10])._jdf.queryExecution().optimizedPlan().toString()
    assert plan(few).count(" aggregate(") == 1 and plan(model).count(" aggregate(") == 1
    assert "Aggregate [_leaf" in plan(few) and "Aggregate [_leaf" not in plan(model)
    counted = lambda: sorted((r["prefix"], round(r["score"], 12), r["pos"], r["neg"]) for r in prefix_counts(few, odd, [2, 10]).collect())
    by_leaves, want = counted(), prefix_auc(few, odd, [2, 10])
    monkeypatch.setattr(model_plan, "LEAF_KEY_TREES", 0)
    assert counted() == by_leaves and prefix_auc(few, odd, [2, 10]) == pytest.approx(want, abs=1e-12)
    assert sum(p + n for k, _, p, n in by_leaves if k == 0) == 400


def test_a_watched_fit_ends_with_its_patience(fitted, monkeypatch):
    """The model kept is that of all trees cut by patience; trees behind the end are not fitted."""
    from pyspark.ml.classification import GBTClassifier

    monkeypatch.setattr(model_plan, "FIRST_TREES", 4)
    _, data = fitted
    total = 16
    train, valid = (data.where(F.pmod(F.xxhash64(FEATURES_COL, LABEL_COL), F.lit(3)) == 0), data.where(F.pmod(F.xxhash64(FEATURES_COL, LABEL_COL), F.lit(3)) > 0))
    gbt = GBTClassifier(featuresCol=FEATURES_COL, labelCol=LABEL_COL, maxIter=total, maxDepth=1, stepSize=0.3, subsamplingRate=0.7, seed=1)
    whole = gbt.fit(train)
    values = prefix_auc(whole, valid)
    fits, plain = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, *a: (fits.append(self.getMaxIter()), plain(self, *a))[1])
    shape = lambda model: [t.toDebugString.split("\n", 1)[1] for t in model.trees]
    for rounds in (1, total):
        fits.clear()
        got, keep = fit_watched(gbt, train, valid, rounds), patience_stop(values, rounds)
        assert shape(got) == shape(whole)[:keep]
        assert fits == ([4] if keep + rounds <= 4 else [4, total] if rounds == 1 else [total])
    fits.clear()
    assert len(fit_watched(gbt, train, valid.where(F.col(LABEL_COL) == 1.0), 1).trees) == total and fits == [4, total]


def test_early_stopping_asks_for_the_configured_trees(spark, monkeypatch):
    """The query fits the configured parameters: all trees, the whole depth."""
    from renewlens import catalog, config

    asked = []

    class Kept:
        trees = 3

    def noted(train, valid, params, overrides=None, early_stopping_rounds=None, **kw):
        assert not overrides and not kw and params == config.MODEL_PARAMS
        asked.append(early_stopping_rounds)
        return Kept

    monkeypatch.setattr(model_plan, "train_model", noted)
    got = catalog.QUERIES["early_stopping"](spark, SF_SMALL).collect()
    assert asked == [5, config.EARLY_STOPPING_ROUNDS]
    assert [tuple(r) for r in got] == [("patience_5", 600, 3), (f"patience_{config.EARLY_STOPPING_ROUNDS}", 600, 3)]


def test_cv_comparison_takes_the_configured_model_and_folds(spark, monkeypatch):
    """The default that the searched best meets is the configured one, on the configured folds."""
    from types import SimpleNamespace

    from renewlens import catalog, config

    asked = []
    monkeypatch.setattr(catalog, "_small_search", lambda *a, **kw: SimpleNamespace(base_params={"random_state": 42}, best_params={"max_depth": 3}))
    monkeypatch.setattr(tuning, "compare_with_default", lambda train, best, default, cv, seed, **kw: asked.append((best, default, cv, seed, kw)))
    catalog.QUERIES["cv_comparison"](spark, SF_SMALL)
    assert asked == [({"random_state": 42, "max_depth": 3}, config.MODEL_PARAMS, 5, config.RANDOM_STATE, {})]
    assert config.MODEL_PARAMS["n_estimators"] == 600 and config.MODEL_PARAMS["max_depth"] == 8


def test_fits_at_a_time_fill_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tuning.fits_at_a_time(spark, -1, 1) == cores and tuning.fits_at_a_time(spark, -1, 100) == max(2, cores // 4)
    assert tuning.fits_at_a_time(spark, -1) == max(2, cores // 4) and tuning.fits_at_a_time(spark, 3, 1) == 3


def test_constant_slots_are_left_out_of_fits(spark, rows, monkeypatch):
    """Slots of one value are no feature of a fit that takes all of them; scores are the same as with them."""
    from pyspark.ml.classification import GBTClassifier

    widths, plain = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, *a: (widths.append(len(a[0].first()[FEATURES_COL])), plain(self, *a))[1])
    space = [{"max_depth": 2, "n_estimators": 3, "learning_rate": 0.3}]
    table = lambda r: [x["test_score"] for x in r.fold_scores.orderBy("fold").collect()]
    some = table(cross_validate(rows, space, 2, 42, refit=False))
    whole = table(cross_validate(rows, [{**space[0], "colsample_bytree": 1.0}], 2, 42, refit=False))
    assert some == pytest.approx(whole, abs=1e-12)
    assert max(widths[:2]) < min(widths[2:]) and set(widths[:2]) == {3}
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_groups_cover_the_grid_once():
    space = {"a": [1, 2, 3], "n_estimators": [10, 20], "b": ["x", "y"]}
    found = {}
    for others, members in grid_groups(space):
        for i, n in members:
            found[i] = {**others, "n_estimators": n}
    assert found == {i: decode_candidate(space, i) for i in range(12)}
    assert len(list(grid_groups(space))) == 6
    assert [m for _, m in grid_groups({"a": [1, 2]})] == [[(0, None)], [(1, None)]]
    groups = list(list_groups([{"a": 1, "n_estimators": 3}, {"a": 2}, {"a": 1, "n_estimators": 1}]))
    assert groups == [({"a": 1}, [(0, 3), (2, 1)]), ({"a": 2}, [(1, None)])]


def test_five_numbers_of_trees_cost_one_fit(rows, monkeypatch):
    """Scores equal those of separate fits with the same seed."""
    from pyspark.ml.classification import GBTClassifier

    fits, plain = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, *a: (fits.append(self.getMaxIter()), plain(self, *a))[1])
    base = {"max_depth": 2, "learning_rate": 0.3, "subsample": 0.7, "random_state": 5}
    space = {"n_estimators": [1, 3, 4, 6, 8]}
    shared = cross_validate(rows, space, 2, 42, base_params=base, refit=False, return_train_score=True)
    assert fits == [8, 8]
    alone = {}
    for i, n in enumerate(space["n_estimators"]):
        one = cross_validate(rows, [{"n_estimators": n}], 2, 42, base_params=base, refit=False, return_train_score=True)
        alone.update({(i, r["fold"]): (r["test_score"], r["train_score"]) for r in one.fold_scores.collect()})
    assert len(fits) == 12
    for r in shared.fold_scores.collect():
        assert np.allclose((r["test_score"], r["train_score"]), alone[r["candidate"], r["fold"]], atol=1e-9)
    assert shared.summary.count() == 5 and shared.candidates is None


def test_a_stopped_search_goes_on(spark, rows, tmp_path, monkeypatch):
    """Stopped after three fits: the rest is run, the table is that of a search in one go."""
    space = {"max_depth": [1, 2], "n_estimators": [2, 3], "learning_rate": [0.1, 0.4]}
    kw = dict(cv=2, seed=7, refit=False, parallelism=1)
    whole = search(rows, space, "grid", store=str(tmp_path / "whole"), **kw)
    table = lambda r: sorted((x["candidate"], x["fold"], x["test_score"]) for x in r.fold_scores.collect())
    assert len(table(whole)) == 16
    put, ends = fold_store.FoldStore.put, []

    def cut(self, *a):
        if len(ends) == 3:
            raise KeyboardInterrupt
        ends.append(a[:2])
        put(self, *a)

    monkeypatch.setattr(fold_store.FoldStore, "put", cut)
    with pytest.raises(KeyboardInterrupt):
        search(rows, space, "grid", store=str(tmp_path / "cut"), **kw)
    again = []
    monkeypatch.setattr(fold_store.FoldStore, "put", lambda self, *a: (again.append(a[:2]), put(self, *a)))
    rest = search(rows, space, "grid", store=str(tmp_path / "cut"), **kw)
    assert len(ends) == 3 and len(again) == 5 and not set(ends) & set(again)
    assert table(rest) == table(whole) and rest.best_params == whole.best_params
    done = search(rows, space, "grid", store=str(tmp_path / "cut"), **kw)
    assert len(again) == 5 and table(done) == table(whole)
    with pytest.raises(ValueError, match="seed"):
        search(rows, space, "grid", store=str(tmp_path / "cut"), **{**kw, "seed": 8})
    with pytest.raises(ValueError, match="data"):
        search(rows.withColumn("house_price", F.col("house_price") + 1), space, "grid", store=str(tmp_path / "cut"), **kw)


def test_tasks_are_drawn_as_needed():
    from concurrent.futures import ThreadPoolExecutor

    drawn, ended = [], []

    def tasks():
        for i in range(20):
            assert len(drawn) - len(ended) < 3
            drawn.append(i)
            yield i

    with ThreadPoolExecutor(2) as pool:
        tuning._drawn(pool, ended.append, tasks(), 2)
    assert sorted(ended) == list(range(20))


def test_fold_scores_are_auc(rows):
    """A search's fold score is the exact AUC of the model's scores on the held-out fold."""
    from renewlens.operators.split import stratified_folds
    from renewlens.plans.model import train_model

    params = {"max_depth": 2, "n_estimators": 3, "learning_rate": 0.3, "random_state": 42}
    got = cross_validate(rows, [params], 2, 42, refit=False).fold_scores
    folds = stratified_folds(rows, 2, "is_renewal", seed=42)
    for r in got.collect():
        part = folds.where(F.col("fold") != r["fold"]).drop("fold")
        m = train_model(part, None, params, vocab_df=rows)
        held = m.score(folds.where(F.col("fold") == r["fold"]).drop("fold"))
        assert M.roc_auc(held, "pred_probability", "is_renewal").first().roc_auc == pytest.approx(r["test_score"], abs=1e-9)

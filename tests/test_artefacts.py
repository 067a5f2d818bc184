"""Versions and manifests; K1 / K2: a saved model keeps its recipes and rules."""

import copy

import pytest
from pyspark.sql import functions as F

from renewlens import config
from renewlens.functions import features
from renewlens.plans import artefacts
from renewlens.plans.model import RenewalModel, train_model


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(240).selectExpr("cast(id as string) as user_id", "if(id % 3 = 0, 'x', 'y') as city", "cast(id % 7 as int) as grade",
                                       "cast(id % 9 as int) as fns_cnt", "cast(id % 50 - 1 as double) as house_price", "cast(id % 4 as double) as city_score",
                                       "cast((id % 7) > 3 as int) as is_renewal").checkpoint()


@pytest.fixture(scope="module")
def model(rows):
    return train_model(rows, overrides={"maxIter": 4, "maxDepth": 3}, early_stopping_rounds=None)


def told(m, rows):
    return sorted(map(tuple, m.score(rows).select("user_id", config.PROBABILITY_COLUMN, config.LEVEL_COLUMN).collect()))


def test_a_save_that_is_cut_off_leaves_the_old_model(spark, rows, model, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    model.save(path)
    before = told(RenewalModel.load(spark, path), rows)
    changed = copy.copy(model)
    changed.threshold = 0.9
    # cut off after the pipeline, after the description, and before the manifest
    for name in ("renewlens.plans.model.write_json_row", "renewlens.plans.artefacts.files_digest", "renewlens.plans.artefacts.write_json_row"):
        with monkeypatch.context() as m:
            m.setattr(name, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
            with pytest.raises(KeyboardInterrupt):
                changed.save(path)
        kept = RenewalModel.load(spark, path)
        assert kept.threshold == model.threshold and told(kept, rows) == before
    assert len(artefacts.versions(spark, path)) == 1
    changed.save(path)
    assert RenewalModel.load(spark, path).threshold == 0.9
    first = artefacts.versions(spark, path)[0]
    assert [v["number"] for v in artefacts.versions(spark, path)] == [1, 2]
    assert RenewalModel.load(spark, path, first["version"]).threshold == model.threshold


def test_changed_files_are_refused(spark, model, tmp_path):
    path = str(tmp_path / "m")
    model.save(path)
    meta = next((tmp_path / "m" / "versions").glob("*/meta/*.txt"))
    (meta.parent / f".{meta.name}.crc").unlink()  # not every store has checksums of its own
    meta.write_text(meta.read_text().replace('"threshold": 0.5', '"threshold": 0.1'))
    with pytest.raises(FileNotFoundError, match="not those that were saved"):
        RenewalModel.load(spark, path)
    with pytest.raises(FileNotFoundError):
        RenewalModel.load(spark, str(tmp_path / "none"))


def test_moved_artefacts_load(spark, rows, model, tmp_path):
    import shutil

    model.save(str(tmp_path / "a"))
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    assert told(RenewalModel.load(spark, str(tmp_path / "b")), rows) == told(model, rows)


def test_later_code_does_not_change_a_saved_model(spark, rows, model, tmp_path, monkeypatch):
    """Recipes and level rules are the model's own."""
    path = model.save(str(tmp_path / "m"))
    before = told(model, rows)
    changed = [features.Recipe(r.inputs, r.output, lambda: F.lit(0.5), r.sql, "0.5D") for r in features.RECIPES]
    monkeypatch.setattr(features, "RECIPES", changed)
    monkeypatch.setattr(config, "LEVEL_TAG_RULES", [{"label": "Z", "min_prob": 0.0, "max_prob": 1.0}])
    assert told(RenewalModel.load(spark, path), rows) == before
    assert told(model, rows) == before
    fresh = train_model(rows, overrides={"maxIter": 1, "maxDepth": 1}, early_stopping_rounds=None)
    assert {r[2] for r in told(fresh, rows)} == {"Z"}


def test_expressions_equal_builders(spark):
    """The text form of every recipe gives what its builder gives, infinities and missing values included."""
    values = [None, 0.0, -1.0, -2.5, 1.0, 4.0, 5.0, 7.0, 1e308, float("nan"), float("inf")]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double")
    names = sorted({c for r in features.RECIPES for c in r.inputs})
    for i, r in enumerate(features.RECIPES):
        rows = df.select(*[F.col("a" if c == r.inputs[0] else "b").alias(c) for c in names])
        pair = rows.select(r.build().cast("double").alias("x"), F.expr(r.expression).cast("double").alias("y"))
        assert pair.where("NOT (x <=> y)").isEmpty(), r.output
    again = features.rebuilt_recipes(features.stored_recipes(features.RECIPES))
    assert [(r.inputs, r.output) for r in again] == [(r.inputs, r.output) for r in features.RECIPES]
    with pytest.raises(ValueError, match="z"):
        features.stored_recipes([features.Recipe(("a",), "z", lambda: F.lit(1), lambda: "1")])

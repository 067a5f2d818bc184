"""End-to-end jobs (I13): train, predict, tune.

Each job reads its input once, cuts lineage at the points that several
actions reuse (checkpoint to the shared folder), and returns its result
frames; writers put them in ``output_dir``. Analyses whose inputs are
missing (no label, no term column) are skipped, as the original does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import analysis as A
from ..operators import profile as P
from ..operators.metrics import evaluation_report
from ..operators.selection import drop_missing, ensure_not_empty
from ..operators.split import PART_TEST, PART_TRAIN, stratified_split
from ..sources.files import require_nonempty_batch, write_json_row, write_predictions, write_table
from .model import RenewalModel, materialize, train_model
from .tuning import compare_with_default, search


@dataclass
class JobResult:
    frames: dict = field(default_factory=dict)
    paths: dict = field(default_factory=dict)
    model: RenewalModel | None = None


def analyses(scored: DataFrame, target_col: str = config.TARGET_COLUMN, term_col: str = config.TERM_COLUMN) -> dict:
    """Every analysis the inputs allow (calibration needs a label; the term ones a term)."""
    out = {}
    cols = set(scored.columns)
    prob, level = config.PROBABILITY_COLUMN, config.LEVEL_COLUMN
    if target_col in cols:
        A.check_no_missing(scored, prob, target_col)
        buckets = A.bucket_summary(scored, prob, target_col)
        A.check_calibration_buckets(buckets)
        out["calibration_buckets"] = buckets
        if term_col in cols:
            ensure_not_empty(drop_missing(scored, [term_col, level, target_col, prob]), "scored rows with a term, level and label")
            perf = A.term_level_performance(scored, term_col, level, target_col)
            out["term_level_performance"] = perf
            out["level_summary"] = A.level_summary(perf, level)
            out["term_level_pivot"] = A.term_level_pivot(perf, term_col, level)
            out["term_trend"] = A.term_trend(scored, term_col, prob, target_col)
            out["chart_bounds"] = A.chart_bounds(scored, prob, target_col, term_col, level)
    if term_col in cols:
        ensure_not_empty(drop_missing(scored, [term_col, level]), "scored rows with a term and level")
        mix = A.level_mix(scored, term_col, level)
        out["level_mix"] = mix
        out["level_mix_pivot"] = A.level_mix_pivot(mix, term_col, level)
    return out


def _write_pivot_csv(res: JobResult, output_dir: str) -> None:
    """A5: the term x level pivot also as a header CSV (one small file)."""
    if "term_level_pivot" in res.frames:
        res.paths["term_level_pivot_csv"] = write_table(
            res.frames["term_level_pivot"].coalesce(1), f"{output_dir}/term_level_pivot_csv", fmt="csv")


def train_job(spark: SparkSession, data: DataFrame, output_dir: str | None = None, params: dict | None = None,
              target_col: str = config.TARGET_COLUMN, key_col: str = config.ID_COLUMN,
              test_size: float = config.TEST_SIZE, seed: int = config.RANDOM_STATE, overrides: dict | None = None,
              early_stopping: bool = True, validation_fraction: float | None = None,
              vocabulary_on_all_rows: bool = True,
              early_stopping_rounds: int | None = config.EARLY_STOPPING_ROUNDS) -> JobResult:
    """3.1: profile -> split -> fit -> evaluate -> score test -> analyses.

    By default it keeps the original's two leaks, named here: the category
    vocabulary is learned on all rows before the split, and early stopping
    watches the test part. ``vocabulary_on_all_rows=False`` learns it on the
    training part only; ``validation_fraction`` carves a stratified
    validation part out of the training part for early stopping, so the test
    part stays unseen until evaluation.
    """
    ensure_not_empty(data, "training data")
    res = JobResult()
    res.frames["profile_basic"] = P.basic_stats(data, target_col)
    res.frames["profile_missing"] = P.missing_counts(data)
    split = materialize(stratified_split(data, target_col, key_col, test_size, seed))
    res.frames["split_balance"] = P.split_balance(split, "part", target_col)
    train = split.where(F.col("part") == PART_TRAIN).drop("part")
    test = split.where(F.col("part") == PART_TEST).drop("part")
    fit_part, watch = train, test
    if validation_fraction:
        inner = stratified_split(train, target_col, key_col, validation_fraction, seed + 1)
        fit_part = inner.where(F.col("part") == PART_TRAIN).drop("part")
        watch = inner.where(F.col("part") == PART_TEST).drop("part")
    model = train_model(fit_part, watch if early_stopping else None, params or config.MODEL_PARAMS,
                        vocab_df=data if vocabulary_on_all_rows else train,
                        target_col=target_col, overrides=overrides, early_stopping_rounds=early_stopping_rounds)
    res.model = model
    scored_test = materialize(model.score(test))
    if output_dir:  # before the analyses: a label that they refuse must not cost the model
        res.paths["model"] = model.save(f"{output_dir}/model")
        res.paths["test_predictions"] = write_predictions(scored_test, f"{output_dir}/test_predictions")
    res.frames["evaluation_train"] = evaluation_report(model.score(train), config.PROBABILITY_COLUMN, target_col)
    res.frames["evaluation_test"] = evaluation_report(scored_test, config.PROBABILITY_COLUMN, target_col)
    res.frames["feature_importance"] = model.feature_importance(spark, 30)
    res.frames["test_predictions"] = scored_test
    res.frames.update(analyses(scored_test, target_col))
    if output_dir:
        for name, df in res.frames.items():
            if name != "test_predictions":
                res.paths[name] = write_table(df, f"{output_dir}/{name}")
        _write_pivot_csv(res, output_dir)
    return res


def predict_job(spark: SparkSession, model_dir: str, data: DataFrame, output_dir: str | None = None,
                target_col: str = config.TARGET_COLUMN, partition_by=None) -> JobResult:
    """3.2: load artefacts -> score once -> write -> analyses when a label / term exists."""
    model = RenewalModel.load(spark, f"{model_dir}")
    require_nonempty_batch(data)
    scored = materialize(model.score(data))
    res = JobResult(model=model)
    res.frames["predictions"] = scored
    if output_dir:  # before the analyses, which may refuse the labels
        res.paths["predictions"] = write_predictions(scored, f"{output_dir}/predictions", partition_by=partition_by)
    res.frames.update(analyses(scored, target_col))
    if output_dir:
        for name, df in res.frames.items():
            if name != "predictions":
                res.paths[name] = write_table(df, f"{output_dir}/{name}")
        _write_pivot_csv(res, output_dir)
    return res


def tune_job(spark: SparkSession, data: DataFrame, output_dir: str | None = None, space: dict | None = None,
             tuning: dict | None = None, target_col: str = config.TARGET_COLUMN, key_col: str = config.ID_COLUMN,
             default_params: dict | None = None, overrides: dict | None = None, final_overrides: dict | None = None,
             top_n: int = 10, resume_dir: str | None = None) -> JobResult:
    """3.4: split -> search on the training part -> top N -> comparison with
    the defaults on the same folds -> best and default fitted on the training
    part (early stop on the test part) and evaluated on the test part.

    ``resume_dir`` (a folder all executors share) keeps the search's fold scores: a job that was
    stopped goes on there with the fits that are missing."""
    from .tuning import cv_results

    tcfg = {**config.HYPERPARAMETER_TUNING_CONFIG, **(tuning or {})}
    res = JobResult()
    split = materialize(stratified_split(data, target_col, key_col, config.TEST_SIZE, tcfg["random_state"]))
    train = split.where(F.col("part") == PART_TRAIN).drop("part")
    test = split.where(F.col("part") == PART_TEST).drop("part")
    found = search(train, space or config.HYPERPARAMETER_SEARCH_SPACE, tcfg["search_method"], tcfg["n_iter"],
                   tcfg["cv"], tcfg["random_state"], target_col=target_col, overrides=overrides,
                   return_train_score=True, store=resume_dir)
    res.frames["cv_results"] = found.summary
    res.frames["cv_top"] = cv_results(found.summary, top_n)
    res.frames["fold_scores"] = found.fold_scores
    defaults = default_params or config.MODEL_PARAMS
    best = {**found.base_params, **found.best_params}  # the model that the search scored
    res.frames["comparison"] = compare_with_default(train, best, defaults, tcfg["cv"],
                                                    tcfg["random_state"], target_col=target_col, overrides=overrides)
    finals = []
    for name, params in (("best", best), ("default", defaults)):
        m = train_model(train, test, params, vocab_df=data, target_col=target_col, overrides=final_overrides or overrides)
        finals.append(evaluation_report(m.score(test), config.PROBABILITY_COLUMN, target_col)
                      .select(F.lit(name).alias("model"), "*"))
    res.frames["holdout_comparison"] = finals[0].unionByName(finals[1])
    if output_dir:
        res.paths["best_params"] = write_json_row(spark, {"best_params": found.best_params,
                                                          "best_score": found.best_score}, f"{output_dir}/best_params")
        for name in ("cv_results", "comparison", "holdout_comparison"):
            res.paths[name] = write_table(res.frames[name], f"{output_dir}/{name}")
    return res

"""Boosted-tree renewal model on Spark MLlib.

Training:
  derive recipes + sanitize (DataFrame code) -> feature stages fitted on the
  vocabulary rows (all rows by default, like the original) -> the prepared
  training table (features, label[, validation flag]) is checkpointed to the
  shared checkpoint folder and persisted, so GBT's many passes neither
  recompute the upstream plan nor lose it with an executor -> GBTClassifier
  (checkpointInterval keeps its own lineage short).
Scoring is one ``transform``: no second pass for labels; probability is
element 1 of the probability vector.

Parameter mapping (reference names -> GBTClassifier): max_depth -> maxDepth,
learning_rate -> stepSize, n_estimators -> maxIter, subsample ->
subsamplingRate, colsample_bytree -> featureSubsetStrategy (per node, not per
tree), min_child_weight -> minInstancesPerNode (a count, not a Hessian sum),
reg_alpha / reg_lambda / gamma have no MLlib counterpart (gamma's scale is
not MLlib's minInfoGain scale): a warning says so. Early stopping watches the
validation part's AUC of every tree prefix, with a patience of 30 rounds, and cuts
the fitted model after the best prefix.
"""

from __future__ import annotations

import copy
import re
import warnings
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import features
from ..functions.features import applicable_recipes, derive_features, sanitize_numeric
from ..functions.levels import level_tag
from ..operators.metrics import auc_from_counts, dealt_counts
from ..operators.selection import check_threshold
from ..session import ensure_checkpoint_dir
from ..sources.files import read_json_row, write_json_row
from .artefacts import find_version, save_version
from .features import (FEATURES_COL, FeatureSpec, fit_feature_model, fit_wide_columns, plan_features, source_feature,
                       vocabulary_sizes, with_wide_codes)

LABEL_COL = "__label"
MIN_MAX_BINS = 32
#: Trees that a fit watched for early stopping begins with, at least.
FIRST_TREES = 32
#: Rows of a model of at most so many trees are counted by their combination of leaves before scores are summed.
LEAF_KEY_TREES = 16


def gbt_params(params: dict | None) -> dict:
    """Reference-style parameters -> GBTClassifier keyword arguments."""
    p = dict(config.TRAINER_DEFAULT_PARAMS if params is None else params)
    out = {
        "maxDepth": int(p.get("max_depth", 6)),
        "stepSize": float(p.get("learning_rate", 0.1)),
        "maxIter": int(p.get("n_estimators", 100)),
        "subsamplingRate": float(p.get("subsample", 1.0)),
        "minInstancesPerNode": max(1, int(round(float(p.get("min_child_weight", 1))))),
        "seed": int(p.get("random_state", config.RANDOM_STATE)),
    }
    col = float(p.get("colsample_bytree", 1.0))
    out["featureSubsetStrategy"] = "all" if col >= 1.0 else repr(col)
    # gamma is a loss-reduction threshold in the booster's own (sum-of-Hessian)
    # units; MLlib's minInfoGain is a per-row impurity decrease, so a direct
    # copy (0.2 of a variance <= 0.25) would forbid every split.
    ignored = [k for k in ("reg_alpha", "reg_lambda", "gamma") if p.get(k)]
    if ignored:
        warnings.warn(f"no MLlib counterpart, not applied: {', '.join(ignored)}")
    return out


def prepare_input(df: DataFrame, recipes=None) -> DataFrame:
    """Recipes + sanitizing; columns a recipe overwrites keep their input value
    under ``__in_<name>`` so scored output shows the input as given."""
    overwritten = [r.output for r in applicable_recipes(df.columns, recipes) if r.output in df.columns]
    kept = df.select("*", *[F.col(c).alias(f"__in_{c}") for c in overwritten])
    return sanitize_numeric(derive_features(kept, recipes))


def restore_input_columns(df: DataFrame, input_cols) -> list:
    names = set(df.columns)
    return [F.col(f"__in_{c}").alias(c) if f"__in_{c}" in names else F.col(c) for c in input_cols]


@dataclass
class RenewalModel:
    pipeline: PipelineModel
    spec: FeatureSpec
    threshold: float = config.DEFAULT_THRESHOLD
    target_col: str = config.TARGET_COLUMN
    trees: int = 0
    # What the model was trained with; later changes of the lists do not reach it.
    recipes: list = field(default_factory=lambda: list(features.RECIPES))
    rules: list = field(default_factory=lambda: copy.deepcopy(config.LEVEL_TAG_RULES))
    vocabulary: DataFrame | None = None  # of the wide category columns

    # -- B10 ------------------------------------------------------------------
    def set_threshold(self, t: float) -> None:
        self.threshold = check_threshold(t)

    def get_threshold(self) -> float:
        return self.threshold

    # -- I4 / I5 / B3 / B9 / H12 ------------------------------------------------
    def _features_frame(self, df: DataFrame) -> DataFrame:
        prepared = prepare_input(df, self.recipes)
        missing = [c for c in self.spec.features if c not in prepared.columns]
        for c in missing:  # B3: absent feature columns become typed nulls
            dtype = "string" if c in self.spec.categorical + self.spec.wide else "double"
            prepared = prepared.withColumn(c, F.lit(None).cast(dtype))
        return with_wide_codes(prepared, self.spec, self.vocabulary)

    def score(self, df: DataFrame, threshold: float | None = None, rules=None) -> DataFrame:
        """Input columns + pred_probability, pred_label, level_tag (one transform)."""
        t = check_threshold(self.threshold if threshold is None else threshold)
        out = self.pipeline.transform(self._features_frame(df))
        p = vector_to_array(F.col("probability")).getItem(1)
        return out.select(
            *restore_input_columns(out, df.columns),
            p.alias(config.PROBABILITY_COLUMN),
            (p >= F.lit(t)).cast("int").alias(config.PRED_LABEL_COLUMN),
            level_tag(p, self.rules if rules is None else rules).alias(config.LEVEL_COLUMN),
        )

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.score(df).select(config.PROBABILITY_COLUMN)

    # -- F5 ---------------------------------------------------------------------
    def feature_importance(self, spark: SparkSession, top_n: int | None = 20) -> DataFrame:
        """Importance per feature (value slot + missing indicator summed), descending."""
        gbt = self.pipeline.stages[-1]
        vec = gbt.featureImportances.toArray()
        agg: dict[str, float] = {}
        for name, v in zip(self.spec.assembled, vec):
            f = source_feature(name)
            agg[f] = agg.get(f, 0.0) + float(v)
        rows = [(f, agg.get(f, 0.0)) for f in self.spec.features]
        df = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
        return df.limit(top_n) if top_n else df

    # -- A7 / A8 / A9 -----------------------------------------------------------
    def save(self, path: str) -> str:
        """A new version under ``path`` (``plans.artefacts``); what was saved before stays."""
        spark = SparkSession.getActiveSession()
        meta = {"spec": self.spec.to_json(), "threshold": self.threshold, "target_col": self.target_col,
                "trees": self.trees, "recipes": features.stored_recipes(self.recipes), "rules": self.rules}

        def write(folder: str) -> None:
            self.pipeline.write().save(f"{folder}/pipeline")
            if self.vocabulary is not None:
                self.vocabulary.write.parquet(f"{folder}/vocabulary")
            write_json_row(spark, meta, f"{folder}/meta")

        save_version(spark, path, write)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> "RenewalModel":
        """The newest whole version under ``path``, or the one named."""
        try:
            folder = find_version(spark, path, version)
            pipeline = PipelineModel.load(f"{folder}/pipeline")
            meta = read_json_row(spark, f"{folder}/meta")
        except Exception as exc:  # one clear error whatever part is missing
            raise FileNotFoundError(f"model artefacts missing or unreadable under {path}: {exc}") from exc
        spec = FeatureSpec.from_json(meta["spec"])
        vocabulary = spark.read.parquet(f"{folder}/vocabulary") if spec.wide else None
        return cls(pipeline, spec, float(meta["threshold"]), meta["target_col"], int(meta.get("trees", 0)),
                   features.rebuilt_recipes(meta["recipes"]), meta["rules"], vocabulary)


def _prepared_training(feature_model: PipelineModel, df: DataFrame, target_col: str) -> DataFrame:
    out = feature_model.transform(df)
    return out.select(FEATURES_COL, F.col(target_col).cast("double").alias(LABEL_COL))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: reliable checkpoint to the shared checkpoint folder (MLlib keeps its own copy while it fits)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def patience_stop(values, rounds: int) -> int:
    """Trees to keep: the best (highest) prefix, scanning until ``rounds`` iterations
    pass without a better value (then later trees are ignored)."""
    best_i, best = 0, float("-inf")
    for i, value in enumerate(values):
        if value > best:
            best_i, best = i, value
        elif i - best_i >= rounds:
            break
    return best_i + 1


def leaf_values(model) -> list[list[float]]:
    """Per tree, its weight times the prediction of each leaf, in the order of the leaf numbers
    that ``leafCol`` gives (left before right, as the printed tree has them)."""
    return [[weight * float(x) for x in re.findall(r"Predict: (\S+)", tree.toDebugString)]
            for tree, weight in zip(model.trees, model.treeWeights)]


def _leaves(model, data: DataFrame) -> DataFrame:
    """Label and, as one array, the leaf number of every tree (one transform)."""
    rows = model.copy({model.leafCol: "_leaf"}).transform(data.select(FEATURES_COL, LABEL_COL))
    return rows.select(LABEL_COL, vector_to_array("_leaf").alias("_leaf"))


def _with_margins(model, rows: DataFrame, prefixes: list[int]) -> DataFrame:
    """``rows`` with ``margins`` for their ``_leaf``: each leaf's value is looked up in one array of the
    model's leaves (trees x leaves, whatever the data) and summed up to each prefix. No Python."""
    spark = rows.sparkSession
    leaves = leaf_values(model)
    values = spark.createDataFrame([(leaves, [n + 1 in prefixes for n in range(len(leaves))])], "v array<array<double>>, ends array<boolean>")
    others = [c for c in rows.columns if c != "_leaf"]
    rows = rows.select("*", values.select(F.struct("v", "ends")).scalar().alias("_model"))
    # One walk over the trees, started from the leaves themselves: an expression for each prefix would
    # find every row's leaves once more for it, or swell to a method that the JVM no longer compiles.
    parts = F.zip_with(F.zip_with("_leaf", "_model.v", lambda leaf, v: F.get(v, leaf.cast("int"))), "_model.ends",
                       lambda x, end: F.struct(x.alias("x"), end.alias("end")))
    start = F.struct(F.lit(0.0).alias("step"), F.array().cast("array<double>").alias("got"))

    def walk(so_far, part):
        step, got = so_far["step"] + part["x"], so_far["got"]
        last = F.coalesce(F.get(got, F.size(got) - 1), F.lit(0.0))
        return F.when(part["end"], F.struct(F.lit(0.0).alias("step"), F.array_append(got, last + step).alias("got"))).otherwise(
            F.struct(step.alias("step"), got.alias("got")))

    margins = F.aggregate(parts, start, walk, lambda so_far: so_far["got"])
    return rows.select(*others, margins.alias("margins"))


def prefix_margins(model, data: DataFrame, prefixes: list[int]) -> DataFrame:
    """``data`` with ``margins``: the margin after each of the (ascending) numbers of trees."""
    return _with_margins(model, _leaves(model, data), prefixes)


def prefix_counts(model, data: DataFrame, prefixes: list[int]) -> DataFrame:
    """``prefix`` (place in ``prefixes``, ascending), ``score``, ``pos``, ``neg``: rows per distinct margin.

    Rows that meet in every leaf share all margins. Of a model of at most ``LEAF_KEY_TREES`` trees
    they are counted first, and each combination of leaves is walked once.
    """
    rows, positive = _leaves(model, data), F.col(LABEL_COL) > 0.5
    if len(model.trees) <= LEAF_KEY_TREES:
        rows = rows.groupBy("_leaf").agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    else:
        one = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long")
        rows = rows.select("_leaf", one(positive).alias("pos"), one(~positive).alias("neg"))
    # No row is without margins, so this is posexplode; but for that Spark infers a filter on the
    # size of the array, which it pushes down to the rows: every row's walk was done again there.
    each = _with_margins(model, rows, prefixes).select(F.posexplode_outer("margins").alias("prefix", "score"), "pos", "neg")
    return each.groupBy("prefix", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def prefix_auc(model, data: DataFrame, prefixes: list[int] | None = None) -> list[float | None]:
    """Exact ROC-AUC (ties half) on ``data`` (features, label) of the model's first n trees, for every n
    or those in ``prefixes``; None where only one class is there.

    Every (prefix, distinct margin) is counted, dealt by range and summed up like any other
    score (``operators.metrics``): nothing is binned and nothing but the result is gathered.
    """
    wanted = sorted(set(prefixes or range(1, len(model.trees) + 1)))
    counts = prefix_counts(model, data, wanted)
    got = {wanted[r["prefix"]]: r["roc_auc"] for r in auc_from_counts(dealt_counts(counts, ["prefix"]), ["prefix"]).collect()}
    return [got.get(n) for n in prefixes or wanted]


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The fitted model cut after its first ``n`` trees."""
    sc = SparkSession.getActiveSession().sparkContext
    jvm, java = sc._jvm, model._java_obj
    trees = sc._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(jvm.double, n)
    given, weight = java.trees(), list(java.treeWeights())
    for i in range(n):
        trees[i], weights[i] = given[i], float(weight[i])
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights, java.numFeatures(), 2)
    java.copyValues(cut, jvm.org.apache.spark.ml.param.ParamMap())
    return GBTClassificationModel(cut)


def fit_watched(gbt: GBTClassifier, train: DataFrame, valid: DataFrame, rounds: int) -> GBTClassificationModel:
    """The fit of all ``maxIter`` trees, cut after its best prefix on ``valid`` (``patience_stop``).

    A fit of fewer trees is the first trees of the whole one. So the fit begins with
    ``FIRST_TREES`` or twice the patience and grows fourfold until the patience has run out, behind
    which no tree is looked at, or all trees are there.
    """
    total = gbt.getMaxIter()
    n = min(total, max(FIRST_TREES, 2 * rounds))
    while True:
        model = gbt.copy({gbt.maxIter: n}).fit(train)
        values = prefix_auc(model, valid)
        if any(v is None for v in values):  # one class only: no AUC, nothing to watch
            return model if n == total else gbt.fit(train)
        keep = patience_stop(values, rounds)
        if n == total or n - keep >= rounds:
            return first_trees(model, keep) if keep < n else model
        n = 4 * n if 8 * n <= total else total


def train_model(
    train_df: DataFrame,
    valid_df: DataFrame | None = None,
    params: dict | None = None,
    vocab_df: DataFrame | None = None,
    target_col: str = config.TARGET_COLUMN,
    include=None,
    exclude=None,
    overrides: dict | None = None,
    early_stopping_rounds: int | None = config.EARLY_STOPPING_ROUNDS,
) -> RenewalModel:
    """Fit features (vocabulary on ``vocab_df``, default: train + valid) and GBT.

    With a validation part, ``prefix_auc`` gives the validation AUC of every prefix, and the model
    is cut after the best one before ``early_stopping_rounds`` rounds pass without a better (None:
    keep all trees); trees behind that point are not fitted. ``threshold`` in ``params`` is kept.
    """
    train_in = prepare_input(train_df)
    vocab_in = prepare_input(vocab_df) if vocab_df is not None else (
        train_in if valid_df is None else train_in.unionByName(prepare_input(valid_df), allowMissingColumns=True)
    )
    spec = plan_features(train_df, target_col, include, exclude)
    vocabulary = fit_wide_columns(vocab_in, spec)
    feature_model = fit_feature_model(vocab_in if vocabulary is None else with_wide_codes(vocab_in, spec, vocabulary), spec)
    sizes = vocabulary_sizes(feature_model)
    max_bins = max([MIN_MAX_BINS] + [n + 1 for n in sizes.values()])

    # cacheNodeIds stays MLlib's default (False): faster in our measurements at depth 4 and 8;
    # pass {"cacheNodeIds": True} in overrides for very deep trees on large data.
    kwargs = {"checkpointInterval": 10, "cacheNodeIds": False, **gbt_params(params), **(overrides or {})}
    gbt = GBTClassifier(featuresCol=FEATURES_COL, labelCol=LABEL_COL, maxBins=max_bins, **kwargs)
    fit_rows = materialize(_prepared_training(feature_model, with_wide_codes(train_in, spec, vocabulary), target_col))
    if valid_df is not None and early_stopping_rounds:
        valid = _prepared_training(feature_model, with_wide_codes(prepare_input(valid_df), spec, vocabulary), target_col)
        gbt_model = fit_watched(gbt, fit_rows, valid, int(early_stopping_rounds))
    else:
        gbt_model = gbt.fit(fit_rows)
    pipeline = PipelineModel(stages=[*feature_model.stages, gbt_model])
    threshold = check_threshold((params or {}).get("threshold", config.DEFAULT_THRESHOLD))
    return RenewalModel(pipeline, spec, threshold, target_col, len(gbt_model.trees), vocabulary=vocabulary)


def attach_scores(df: DataFrame, scores: DataFrame, key: str = config.ID_COLUMN) -> DataFrame:
    """Stored scores joined to their rows by key (left; sort-merge or broadcast by size).

    A key with several scores would multiply rows: it raises, with the number of such keys.
    """
    twice = scores.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
    if twice:
        raise ValueError(f"{twice} keys have more than one score")
    return df.join(scores, key, "left")

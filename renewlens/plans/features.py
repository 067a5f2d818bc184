"""Feature pipeline on MLlib.

The recipe columns and the sanitizing run before the pipeline as plain
DataFrame code (``plans.model.prepare_input``). Stages, all built-in and
persistable:
  1. one multi-column StringIndexer for the text features (sorted
     vocabularies learned in one pass; unseen and null share the extra index,
     handleInvalid="keep");
  2. SQLTransformer: per numeric feature a 0/1 missing indicator and a
     sentinel fill below any real value (MLlib trees reject NaN), so the
     trees can still send missing rows their own way;
  3. VectorAssembler.
Category columns of more than ``MAX_VOCABULARY`` values are no indexer's: before the stages
they are encoded by a joined table (``plans.vocabulary``). The trees take such a column's
positions as one ordered number with quantile bins, not as categories.
The feature list is resolved once, from the training frame's columns, and
stored with the model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.features import applicable_recipes
from ..operators.selection import select_feature_names
from .vocabulary import encode_by_table, vocabulary_table

MISSING_SENTINEL = -1.0e9
# Largest vocabulary of an indexer, about (values are counted approximately).
MAX_VOCABULARY = 10_000
WIDE_SUFFIX = "__code"
FEATURES_COL = "features"


def category_indexer(columns, suffix: str) -> StringIndexer:
    """One multi-column StringIndexer: every vocabulary is learned in one pass."""
    return StringIndexer(inputCols=list(columns), outputCols=[f"{c}{suffix}" for c in columns],
                         handleInvalid="keep", stringOrderType="alphabetAsc")


def fit_category_indexers(df: DataFrame, columns) -> PipelineModel:
    """H8: text columns present -> ``<c>_index`` (sorted vocabulary; unseen / null -> extra index)."""
    types = dict(df.dtypes)
    cols = [c for c in columns if types.get(c) == "string"]
    return Pipeline(stages=[category_indexer(cols, "_index")] if cols else []).fit(df)


@dataclass
class FeatureSpec:
    """What the fitted feature stages consume and produce."""

    features: list[str]
    categorical: list[str]
    numeric: list[str]
    assembled: list[str] = field(default_factory=list)
    input_types: dict = field(default_factory=dict)
    wide: list[str] = field(default_factory=list)  # category columns encoded by a table

    def to_json(self) -> dict:
        return {"features": self.features, "categorical": self.categorical, "numeric": self.numeric,
                "assembled": self.assembled, "input_types": self.input_types, "wide": self.wide}

    @classmethod
    def from_json(cls, d: dict) -> "FeatureSpec":
        return cls(d["features"], d["categorical"], d["numeric"], d.get("assembled", []), d.get("input_types", {}),
                   d.get("wide", []))


def plan_features(df: DataFrame, target_col: str = config.TARGET_COLUMN, include=None, exclude=None) -> FeatureSpec:
    """Resolve the feature list from the columns the derive step will produce."""
    derived_cols = list(df.columns)
    for r in applicable_recipes(df.columns):
        if r.output not in derived_cols:
            derived_cols.append(r.output)
    feats = select_feature_names(derived_cols, target_col, include, exclude)
    types = dict(df.dtypes)
    categorical = [c for c in feats if c in config.CATEGORICAL_COLUMNS and types.get(c) == "string"]
    other = [c for c in feats if types.get(c) == "string" and c not in categorical]
    if other:
        raise ValueError(f"text columns without a role: {', '.join(other)}; exclude them or make them numbers")
    numeric = [c for c in feats if c not in categorical]
    return FeatureSpec(feats, categorical, numeric, input_types={c: types[c] for c in df.columns if c in feats})


def feature_stages(df: DataFrame, spec: FeatureSpec) -> list:
    """Unfitted stages 1-3 for ``spec`` (fit them on the rows that define the vocabulary)."""
    stages = [category_indexer(spec.categorical, "__idx")] if spec.categorical else []
    fill = ", ".join(
        f"COALESCE(CAST(`{c}` AS DOUBLE), CAST({MISSING_SENTINEL} AS DOUBLE)) AS `{c}__val`, "
        f"CAST(`{c}` IS NULL AS DOUBLE) AS `{c}__missing`"
        for c in spec.numeric
    )
    stages.append(SQLTransformer(statement=f"SELECT *{', ' + fill if fill else ''} FROM __THIS__"))
    spec.assembled = [f"{c}__idx" for c in spec.categorical] + [f"{c}{WIDE_SUFFIX}" for c in spec.wide] + [x for c in spec.numeric for x in (f"{c}__val", f"{c}__missing")]
    stages.append(VectorAssembler(inputCols=spec.assembled, outputCol=FEATURES_COL, handleInvalid="error"))
    return stages


def wide_columns(df: DataFrame, columns, limit: int = MAX_VOCABULARY) -> list[str]:
    """The columns with more than ``limit`` values (approximate counts, one aggregate)."""
    if not columns:
        return []
    row = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > limit]


def check_vocabularies(df: DataFrame, columns, limit: int = MAX_VOCABULARY) -> None:
    """Raise when a category column has more than ``limit`` values: an indexer's vocabulary is held
    on the driver and sets the trees' bins."""
    wide = wide_columns(df, columns, limit)
    if wide:
        raise ValueError(f"more than {limit} categories in: {', '.join(wide)}")


def fit_wide_columns(df: DataFrame, spec: FeatureSpec, limit: int | None = None) -> DataFrame | None:
    """Take the wide category columns out of the indexer's: they are noted in ``spec.wide`` and
    their vocabulary table is returned (None: there are none)."""
    spec.wide = wide_columns(df, spec.categorical, MAX_VOCABULARY if limit is None else limit)
    spec.categorical = [c for c in spec.categorical if c not in spec.wide]
    return vocabulary_table(df, spec.wide) if spec.wide else None


def with_wide_codes(df: DataFrame, spec: FeatureSpec, vocabulary: DataFrame | None) -> DataFrame:
    """``df`` with the positions of its wide category columns, as the stages take them."""
    return encode_by_table(df, vocabulary, spec.wide, WIDE_SUFFIX) if spec.wide else df


def fit_feature_model(df: DataFrame, spec: FeatureSpec) -> PipelineModel:
    """Learn the vocabularies on ``df`` (all rows, as the original does)."""
    check_vocabularies(df, spec.categorical)
    return Pipeline(stages=feature_stages(df, spec)).fit(df)


def vocabulary_sizes(model: PipelineModel) -> dict:
    from pyspark.ml.feature import StringIndexerModel

    out = {}
    for s in model.stages:
        if isinstance(s, StringIndexerModel):
            out.update({c: len(labels) for c, labels in zip(s.getInputCols(), s.labelsArray)})
    return out


def source_feature(assembled_name: str) -> str:
    """Map an assembled slot back to its feature name (value + indicator -> feature)."""
    for suffix in ("__idx", WIDE_SUFFIX, "__val", "__missing"):
        if assembled_name.endswith(suffix):
            return assembled_name[: -len(suffix)]
    return assembled_name


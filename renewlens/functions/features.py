"""Feature recipes (H1-H6, B2, K1) and numeric sanitizing.

Each recipe is (inputs, output, Column builder, SQL builder). Recipes run in
order on the growing table and only when all their inputs exist. Builders
reproduce IEEE results (x / 0 -> +/-inf or NaN, log1p(-1) -> -inf,
log1p(x < -1) -> NaN) so infinities can be counted like the original does;
``sanitize`` then turns every NaN / infinity into null, the one missing value
used downstream.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS_INF = float("inf")
NEG_INF = float("-inf")
NAN = float("nan")


def ieee_divide(num: Column, den: Column) -> Column:
    """num / den with IEEE results at den = 0 (ANSI division would raise)."""
    n, d = num.cast("double"), den.cast("double")
    at_zero = F.when(n > 0, F.lit(POS_INF)).when(n < 0, F.lit(NEG_INF)).otherwise(F.lit(NAN))
    return F.when(d == 0, F.when(n.isNull(), F.lit(None).cast("double")).otherwise(at_zero)).otherwise(
        F.try_divide(n, d)
    )


def ieee_log1p(x: Column) -> Column:
    """log1p with -inf at -1 and NaN below (Spark's log1p returns null there)."""
    v = x.cast("double")
    return F.when(v == -1.0, F.lit(NEG_INF)).when(v < -1.0, F.lit(NAN)).otherwise(F.log1p(v))


def is_nonfinite(c: Column) -> Column:
    v = c.cast("double")
    return F.isnan(v) | (F.abs(v) == F.lit(POS_INF))


def sanitize(c: Column) -> Column:
    """NaN / +-inf -> null, other values kept (H7)."""
    return F.when(is_nonfinite(c), F.lit(None).cast("double")).otherwise(c.cast("double"))


# SQL text (DuckDB) of the same builders -------------------------------------

def _sql_ieee_divide(n: str, d: str) -> str:
    n, d = f"CAST({n} AS DOUBLE)", f"CAST({d} AS DOUBLE)"
    return (
        f"CASE WHEN {d} = 0 THEN (CASE WHEN {n} IS NULL THEN NULL WHEN {n} > 0 THEN CAST('inf' AS DOUBLE) "
        f"WHEN {n} < 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END) ELSE {n} / {d} END"
    )


def _sql_ieee_log1p(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return (
        f"CASE WHEN {v} = -1 THEN CAST('-inf' AS DOUBLE) WHEN {v} < -1 THEN CAST('nan' AS DOUBLE) "
        f"ELSE ln(1 + {v}) END"
    )


def sanitize_sql(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN isnan({v}) OR abs({v}) = CAST('inf' AS DOUBLE) THEN NULL ELSE {v} END"


@dataclass(frozen=True)
class Recipe:
    inputs: tuple[str, ...]
    output: str
    build: Callable[[], Column]
    sql: Callable[[], str]
    #: The builder as Spark SQL text; what a saved model keeps of a recipe.
    expression: str | None = None


def _c(name: str) -> Column:
    return F.col(name)


def _stored_divide(n: str, d: str) -> str:
    n, d = f"CAST({n} AS DOUBLE)", f"({d})"
    return (f"CASE WHEN {d} = 0 THEN CASE WHEN {n} > 0 THEN DOUBLE('Infinity') WHEN {n} < 0 THEN DOUBLE('-Infinity') "
            f"WHEN {n} IS NOT NULL THEN DOUBLE('NaN') END ELSE try_divide({n}, {d}) END")


def _stored_log1p(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN {v} = -1 THEN DOUBLE('-Infinity') WHEN {v} < -1 THEN DOUBLE('NaN') ELSE log1p({v}) END"


def stored_recipes(recipes) -> list[dict]:
    """Recipes as plain values, to be kept with a model."""
    without = [r.output for r in recipes if not r.expression]
    if without:
        raise ValueError(f"recipes without an expression cannot be saved: {', '.join(without)}")
    return [{"inputs": list(r.inputs), "output": r.output, "expression": r.expression} for r in recipes]


def rebuilt_recipes(stored: list[dict]) -> list[Recipe]:
    """The recipes that ``stored_recipes`` gave."""
    return [Recipe(tuple(d["inputs"]), d["output"], lambda e=d["expression"]: F.expr(e), lambda e=d["expression"]: e, d["expression"]) for d in stored]


# The recipe list is an extension point: append (inputs, output, builders, expression).
RECIPES: list[Recipe] = [
    Recipe(("house_price",), "house_price_log",
           lambda: ieee_log1p(_c("house_price")),
           lambda: _sql_ieee_log1p("house_price"), _stored_log1p("house_price")),
    Recipe(("city_score", "house_price"), "city_score_house_price_ratio",
           lambda: ieee_divide(_c("city_score"), _c("house_price").cast("double") + 1.0),
           lambda: _sql_ieee_divide("city_score", "CAST(house_price AS DOUBLE) + 1"),
           _stored_divide("city_score", "CAST(house_price AS DOUBLE) + 1D")),
    Recipe(("fns_cnt", "grade"), "fns_cnt_per_grade",
           lambda: ieee_divide(_c("fns_cnt"), _c("grade").cast("double") + 1.0),
           lambda: _sql_ieee_divide("fns_cnt", "CAST(grade AS DOUBLE) + 1"),
           _stored_divide("fns_cnt", "CAST(grade AS DOUBLE) + 1D")),
    Recipe(("is_enable", "fns_cnt"), "is_enable_fns_interaction",
           lambda: _c("is_enable").cast("double") * _c("fns_cnt").cast("double"),
           lambda: "CAST(is_enable AS DOUBLE) * CAST(fns_cnt AS DOUBLE)", "CAST(is_enable AS DOUBLE) * CAST(fns_cnt AS DOUBLE)"),
    Recipe(("refresh_num", "fns_cnt"), "refresh_fns_interaction",
           lambda: _c("refresh_num").cast("double") * _c("fns_cnt").cast("double"),
           lambda: "CAST(refresh_num AS DOUBLE) * CAST(fns_cnt AS DOUBLE)", "CAST(refresh_num AS DOUBLE) * CAST(fns_cnt AS DOUBLE)"),
    # Runs last so the ratios and interactions above use the raw count: >= 5 -> 4.
    Recipe(("fns_cnt",), "fns_cnt",
           lambda: F.when(_c("fns_cnt") >= 5, F.lit(4.0)).otherwise(_c("fns_cnt").cast("double")),
           lambda: "CASE WHEN fns_cnt >= 5 THEN CAST(4 AS DOUBLE) ELSE CAST(fns_cnt AS DOUBLE) END",
           "CASE WHEN fns_cnt >= 5 THEN 4D ELSE CAST(fns_cnt AS DOUBLE) END"),
]


def applicable_recipes(columns, recipes=None) -> list[Recipe]:
    """Recipes whose inputs exist, evaluated on the growing column set (B2)."""
    have = set(columns)
    out = []
    for r in RECIPES if recipes is None else recipes:
        if all(c in have for c in r.inputs):
            out.append(r)
            have.add(r.output)
    return out


def derive_features(df: DataFrame, recipes=None) -> DataFrame:
    """Add recipe outputs (raw IEEE values) in order.

    Recipes go into one projection per dependency layer: a recipe that reads
    (or overwrites) a column an earlier recipe of the layer writes starts a
    new layer, so in-order semantics hold with few plan nodes.
    """
    layer: dict = {}
    for r in applicable_recipes(df.columns, recipes):
        if any(c in layer for c in r.inputs) or r.output in layer:
            df, layer = df.withColumns(layer), {}
        layer[r.output] = r.build()
    return df.withColumns(layer) if layer else df


def numeric_columns(df: DataFrame, names=None) -> list[str]:
    names = names if names is not None else df.columns
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in names if isinstance(types.get(c), numeric)]


def floating_columns(df: DataFrame, names=None) -> list[str]:
    names = names if names is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in names if isinstance(types.get(c), (T.FloatType, T.DoubleType))]


def sanitize_numeric(df: DataFrame, columns=None) -> DataFrame:
    """Non-finite values of every floating column -> null (integers cannot hold them)."""
    cols = set(floating_columns(df, columns))
    return df.select(*[sanitize(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])

"""Term sort key (H9-H11) and term order (F2).

A term name such as ``2023年秋季第5期`` sorts by (year, season, period, text):
  * year   - the first ``20dd`` in the text, else 0;
  * season - with that first year removed, the first season character found in
             the order 寒 春 暑 秋 (list order, not text position), else 4;
  * period - after also removing every further ``20dd``, the first run of
             digits, else 0;
  * a missing term sorts as (0, 4, 0, "").
Digits are ASCII only ([0-9]); full-width digits are not treated as digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

YEAR_PATTERN = "20[0-9]{2}"
PERIOD_TYPE = "decimal(38,0)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def term_year(term) -> Column:
    t = _col(term).cast("string")
    return F.coalesce(F.regexp_extract(t, f"({YEAR_PATTERN})", 1).try_cast("int"), F.lit(0))


def _without_first_year(t: Column) -> Column:
    return F.regexp_replace(t, f"(?s)^(.*?){YEAR_PATTERN}", "$1")


def term_season(term) -> Column:
    rest = _without_first_year(_col(term).cast("string"))
    expr = None
    for idx, season in enumerate(config.SEASON_ORDER):
        cond = F.contains(rest, F.lit(season))
        expr = F.when(cond, F.lit(idx)) if expr is None else expr.when(cond, F.lit(idx))
    return F.coalesce(expr.otherwise(F.lit(len(config.SEASON_ORDER))), F.lit(len(config.SEASON_ORDER)))


def term_period(term) -> Column:
    rest = F.regexp_replace(_without_first_year(_col(term).cast("string")), YEAR_PATTERN, "")
    digits = F.regexp_extract(rest, "([0-9]+)", 1)
    return F.coalesce(digits.try_cast(PERIOD_TYPE), F.lit(0).cast(PERIOD_TYPE))


def term_sort_columns(term, prefix: str = "term") -> list[Column]:
    """[year, season, period, text] aliased ``{prefix}_year`` ... for ``orderBy``."""
    t = _col(term)
    return [
        term_year(t).alias(f"{prefix}_year"),
        term_season(t).alias(f"{prefix}_season"),
        term_period(t).alias(f"{prefix}_period"),
        F.coalesce(t.cast("string"), F.lit("")).alias(f"{prefix}_text"),
    ]


def with_term_sort_key(df, term_col: str, prefix: str = "term"):
    return df.select("*", *term_sort_columns(term_col, prefix))


def term_order_by(prefix: str = "term") -> list[str]:
    return [f"{prefix}_year", f"{prefix}_season", f"{prefix}_period", f"{prefix}_text"]


# ---------------------------------------------------------------------------
# SQL text (DuckDB dialect) of the same key
# ---------------------------------------------------------------------------

def term_year_sql(t: str) -> str:
    return f"COALESCE(TRY_CAST(NULLIF(regexp_extract({t}, '({YEAR_PATTERN})', 1), '') AS INTEGER), 0)"


def _without_first_year_sql(t: str) -> str:
    return f"regexp_replace({t}, '(?s)^(.*?){YEAR_PATTERN}', '\\1')"


def term_season_sql(t: str) -> str:
    rest = _without_first_year_sql(t)
    whens = " ".join(f"WHEN contains({rest}, '{s}') THEN {i}" for i, s in enumerate(config.SEASON_ORDER))
    return f"COALESCE(CASE {whens} ELSE {len(config.SEASON_ORDER)} END, {len(config.SEASON_ORDER)})"


def term_period_sql(t: str) -> str:
    rest = f"regexp_replace({_without_first_year_sql(t)}, '{YEAR_PATTERN}', '', 'g')"
    return (
        f"COALESCE(TRY_CAST(NULLIF(regexp_extract({rest}, '([0-9]+)', 1), '') AS DECIMAL(38,0)), "
        f"CAST(0 AS DECIMAL(38,0)))"
    )


def term_sort_sql(t: str, prefix: str = "term") -> str:
    return (
        f"{term_year_sql(t)} AS {prefix}_year, {term_season_sql(t)} AS {prefix}_season, "
        f"{term_period_sql(t)} AS {prefix}_period, COALESCE(CAST({t} AS VARCHAR), '') AS {prefix}_text"
    )

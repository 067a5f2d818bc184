"""Level tags: interval rules -> label (H12), and level display order.

A rule matches unless v < min, v = min with an open lower end, v > max, or
v = max with an open upper end. The first matching rule wins; when none
matches the default label is used. A missing value (null or NaN) compares
false everywhere in the original, so it matched the *first* rule: that is
the default of ``missing_label`` here (parity); pass the default label to
tag missing values as unknown instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from ..config import LevelRule

_UNSET = object()


def _rules(rule_configs) -> list[LevelRule]:
    rules = [LevelRule(**given) for given in (config.LEVEL_TAG_RULES if rule_configs is None else rule_configs)]
    if not rules:
        raise ValueError("level rules are empty: cannot tag")
    return rules


def _rule_condition(v: Column, rule: LevelRule) -> Column:
    cond = F.lit(True)
    if rule.min_prob is not None:
        lo = F.lit(float(rule.min_prob))
        cond = cond & ((v >= lo) if rule.min_inclusive else (v > lo))
    if rule.max_prob is not None:
        hi = F.lit(float(rule.max_prob))
        cond = cond & ((v <= hi) if rule.max_inclusive else (v < hi))
    return cond


def level_tag(prob: Column | str, rule_configs=None, default_label: str = config.DEFAULT_LEVEL_LABEL,
              missing_label=_UNSET) -> Column:
    """Folded ``when`` chain over the rules; stays inside whole-stage codegen."""
    rules = _rules(rule_configs)
    v = F.col(prob) if isinstance(prob, str) else prob
    v = v.cast("double")
    missing = rules[0].label if missing_label is _UNSET else missing_label
    expr = F.when(v.isNull() | F.isnan(v), F.lit(missing))
    for rule in rules:
        expr = expr.when(_rule_condition(v, rule), F.lit(rule.label))
    return expr.otherwise(F.lit(default_label))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def level_tag_sql(prob_sql: str, rule_configs=None, default_label: str = config.DEFAULT_LEVEL_LABEL,
                  missing_label=_UNSET) -> str:
    """Same chain as SQL text (works in Spark SQL and DuckDB)."""
    rules = _rules(rule_configs)
    v = f"CAST({prob_sql} AS DOUBLE)"
    missing = rules[0].label if missing_label is _UNSET else missing_label
    parts = [f"CASE WHEN {v} IS NULL OR isnan({v}) THEN {_sql_str(missing)}"]
    for rule in rules:
        conds = []
        if rule.min_prob is not None:
            op = ">=" if rule.min_inclusive else ">"
            conds.append(f"{v} {op} CAST({float(rule.min_prob)!r} AS DOUBLE)")
        if rule.max_prob is not None:
            op = "<=" if rule.max_inclusive else "<"
            conds.append(f"{v} {op} CAST({float(rule.max_prob)!r} AS DOUBLE)")
        parts.append(f"WHEN {' AND '.join(conds) or 'TRUE'} THEN {_sql_str(rule.label)}")
    parts.append(f"ELSE {_sql_str(default_label)} END")
    return " ".join(parts)


def level_rank(level: Column | str, preferred=None) -> Column:
    """Sort key of a level: preferred levels first in their order, then the
    rest by name (use with ``level`` itself as the second key)."""
    lv = F.col(level) if isinstance(level, str) else level
    pref = preferred or config.PREFERRED_LEVEL_ORDER
    pos = F.array_position(F.array(*[F.lit(p) for p in pref]), lv)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(pref)))


def level_rank_sql(level_sql: str, preferred=None) -> str:
    pref = preferred or config.PREFERRED_LEVEL_ORDER
    whens = " ".join(f"WHEN {level_sql} = {_sql_str(p)} THEN {i}" for i, p in enumerate(pref))
    return f"(CASE {whens} ELSE {len(pref)} END)"

"""Analyses of a scored table (D4-D10, D19 with E1-E4, C3, C4, H13, H16).

Every analysis is one grouped aggregate over the scored rows (partial
aggregation on the map side, so a hot term or level only costs its partial
rows), followed by work on the aggregated table, whose size is bounded by
terms x levels. Windows without a partition key (positions, term order) run
only on those bounded tables: the distinct levels (at most the rule count
plus unknown / foreign labels) or the distinct terms (calendar periods).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.levels import level_rank
from ..functions.terms import term_order_by, term_sort_columns
from .selection import drop_missing, require_columns


def round_half_even(c: Column, places: int = 4) -> Column:
    """Round like numpy (half to even on the binary value): rint(x * 10^k) / 10^k."""
    scale = float(10 ** places)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


# ---------------------------------------------------------------------------
# D4 calibration buckets
# ---------------------------------------------------------------------------

def bucket_index(prob: Column | str, buckets: int = config.BUCKET_COUNT) -> Column:
    """trunc(clip(p * 100, 0, 99)) as int: 0.29 -> 28, 1.2 -> 99, -0.01 -> 0."""
    p = F.col(prob) if isinstance(prob, str) else prob
    scaled = p.cast("double") * F.lit(float(buckets))
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(float(buckets - 1))).cast("int")


def bucket_summary(df: DataFrame, prob_col: str, label_col: str, buckets: int = config.BUCKET_COUNT) -> DataFrame:
    """Per 1 % bucket: size, mean label, mean probability, left edge, centre."""
    require_columns(df, [prob_col, label_col])
    b = F.col("bucket")
    return (
        df.select(bucket_index(prob_col, buckets).alias("bucket"),
                  F.col(prob_col).cast("double").alias("_p"),
                  F.col(label_col).cast("double").alias("_y"))
        .groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.avg("_y").alias("renewal_rate"),
            F.avg("_p").alias("avg_probability"),
        )
        .withColumn("bucket_left", b / F.lit(float(buckets)))
        .withColumn("bucket_center", F.col("bucket_left") + F.lit(0.5 / buckets))
    )


def null_guard_counts(df: DataFrame, prob_col: str, label_col: str) -> DataFrame:
    """Counts of missing probabilities / labels (the analysis refuses > 0)."""
    def missing(c):
        col = F.col(c)
        return col.isNull() | F.isnan(col.cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(missing(prob_col)).alias("n_missing_probability"),
        F.count_if(missing(label_col)).alias("n_missing_label"),
    )


def check_no_missing(df: DataFrame, prob_col: str, label_col: str) -> None:
    """Raise like the original when probabilities or labels have gaps (one job)."""
    row = null_guard_counts(df, prob_col, label_col).first()
    if row["n_missing_probability"]:
        raise ValueError("probabilities contain missing values")
    if row["n_missing_label"]:
        raise ValueError("labels contain missing values")


def check_calibration_buckets(buckets: DataFrame) -> None:
    """The calibration needs at least two non-empty buckets."""
    if buckets.limit(2).count() < 2:
        raise ValueError("fewer than two non-empty buckets: cannot fit calibration")


# ---------------------------------------------------------------------------
# D5 / D6 / D7 level performance by term
# ---------------------------------------------------------------------------

def level_positions(agg: DataFrame, level_col: str) -> DataFrame:
    """X position of each level present: preferred S..D first, rest by name."""
    lv = agg.select(level_col).distinct()
    w = Window.orderBy(level_rank(level_col), F.col(level_col))
    return lv.withColumn("_pos", F.row_number().over(w) - 1)


def with_level_position(agg: DataFrame, level_col: str, out_col: str = "_pos") -> DataFrame:
    """Level position computed on an aggregated (bounded) table in the same pass:
    dense rank of the levels present, in display order."""
    w = Window.orderBy(level_rank(level_col), F.col(level_col))
    return agg.withColumn(out_col, F.dense_rank().over(w) - 1)


def term_level_performance(df: DataFrame, term_col: str, level_col: str, label_col: str) -> DataFrame:
    """Per (term, level): mean label, count, binomial std error, x position,
    marker size clip(n, 20, 260)."""
    require_columns(df, [term_col, level_col, label_col])
    clean = drop_missing(df.select(term_col, level_col, label_col), [term_col, level_col, label_col])
    agg = clean.groupBy(term_col, level_col).agg(
        F.avg(F.col(label_col).cast("double")).alias("renewal_rate"),
        F.count(label_col).alias("sample_count"),
    )
    r, n = F.col("renewal_rate"), F.col("sample_count")
    agg = agg.withColumn(
        "std_err",
        F.sqrt(F.greatest(r * (F.lit(1.0) - r), F.lit(0.0)) / F.greatest(n, F.lit(1)).cast("double")),
    ).withColumn("marker_size", F.least(F.greatest(n, F.lit(config.MARKER_MIN)), F.lit(config.MARKER_MAX)))
    # bounded table (terms x levels): a global window is one small task
    return with_level_position(agg, level_col, "_pos").withColumn("x_base", F.col("_pos").cast("double")).drop("_pos")


def level_summary(perf: DataFrame, level_col: str) -> DataFrame:
    """Per level, rate weighted by max(n, 1), total count, share of all rows, x."""
    w = F.greatest(F.col("sample_count"), F.lit(1)).cast("double")
    by_level = perf.groupBy(level_col).agg(
        (F.sum(F.col("renewal_rate") * w) / F.sum(w)).alias("weighted_rate"),
        F.sum("sample_count").alias("total_samples"),
        F.first("x_base").cast("int").alias("x"),
    )
    # The level table is bounded (distinct levels): a global window is one small task.
    grand = F.sum("total_samples").over(Window.partitionBy(F.lit(0)))
    return by_level.withColumn(
        "sample_ratio", F.col("total_samples").cast("double") / F.greatest(grand, F.lit(1)).cast("double")
    )


def term_level_pivot(perf: DataFrame, term_col: str, level_col: str, levels=None) -> DataFrame:
    """One row per term; ``<level>_rate`` and ``<level>_share`` rounded to 4.

    Shares are over all levels of the term; only the listed levels get columns.
    """
    levels = list(levels or config.PREFERRED_LEVEL_ORDER)
    term_total = F.sum("sample_count").over(Window.partitionBy(term_col))
    shaped = perf.select(
        term_col,
        level_col,
        round_half_even(F.col("renewal_rate")).alias("rate"),
        round_half_even(F.col("sample_count").cast("double") / term_total.cast("double")).alias("share"),
    )
    return shaped.groupBy(term_col).pivot(level_col, levels).agg(
        F.first("rate").alias("rate"), F.first("share").alias("share")
    )


# ---------------------------------------------------------------------------
# D8 / D9 level mix by term
# ---------------------------------------------------------------------------

def level_mix(df: DataFrame, term_col: str, level_col: str) -> DataFrame:
    """D8 + E1: rows per (term, level), term total, share = n / max(total, 1)."""
    require_columns(df, [term_col, level_col])
    clean = drop_missing(df.select(term_col, level_col), [term_col, level_col])
    agg = clean.groupBy(term_col, level_col).agg(F.count(F.lit(1)).alias("sample_count"))
    total = F.sum("sample_count").over(Window.partitionBy(term_col))
    return agg.withColumn("term_total", total).withColumn(
        "sample_ratio", F.col("sample_count").cast("double") / F.greatest(F.col("term_total"), F.lit(1)).cast("double")
    )


def term_order_table(terms: DataFrame, term_col: str) -> DataFrame:
    """Distinct terms with their position in (year, season, period, text) order."""
    distinct = terms.select(F.col(term_col).cast("string").alias(term_col)).distinct()
    return with_term_order(distinct, term_col)


def with_term_order(table: DataFrame, term_col: str, out_col: str = "term_order") -> DataFrame:
    """Term position (dense rank in term order) added to a bounded table keyed by term."""
    keyed = table.select("*", *term_sort_columns(term_col, "_t"))
    w = Window.orderBy(*term_order_by("_t"))
    return keyed.withColumn(out_col, (F.dense_rank().over(w) - 1).cast("int")).drop(*term_order_by("_t"))


def level_mix_pivot(mix: DataFrame, term_col: str, level_col: str, levels=None) -> DataFrame:
    """D9 + C4: share by term and level, gaps 0, with the term's position.

    Without a list, every level present gets a column (the preferred ones first, then by
    name); preferred levels have one whether present or not. The levels are read from the
    aggregated mix: terms x levels rows, whatever the input.
    """
    if levels is None:
        present = {r[0] for r in mix.select(level_col).distinct().collect()}
        preferred = list(config.PREFERRED_LEVEL_ORDER)
        known = present.issubset(preferred)
        levels = preferred if known else [lv for lv in preferred if lv in present] + sorted(present - set(preferred))
    levels = list(levels)
    piv = mix.groupBy(term_col).pivot(level_col, levels).agg(F.first("sample_ratio"))
    piv = piv.select(term_col, *[F.coalesce(F.col(lv), F.lit(0.0)).alias(f"{lv}_ratio") for lv in levels])
    # one row per term: the term spine is the pivot itself (bounded: distinct terms)
    return with_term_order(piv, term_col).select(term_col, "term_order", *[f"{lv}_ratio" for lv in levels])


# ---------------------------------------------------------------------------
# D10 term trend
# ---------------------------------------------------------------------------

def term_trend(df: DataFrame, term_col: str, prob_col: str, label_col: str) -> DataFrame:
    """Per term mean probability, mean label, size, and term position."""
    require_columns(df, [term_col, prob_col, label_col])
    clean = drop_missing(df.select(term_col, prob_col, label_col), [term_col, prob_col, label_col])
    agg = clean.groupBy(F.col(term_col).cast("string").alias(term_col)).agg(
        F.avg(F.col(prob_col).cast("double")).alias("pred_renewal_rate"),
        F.avg(F.col(label_col).cast("double")).alias("actual_renewal_rate"),
        F.count(F.lit(1)).alias("sample_count"),
    )
    return with_term_order(agg, term_col)  # bounded: one row per term


# ---------------------------------------------------------------------------
# D19 chart bounds
# ---------------------------------------------------------------------------

def chart_bounds(scored: DataFrame, prob_col: str, label_col: str, term_col: str, level_col: str) -> DataFrame:
    """Axis limits the charts derive from the data: one (bound, value) row each.

    A single chain, one pass over the rows: an aggregate at the (bucket, term,
    level) grain (bounded: 100 x terms x levels rows) -> grouping sets for the
    bucket, (term, level) and term grains plus the total -> a window for the
    per-level weighted rate -> one conditional aggregate -> unpivot.
    """
    require_columns(scored, [prob_col, label_col, term_col, level_col])
    p, y = F.col(prob_col).cast("double"), F.col(label_col).cast("double")
    both = p.isNotNull() & ~F.isnan(p) & y.isNotNull() & ~F.isnan(y)
    fine = scored.groupBy(
        bucket_index(prob_col).alias("_b"), F.col(term_col).alias("_t"), F.col(level_col).alias("_l")
    ).agg(
        F.max(p).alias("_maxp"),
        F.sum(p).alias("_sp"), F.count(p).alias("_np"),
        F.sum(y).alias("_sy"), F.count(y).alias("_ny"),
        F.sum(F.when(both, p)).alias("_sp2"), F.sum(F.when(both, y)).alias("_sy2"), F.count_if(both).alias("_n2"),
    )
    grains = fine.groupingSets([["_b"], ["_t", "_l"], ["_t"], []], "_b", "_t", "_l").agg(
        F.grouping_id().alias("_g"),
        F.max("_maxp").alias("maxp"),
        (F.sum("_sp") / F.sum("_np")).alias("ap"),
        F.sum("_ny").alias("ny"),
        (F.sum("_sy") / F.sum("_ny")).alias("rr"),
        F.sum("_n2").alias("n2"),
        (F.sum("_sp2") / F.sum("_n2")).alias("pr"),
        (F.sum("_sy2") / F.sum("_n2")).alias("ar"),
    )
    # grouping ids over (_b, _t, _l): bucket = 0b011, (term, level) = 0b100, term = 0b101, total = 0b111
    g = F.col("_g")
    is_bucket, is_tl, is_term, is_total = g == 3, g == 4, g == 5, g == 7
    perf_row = is_tl & F.col("_t").isNotNull() & F.col("_l").isNotNull() & (F.col("ny") > 0)
    w = F.greatest(F.col("ny"), F.lit(1)).cast("double")
    per_level = Window.partitionBy(F.when(perf_row, F.col("_l")))  # bounded: the grouping-set rows
    weighted = F.when(perf_row, F.sum(F.when(perf_row, F.col("rr") * w)).over(per_level)
                      / F.sum(F.when(perf_row, w)).over(per_level))
    trend_row = is_term & F.col("_t").isNotNull() & (F.col("n2") > 0)
    bounds = grains.withColumn("wr", weighted).agg(
        F.least(F.lit(1.0), F.max(F.when(is_total, F.col("maxp"))) * F.lit(config.X_MAX_MARGIN)).alias("x_max"),
        F.greatest(F.lit(0.0), F.least(F.min(F.when(is_bucket, F.col("ap"))), F.min(F.when(is_bucket, F.col("rr"))))).alias("diag_min"),
        F.least(F.lit(1.0), F.greatest(F.max(F.when(is_bucket, F.col("ap"))), F.max(F.when(is_bucket, F.col("rr"))))).alias("diag_max"),
        F.least(F.lit(config.Y_UPPER_CAP),
                F.greatest(F.max(F.when(perf_row, F.col("rr"))), F.max("wr")) + F.lit(config.Y_UPPER_PAD)).alias("y_upper"),
        (F.greatest(F.max(F.when(trend_row, F.col("pr"))), F.max(F.when(trend_row, F.col("ar"))))
         * F.lit(config.TREND_Y_FACTOR)).alias("trend_y_max"),
    )
    names = ["x_max", "diag_min", "diag_max", "y_upper", "trend_y_max"]
    return bounds.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("bound"), F.col(n).cast("double").alias("value")) for n in names
    ])))

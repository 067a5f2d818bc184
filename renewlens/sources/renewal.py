"""The ``renewal`` table: one row per order, shaped like the training table.

The driver's tables hold no renewal data, so this view derives every column
of the training schema (city, device, activity counts, term, label ...) from
the TPC-H-like tables with deterministic expressions. It is built twice: as a
Spark plan (``renewal_df``) and as DuckDB SQL text (``RENEWAL_CTE_SQL``) that the
oracle queries start from. Both give the same rows.

Plan shape (Spark):
  * lineitem -> partial + final aggregate per order (map-side combine; one row per order)
  * orders -> per (customer, day) aggregate -> window ``lead`` per customer over
    that calendar-bounded table -> joined back to the orders on (customer,
    day). A customer with a third of all orders still puts at most one row per
    day into the window, and the join back is hash-partitioned on (customer,
    day), so its orders spread over many tasks.
  * customer: joined to the orders by key; nation/region are fixed-size (25 / 5
    rows) broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .tables import read_table

RENEWAL_WINDOW_DAYS = 90
TERM_YEAR_SHIFT = 20  # order years 1995-2001 become terms 2015-2021

RENEWAL_COLUMNS = [
    "user_id", "city", "district", "city_level", "city_score", "house_price", "grade",
    "refresh_num", "device", "is_enable", "fns_cnt", "b2c_term_name", "l1_term_name",
    "l1_term_renewal_end_date", "is_renewal",
]


def _season(month: Column) -> Column:
    return (
        F.when(month <= 2, F.lit("寒"))
        .when(month <= 5, F.lit("春"))
        .when(month <= 8, F.lit("暑"))
        .otherwise(F.lit("秋"))
    )


def customer_days(orders: DataFrame, key: str = "o_custkey", day: str = "o_day", order_id: str = "o_orderkey") -> DataFrame:
    """One row per (customer, day): the day's largest order id and the customer's
    next distinct day (``lead`` over a table with at most one row per day)."""
    return (
        orders.groupBy(key, day)
        .agg(F.max(order_id).alias("_day_max_id"))
        .withColumn("_next_day", F.lead(day).over(Window.partitionBy(key).orderBy(day)))
    )


def _next_order_day_col(day: str = "o_day", order_id: str = "o_orderkey") -> Column:
    # successor on the same day when a larger id exists that day, else the next day
    return F.when(F.col(order_id) < F.col("_day_max_id"), F.col(day)).otherwise(F.col("_next_day"))


def next_order_day(orders: DataFrame, key: str = "o_custkey", day: str = "o_day", order_id: str = "o_orderkey") -> DataFrame:
    """Per order, the day of the same customer's next order (by day, then id).

    Exact ``lead`` over (day, id) within a customer, computed skew-safely:
    the successor is on the same day when a larger id exists that day, else it
    is the customer's next distinct day (a window over one row per day).
    """
    joined = orders.join(customer_days(orders, key, day, order_id), [key, day], "left")
    return joined.withColumn("_next_order_day", _next_order_day_col(day, order_id)).drop("_day_max_id", "_next_day")


def renewal_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the renewal table from the driver tables at ``sf_dir``.

    One plan whatever the sizes: customer is joined to the orders by key (the
    planner or AQE broadcasts it when it is small, splits skewed keys when
    not), the per-(customer, day) table is left-joined.
    """
    orders = read_table(
        spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    ).withColumn("o_day", F.to_date("o_orderdate"))
    lines = (
        read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag"])
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("_n_lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("_n_returned"),
        )
    )
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    # nation (25 rows) and region (5 rows) are fixed-size by the schema.
    geo = bounded_broadcast(
        read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]).join(
            F.broadcast(read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])),
            F.col("n_regionkey") == F.col("r_regionkey"),
        )
    )

    o = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    # a left join on a unique key: Catalyst drops it when the label is unused,
    # and orders without a date stay
    o = o.join(customer_days(orders), ["o_custkey", "o_day"], "left")
    o = o.withColumn("_next_order_day", _next_order_day_col())
    o = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")

    month = F.month("o_day")
    term = F.concat(
        (F.year("o_day") + TERM_YEAR_SHIFT).cast("string"),
        F.lit("年"),
        _season(month),
        F.lit("季第"),
        month.cast("string"),
        F.lit("期"),
    )
    renewed = F.coalesce(
        (F.datediff(F.col("_next_order_day"), F.col("o_day")) <= RENEWAL_WINDOW_DAYS).cast("int"), F.lit(0)
    )
    return o.select(
        F.col("o_orderkey").alias("user_id"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("district"),
        F.col("c_mktsegment").alias("city_level"),
        (F.col("n_nationkey") * 10).cast("double").alias("city_score"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("house_price"),
        (F.col("o_orderkey") % 9).cast("int").alias("grade"),
        F.coalesce(F.col("_n_returned"), F.lit(0)).cast("int").alias("refresh_num"),
        F.col("o_orderpriority").alias("device"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).cast("int").alias("is_enable"),
        F.col("_n_lines").cast("int").alias("fns_cnt"),
        F.col("o_orderstatus").alias("b2c_term_name"),
        term.alias("l1_term_name"),
        F.date_format(F.date_add("o_day", RENEWAL_WINDOW_DAYS), "yyyy-MM-dd").alias("l1_term_renewal_end_date"),
        renewed.alias("is_renewal"),
    )


def pseudo_score(user_id: Column | None = None) -> Column:
    """Model-free score in [0, 0.25) for analysis checks: (id * 7919 mod 10007) / 10007 / 4."""
    uid = F.col("user_id") if user_id is None else user_id
    return (uid * 7919 % 10007).cast("double") / F.lit(10007.0) / F.lit(4.0)


# ---------------------------------------------------------------------------
# DuckDB text of the same view (oracle side)
# ---------------------------------------------------------------------------

RENEWAL_CTE_SQL = f"""
renewal AS (
  SELECT
    o.o_orderkey AS user_id,
    n.n_name AS city,
    r.r_name AS district,
    c.c_mktsegment AS city_level,
    CAST(n.n_nationkey * 10 AS DOUBLE) AS city_score,
    CASE WHEN o.o_orderkey % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE c.c_acctbal END AS house_price,
    CAST(o.o_orderkey % 9 AS INTEGER) AS grade,
    CAST(COALESCE(l.n_returned, 0) AS INTEGER) AS refresh_num,
    o.o_orderpriority AS device,
    CAST(CASE WHEN o.o_orderstatus = 'O' THEN 0 ELSE 1 END AS INTEGER) AS is_enable,
    CAST(l.n_lines AS INTEGER) AS fns_cnt,
    o.o_orderstatus AS b2c_term_name,
    CAST(year(o.o_orderdate) + {TERM_YEAR_SHIFT} AS VARCHAR) || '年'
      || CASE WHEN month(o.o_orderdate) <= 2 THEN '寒' WHEN month(o.o_orderdate) <= 5 THEN '春'
              WHEN month(o.o_orderdate) <= 8 THEN '暑' ELSE '秋' END
      || '季第' || CAST(month(o.o_orderdate) AS VARCHAR) || '期' AS l1_term_name,
    strftime(CAST(o.o_orderdate AS DATE) + INTERVAL {RENEWAL_WINDOW_DAYS} DAY, '%Y-%m-%d') AS l1_term_renewal_end_date,
    CAST(CASE WHEN date_diff('day', CAST(o.o_orderdate AS DATE),
                   CAST(LEAD(o.o_orderdate) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS DATE))
                   <= {RENEWAL_WINDOW_DAYS} THEN 1 ELSE 0 END AS INTEGER) AS is_renewal
  FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned
    FROM lineitem GROUP BY l_orderkey
  ) l ON l.l_orderkey = o.o_orderkey
)"""

PSEUDO_SCORE_SQL = "CAST(user_id * 7919 % 10007 AS DOUBLE) / CAST(10007.0 AS DOUBLE) / CAST(4.0 AS DOUBLE)"

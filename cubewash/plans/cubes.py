"""Cubes built from the driver's TPC-H-like tables (P-05 long -> wide).

Four shapes:

* ``nation_brand_cube``: ``n_name x p_brand`` rows, one ``YYYYQn`` column per
  ship quarter, value = sum of ``l_extendedprice`` with returned lines
  (``l_returnflag = 'R'``) negated, zero-filled. Every detector fires on it.
* ``nation_brand_month_cube``: the same by ship month, ``YYYY_M``; a wide cube.
* ``segment_month_cube``: ``n_name x c_mktsegment x o_orderpriority`` rows, one
  ``YYYY_M`` column per order month, value = sum of ``o_totalprice``, *not*
  zero-filled (gaps are NULL cells).
* ``customer_brand_cube``: ``c_name x p_brand`` rows (the reference's own
  customer x product-line grain); its row count grows with the data.

Money is summed as ``decimal(18,2)`` (order-free, exact) and cast to double at
the end, so results do not depend on partitioning.

Periods come from the data: a cube has the default labels, widened to the first
and last date, so no fact falls outside. Join plan (sizes at 100 TB in mind):
column pruning and the null filter reach the lineitem scan. Lines get their brand from ``part`` and their nation
from ``orders x customer`` (built on the orders side, which is 4x smaller than
lineitem), so lineitem-sized data crosses at most two shuffles (by part key,
then by order key) and none when a dimension fits the broadcast threshold.
Broadcasts are never forced: Spark broadcasts a side only when its size
estimate is under ``spark.sql.autoBroadcastJoinThreshold``, and AQE re-plans
from measured shuffle sizes. The aggregation to the cube grain runs with
map-side partial sums, so the last shuffle carries at most one row per
(group, map task); in the customer cube, where hardly any lines share a group,
lines are dealt out by group in parts of bounded size instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import YYYY_M, YYYYQN, date_period_index_col, format_period, parse_period, \
    period_label_col, period_labels
from ..sources.cube import long_to_wide

MONEY = "decimal(18,2)"
#: Lines that a task sums to rows of the customer x brand cube.
LINES_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter_labels(start: str = "1995Q1", end: str = "2001Q4") -> list[str]:
    return period_labels(start, end, YYYYQN)


def month_labels(start: str = "1995_1", end: str = "2001_8") -> list[str]:
    return period_labels(start, end, YYYY_M)


def covering(default: list[str], dates: DataFrame, fmt: str) -> list[str]:
    """The default labels, widened to all periods that the dates (one column) fall into."""
    index = date_period_index_col(F.col(dates.columns[0]), fmt)
    span = dates.agg(F.min(index).alias("lo"), F.max(index).alias("hi")).first()
    if span["lo"] is None:
        return default
    lo, hi = parse_period(default[0], fmt), parse_period(default[-1], fmt)
    return [format_period(i, fmt) for i in range(min(lo, span["lo"]), max(hi, span["hi"]) + 1)]


def ship_quarters(spark: SparkSession, sf_dir: str) -> list[str]:
    return covering(quarter_labels(), table(spark, sf_dir, "lineitem").select("l_shipdate"), YYYYQN)


def order_months(spark: SparkSession, sf_dir: str) -> list[str]:
    return covering(month_labels(), table(spark, sf_dir, "orders").select("o_orderdate"), YYYY_M)


def ship_months(spark: SparkSession, sf_dir: str) -> list[str]:
    return covering(month_labels(end="2001_12"), table(spark, sf_dir, "lineitem").select("l_shipdate"), YYYY_M)


def nation_brand_facts(spark: SparkSession, sf_dir: str, fmt: str = YYYYQN) -> DataFrame:
    """Long form (n_name, p_brand, period, value decimal) of the main cube, of all lines."""
    li = (table(spark, sf_dir, "lineitem")
          .where(F.col("l_shipdate").isNotNull())
          .select(
              "l_orderkey", "l_partkey",
              date_period_index_col(F.col("l_shipdate"), fmt).alias("index"),
              F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice").cast(MONEY))
              .otherwise(F.col("l_extendedprice").cast(MONEY)).alias("v")))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # brand of every line; order -> nation from the (smaller) orders side
    lines = li.join(part, li.l_partkey == part.p_partkey)
    order_nation = orders.join(customer, orders.o_custkey == customer.c_custkey)
    facts = (lines.join(order_nation, lines.l_orderkey == order_nation.o_orderkey)
             # map-side partial sums make the final shuffle tiny (nations x brands x periods)
             .groupBy("c_nationkey", "p_brand", "index").agg(F.sum("v").alias("v")))
    return (facts.join(nation, facts.c_nationkey == nation.n_nationkey)
            .select("n_name", "p_brand", period_label_col(F.col("index"), fmt).alias("period"), "v"))


def nation_brand_cube(spark: SparkSession, sf_dir: str,
                      labels: list[str] | None = None) -> DataFrame:
    labels = labels or ship_quarters(spark, sf_dir)
    facts = nation_brand_facts(spark, sf_dir)
    return long_to_wide(facts, ["n_name", "p_brand"], "period", "v", labels, fill=0.0)


def nation_brand_month_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = nation_brand_facts(spark, sf_dir, YYYY_M)
    return long_to_wide(facts, ["n_name", "p_brand"], "period", "v", ship_months(spark, sf_dir), fill=0.0)


def customer_brand_cube(spark: SparkSession, sf_dir: str,
                        labels: list[str] | None = None, returns_only: bool = False) -> DataFrame:
    """``c_name x p_brand`` by ship quarter, zero-filled; rows grow with the data.

    ``returns_only`` counts returned lines alone (others are 0), so many rows are all zero."""
    labels = labels or ship_quarters(spark, sf_dir)
    price = F.col("l_extendedprice").cast(MONEY)
    other = F.lit(0).cast(MONEY) if returns_only else price
    li = (table(spark, sf_dir, "lineitem").where(F.col("l_shipdate").isNotNull())
          .select("l_orderkey", "l_partkey",
                  date_period_index_col(F.col("l_shipdate"), YYYYQN).alias("index"),
                  F.when(F.col("l_returnflag") == "R", -price).otherwise(other).alias("v")))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    tasks = line_tasks(spark, sf_dir)
    order_names = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "c_name")
    lines = li.join(part, li.l_partkey == part.p_partkey).repartition(tasks, "l_orderkey")
    # hardly two lines share a cube cell, so they are dealt out by row of the cube and summed there
    facts = (lines.join(order_names, lines.l_orderkey == order_names.o_orderkey)
             .select("c_name", "p_brand", period_label_col(F.col("index"), YYYYQN).alias("period"), "v")
             .repartition(tasks, "c_name", "p_brand"))
    return long_to_wide(facts, ["c_name", "p_brand"], "period", "v", labels, fill=0.0)


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Parts that lineitem-sized data is dealt into, of some LINES_A_TASK lines each.

    Left to themselves, parts of few compressed bytes are merged until a task holds
    millions of lines, whose hash tables and sorts then spill."""
    lines = table(spark, sf_dir, "lineitem").count()  # from the files' footers
    return max(spark.sparkContext.defaultParallelism, -(-lines // LINES_A_TASK))


def segment_month_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = (table(spark, sf_dir, "orders").where(F.col("o_orderdate").isNotNull())
              .select("o_custkey", "o_orderpriority",
                      period_label_col(date_period_index_col(F.col("o_orderdate"), YYYY_M),
                                       YYYY_M).alias("period"),
                      F.col("o_totalprice").cast(MONEY).alias("v")))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    by_seg = (orders.join(customer, orders.o_custkey == customer.c_custkey)
              .groupBy("c_nationkey", "c_mktsegment", "o_orderpriority", "period")
              .agg(F.sum("v").alias("v")))
    return (by_seg.join(nation, by_seg.c_nationkey == nation.n_nationkey)
            .select("n_name", "c_mktsegment", "o_orderpriority", "period", "v"))


def segment_month_cube(spark: SparkSession, sf_dir: str,
                       labels: list[str] | None = None) -> DataFrame:
    labels = labels or order_months(spark, sf_dir)
    facts = segment_month_facts(spark, sf_dir)
    return long_to_wide(facts, ["n_name", "c_mktsegment", "o_orderpriority"], "period", "v",
                        labels, fill=None)

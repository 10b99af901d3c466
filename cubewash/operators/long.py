"""D-01..D-05 on long tables: one row per cell, never pivoted.

For cubes whose periods are too many for a row. A cube row is a window partition: running
sums, neighbours and ranks replace the matrix rules of :mod:`cubewash.functions.blocks`
and give the same flags to the last bit (sums run in period order, percentiles are
interpolated between ranked values from the nearer one). Windows spill, so a row's periods
need not fit into memory; two orderings of the partition (by period, by value) share one
shuffle on the id tuple.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import free_name, q
from ..model import ROW_ID
from ..sources.cube import row_id, row_key
from .detect import DEFAULT_DETECTORS, ROW_KEY, detection_id, merged_fields


def fill_periods(facts: DataFrame, ids: list[str], period: str, value: str, labels: list[str],
                 fill: float | None = 0.0) -> DataFrame:
    """(ids, pos, period, value): a row for every id tuple and label; cells without a fact get ``fill``."""
    places = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias(period)) for i, c in enumerate(labels)])
    spine = facts.select(*[q(c) for c in ids]).distinct().select(*[q(c) for c in ids], F.explode(places).alias("p"))
    spine = spine.select(*[q(c) for c in ids], "p.*")
    given = facts.select(*[q(c) for c in ids], period, F.col(value).cast("double").alias("__v"))
    on = [spine[c].eqNullSafe(given[c]) for c in [*ids, period]]
    cell = F.col("__v") if fill is None else F.coalesce("__v", F.lit(fill))
    return spine.join(given, on, "left").select(*[spine[c] for c in ids], "pos", spine[period],
                                                cell.alias(value))


def _percentile(ordered_value: Column, rank: Column, count: Column, p: float, row) -> Column:
    """Linear-interpolated percentile of a row's values from their ranks (from 1)."""
    h = (count - 1).cast("double") * F.lit(p)
    low = F.floor(h)
    t = h - low
    at = lambda place: F.max(F.when(rank == place + 1, ordered_value)).over(row)
    a, b = at(low), at(F.least(low + 1, count - 1))
    return F.when(count > 0, F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t))


def flag_long(cells: DataFrame, ids: list[str], pos: str, value: str) -> DataFrame:
    """``cells`` with a column ``bits``: the set of default detectors that flag the cell."""
    keys = [q(c) for c in ids]
    row = Window.partitionBy(*keys)
    by_pos, by_value = row.orderBy(pos), row.orderBy(F.col("__x").asc_nulls_last())
    whole = by_pos.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.col("__x")
    positive = F.when(x > 0, x).otherwise(F.lit(0.0))
    first = cells.withColumn("__x", F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))).withColumns({
        "__before": F.coalesce(F.sum(positive).over(by_pos.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "__total": F.sum(positive).over(whole), "__n": F.count(F.lit(1)).over(whole),
        "__positive": F.count(F.when(x > 0, 1)).over(whole), "__there": F.count(x).over(whole),
        "__beside": F.coalesce(F.lag(x).over(by_pos) == 0, F.lit(False))
        | F.coalesce(F.lead(x).over(by_pos) == 0, F.lit(False))})
    ranked = first.withColumn("__rank", F.row_number().over(by_value))
    bounded = ranked.withColumns({f"__q{k}": _percentile(x, F.col("__rank"), F.col("__there"), p, row)
                                  for k, p in ((1, 0.25), (3, 0.75))})
    reach = 1.5 * (F.col("__q3") - F.col("__q1"))
    number = lambda c: F.nanvl(c, F.lit(None).cast("double"))  # noqa: E731  a bound that is no number flags nothing
    mean = F.when(F.col("__positive") > 0, F.col("__total") / F.col("__positive")).otherwise(F.lit(0.0))
    rules = [x < 0, (x < 0) & (F.col("__before") >= F.abs(x)),
             (F.col("__n") >= 2) & (x > 0) & (x > 2.0 * mean) & F.col("__beside"),
             (F.col("__n") >= 2) & ((x < number(F.col("__q1") - reach)) | (x > number(F.col("__q3") + reach)))]
    bits = sum((F.when(rule, F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(rules)), F.lit(0))
    return bounded.select(*[q(c) for c in cells.columns], bits.alias("bits"))


def detect_long(cells: DataFrame, ids: list[str], pos: str = "pos", column: str = "period",
                value: str = "value") -> DataFrame:
    """Merged detections of a long table (ids, position, column, value), as of its pivoted cube.

    Every cell of a row is a row here; a NULL or NaN value is a missing cell. Same columns
    and ids as :func:`cubewash.operators.detect.detect` without the place in a file."""
    if free_name(cells, "bits") != "bits":
        raise ValueError("a long table must not have a column 'bits'")
    flagged = flag_long(cells, ids, pos, value).where("bits <> 0").withColumns(
        {ROW_ID: row_id(ids), ROW_KEY: row_key(ids)})
    return flagged.select(
        detection_id(F.col(ROW_ID), q(column)).alias("detection_id"), ROW_ID, ROW_KEY,
        q(pos).alias("pos"), q(column).alias("column"), q(value).alias("value"),
        *map(F.expr, merged_fields("bits", DEFAULT_DETECTORS)))

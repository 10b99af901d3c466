"""Selection policies (G-01..G-04): detections -> selections tables.

The reference builds selections one click at a time in the browser. Here the
same rules are bulk DataFrame operations:

* :func:`stage_all` - "stage all visible" in a detector's view or in the view
  of all anomalies (default fix in context G-01, attribution G-02, G-03).
* :func:`latest_selections` - a log of staging events reduced to the last
  write per detection (G-04 upsert), with unstage and clear events removing it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DETECTOR_ACTION, DETECTORS
from .apply import Policy, attribution_expr


def default_fix(context: str | None) -> F.Column:
    """G-01: the context detector's first action if it flagged the cell, else the
    merged default fix."""
    if context is None:
        return F.col("suggested_fix")
    return F.when(F.array_contains("flagged_by", context), F.lit(DETECTOR_ACTION[context])) \
        .otherwise(F.col("suggested_fix"))


def stage_all(detections: DataFrame, measures: list[str], policy: Policy = Policy()) -> DataFrame:
    """G-03: selections for every detection visible under ``policy``.

    ``sel_ord`` is the position of the column name in text order, which is the
    order the reference stages a row's cells in (detections sorted by row, then
    column text)."""
    visible = (policy.context,) if policy.context else (policy.detectors or DETECTORS)
    vis = detections.where(F.arrays_overlap("flagged_by", F.array(*[F.lit(t) for t in visible])))
    fix = default_fix(policy.context)
    explicit = F.lit(policy.context) if policy.context else None
    rank = {m: i for i, m in enumerate(sorted(measures))}
    ord_map = F.create_map(*[x for m, i in rank.items() for x in (F.lit(m), F.lit(i))]) \
        if measures else None
    return vis.select(
        "detection_id",
        fix.alias("fix"),
        attribution_expr(F.col("flagged_by"), fix, explicit).alias("attribution"),
        (ord_map[F.col("column")] if ord_map is not None else F.lit(0)).cast("bigint")
        .alias("sel_ord"),
        "flagged_by",
    )


def latest_selections(events: DataFrame) -> DataFrame:
    """G-04: ``events(detection_id, fix, attribution, sel_ord, op)`` -> current selections.

    ``op`` is 'stage' (the last one of a detection gives fix and attribution), 'unstage' or
    'clear' (of all detections; its detection_id says nothing). A detection keeps the place
    it was first staged at since it was last unstaged or cleared: staging it again changes
    the fix, not the order in which it is applied.

    Aggregates with map-side partial results, so a detection that is toggled very often
    does not pile up in one task."""
    cleared = events.agg(F.max(F.when(F.col("op") == "clear", F.col("sel_ord")))).first()[0]
    since = events.where("op <> 'clear'")
    if cleared is not None:
        since = since.where(F.col("sel_ord") > cleared)
    gone = since.where("op = 'unstage'").groupBy("detection_id").agg(F.max("sel_ord").alias("gone"))
    staged = since.where("op = 'stage'").join(gone, "detection_id", "left").where("gone IS NULL OR sel_ord > gone")
    return staged.groupBy("detection_id").agg(
        F.max_by(F.struct("fix", "attribution"), "sel_ord").alias("e"), F.min("sel_ord").alias("sel_ord")).select(
        "detection_id", "e.fix", "e.attribution", "sel_ord")


def unstage(selections: DataFrame, detection_ids: DataFrame) -> DataFrame:
    """G-04 bulk unstage: drop the listed detections (anti join)."""
    return selections.join(detection_ids.select("detection_id"), "detection_id", "left_anti")

"""Apply fixes to a cube and produce the audit log (X-01..X-15).

The reference mutates a copy of the frame in five passes: validate, bulk
set-to-zero, refund cascades, splits, keeps. All of these only touch cells of
the row that holds the selected detection, so the Spark plan is:

* **policy path** (:func:`apply_policy`): the fixes follow from the detector
  flags of the row itself (a staging policy, G-01..G-03). Detection, choice of
  fix and the passes run in one narrow stage: no shuffle at all.
* **selection path** (:func:`apply_selections`): an explicit selections table
  (detection_id, fix, attribution, sel_ord) is validated against the
  detections, grouped per row (at most one action per measure cell, so groups
  are bounded by the number of periods) and joined to the cube on the row id:
  one shuffle, or a broadcast when AQE measures the action side as small.

The passes run over blocks of rows (:func:`cubewash.functions.blocks.apply_passes`) and
leave, beside the new measures, a log of small numbers (pass, order, step, position,
credited detector, values). Names, row keys and ids are looked up when the log is
exploded; ``cleaned_cube`` and ``changes`` are two projections of one frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.cells import cells_array, q, sql_name
from ..model import (
    ACTIONS,
    APPLIED,
    CELLS,
    DETECTOR_ACTION,
    DETECTORS,
    FIX_ATTRIBUTION,
    KEEP_AS_IS,
    KEY,
    PRIMARY,
    REFUND,
    REFUND_CASCADE,
    ROW_ID,
    SET_TO_ZERO,
    SPLIT_EVENLY,
    ColumnRoles,
    InvalidSelectionError,
)
from ..sources.cube import prepare, row_key, user_columns
from .detect import DEFAULT_DETECTORS, ROW_KEY, Detector, combos, detection_id, lookup, masks

#: The pass that treats a fix; a cell set to zero and credited to the refund detector is a refund.
PASS_OF_FIX = {SET_TO_ZERO: blocks.ZERO, SPLIT_EVENLY: blocks.SPLIT, KEEP_AS_IS: blocks.KEEP}
FIX_OF_PASS = {blocks.ZERO: SET_TO_ZERO, blocks.REFUND: SET_TO_ZERO, blocks.SPLIT: SPLIT_EVENLY,
               blocks.KEEP: KEEP_AS_IS}
ACTION_T = "array<struct<ord:bigint,pos:int,kind:int,detector:int>>"


def attribution_expr(flagged_by: Column, fix: Column, explicit: Column | None = None) -> Column:
    """X-03: the explicit detector if it flagged the cell, else the first detector
    of the fix's priority list that did, else the first detector that flagged it."""
    out = F.element_at(flagged_by, 1)
    for f in reversed(list(FIX_ATTRIBUTION)):
        chain = F.lit(None).cast("string")
        for d in reversed(FIX_ATTRIBUTION[f]):
            chain = F.when(F.array_contains(flagged_by, d), F.lit(d)).otherwise(chain)
        out = F.when(fix == f, F.coalesce(chain, F.element_at(flagged_by, 1))).otherwise(out)
    if explicit is not None:
        out = F.when(explicit.isNotNull() & F.array_contains(flagged_by, explicit),
                     explicit).otherwise(out)
    return out


def attribute(flagged_by: list[str], fix: str | None, explicit: str | None = None) -> str | None:
    """X-03 for one known set of flags, as a search through a ranked list."""
    ranked = [explicit, *FIX_ATTRIBUTION.get(fix, ()), *flagged_by]
    return next(filter(set(flagged_by).__contains__, ranked), None)


def pass_of(fix: str | None, detector: str | None) -> int:
    """The pass that treats a fix; 0 if there is nothing to do."""
    return blocks.REFUND if fix == SET_TO_ZERO and detector == REFUND else PASS_OF_FIX.get(fix, 0)


# --- policies (G-01..G-03) -----------------------------------------------------

@dataclass(frozen=True)
class Policy:
    """Which flagged cells to stage and with which fix.

    ``context`` mirrors staging from a detector's view: only cells that detector
    flagged, with that detector's first action and credited to it. ``None`` is
    the "all anomalies" view: every flagged cell with its merged default fix.
    ``detectors`` narrows the "all" view to cells flagged by one of them (A-07)."""

    context: str | None = None
    detectors: tuple[str, ...] | None = None


def _choices(policy: Policy, detectors: tuple[Detector, ...]) -> tuple[list[int], list[int]]:
    """(pass, place of the credited detector) for every set of flagging detectors; pass 0: not staged."""
    names = [d.name for d in detectors]
    visible = set(policy.detectors or names)
    kinds, credited = [], []
    for combo in combos(detectors):
        if policy.context is not None:
            staged, fix, who = policy.context in combo["flagged_by"], DETECTOR_ACTION[policy.context], policy.context
        else:
            staged = bool(visible & set(combo["flagged_by"]))
            fix = combo["suggested_fix"]
            who = attribute(combo["flagged_by"], fix)
        kinds.append(pass_of(fix, who) if staged else 0)
        credited.append(names.index(who) if staged else 0)
    return kinds, credited


def _stage_order(measures: list[str]) -> list[int]:
    """Place of each position when the cells of a row are staged by column text."""
    place = [0] * len(measures)
    for rank, i in enumerate(sorted(range(len(measures)), key=lambda i: measures[i])):
        place[i] = rank
    return place


def _untouched() -> Column:
    return F.struct(F.col(CELLS).alias("cells"), F.array().cast(blocks.LOG_T).alias("log"))


def apply_policy(df: DataFrame, roles: ColumnRoles, policy: Policy = Policy(),
                 detectors: tuple[Detector, ...] = DEFAULT_DETECTORS) -> DataFrame:
    """Detect and apply in one narrow pass. Returns the cube columns plus
    ``__row_id``, ``__row_key`` and ``__applied`` (struct of new cells and log)."""
    measures = roles.measure_columns
    cube = prepare(df, roles.id_columns, measures)
    kinds, credited = _choices(policy, detectors)
    applied = blocks.policy_column(F.col(CELLS), measures, masks(detectors), kinds, credited,
                                   _stage_order(measures)) if measures else _untouched()
    return cube.select(*[q(c) for c in user_columns(df)], ROW_ID, row_key(roles.id_columns).alias(KEY),
                       applied.alias(APPLIED))


# --- explicit selections (X-01, X-02, X-09, D5) ------------------------------

def validate_selections(detections: DataFrame, selections: DataFrame) -> DataFrame:
    """Check and resolve a selections table; raise on the first problem.

    ``selections``: detection_id, fix, optional attribution, optional sel_ord (without
    it, selections of a row apply in column order).
    Returns (detection_id, __row_id, pos, fix, attribution, ord) with one row per
    detection. One job computes all three checks (unknown id, fix not allowed,
    conflicting duplicates) and returns at most one offending row."""
    cols = set(selections.columns)
    sel = selections.select(
        "detection_id", "fix",
        (F.col("attribution") if "attribution" in cols else F.lit(None).cast("string"))
        .alias("attribution"),
        (F.col("sel_ord") if "sel_ord" in cols else F.lit(0)).cast("bigint").alias("ord"))
    # D5: selections of one fix collapse to the first; different fixes are a conflict,
    # a missing fix (a value of its own here) included.
    dedup = sel.groupBy("detection_id", "fix").agg(
        F.min("ord").alias("ord"), F.min_by("attribution", "ord").alias("attribution"))
    per_det = dedup.groupBy("detection_id").agg(
        F.count("*").alias("n_choices"),
        F.min_by(F.struct("fix", "attribution", "ord"), "ord").alias("c"))
    det = detections.select("detection_id", ROW_ID, "pos", "flagged_by", "suggested_fix",
                            "alternative_fixes")
    joined = per_det.join(det, "detection_id", "left")
    problem = (F.when(F.col(ROW_ID).isNull(),
                      F.concat(F.lit("Unknown detection_id: "), F.col("detection_id")))
               .when(F.col("n_choices") > 1,
                     F.concat(F.lit("Conflicting selections for detection "),
                              F.col("detection_id")))
               .when(~F.coalesce(F.array_contains(F.array_append(
                   F.col("alternative_fixes"), F.col("suggested_fix")), F.col("c.fix")), F.lit(False)),
                     F.concat(F.lit("Fix '"), F.coalesce(F.col("c.fix"), F.lit("NULL")),
                              F.lit("' not allowed for detection "), F.col("detection_id"),
                              F.lit(" (allowed: "),
                              F.array_join(F.array_sort(F.array_append(
                                  F.col("alternative_fixes"), F.col("suggested_fix"))), ", "),
                              F.lit(")"))))
    checked = joined.select("*", problem.alias("__problem"))
    bad = checked.where(F.col("__problem").isNotNull()).select("__problem").limit(1).collect()
    if bad:
        raise InvalidSelectionError(bad[0][0])
    return checked.select(
        "detection_id", ROW_ID, "pos", F.col("c.fix").alias("fix"),
        attribution_expr(F.col("flagged_by"), F.col("c.fix"), F.col("c.attribution"))
        .alias("attribution"),
        F.col("c.ord").alias("ord"))


def apply_selections(df: DataFrame, roles: ColumnRoles, detections: DataFrame,
                     selections: DataFrame) -> DataFrame:
    """X-01..X-14 for an explicit selections table. Same output as :func:`apply_policy`."""
    measures = roles.measure_columns
    resolved = validate_selections(detections, selections)
    refund = (F.col("fix") == SET_TO_ZERO) & (F.col("attribution") == REFUND)
    kind = F.when(refund, blocks.REFUND)
    for fix, pass_no in PASS_OF_FIX.items():
        kind = kind.when(F.col("fix") == fix, pass_no)
    who = F.array_position(F.array(*map(F.lit, DETECTORS)), F.col("attribution")) - 1
    per_row = resolved.groupBy(ROW_ID).agg(F.collect_list(F.struct(
        F.col("ord"), F.col("pos"), kind.alias("kind"), who.cast("int").alias("detector")))
        .cast(ACTION_T).alias(ACTIONS))
    user_cols = user_columns(df)
    cube = prepare(df, roles.id_columns, measures).select(
        *[q(c) for c in user_cols], ROW_ID, row_key(roles.id_columns).alias(KEY), CELLS)
    joined = cube.join(per_row, ROW_ID, "left")
    applied = blocks.actions_column(F.col(CELLS), F.coalesce(ACTIONS, F.array().cast(ACTION_T)), measures) \
        if measures else _untouched()
    return joined.select(*[q(c) for c in user_cols], ROW_ID, KEY, applied.alias(APPLIED))


# --- outputs (X-11..X-14) ---------------------------------------------------

def cleaned_cube(applied: DataFrame, roles: ColumnRoles) -> DataFrame:
    """X-14: the cube with fixed measures (double), same column order as the input."""
    pos = {m: i for i, m in enumerate(roles.measure_columns)}
    return applied.selectExpr(*[f"get({APPLIED}.cells, {pos[c]}) AS {sql_name(c)}" if c in pos else sql_name(c)
                                for c in user_columns(applied)])


def changes(applied: DataFrame, roles: ColumnRoles, run_id: str = "run",
            detectors: tuple[Detector, ...] = DEFAULT_DETECTORS) -> DataFrame:
    """X-11: one row per change entry.

    change_id is deterministic (hash of run id, detection id, pass and step), so a
    recomputed partition yields the same ids; the parent of a cascade entry is the refund's
    primary entry. The detection of an entry is that of the cell the action was chosen for:
    the entry's own cell, but the refund's cell for its cascade, and the spike's for a split."""
    def name(at: str) -> str:
        return lookup(at, roles.measure_columns, "string") if roles.measure_columns else "CAST(NULL AS STRING)"

    fixes = lookup("pass", [FIX_OF_PASS.get(k) for k in range(max(FIX_OF_PASS) + 1)], "string")
    log = F.col("__log")
    # Positions are exploded, not the entries: the generator then consumes a plain array, and
    # nested-field pruning has nothing to push into the function that makes the log.
    at = F.when(F.size(log) > 0, F.sequence(F.lit(0), F.size(log) - 1)).otherwise(F.array().cast("array<int>"))
    entries = (applied.select(ROW_ID, F.col(KEY).alias(ROW_KEY), F.col(f"{APPLIED}.log").alias("__log"))
               .select(ROW_ID, ROW_KEY, "__log", F.explode(at).alias("__k"))
               .select(ROW_ID, ROW_KEY, F.get(log, F.col("__k")).alias("__e"))
               .select(ROW_ID, ROW_KEY, "__e.*"))
    cascade = f"(pass = {blocks.REFUND} AND step > 0)"
    named = entries.selectExpr(
        ROW_ID, ROW_KEY, "pass", "ord", "step", "pos", "value_before", "value_after",
        f"{lookup('detector', [d.name for d in detectors], 'string')} AS anomaly_type",
        f"CASE WHEN {cascade} THEN '{REFUND_CASCADE}' ELSE '{PRIMARY}' END AS change_kind",
        f"{name('pos')} AS column", f"{name('target')} AS __target",
        f"{fixes} AS suggested_fix", f"pass = {blocks.KEEP} AS flagged", f"{cascade} AS __cascade")
    with_id = named.withColumn("detection_id", detection_id(F.col(ROW_ID), F.col("__target")))

    def cid(step: str) -> str:
        return f"sha2(concat_ws('|', '{run_id}', detection_id, CAST(pass AS STRING), {step}), 256)"

    return with_id.selectExpr(
        f"{cid('CAST(step AS STRING)')} AS change_id", "anomaly_type", "change_kind", ROW_KEY, "column",
        "value_before", "value_after", "suggested_fix", "flagged",
        f"CASE WHEN __cascade THEN {cid(chr(39) + '0' + chr(39))} END AS parent_change_id",
        "detection_id", ROW_ID, "pos", "pass", "ord", "step")


def what_if(applied: DataFrame, roles: ColumnRoles) -> DataFrame:
    """X-15: the cells that the fixes would change (row_key, column, value_before,
    value_after). A lazy, narrow view of an applied frame; nothing is written."""
    measures = roles.measure_columns
    before, after = cells_array(applied, measures), F.col(f"{APPLIED}.cells")
    names = F.array(*[F.lit(m) for m in measures]).cast("array<string>")
    cells = F.transform(names, lambda name, i: F.struct(
        name.alias("column"), F.get(before, i).alias("value_before"), F.get(after, i).alias("value_after")))
    changed = F.filter(cells, lambda c: ~c["value_before"].eqNullSafe(c["value_after"]))
    return (applied.select(F.col(KEY).alias(ROW_KEY), F.explode(changed).alias("c"))
            .select(ROW_KEY, "c.*"))


def summary(change_rows: DataFrame) -> DataFrame:
    """X-12: number of entries per detector, zero-filled for all four."""
    spark = change_rows.sparkSession
    counts = change_rows.groupBy("anomaly_type").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(d, i) for i, d in enumerate(DETECTORS)],
                                  "anomaly_type string, k int")
    return (names.join(counts, "anomaly_type", "left")
            .select("anomaly_type", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "k")
            .orderBy("k").drop("k"))


__all__ = ["Policy", "apply_policy", "apply_selections", "cleaned_cube", "changes", "summary", "what_if",
           "validate_selections", "attribution_expr", "apply_passes"]

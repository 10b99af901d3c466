"""Detectors (D-01..D-05) and the per-cell merge (M-01..M-07).

Every detector is row-local: it only reads the measure cells of its own row.
The whole detection is therefore one narrow stage over the cube:

    scan -> measure array -> flagged positions -> explode -> merged detection rows

No Exchange appears after the cube is built. All detectors look at a cell side by
side and leave one small integer (bit k = detector k), so the merge needs no group-by
either (M-01).

Detectors are pluggable: a :class:`Detector` names its primary fix, its alternative
fixes and its rule, a function from a matrix (cube rows x periods, NaN where a cell is
missing) to the cells that it flags (:mod:`cubewash.functions.blocks`). One rule serves
cubes of any width. The default registry holds the four reference detectors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.cells import q, sql_text
from ..model import (
    CELLS,
    DOUBLE_BOOKING,
    FILE_PATH,
    FIX_PRIORITY,
    FLAGS,
    KEEP_AS_IS,
    KEY,
    NEGATIVE,
    OUTLIER,
    REFUND,
    ROW_ID,
    ROW_INDEX,
    SET_TO_ZERO,
    SPLIT_EVENLY,
    ColumnRoles,
)
from ..sources.cube import prepare, row_key

ROW_KEY = "row_key"


@dataclass(frozen=True)
class Detector:
    """``mask`` takes a matrix of cube rows and gives a boolean matrix of the flagged cells.

    It looks at each row by itself; cubes of fewer than ``min_measures`` periods have no
    flags of it."""

    name: str
    fix: str
    alternatives: tuple[str, ...]
    mask: blocks.Mask
    min_measures: int = 1


NEGATIVES = Detector(NEGATIVE, SET_TO_ZERO, (), blocks.negatives)
REFUNDS = Detector(REFUND, SET_TO_ZERO, (), blocks.refunds)
DOUBLE_BOOKINGS = Detector(DOUBLE_BOOKING, SPLIT_EVENLY, (), blocks.double_bookings, 2)
OUTLIERS = Detector(OUTLIER, KEEP_AS_IS, (SET_TO_ZERO,), blocks.outliers, 2)
DEFAULT_DETECTORS: tuple[Detector, ...] = (NEGATIVES, REFUNDS, DOUBLE_BOOKINGS, OUTLIERS)


def masks(detectors: tuple[Detector, ...]) -> list[tuple[int, blocks.Mask]]:
    return [(d.min_measures, d.mask) for d in detectors]


def flag_cells(df: DataFrame, roles: ColumnRoles,
               detectors: tuple[Detector, ...] = DEFAULT_DETECTORS,
               *, keep: list[str] | None = None) -> DataFrame:
    """One row per cube row with ``__cells`` and ``__flags``: the flagged positions, each with
    the set of detectors that flag it (bit k = detector k). Narrow.

    ``keep`` lists extra columns to carry (default: row id, row index, row key)."""
    ids, measures = roles.id_columns, roles.measure_columns
    p = prepare(df, ids, measures)
    carry = [c for c in (ROW_ID, CELLS, ROW_INDEX, FILE_PATH) if c in p.columns]
    more = [q(c) for c in keep or [] if c not in carry]
    flags = blocks.flags_column(F.col(CELLS), len(measures), masks(detectors)) if measures else F.array().cast(
        blocks.FLAGS_T)
    return p.select(*carry, row_key(ids).alias(KEY), *more, flags.alias(FLAGS))


def flagged_by(position: int | Column, flags: Column | None = None) -> Column:
    """Whether any cell of a row is flagged by the detector at ``position`` (A-04)."""
    return F.exists(F.col(FLAGS) if flags is None else flags,
                    lambda f: f["bits"].bitwiseAND(F.lit(1 << position)) != 0)


def merge_combo(flagged: list[str], detectors: tuple[Detector, ...]) -> dict:
    """M-02..M-04 for one set of flagging detectors.

    Each hit offers its own fix (grade 0) and its alternatives (grade 1). Sorted by
    grade and then by FIX_PRIORITY, the first offer is the default; the rest, in
    priority order, are the alternatives."""
    hits = [d for d in detectors if d.name in flagged]
    place = {**{f: i for i, f in enumerate(FIX_PRIORITY)}, None: -1}
    offers = [(0, d.fix) for d in hits] + [(1, f) for d in hits for f in d.alternatives]
    offers.sort(key=lambda o: (o[0], place.get(o[1], len(place))))
    default = offers[0][1] if offers else None
    rest = dict.fromkeys(f for _, f in offers if f != default)
    return {"flagged_by": [d.name for d in hits], "suggested_fix": default,
            "alternative_fixes": sorted(rest, key=lambda f: place.get(f, len(place)))}


def lookup(index: str, values: list, dtype: str) -> str:
    """SQL text of ``values[index]`` (from 0). Rules that depend on few values, such as the set
    of flagging detectors, are evaluated once per value on the driver; per cell a lookup remains."""
    def literal(v) -> str:
        if isinstance(v, (list, tuple)):
            return f"CAST(array({', '.join(map(literal, v))}) AS {dtype})"
        return sql_text(v)

    return f"element_at(array({', '.join(map(literal, values))}), {index} + 1)"


def combos(detectors: tuple[Detector, ...]) -> list[dict]:
    k = len(detectors)
    return [merge_combo([d.name for j, d in enumerate(detectors) if b >> j & 1], detectors)
            for b in range(1 << k)]


def merged_fields(bits: str, detectors: tuple[Detector, ...]) -> list[str]:
    """M-02..M-05 for one cell, given the SQL text of its set of flags."""
    table = combos(detectors)
    return [f"{lookup(bits, [t['flagged_by'] for t in table], 'array<string>')} AS flagged_by",
            f"{lookup(bits, [t['suggested_fix'] for t in table], 'string')} AS suggested_fix",
            "1.0D AS confidence",
            f"{lookup(bits, [t['alternative_fixes'] for t in table], 'array<string>')} AS alternative_fixes"]


def detection_id(row_id_col: Column, column: Column) -> Column:
    """M-06: deterministic id of a cell, stable over recomputation."""
    return F.concat(F.lit("d_"), F.substring(
        F.sha2(F.concat_ws("|", row_id_col, column), 256), 1, 32))


def explode_detections(flagged: DataFrame, measures: list[str],
                       detectors: tuple[Detector, ...] = DEFAULT_DETECTORS,
                       *, carry: list[str] | None = None) -> DataFrame:
    """Flagged positions of :func:`flag_cells` -> one merged row per cell."""
    flagged = flagged.withColumnRenamed(KEY, ROW_KEY)
    keep = [ROW_ID, ROW_KEY] + [c for c in (FILE_PATH, ROW_INDEX) if c in flagged.columns]
    keep += [c for c in (carry or []) if c not in keep]
    cells = flagged.select(*keep, CELLS, F.explode(FLAGS).alias("__f")).selectExpr(
        *[f"`{c}`" for c in keep], "__f.pos AS pos", "__f.bits AS __bits", f"get({CELLS}, __f.pos) AS value",
        f"{lookup('__f.pos', measures, 'string') if measures else 'CAST(NULL AS STRING)'} AS column")
    return cells.select(detection_id(F.col(ROW_ID), F.col("column")).alias("detection_id"), *keep, "pos",
                        "column", "value", *map(F.expr, merged_fields("__bits", detectors)))


def detect(df: DataFrame, roles: ColumnRoles,
           detectors: tuple[Detector, ...] = DEFAULT_DETECTORS) -> DataFrame:
    """D-05 + M-*: merged detections of a cube, one row per flagged cell.

    Columns: detection_id, __row_id, row_key, [__row_index], pos, column, value,
    flagged_by, suggested_fix, confidence, alternative_fixes."""
    flagged = flag_cells(df, roles, detectors)
    return explode_detections(flagged, roles.measure_columns, detectors)


def detect_one(df: DataFrame, roles: ColumnRoles, detector: Detector) -> DataFrame:
    """Raw detections of a single detector (the reference's ``detect_x``)."""
    dets = detect(df, roles, (detector,))
    return dets.select(
        "detection_id", ROW_ID, ROW_KEY, *[c for c in (FILE_PATH, ROW_INDEX) if c in dets.columns],
        "pos", "column", "value", F.lit(detector.name).alias("detector"),
        F.lit(detector.fix).alias("suggested_fix"), F.lit(1.0).alias("confidence"),
        F.array(*[F.lit(a) for a in detector.alternatives]).cast("array<string>")
        .alias("alternative_fixes"),
    )


def ordered(detections: DataFrame) -> DataFrame:
    """M-07 export order: file order of the row, then column name as text."""
    place = [c for c in (FILE_PATH, ROW_INDEX) if c in detections.columns] or [ROW_ID]
    return detections.orderBy(*place, "column")


def merge_raw(raw: DataFrame, detectors: tuple[Detector, ...] = DEFAULT_DETECTORS) -> DataFrame:
    """Generic M-01 for externally produced raw detections
    (``__row_id, row_key, pos, column, value, detector``): group by cell.

    Value is the value of the first raw detection in detector order."""
    order = F.create_map(*[x for i, d in enumerate(detectors) for x in (F.lit(d.name), F.lit(i))])
    g = (raw.groupBy(ROW_ID, "pos", "column")
         .agg(F.first(ROW_KEY).alias(ROW_KEY),
              F.min_by("value", order[F.col("detector")]).alias("value"),
              *[F.max(F.col("detector") == F.lit(d.name)).alias(d.name) for d in detectors]))
    bits = " + ".join(f"CASE WHEN `{d.name}` THEN {1 << k} ELSE 0 END" for k, d in enumerate(detectors))
    return g.select(
        detection_id(F.col(ROW_ID), F.col("column")).alias("detection_id"),
        ROW_ID, ROW_KEY, "pos", "column", "value",
        *map(F.expr, merged_fields(f"({bits})", detectors)),
    )

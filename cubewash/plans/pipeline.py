"""The reference's whole workflow as one batch job:

    read -> infer/validate schema -> detect -> choose fixes -> apply
         -> cleaned cube + audit log (committed together) -> run summary

``detect_file`` and ``clean_file`` are the two entry points a user of the
reference's upload/detect/apply flow needs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import q
from ..model import DETECTORS, FILE_PATH, FLAGS, ROW_INDEX, ColumnRoles, CubeError, SchemaError
from ..operators import apply as ap
from ..operators import detect as dt
from ..operators import profile as pf
from ..operators import views as vw
from ..sinks import writers as wr
from ..sources.cube import read_cube, user_columns


@dataclass
class DetectResult:
    roles: ColumnRoles
    detections: DataFrame
    counts: dict[str, int]


def _roles(df: DataFrame, roles: ColumnRoles | None) -> ColumnRoles:
    res = pf.resolve_schema(df, roles)
    if not res.ok:
        raise SchemaError(res.hard_errors)
    return res.roles


def detect_file(spark: SparkSession, path: str, *, roles: ColumnRoles | None = None,
                store: str | None = None, run_summary: str | None = None) -> DetectResult:
    """Detections of a cube file; re-uses a stored detection table only if it was made
    by this format version from the same files, roles and detectors (S-06)."""
    df = read_cube(spark, path)
    resolved = _roles(df, roles)
    made_of = wr.detection_fingerprint(spark, path, resolved, dt.DEFAULT_DETECTORS) if store else ""
    dets = wr.read_detections(spark, store, made_of) if store else None
    if dets is None:
        dets = dt.detect(df, resolved)
        if store:
            wr.write_detections(dets, store, made_of)
            dets = wr.read_detections(spark, store, made_of)
    counts = vw.detector_counts(dets).first().asDict()
    if run_summary:
        wr.append_run_summary(spark, run_summary, path.rstrip("/").rsplit("/", 1)[-1], status="detected",
                              row_count=df.count(), anomaly_counts=counts)
    return DetectResult(resolved, dets, counts)


def clean_file(spark: SparkSession, path: str, out_dir: str, *,
               roles: ColumnRoles | None = None, policy: ap.Policy | None = None,
               selections: DataFrame | None = None, detections: DataFrame | None = None,
               file_id: str | None = None, project: str = "demo",
               applied_at: datetime | None = None, run_summary: str | None = None,
               validate: bool = True) -> dict:
    """Apply fixes and commit the cleaned cube and the audit log once.

    Without ``selections`` the fixes follow ``policy`` (default: every detection
    with its default fix) in a single narrow pass. With ``selections`` they are
    validated against ``detections`` (computed when not given) and joined by row.
    The applied frame feeds two writers, so it is persisted (memory and disk);
    a lost executor recomputes its partitions deterministically from the scan."""
    df = read_cube(spark, path)
    # ``validate=False`` trusts ``roles`` that the caller has just validated
    # (saves the two profile jobs); without roles the schema is always resolved.
    resolved = roles if (roles is not None and not validate) else _roles(df, roles)
    run_id = uuid.uuid4().hex[:8]
    file_id = file_id or path.rstrip("/").rsplit("/", 1)[-1]
    if selections is None:
        applied = ap.apply_policy(df, resolved, policy or ap.Policy())
    else:
        dets = detections if detections is not None else dt.detect(df, resolved)
        applied = ap.apply_selections(df, resolved, dets, selections)
    applied = applied.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        changes = ap.changes(applied, resolved, run_id)
        counts = {r["anomaly_type"]: r["n"] for r in ap.summary(changes).collect()}
        header = {"file_id": file_id, "applied_at": wr.iso_utc(applied_at),
                  "user_id": f"project:{project}",
                  "summary": {d: int(counts.get(d, 0)) for d in DETECTORS},
                  "total_changes": int(sum(counts.values()))}
        wr.commit_apply(spark, out_dir, ap.cleaned_cube(applied, resolved), changes, header)
    finally:
        applied.unpersist()
    if run_summary:
        wr.append_run_summary(spark, run_summary, file_id, status="cleaned",
                              applied_changes=header["total_changes"],
                              cleaned_at=header["applied_at"])
    return header


def preview_rows(df: DataFrame, roles: ColumnRoles, detected: str | None = None) -> DataFrame:
    """A-05: the rows of a scanned cube with their place, optionally only flagged rows.

    The flag is computed in the row's own narrow pass; nothing is joined."""
    if detected is None:
        return df
    columns = user_columns(df)
    flagged = dt.flag_cells(df, roles, keep=columns)
    names = [d.name for d in dt.DEFAULT_DETECTORS]
    if detected not in (*names, "any"):
        raise CubeError(f"Unknown detector type '{detected}'.")
    hit = F.size(FLAGS) > 0 if detected == "any" else dt.flagged_by(names.index(detected))
    # A generator instead of a filter: a pushed-down filter would compute the flags a second time.
    kept = F.explode(F.array_repeat(F.lit(True), hit.cast("int"))).alias("__kept")
    return flagged.select(*[q(c) for c in columns], FILE_PATH, ROW_INDEX, kept).drop("__kept")


def preview(spark: SparkSession, path: str, roles: ColumnRoles, detected: str | None = None,
            after: tuple[str, int] | int | None = None, limit: int = 100) -> DataFrame:
    """A-05/A-06: a page of cube rows in file order, optionally only flagged rows.

    ``after`` is the place of the last row of the page before: its file path and index.
    An index alone will do for a cube of one file; for more it is an error."""
    df = read_cube(spark, path, check_empty=False)
    if isinstance(after, int):
        files = df.inputFiles()
        if len(files) > 1:
            raise CubeError("A cube of several files is paged by (file path, row index).")
        after = (df.select(FILE_PATH).first()[0], after)
    return vw.page(preview_rows(df, roles, detected), after, limit)


def preview_total(spark: SparkSession, path: str, roles: ColumnRoles, detected: str | None = None) -> int:
    """How many rows all pages of :func:`preview` have together."""
    return preview_rows(read_cube(spark, path, check_empty=False), roles, detected).count()

"""Sinks (S-04..S-08).

* cleaned cube -> Parquet (snappy), input column order (S-04);
* audit log -> gzip NDJSON of change rows + a one-row header JSON (S-05);
* detections -> Parquet table, re-used only for the same input, roles and version (S-06);
* both artifacts of an apply are written into a folder per run and committed by creating
  one pointer; a second apply is refused (S-07);
* one appended run-summary row per step (S-08).

Writers are Spark's own distributed writers; nothing is collected on the driver.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DETECTIONS_FORMAT_VERSION, AlreadyCleanedError, ColumnRoles
from . import records
from .records import file_system

COMMIT_MARKER = "_CLEANED"
POINTER = f"{COMMIT_MARKER}/commit.json"
ARTIFACTS = ("cleaned", "audit")


def iso_utc(when: datetime | None = None) -> str:
    """A moment (default: now; without a zone it is UTC) as text in UTC, by the second."""
    when = datetime.now(UTC) if when is None else when
    utc = when.replace(tzinfo=when.tzinfo or UTC).astimezone(UTC)
    return f"{utc.replace(tzinfo=None).isoformat(timespec='seconds')}Z"


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = file_system(spark, path)
    return bool(fs.exists(p))


def write_cleaned(cleaned: DataFrame, path: str, mode: str = "errorifexists") -> None:
    cleaned.write.mode(mode).option("compression", "snappy").parquet(path)


def write_audit(changes: DataFrame, header: dict, path: str, mode: str = "errorifexists") -> None:
    """Change rows as gzip JSON lines under ``path/changes``; header under ``path/header``."""
    spark = changes.sparkSession
    out = changes.select(
        "change_id", "anomaly_type", "change_kind", "row_key",
        "column", "value_before", "value_after", "suggested_fix", "flagged",
        "parent_change_id")
    out.write.mode(mode).option("compression", "gzip").json(f"{path}/changes")
    spark.createDataFrame([(json.dumps(header),)], "value string") \
        .coalesce(1).write.mode(mode).text(f"{path}/header")


def read_audit_header(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/header").first()[0])


def detection_fingerprint(spark: SparkSession, path: str, roles: ColumnRoles, detectors) -> str:
    """What a detection table was made of: input files (name, length, time), roles, detectors, version."""
    fs, p, _ = file_system(spark, path)
    files, listed = [], fs.listFiles(p, True)
    while listed.hasNext():
        f = listed.next()
        files.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    parts = [DETECTIONS_FORMAT_VERSION, sorted(files), roles.id_columns, roles.time_columns,
             roles.measure_columns, [d.name for d in detectors]]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def write_detections(detections: DataFrame, path: str, made_of: str = "") -> None:
    """S-06: detections, and under ``path/_made_of`` what they were made of (written last)."""
    spark = detections.sparkSession
    fs, p, _ = file_system(spark, f"{path}/_made_of")
    fs.delete(p, True)
    detections.write.mode("overwrite").parquet(f"{path}/detections")
    spark.createDataFrame([(f"{DETECTIONS_FORMAT_VERSION}:{made_of}",)], "value string") \
        .coalesce(1).write.mode("overwrite").text(f"{path}/_made_of")


def read_detections(spark: SparkSession, path: str, made_of: str = "") -> DataFrame | None:
    """A stored detection table, or None when there is none that was completely written
    from the same input, roles, detectors and format version (the caller then recomputes)."""
    if not path_exists(spark, f"{path}/_made_of/_SUCCESS"):
        return None
    if spark.read.text(f"{path}/_made_of").first()[0] != f"{DETECTIONS_FORMAT_VERSION}:{made_of}":
        return None
    return spark.read.parquet(f"{path}/detections")


def commit_apply(spark: SparkSession, out_dir: str, cleaned: DataFrame, changes: DataFrame,
                 header: dict) -> dict:
    """S-07: write both artifacts once.

    Each run writes into a folder of its own, ``out_dir/run-<id>``. Only when both
    artifacts are complete the pointer (a record in ``out_dir/_CLEANED``) is published with
    the run's name and the header; a name is given once, so of any number of concurrent or
    repeated runs one is committed. Readers follow the pointer (:func:`committed_artifact`).
    A run that fails or loses leaves no pointer, and its folder is removed. What stands
    under the pointer's name without being a record of a run with both artifacts (left by a
    writer that died, or whose folder was deleted) is set aside and the run commits."""
    pointer = f"{out_dir}/{POINTER}"
    taken = "The cube has been cleaned already; its committed artifacts stay as they are."
    if _committed_run(spark, out_dir):
        raise AlreadyCleanedError(taken)
    run = f"run-{uuid.uuid4().hex}"
    fs, own, jvm = file_system(spark, f"{out_dir}/{run}")
    committed = False
    try:
        write_cleaned(cleaned, f"{out_dir}/{run}/cleaned")
        write_audit(changes, header, f"{out_dir}/{run}/audit")
        while not records.publish(spark, pointer, {"run": run, **header}):
            if _committed_run(spark, out_dir):
                raise AlreadyCleanedError(taken)
            records.set_aside(spark, pointer)
        committed = True
        # Published under plain names too where these are free; the pointer is what counts.
        for name in ARTIFACTS:
            plain = jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{name}")
            if not fs.exists(plain):
                fs.rename(jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{run}/{name}"), plain)
    finally:
        if not committed:
            fs.delete(own, True)
    return header


def _committed_run(spark: SparkSession, out_dir: str) -> dict[str, str] | None:
    """Folders of both artifacts that the pointer names; None if it names none that are there."""
    record = records.read(spark, f"{out_dir}/{POINTER}")
    if record is None or "run" not in record:
        return None
    found = {}
    for name in ARTIFACTS:
        places = [f"{out_dir}/{record['run']}/{name}", f"{out_dir}/{name}"]
        found[name] = next((x for x in places if path_exists(spark, x)), None)
    return found if all(found.values()) else None


def committed_artifact(spark: SparkSession, out_dir: str, name: str) -> str | None:
    """Folder of a committed artifact (``cleaned`` or ``audit``), None before a commit."""
    return (_committed_run(spark, out_dir) or {}).get(name)


def append_run_summary(spark: SparkSession, path: str, file_id: str, *, event_id: str | None = None,
                       **fields) -> None:
    """S-08: append one event for ``file_id``; fields that are not given stay as they were.

    Events are numbered by the nanosecond clock, so two in one second keep their order. An
    event that is retried under its ``event_id`` is written once."""
    folder = f"{path}/event_id={event_id or uuid.uuid4().hex}"
    if path_exists(spark, f"{folder}/_SUCCESS"):
        return
    counts = fields.get("anomaly_counts")
    row = (file_id, time.time_ns(), iso_utc(), fields.get("row_count"), fields.get("status"),
           None if counts is None else json.dumps(counts), fields.get("applied_changes"),
           fields.get("cleaned_at"))
    schema = ("file_id string, seq long, updated_at string, row_count long, status string, "
              "anomaly_counts string, applied_changes long, cleaned_at string")
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(folder)


def latest_run_summary(spark: SparkSession, path: str) -> DataFrame:
    """Latest state per file: of each field the newest value that an event gave
    (``max_by`` ignores nothing by itself, so the order is null where the field is)."""
    df = spark.read.parquet(path).drop("event_id")
    fields = [c for c in df.columns if c not in ("file_id", "seq")]
    return df.groupBy("file_id").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields])

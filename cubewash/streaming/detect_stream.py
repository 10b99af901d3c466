"""Detections over cube files that arrive in a folder (Structured Streaming).

Every detector reads only its own row, so the batch plan of
:func:`cubewash.operators.detect.detect` runs unchanged on a streaming
DataFrame: no state, no watermark, append mode. The file source and the
checkpointed file sink give exactly-once output across restarts and lost
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..model import ColumnRoles
from ..operators import detect as dt


def detect_stream(spark: SparkSession, path: str, schema: T.StructType, roles: ColumnRoles,
                  *, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming merged detections of the Parquet cube files under ``path``.

    ``schema`` is the cube schema (streaming file sources need it up front)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return dt.detect(reader.parquet(path), roles)


def write_stream(detections: DataFrame, out: str, checkpoint: str, *,
                 available_now: bool = True) -> StreamingQuery:
    """Append the detections to Parquet under ``out``; ``checkpoint`` must be a
    shared folder (the cluster's checkpoint area), never a machine-local one."""
    w = (detections.writeStream.format("parquet").outputMode("append")
         .option("path", out).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()

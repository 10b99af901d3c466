"""Sources, sinks, pipeline and streaming on a cube built from the sf0.001 tables."""

from __future__ import annotations

import json
import os
import tempfile

import pytest

from cubewash.model import AlreadyCleanedError, DuplicateColumnsError, EmptyInputError
from cubewash.operators import detect as dt
from cubewash.plans import cubes, pipeline
from cubewash.plans.queries import main_roles
from cubewash.sinks import writers as wr
from cubewash.sources.cube import read_cube

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cube_path(spark):
    if not os.path.exists(f"{SF}/lineitem.parquet"):
        pytest.skip("driver tables not present")
    d = tempfile.mkdtemp(prefix="cubewash-test-")
    path = f"{d}/cube.parquet"
    cubes.nation_brand_cube(spark, SF).write.parquet(path)
    return path


def test_read_cube_keeps_file_order(spark, cube_path):
    df = read_cube(spark, cube_path)
    assert "__row_index" in df.columns
    assert df.count() == 621


def test_zero_rows_rejected(spark):
    d = tempfile.mkdtemp(prefix="cubewash-test-")
    spark.createDataFrame([], "c string, `2021_1` double").write.parquet(f"{d}/e.parquet")
    with pytest.raises(EmptyInputError):
        read_cube(spark, f"{d}/e.parquet")


def test_duplicate_columns_rejected(spark):
    d = tempfile.mkdtemp(prefix="cubewash-test-")
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table([pa.array(["a"]), pa.array([1.0]), pa.array([2.0])],
                 names=["c", "2021_5", "2021_5"])
    pq.write_table(t, f"{d}/dup.parquet")
    with pytest.raises(DuplicateColumnsError):
        read_cube(spark, f"{d}/dup.parquet")


def test_detect_file_with_versioned_store(spark, cube_path):
    store = tempfile.mkdtemp(prefix="cubewash-test-") + "/dets"
    first = pipeline.detect_file(spark, cube_path, store=store)
    again = pipeline.detect_file(spark, cube_path, store=store)
    assert first.counts == again.counts
    assert first.counts == {"negative": 1590, "refund": 1113, "double_booking": 144,
                            "outlier": 3793}


def test_clean_file_commits_once(spark, cube_path):
    out = tempfile.mkdtemp(prefix="cubewash-test-") + "/out"
    header = pipeline.clean_file(spark, cube_path, out, file_id="f1")
    assert header["summary"]["double_booking"] % 2 == 0
    cleaned = spark.read.parquet(f"{out}/cleaned")
    assert cleaned.count() == 621
    assert [c for c in cleaned.columns] == [c for c in spark.read.parquet(cube_path).columns]
    changes = spark.read.json(f"{out}/audit/changes")
    assert changes.count() == header["total_changes"]
    assert json.loads(spark.read.text(f"{out}/_CLEANED").first()[0])["file_id"] == "f1"
    with pytest.raises(AlreadyCleanedError):
        pipeline.clean_file(spark, cube_path, out)


def test_run_summary_latest(spark):
    path = tempfile.mkdtemp(prefix="cubewash-test-") + "/runs"
    wr.append_run_summary(spark, path, "f1", status="detected", row_count=3)
    wr.append_run_summary(spark, path, "f1", status="cleaned", applied_changes=2)
    rows = wr.latest_run_summary(spark, path).collect()
    assert len(rows) == 1


def test_streaming_matches_batch(spark, cube_path):
    from cubewash.streaming.detect_stream import detect_stream, write_stream

    schema = spark.read.parquet(cube_path).schema
    base = tempfile.mkdtemp(prefix="cubewash-test-")
    q = write_stream(detect_stream(spark, cube_path, schema, main_roles()), f"{base}/out",
                     f"{base}/ckpt")
    q.awaitTermination(300)
    streamed = spark.read.parquet(f"{base}/out").count()
    batch = dt.detect(spark.read.parquet(cube_path), main_roles()).count()
    assert streamed == batch

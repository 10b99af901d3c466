"""Published records, the commit of an apply (S-07), and the cube store (P-04, V-09)."""

from __future__ import annotations

import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest

from cubewash.model import AlreadyCleanedError, ColumnRoles, ConflictError, CubeError, SchemaError
from cubewash.plans.store import CubeStore
from cubewash.sinks import records
from cubewash.sinks import writers as wr

CHANGES = ("change_id string, anomaly_type string, change_kind string, row_key struct<id: string>, "
           "column string, value_before double, value_after double, suggested_fix string, flagged boolean, "
           "parent_change_id string")


def scratch() -> str:
    return tempfile.mkdtemp(prefix="cubewash-test-")


@pytest.fixture()
def artifacts(spark):
    return spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([], CHANGES)


def test_a_name_is_given_once(spark):
    path = f"{scratch()}/deep/er/record.json"
    assert records.read(spark, path) is None
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda k: records.publish(spark, path, {"k": k}), range(6)))
    assert sum(won) == 1
    assert records.read(spark, path) == {"k": won.index(True)}
    assert records.names(spark, os.path.dirname(path)) == ["record.json"]
    assert records.set_aside(spark, path) and not records.set_aside(spark, path)
    assert records.publish(spark, path, {"k": "new"})


@pytest.mark.parametrize("step", ["write_cleaned", "write_audit", "publish"])
def test_a_crash_before_the_pointer_leaves_nothing_and_a_retry_commits(spark, artifacts, monkeypatch, step):
    out = scratch()

    def dies(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(records if step == "publish" else wr, step, dies)
        with pytest.raises(RuntimeError):
            wr.commit_apply(spark, out, *artifacts, {"n": 1})
    assert wr.committed_artifact(spark, out, "cleaned") is None
    assert [n for n in records.names(spark, out) if n.startswith("run-")] == []
    wr.commit_apply(spark, out, *artifacts, {"n": 2})
    assert wr.read_audit_header(spark, wr.committed_artifact(spark, out, "audit")) == {"n": 2}


def test_a_crash_between_pointer_and_plain_names_is_a_commit(spark, artifacts):
    out = scratch()
    wr.write_cleaned(artifacts[0], f"{out}/run-a/cleaned")
    wr.write_audit(artifacts[1], {"n": 1}, f"{out}/run-a/audit")
    records.publish(spark, f"{out}/{wr.POINTER}", {"run": "run-a"})
    with pytest.raises(AlreadyCleanedError):
        wr.commit_apply(spark, out, *artifacts, {"n": 2})
    assert wr.read_audit_header(spark, wr.committed_artifact(spark, out, "audit")) == {"n": 1}
    os.rename(f"{out}/run-a/cleaned", f"{out}/cleaned")  # half of the names were given
    assert wr.committed_artifact(spark, out, "cleaned") == f"{out}/cleaned"


@pytest.mark.parametrize("left", [b"", b"{\"run\": ", b"{\"run\": \"run-gone\"}", b"[1]"])
def test_a_pointer_that_names_no_run_is_taken_over(spark, artifacts, left):
    out = scratch()
    os.makedirs(f"{out}/_CLEANED")
    with open(f"{out}/{wr.POINTER}", "wb") as f:
        f.write(left)
    assert wr.committed_artifact(spark, out, "cleaned") is None
    wr.commit_apply(spark, out, *artifacts, {"n": 3})
    assert spark.read.parquet(wr.committed_artifact(spark, out, "cleaned")).count() == 1
    with pytest.raises(AlreadyCleanedError):
        wr.commit_apply(spark, out, *artifacts, {"n": 4})


def test_of_racing_runs_one_commits(spark, artifacts):
    out = scratch()

    def run(k):
        try:
            return wr.commit_apply(spark, out, *artifacts, {"n": k})["n"]
        except AlreadyCleanedError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [k for k in pool.map(run, range(4)) if k is not None]
    assert len(won) == 1
    assert wr.read_audit_header(spark, wr.committed_artifact(spark, out, "audit")) == {"n": won[0]}
    assert [n for n in records.names(spark, out) if n.startswith("run-")] in ([], [records.read(
        spark, f"{out}/{wr.POINTER}")["run"]])


def test_a_retried_event_is_written_once(spark):
    path = f"{scratch()}/runs"
    for _ in range(2):
        wr.append_run_summary(spark, path, "f", event_id="detect-1", status="detected", row_count=3)
    wr.append_run_summary(spark, path, "f", event_id="clean-1", status="cleaned")
    wr.append_run_summary(spark, path, "f", event_id="detect-1", status="detected")
    assert spark.read.parquet(path).count() == 2
    assert wr.latest_run_summary(spark, path).first()["status"] == "cleaned"


@pytest.fixture()
def cube(spark):
    path = f"{scratch()}/cube.parquet"
    rows = [(f"r{i}", float(i), "n/a" if i == 3 else f" {i}.5 " if i != 5 else "-40", 2.0) for i in range(20)]
    spark.createDataFrame(rows, "c string, `2021_1` double, `2021_2` string, `2021_3` double").write.parquet(path)
    return path


def test_coerce_writes_a_version_and_forgets_what_depended_on_the_old(spark, cube):
    store = CubeStore.create(spark, f"{scratch()}/store", cube)
    before = store.schema()
    assert before.coercible_columns == ["2021_2"] and before.roles.measure_columns == ["2021_1", "2021_3"]
    assert store.save_roles(before.roles).ok and store.state().saved_roles == before.roles
    old = store.detections()
    assert "2021_2" not in {r["column"] for r in old.collect()}
    reader = store.read()  # a job that began before

    after = store.coerce(["2021_2"])
    assert after.roles.measure_columns == ["2021_1", "2021_2", "2021_3"] and after.coercible_columns == []
    state = store.state()
    assert (state.number, state.event, state.roles, state.detections) == (4, "coerced", None, None)
    assert [s.event for s in store.history()] == ["created", "roles saved", "detected", "coerced"]
    values = {r["c"]: r["2021_2"] for r in store.read().collect()}
    assert values["r3"] is None and values["r4"] == 4.5 and values["r5"] == -40.0
    assert dict(spark.read.parquet(cube).dtypes)["2021_2"] == "string"
    assert reader.count() == 20
    assert "r5" in {r["row_key"]["c"] for r in store.detections().where("column = '2021_2'").collect()}
    assert len(store.vacuum()) == 1 and store.read().count() == 20


def test_stored_detections_are_used_until_roles_change(spark, cube):
    store = CubeStore.create(spark, f"{scratch()}/store", cube)
    store.detections()
    kept = store.state()
    store.detections()
    assert store.state() == kept
    bad = store.save_roles(ColumnRoles(["c"], ["2021_1", "2021_2"], ["2021_1", "2021_2"]))
    assert not bad.ok and store.state() == kept  # refused: nothing changes
    store.save_roles(ColumnRoles(["c"], ["2021_1"], ["2021_1"]))
    assert store.state().detections is None
    assert {r["column"] for r in store.detections().collect()} <= {"2021_1"}


def test_a_store_is_not_changed_twice_from_one_state(spark, cube):
    store = CubeStore.create(spark, f"{scratch()}/store", cube)
    state = store.state()
    store._follow(state, "first")
    with pytest.raises(ConflictError):
        store._follow(state, "second")
    with pytest.raises(ConflictError):
        CubeStore.create(spark, store.root, cube)
    with pytest.raises(CubeError):
        store.coerce(["2021_9"])
    with pytest.raises(CubeError):
        CubeStore(spark, scratch()).state()
    duplicates = f"{scratch()}/twice"
    spark.createDataFrame([("a", 1.0), ("a", 2.0)], "c string, `2021_1` double").write.parquet(duplicates)
    with pytest.raises(SchemaError):
        CubeStore.create(spark, f"{scratch()}/store", duplicates).detections()


def test_staged_selections_follow_the_log(spark, cube):
    store = CubeStore.create(spark, f"{scratch()}/store", cube)
    with pytest.raises(CubeError):
        store.clear()  # nothing is detected yet
    store.coerce(["2021_2"])
    ids = sorted(r["detection_id"] for r in store.detections().collect())
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "detection_id string, fix string, sel_ord long")
    current = lambda: {r["detection_id"]: (r["fix"], r["sel_ord"]) for r in store.selections().collect()}
    assert current() == {}
    store.stage(rows(("a", "set_to_zero", 1), ("b", "keep_as_is", 2)))
    store.stage(rows(("a", "keep_as_is", 9)))
    first = current()
    assert first["a"] == ("keep_as_is", (1 << 40) + 1)  # the fix is new, the place is not
    store.unstage(rows(("a", None, 0)))
    store.stage(rows(("a", "set_to_zero", 1)))
    assert current()["a"][1] > first["b"][1]  # staged anew: it goes to the end
    store.clear()
    assert current() == {}
    store.stage(rows((ids[0], "set_to_zero", 1)))
    assert set(current()) == {ids[0]}
    other = CubeStore(spark, store.root)
    assert other.apply(f"{scratch()}/out")["total_changes"] >= 1
    assert [n.split("-")[0] for n in store.vacuum()] == ["events"] * 4
    store.save_roles(ColumnRoles(["c"], ["2021_1", "2021_2"], ["2021_1", "2021_2"]))
    store.detections()
    assert current() == {}  # of other detections


def test_clear_in_a_plain_log(spark):
    from cubewash.operators import policy as pol

    log = spark.createDataFrame(
        [("a", "x", None, 1, "stage"), (None, None, None, 5, "clear"), ("b", "y", "outlier", 6, "stage"),
         ("b", "z", None, 8, "stage"), ("c", "y", None, 7, "stage"), ("c", None, None, 9, "unstage"),
         ("c", "w", None, 10, "stage")],
        "detection_id string, fix string, attribution string, sel_ord long, op string")
    assert {tuple(r) for r in pol.latest_selections(log).collect()} == {("b", "z", None, 6), ("c", "w", None, 10)}

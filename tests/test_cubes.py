"""The customer x brand cube on tables with rows of their own."""

from __future__ import annotations

import datetime as dt
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from cubewash.plans import cubes, queries
from cubewash.sources.cube import long_to_wide


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    """Six customers (two of one name), 40 orders (two of one key), 160 lines, some without a date or a price."""
    d = tempfile.mkdtemp(prefix="cubewash-test-")
    customer = [(i, None if i == 5 else f"C{i % 4}") for i in range(6)]
    orders = [(i % 39, i % 7) for i in range(40)]
    part = [(i, f"B{i % 3}") for i in range(5)]
    lines = [(i % 41, i % 6, None if i % 9 == 8 else 100.25 + i, "R" if i % 3 else "N",
              None if i % 17 == 16 else dt.datetime(1996 + i % 4, 1 + i % 12, 3)) for i in range(160)]
    for name, rows, schema in (
            ("customer", customer, "c_custkey long, c_name string"),
            ("orders", orders, "o_orderkey long, o_custkey long"),
            ("part", part, "p_partkey long, p_brand string"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_extendedprice double, l_returnflag string, "
                                "l_shipdate timestamp")):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    want = {}
    for okey, pkey, price, returned, day in lines:
        for k, cust in orders:
            for c, name in customer:
                if day and k == okey and c == cust and pkey < 5:
                    cell = (name, f"B{pkey % 3}"), f"{day.year}Q{(day.month + 2) // 3}"
                    value = 0.0 if price is None else -price if returned == "R" else price
                    want.setdefault(cell[0], {}).setdefault(cell[1], []).append(value)
    return d, {k: {p: sum(v) for p, v in row.items()} for k, row in want.items()}


def test_customer_cube_equals_loops_whatever_its_parts(spark, tables, monkeypatch):
    d, want = tables
    for lines_a_task in (7, 10**6):
        monkeypatch.setattr(cubes, "LINES_A_TASK", lines_a_task)
        cube = cubes.customer_brand_cube(spark, d)
        got = {(r["c_name"], r["p_brand"]): r for r in cube.collect()}
        assert len(got) == cube.count() and got.keys() == want.keys()
        for k, row in got.items():
            for p in cube.columns[2:]:
                assert row[p] == pytest.approx(want[k].get(p, 0.0), abs=1e-9)


def test_customer_cube_has_more_parts_with_more_lines(spark, tables, monkeypatch):
    d, _ = tables
    monkeypatch.setattr(cubes, "LINES_A_TASK", 4)
    plan = plan_of(cubes.customer_brand_cube(spark, d))
    assert plan.count("hashpartitioning(c_name") == 1  # summed and laid out where they were dealt to
    assert "40), REPARTITION_BY_NUM" in plan


def test_cube_keeps_no_sum_for_empty_cells(spark):
    labels = [f"2021_{i}" for i in range(1, 13)]
    facts = spark.createDataFrame([("a", "2021_3", 1), ("a", "2021_3", 2), (None, "2021_12", None), (None, "2021_1", 5)],
                                  "id string, p string, v long").withColumn("v", F.col("v").cast("decimal(18,2)"))
    wide = long_to_wide(facts, ["id"], "p", "v", labels, fill=None)
    rows = {r["id"]: r for r in wide.collect()}
    assert [rows["a"][c] for c in labels] == [None, None, 3.0] + [None] * 9
    assert [rows[None][c] for c in labels] == [5.0] + [None] * 11
    assert wide.columns == ["id", *labels] and {f.dataType.simpleString() for f in wide.schema.fields[1:]} == {"double"}
    # one decimal sum, not one a period
    assert len(set(re.findall(r"partial_sum\([^)]*\)", plan_of(wide)))) == 1

def test_findings_of_returns_build_the_cube_once(spark, tables, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.pf, "findings", lambda df, roles: seen.append(df) or spark.range(0).selectExpr(
        "'a' check_id", "'b' severity", "'c' column", "id n"))
    queries.schema_findings_returns(spark, tables[0]).collect()
    assert "Join" not in plan_of(seen[0]) and seen[0].count() == len(tables[1])

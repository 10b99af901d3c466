from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cubewash.model import ColumnRoles  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from cubewash.session import local_session

    s = local_session("*", extra={"spark.sql.shuffle.partitions": "8"})
    yield s


def row_frame(spark, values: list[list[float | None]], ids: list[str] | None = None):
    """Cube with one id column ``id`` and measures m1..mN (one list per row)."""
    n = len(values[0])
    cols = ", ".join(f"m{i + 1} double" for i in range(n))
    ids = ids or [f"r{k}" for k in range(len(values))]
    rows = [(ids[k], *[None if v is None else float(v) for v in vals])
            for k, vals in enumerate(values)]
    df = spark.createDataFrame(rows, f"id string, {cols}")
    measures = [f"m{i + 1}" for i in range(n)]
    return df, ColumnRoles(["id"], measures, measures)


def flagged(spark, values, detector) -> list[tuple[str, str]]:
    from cubewash.operators.detect import detect_one

    df, roles = row_frame(spark, values)
    return sorted((r["row_key"]["id"], r["column"])
                  for r in detect_one(df, roles, detector).collect())

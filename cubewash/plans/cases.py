"""Cubes with one fault each, derived from the tables, and what the checks say of them.

Every case is a projection of the segment x month cube, which is written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import q
from ..model import ColumnRoles
from ..operators import profile as pf
from ..session import ensure_checkpoint_dir
from .cubes import segment_month_cube

IDS = ["n_name", "c_mktsegment", "o_orderpriority"]
#: The months that the cases treat apart, and the nation whose cells become text.
MONTH, OTHER_MONTH, NATION = "1996_3", "1998_7", "NATION_7"


def written(spark: SparkSession, cube: DataFrame) -> DataFrame:
    """The cube as files in the shared folder, so that cases do not build it again."""
    path = f"{ensure_checkpoint_dir(spark)}/cubewash-{uuid.uuid4().hex}/cube"
    cube.write.parquet(path)
    return spark.read.parquet(path)


def with_text(cube: DataFrame, month: str) -> DataFrame:
    """``month`` as text, with words instead of numbers in the rows of one nation."""
    text = F.when(F.col("n_name") == NATION, F.lit("n/a")).otherwise(q(month).cast("string"))
    return cube.withColumn(month, text)


def cases(base: DataFrame) -> dict[str, tuple[DataFrame, ColumnRoles | None]]:
    """name -> (cube, roles that a user gives; None: inferred)."""
    months = [c for c in base.columns if c not in IDS]
    by_pos = lambda names: base.select(*[q(c) for c in names])
    swapped = {MONTH: OTHER_MONTH, OTHER_MONTH: MONTH}
    given = ColumnRoles(IDS, months, months)
    one_id = base.select(F.concat_ws("|", *IDS).alias("row"), *[q(c) for c in months])
    words = base.select(*IDS, *[F.when(F.col("n_name").isNotNull(), F.lit("x")).alias(c) for c in months[:3]])
    return {
        "inferred": (base, None),
        "out of order": (by_pos([*IDS, *[swapped.get(c, c) for c in months]]), None),
        "gap": (by_pos([c for c in base.columns if c not in swapped]), None),
        "mixed formats": (base.withColumnRenamed(MONTH, "1996-03"), None),
        "one id": (one_id, None),
        "no period": (base.select(*IDS, *[q(c).alias(f"m{i}") for i, c in enumerate(months)]), None),
        "no id": (by_pos(months), None),
        "no measures": (words, None),
        "text period": (with_text(base, MONTH), None),
        "text as measure": (with_text(base, MONTH), given),
        "unknown columns": (base, ColumnRoles([*IDS, "region"], months, [*months, "2099_1"])),
        "too few ids": (base, ColumnRoles(IDS[:2], months, months)),
    }


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """case, check_id, severity, column, n of every case."""
    parts = [pf.findings(cube, roles).select(F.lit(name).alias("case"), "check_id", "severity", "column", "n")
             for name, (cube, roles) in cases(written(spark, segment_month_cube(spark, sf))).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def roles(spark: SparkSession, sf: str) -> DataFrame:
    """case, role, pos, column: the roles inferred (V-01, V-02, V-05..V-08) for the cases without given ones."""
    rows = []
    for name, (cube, given) in cases(written(spark, segment_month_cube(spark, sf))).items():
        if given is None:
            found = pf.infer_schema(cube)
            for role, columns in (("id", found.roles.id_columns), ("time", found.roles.time_columns),
                                  ("measure", found.roles.measure_columns), ("coercible", found.coercible_columns)):
                rows += [(name, role, i, c) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "case string, role string, pos int, column string")

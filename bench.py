"""Benchmark: the reference's three timed steps (schema, detect, apply with every
detection staged) on cubes built from the driver tables, plus the cube build.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line. Each cube is built by Spark from the tables and written
as Parquet first (the reference starts from an uploaded Parquet file too).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cubewash.operators import detect as dt  # noqa: E402
from cubewash.operators import profile as pf  # noqa: E402
from cubewash.operators import views as vw  # noqa: E402
from cubewash.plans import cubes, pipeline  # noqa: E402
from cubewash.session import local_session  # noqa: E402
from cubewash.sources.cube import read_cube  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="cubewash-bench",
                          extra={"spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2))})
    scratch = tempfile.mkdtemp(prefix="cubewash-bench-")
    times: dict[str, float] = {}
    info: dict[str, object] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    spark.range(1).count()  # JVM warm-up outside the timings
    for cube_name, build in (("nation_brand", cubes.nation_brand_cube),
                             ("customer_brand", cubes.customer_brand_cube)):
        path = f"{scratch}/{cube_name}.parquet"
        timed(f"{cube_name}_build",
              lambda: build(spark, sf_dir).write.mode("overwrite").parquet(path))
        schema = timed(f"{cube_name}_schema", lambda: pf.infer_schema(read_cube(spark, path)))
        roles = schema.roles
        info[f"{cube_name}_rows"] = spark.read.parquet(path).count()

        def detect():
            d = dt.detect(read_cube(spark, path), roles)
            return vw.detector_counts(d).first().asDict()
        info[f"{cube_name}_counts"] = timed(f"{cube_name}_detect", detect)
        # roles were validated in the timed schema step above
        header = timed(f"{cube_name}_apply_all", lambda: pipeline.clean_file(
            spark, path, f"{scratch}/{cube_name}_out", roles=roles, validate=False))
        info[f"{cube_name}_changes"] = header["total_changes"]

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "cube_clean_total", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "info": info}))


if __name__ == "__main__":
    main()

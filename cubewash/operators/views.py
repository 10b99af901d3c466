"""Aggregations and views over detections (A-01..A-09).

All of them are declarative DataFrame queries. Counts use ``count_if`` /
partial aggregation, so a hot detector or row never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import free_name
from ..model import DETECTORS, FILE_PATH, FLAGS, KEY, ROW_ID, ROW_INDEX, CubeError
from ..session import ensure_checkpoint_dir
from .detect import DEFAULT_DETECTORS, ROW_KEY, Detector, flagged_by


def detector_counts(detections: DataFrame) -> DataFrame:
    """A-01: cells per detector, zero-filled; one row, one column per detector."""
    return detections.agg(*[
        F.count_if(F.array_contains("flagged_by", d)).cast("bigint").alias(d) for d in DETECTORS])


def totals(detections: DataFrame) -> DataFrame:
    """A-02 + A-03: number of merged detections and the sum of |value|.

    Summed as decimals, so the result does not depend on the order of the rows."""
    return detections.agg(F.count(F.lit(1)).alias("n_detections"),
                          F.sum(F.abs("value").cast("decimal(38,6)")).cast("double").alias("magnitude"))


def filter_types(detections: DataFrame, types: list[str]) -> DataFrame:
    """A-07: detections flagged by any of ``types``."""
    return detections.where(F.arrays_overlap("flagged_by", F.array(*[F.lit(t) for t in types])))


def row_flags(flagged: DataFrame, detectors: tuple[Detector, ...] = DEFAULT_DETECTORS) -> DataFrame:
    """A-04: per cube row, whether it holds a detection of each type and of any.

    Works on :func:`~cubewash.operators.detect.flag_cells` output, so it is a
    narrow projection (no group-by over detections)."""
    flagged = flagged.withColumnRenamed(KEY, ROW_KEY)
    keep = [c for c in (ROW_ID, FILE_PATH, ROW_INDEX, ROW_KEY) if c in flagged.columns]
    return flagged.select(*keep, *[flagged_by(k).alias(d.name) for k, d in enumerate(detectors)],
                          (F.size(FLAGS) > 0).alias("any"))


def flagged_rows(flags: DataFrame, detected: str = "any") -> DataFrame:
    """A-05: rows with at least one detection of ``detected`` (or ``any``).

    The row filter runs as a generator (each row yields itself when flagged): a plain
    ``where`` would be pushed below the projection and compute the flags a second time."""
    if detected not in (*DETECTORS, "any"):
        raise CubeError(f"Unknown detector type '{detected}'.")
    keep = F.explode(F.array_repeat(F.lit(True), F.col(detected).cast("int")))
    return flags.select("*", keep.alias("__keep")).drop("__keep")


def page(rows: DataFrame, after: tuple[str, int] | None = None, limit: int = 100) -> DataFrame:
    """A-06 keyset paging: the next ``limit`` rows after the place ``after``
    (file path, index in the file) in file order.

    The filter prunes by the place before the per-partition top-k, so a page
    never sorts the whole table."""
    if after is not None:
        path, index = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col(FILE_PATH) > path)
                          | ((F.col(FILE_PATH) == path) & (F.col(ROW_INDEX) > index)))
    return rows.orderBy(FILE_PATH, ROW_INDEX).limit(limit)


#: Bins of a pass of :func:`radix_cut`; so many counts come to the driver.
RADIX = 4096


def radix_cut(sizes: DataFrame, k: int, radix: int = RADIX) -> tuple[float, int] | None:
    """(value, rows above it) of the k-th largest ``size`` of non-negative doubles; None if there are fewer.

    The first pass counts rows by binary exponent, each further one divides what is left,
    from its smallest to its largest value, into ``radix`` bins. A binade holds 2**52 values,
    so at the default there are six passes at most, whatever the data; each is one aggregate
    with map-side partial counts."""
    size, above = F.col("size"), 0
    infinite = size == float("inf")
    label = F.when(infinite, 5000).when(size > 0, F.floor(F.log2(size)).cast("int")).otherwise(-5000)
    left = sizes
    while True:
        bins = left.groupBy(label.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")).collect()
        for b in sorted(bins, key=lambda r: -r["bin"]):
            if above + b["n"] >= k:
                break
            above += b["n"]
        else:
            return None
        if b["lo"] == b["hi"]:
            return b["lo"], above
        lo, hi = F.lit(b["lo"]), F.lit(b["hi"])
        left = sizes.where((size >= lo) & (size <= hi))
        # halves first: the span of the largest doubles has no finite double
        share = (size / 2 - lo / 2) / (hi / 2 - lo / 2)
        label = F.least(F.floor(share * radix), F.lit(radix - 1)).cast("int")


def first_by(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``, found by counting range partitions; only the
    partition that holds the cut is sorted."""
    part = free_name(rows, "part")
    ranged = rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).checkpoint()
    before, cut = 0, None
    for r in ranged.groupBy(part).count().orderBy(part).collect():  # a row per shuffle partition
        if before + r["count"] >= n:
            cut = r[part]
            break
        before += r["count"]
    if cut is None:
        return ranged.drop(part)
    last = ranged.where(F.col(part) == cut).orderBy(*order).limit(n - before)
    return ranged.where(F.col(part) < cut).unionByName(last).drop(part)


def top_share(detections: DataFrame, divisor: int = 20, tie: list[str] | None = None,
              max_driver_rows: int = RADIX) -> DataFrame:
    """A-08: the ``max(1, n // divisor)`` detections with the largest |value|.

    Ties break on ``tie`` (default: the detection id). The value at the cut is found by
    counting (:func:`radix_cut`), on as many partitions as the detections have. All rows
    above it are kept, and of the rows at the cut the first by ``tie``, which are cut by
    range, so a value that many rows share does not meet in one task. ``max_driver_rows``
    is how many counts a pass may bring to the driver (two at least); fewer mean more passes."""
    tie = tie or ["detection_id"]
    ensure_checkpoint_dir(detections.sparkSession)
    detections = detections.checkpoint()  # the passes would detect again each time
    size = F.abs(F.col("value"))
    n = detections.count()
    k = max(1, n // divisor)
    cut = radix_cut(detections.select(size.alias("size")), k, max(2, max_driver_rows)) if n else None
    if cut is None:
        return detections.limit(0)
    value, above = cut
    at = first_by(detections.where(size == F.lit(value)), tie, k - above)
    return detections.where(size > F.lit(value)).unionByName(at)


def selections_by_detector(selections: DataFrame) -> DataFrame:
    """A-09: staged selections per credited detector (attribution, else first flag)."""
    target = F.coalesce(F.col("attribution"), F.element_at("flagged_by", 1))
    counts = selections.groupBy(target.alias("detector")).agg(F.count(F.lit(1)).alias("n"))
    return counts

"""Filter interaction audit: what each filter removes under every order of the filters.

Each text is judged once: a bit per filter that it fails. Documents of one part
are then no more than a weight per (bits, good, toxic), so counts are summed
map-side and a part is a table of at most 2**filters * 4 weights. For it two
matrices are combined by minimum (a min-plus product): the mask matrix (0 where
a set of failures holds a filter, infinity elsewhere) and the position matrix
(the inverse permutation of each order). Entry (failures, order) of the product
is the step at which such documents go. Weighted scatter counts over these steps
give kept, removed and lost; a filter's redundant documents fail it at a later
step than they went.

Filter E (identical to the text of a smaller doc_id) compares 128-bit digests.
Rows of one digest are reduced to weights and their smallest doc_id map-side
before anything is joined, so a text that a third of the rows share is a few rows.

Edge cases: a null text is empty. A null lang is the part of the empty string.
A null doc_id has no smaller and is no one's smaller: such a row never fails E.
Rows that repeat a doc_id are rows of their own, and not smaller than each other.
A doc_id with several label rows is good or toxic if any of them says so. Other
columns are not read. Very long texts are judged whole. An empty table has no
parts and so no rows; parts of few documents have all their rows, zeros included.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubewash.llm.common import checkpoint, text_bytes

FILTERS = "ABCDE"
#: The filter that depends on other rows, not on the text alone.
COPY = FILTERS.index("E")
_MARKS = regex.compile(rb"[#$%&*|]")
_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
           "unique_fails long, good_lost long, toxic_lost long, shapley long")


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails; words are runs of other bytes than white space."""
    words = text.split()
    points = len(text) - len(text.translate(None, _BEGINS))  # code points
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * points,
             _MARKS.search(text) is not None)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


_CAPITALS = bytes(range(65, 91))
#: Bytes that begin a code point in UTF-8 (deleting them leaves the others).
_BEGINS = bytes(b for b in range(256) if not 128 <= b < 192)


def judge_column(text: Column) -> Column:
    """struct<fails, digest>: bits of A to D, and 128 bits of the text (null: empty)."""

    @F.arrow_udf("fails int, digest binary")
    def judge(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        fails, digests = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            raw = data[a:b].tobytes()
            fails.append(text_failures(raw))
            digests.append(xxhash.xxh3_128_digest(raw))
        return pa.StructArray.from_arrays([pa.array(fails, pa.int32()), pa.array(digests, pa.binary())],
                                          names=["fails", "digest"])

    return judge(text)


def failure_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, weight): how many documents of a part fail which set of filters."""
    marks = checkpoint(labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    judged = docs.select(F.col("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                         judge_column(F.col("text")).alias("j")).select("doc_id", "part", "j.*")
    rows = judged.join(marks, "doc_id", "left").select(
        "doc_id", "part", "fails", "digest", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # per digest at most a row for each part and label; ``first``: rows at the smallest doc_id of that row
    alike = checkpoint(rows.groupBy("digest", "fails", "part", "good", "toxic", "doc_id").agg(
        F.count(F.lit(1)).alias("n")).groupBy("digest", "fails", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed")))
    least = alike.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    joined = alike.join(least, "digest")
    spared = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    cases = F.array(F.struct(F.col("fails").alias("fails"), spared.alias("w")),
                    F.struct((F.col("fails") + (1 << COPY)).alias("fails"), (F.col("n") - spared).alias("w")))
    return (joined.select("part", "good", "toxic", F.explode(cases).alias("c")).where("c.w > 0")
            .groupBy("part", F.col("c.fails").alias("fails"), "good", "toxic")
            .agg(F.sum("c.w").cast("long").alias("weight")))


def removal_steps(fails: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """[set of failures, order] -> step at which it goes, from 1; filters + 1 if never.

    The min-plus product of the mask matrix and the position matrix.
    """
    n = orders.shape[1]
    position = np.argsort(orders, axis=1) + 1  # inverse permutations: the step of each filter
    mask = np.where(fails[:, None] >> np.arange(n) & 1, 0, n + 1)
    return np.minimum((mask[:, None, :] + position[None, :, :]).min(axis=2), n + 1)


def _audit_part(table: pa.Table) -> pa.Table:
    """All orders and steps of one part, from its weights (at most 2**filters * 4 rows)."""
    part = table["part"][0].as_py()
    fails = table["fails"].to_numpy()
    weight = table["weight"].to_numpy()
    good, toxic = (weight * table[c].to_numpy(zero_copy_only=False) for c in ("good", "toxic"))
    n = len(FILTERS)
    orders = np.array(list(itertools.permutations(range(n))))
    gone = removal_steps(fails, orders)
    rows = np.arange(len(orders))[None, :]

    def scattered(weights: np.ndarray) -> np.ndarray:
        """[order, step]: weight that goes at each step (the last: what stays)."""
        out = np.zeros((len(orders), n + 1), np.int64)
        np.add.at(out, (np.broadcast_to(rows, gone.shape), gone - 1), np.broadcast_to(weights[:, None], gone.shape))
        return out[:, :n]

    removed = scattered(weight)
    fails_at = (fails[:, None, None] >> orders[None, :, :]) & 1  # [case, order, step]: fails the step's filter
    redundant = np.einsum("cos,c->os", fails_at * (gone[:, :, None] < np.arange(1, n + 1)), weight)
    unique = np.array([weight[fails == 1 << f].sum() for f in range(n)])
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, orders, removed)
    columns = {
        "part": [part] * orders.size,
        "filter_order": np.repeat(["".join(FILTERS[f] for f in o) for o in orders], n),
        "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)),
        "kept": (weight.sum() - np.cumsum(removed, axis=1)).ravel(), "removed": removed.ravel(),
        "redundant": redundant.ravel(), "unique_fails": unique[orders].ravel(),
        "good_lost": scattered(good).ravel(), "toxic_lost": scattered(toxic).ravel(),
        "shapley": shapley[orders].ravel()}
    table = pa.table({k: pa.array(v) for k, v in columns.items()})
    return table.set_column(0, "part", pc.cast(table["part"], pa.string()))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: see the module's text for the counts."""
    weights = checkpoint(failure_weights(docs, labels))
    return weights.groupBy("part").applyInArrow(_audit_part, _SCHEMA)

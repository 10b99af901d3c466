"""Approximate nearest neighbours with multi-index hashing over learned binary codes.

Codes: the signs of ``ROTATIONS`` learned rotations of the centred vectors (each
alternates between rounding to signs and the orthogonal map that fits them best;
fitted on at most ``SAMPLE_ROWS`` vectors, those of the smallest hash). Every
vector is indexed. A code is cut into substrings of 16 bits, each with its own
bucket table. By the pigeonhole principle, a code within Hamming radius R of a
query agrees with it up to r = R // m bits in one of the first R % m + 1 of the
m substrings, or up to r - 1 bits in one of the rest; probing these buckets
retrieves every code within R. What is retrieved and within R is reranked by
the Euclidean distance of the original vectors in double precision.

R is measured, not set: a bounded set of queries is searched exactly, and R
covers ``COVER`` of their true neighbours, so it follows the data's size. A
query that finds fewer than k rows within R is searched again with R = all bits.

Index shards and query blocks have bounded sizes; a task holds one of each.
Equal vectors are one index entry with their k + 1 smallest ids, which is all
that k nearest rows can need, so a common vector costs no more than another.

Edge cases: vectors that are null, zero, hold null or non-finite components, or
have another length than most (the smallest such length in a tie) take no part, nor do rows
without vec_id. Repeated rows of one vec_id and vector are one candidate, and
rows under the query's own vec_id are none. Ties go to the smaller vec_id. Other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cubewash.llm.common import checkpoint

ROTATIONS = 4
ITERATIONS = 30
SAMPLE_ROWS = 20_000
TRIAL_QUERIES = 128
COVER = 0.985
SHARD_ROWS = 8_192
BLOCK_QUERIES = 512


@dataclass
class BinaryCodes:
    mean: np.ndarray
    planes: np.ndarray  # (dimensions, bits)

    @staticmethod
    def learn(sample: np.ndarray, seed: int = 5) -> BinaryCodes:
        rng = np.random.default_rng(seed)
        mean = sample.mean(axis=0)
        centred = sample - mean
        planes = []
        for _ in range(ROTATIONS):
            rotation = np.linalg.qr(rng.normal(size=(sample.shape[1],) * 2))[0]
            for _ in range(ITERATIONS):
                left, _, right = np.linalg.svd(centred.T @ np.sign(centred @ rotation))
                rotation = left @ right
            planes.append(rotation)
        planes = np.concatenate(planes, axis=1)
        spare = -planes.shape[1] % 16  # whole substrings: repeat some planes
        return BinaryCodes(mean, np.concatenate([planes, planes[:, :spare]], axis=1))

    @property
    def bits(self) -> int:
        return self.planes.shape[1]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """(n, bits / 16) uint16."""
        return np.packbits((vectors - self.mean) @ self.planes > 0, axis=1).view(np.uint16)


def _matrix(column) -> np.ndarray:
    """Vectors of one length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all codes of a to all of b."""
    out = np.zeros((len(a), len(b)), np.int32)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j][:, None] ^ b[:, j][None, :])
    return out


class MultiIndex:
    """Bucket tables of every substring of a shard's codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, first = np.unique(codes[order, j], return_index=True)
            self.tables.append((values, np.diff(np.append(first, len(order))), order))

    def probe(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """(queries, rows) marks: retrieved from some bucket that the pigeonhole principle names."""
        m = queries.shape[1]
        found = np.zeros((len(queries), len(self.codes)), bool)
        for j, (values, sizes, order) in enumerate(self.tables):
            reach = radius // m - (0 if j <= radius % m else 1)
            if reach >= 0:
                near = np.bitwise_count(queries[:, j][:, None] ^ values[None, :]) <= reach
                found[:, order] |= np.repeat(near, sizes, axis=1)
        return found


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
        & F.exists("embedding", lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (size["n"] if size else 0))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(embedding, ids): each vector once, with its k + 1 smallest ids."""
    # The rank limit is applied before the shuffle too, so a common vector sends k + 1 rows a task.
    first = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    return (rows.distinct().withColumn("place", first).where(F.col("place") <= k + 1)
            .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


@dataclass
class Index:
    codes: BinaryCodes
    entries: DataFrame  # rep (smallest id), ids, embedding, code
    rows: int


def build_index(vectors: DataFrame, k: int) -> Index | None:
    """Index of all usable vectors; None if there is none."""
    distinct = checkpoint(_distinct(usable(vectors), k))
    sample = (distinct.select("embedding", F.xxhash64(F.col("ids")[0]).alias("h")).orderBy("h")
              .limit(SAMPLE_ROWS).select("embedding").toArrow())
    if not sample.num_rows:
        return None
    model = BinaryCodes.learn(_matrix(sample["embedding"]))
    coded = distinct.select(F.col("ids")[0].alias("rep"), "ids", "embedding",
                            code_column(model, F.col("embedding")).alias("code"))
    entries = checkpoint(coded)
    return Index(model, entries, entries.count())


def code_column(model: BinaryCodes, vector: Column) -> Column:
    @F.arrow_udf("binary")
    def code(vectors: pa.Array) -> pa.Array:
        return pa.array([c.tobytes() for c in model.encode(_matrix(vectors))] if len(vectors) else [], pa.binary())

    return code(vector)


def _codes(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(len(column), -1)


def _nearest(q_ids, queries, rows, vectors, ids, marks, k, distances=None) -> pa.Table:
    """The k + 1 nearest marked rows of each query, ties to the smaller id."""
    out_q, out_d, out_row = [], [], []
    for i in range(len(q_ids)):
        at = np.flatnonzero(marks[i])
        if len(at):
            d = np.sqrt(((vectors[at] - queries[i]) ** 2).sum(axis=1))
            best = np.lexsort((rows[at], d))[:k + 1]
            out_q += [q_ids[i]] * len(best)
            out_d.append(d[best])
            out_row.append(at[best])
    take = np.concatenate([np.zeros(0, np.int64), *out_row])
    return pa.table({"q": pa.array(out_q, pa.int64()),
                     "d": pa.array(np.concatenate([np.zeros(0), *out_d])),
                     "ids": ids.take(pa.array(take)).cast(pa.list_(pa.int64()))})


def measured_radius(index: Index, queries: DataFrame, k: int) -> int:
    """The Hamming radius that holds COVER of the true neighbours of a bounded set of queries."""
    trial = (queries.orderBy(F.xxhash64("q")).limit(TRIAL_QUERIES).select("q", "embedding").toArrow())
    if not trial.num_rows:
        return index.codes.bits
    q, model = _matrix(trial["embedding"]), index.codes
    own, q_codes = trial["q"].to_numpy(), index.codes.encode(q)

    def scan(batches):
        for batch in batches:
            vectors, rep = _matrix(batch.column(1)), batch.column(0).to_numpy()
            codes = model.encode(vectors)
            bits = hamming(q_codes, codes)
            for i in range(len(q)):
                d = np.sqrt(((vectors - q[i]) ** 2).sum(axis=1))
                d[rep == own[i]] = np.inf
                best = np.argsort(d, kind="stable")[:k]
                best = best[np.isfinite(d[best])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best), i)), pa.array(d[best]), pa.array(bits[i, best])],
                    names=["q", "d", "bits"])

    near = (index.entries.select("rep", "embedding").mapInArrow(scan, "q long, d double, bits int")
            .withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("d")))
            .where(F.col("place") <= k).select("bits").toArrow()["bits"].to_numpy())
    return int(np.quantile(near, COVER, method="higher")) if len(near) else model.bits


def _search_tiles(index: Index, queries: DataFrame, n_queries: int, radius: int, k: int) -> DataFrame:
    """(q, d, ids): per tile of a shard and a block of queries, the nearest entries within ``radius``."""
    shards = max(1, -(-index.rows // SHARD_ROWS))
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    entries = index.entries.select(
        F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "rep", "ids", "embedding", "code")
    asked = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), "q", "embedding", "code")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "d": pa.array([], pa.float64()),
                             "ids": pa.array([], pa.list_(pa.int64()))})
        rep, ids = left["rep"].to_numpy(), left["ids"].combine_chunks()
        codes, q_codes = _codes(left["code"]), _codes(right["code"])
        marks = MultiIndex(codes).probe(q_codes, radius)
        for i in range(len(marks)):  # full distance only of what was retrieved
            at = np.flatnonzero(marks[i])
            marks[i, at] = np.bitwise_count(codes[at] ^ q_codes[i]).sum(axis=1) <= radius
        return _nearest(right["q"].to_numpy(), _matrix(right["embedding"]), rep, _matrix(left["embedding"]),
                        ids, marks, k)

    return (entries.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
            .applyInArrow(tile, "q long, d double, ids array<long>"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, d, place): the k + 1 nearest ids of each query vector."""
    order = W.partitionBy("q").orderBy("d", "vec_id")
    return (found.select("q", "d", F.explode("ids").alias("vec_id"))
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1))


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of every row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    index = build_index(vectors, k)
    if index is None:
        return spark.createDataFrame([], schema)
    # Queries with one vector are searched once, under the vector's smallest id.
    rep_of = index.entries.select(F.col("rep").alias("q"), "embedding", "code")
    wanted = checkpoint(usable(vectors).where(is_query).distinct().join(rep_of, "embedding")
                        .select(F.col("vec_id").alias("query_id"), "q"))
    queries = checkpoint(rep_of.join(wanted.select("q").distinct(), "q", "left_semi"))
    n_queries = queries.count()
    radius = measured_radius(index, queries, k)
    first = checkpoint(_best(_search_tiles(index, queries, n_queries, radius, k), k))
    # Every query must find k rows, or all there are: the rest is searched over all bits.
    enough = first.groupBy("q").count().where(F.col("count") > k).select("q")
    short = checkpoint(queries.join(enough, "q", "left_anti"))
    n_short = short.count()
    if n_short:
        again = _best(_search_tiles(index, short, n_short, index.codes.bits, k), k)
        first = first.join(enough, "q", "left_semi").unionByName(again)
    order = W.partitionBy("query_id").orderBy("place")
    return (wanted.join(first, "q").where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.col("d").alias("score")))

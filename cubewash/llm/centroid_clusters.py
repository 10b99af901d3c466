"""Centroid clustering in exact integers, as JVM-native expressions.

Components become integers floor(scale * x). A vector's squared distance to a
centroid is ``zip_with`` (squared differences to a literal array) folded by
``aggregate``; ``array_min`` of the structs (distance, number) chooses the
cluster, so ties go to the smaller number. An update is one aggregate with a
sum per component, each a plain column, so it runs in generated code with
map-side partial sums; a round brings one row per cluster to the driver, whatever
the number of vectors. No Python runs on the executors.

Integers are longs: components up to 2**27 in size (x up to 2**17 at the default
scale) are exact, larger ones end in Spark's overflow error rather than in a wrong sum.

Edge cases: vectors that are null, of another length, or with a null or
non-finite component take no part and are not returned. Fewer usable vectors than
clusters give that many clusters; none give an empty result. A null vec_id counts
as the text 'null' where centroids are chosen; equal hashes (repeated vec_ids) are
ordered by the vector. Repeated rows are rows of their own. Equal centroids share no
vector: the smaller number takes all. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubewash.llm.common import Staging

DIM = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3


def usable(embedding: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, none null or non-finite."""
    def finite(x: Column) -> Column:
        d = x.cast("double")
        return x.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))

    return F.coalesce((F.size(embedding) == dim) & F.forall(embedding, finite), F.lit(False))


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the usable vectors of ``vectors`` (vec_id, embedding) in integers."""
    return vectors.where(usable(F.col("embedding"), dim)).select(
        "vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def first_centroids(points: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors of the smallest sha256 of ``seed:vec_id``, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = points.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(clusters)
    return [r["x"] for r in rows.collect()]  # at most ``clusters`` rows


def squared_distance(x: Column, centroid: list[int]) -> Column:
    literal = F.expr(f"array({', '.join(f'{c}L' for c in centroid)})")
    return F.aggregate(F.zip_with(x, literal, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"),
                       lambda acc, d: acc + d)


def nearest(x: Column, centroids: list[list[int]]) -> Column:
    """struct<distance, cluster> of the nearest centroid; ties go to the smaller number."""
    return F.array_min(F.array(*[F.struct(squared_distance(x, c).alias("distance"), F.lit(k).alias("cluster"))
                                 for k, c in enumerate(centroids)]))


def updated(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floor of each component's mean over the vectors of a cluster; an empty cluster keeps its centroid."""
    dim = len(centroids[0])
    assigned = points.select(nearest(F.col("x"), centroids)["cluster"].alias("cluster"),
                             *[F.col("x")[i].alias(f"x{i}") for i in range(dim)])
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"),
                                           *[F.sum(f"x{i}").alias(f"x{i}") for i in range(dim)])
    out = list(centroids)
    for row in sums.collect():  # one row per cluster
        out[row["cluster"]] = [row[f"x{i}"] // row["n"] for i in range(dim)]
    return out


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def fit(points: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Final centroids of integer vectors (vec_id, x), which are read once per round."""
    centroids = first_centroids(points, clusters, seed)
    for _ in range(rounds if centroids else 0):
        new = updated(points, centroids)
        if new == centroids:  # assignments cannot change any more
            break
        centroids = new
    return centroids


def cluster_vectors(vectors: DataFrame, dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS,
                    scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector."""
    points = Staging(vectors.sparkSession, "centroid_clusters").write(integer_vectors(vectors, dim, scale))
    centroids = fit(points, clusters, rounds, seed)
    if not centroids:
        return points.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"),
            ("centroid_sha256", "string"))])
    found = points.select("vec_id", nearest(F.col("x"), centroids).alias("n")).select(
        "vec_id", F.col("n.cluster").alias("cluster"), F.col("n.distance").alias("distance"))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of_cluster = F.array(*[F.lit(inertia.get(k, 0)).cast("long") for k in range(len(centroids))])
    shas = F.array(*[F.lit(digest(c)) for c in centroids])
    at = F.col("cluster") + 1
    return found.select(
        "vec_id", "cluster", "distance", F.element_at(of_cluster, at).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.element_at(shas, at).alias("centroid_sha256"))

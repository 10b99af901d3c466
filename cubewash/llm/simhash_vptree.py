"""SimHash near-duplicates, linked with a vantage-point tree over shards.

Every whole text gets a 64-bit SimHash of its word shingles. Rows of one
fingerprint are one class; only distinct fingerprints are searched. The tree
splits the fingerprints at a vantage point v and radius m: the inner branch
takes distances up to m, the outer branch those above m. By the triangle
inequality a link of radius r can cross only from the ring m-r < d <= m, so the
outer branch also takes this ring and every pair within r meets in some leaf.
Leaves are Spark groups ("shards"); inside, the same split goes on in memory
down to small blocks that are compared bit by bit. A shard returns a spanning
forest of its links, not the links, so large groups of near copies stay linear.
Every level of the tree copies its ring once more, so shards hold a fixed share of
the fingerprints, one of ``SHARDS``: the tree has the same depth whatever their number,
and rows are dealt out in proportion to the input. Only past ``SHARD_ROWS`` a shard
it grows deeper. Rows are dealt out once; shards that came out twice too large are
split again.

The forests of all shards are joined into components by alternating min-label
rounds on Spark, checkpointed each round.

Edge cases: null and empty texts, or texts of white space alone, have
fingerprint zero and are linked like any other; a null doc_id never becomes a
component's id unless all its rows have none; rows that repeat a doc_id are
rows of their own (each is returned). Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubewash.llm.common import LOWER, checkpoint, fresh_name

SEED = 42
#: A shard holds one of so many parts of the fingerprints; with the overlap there are more shards.
SHARDS = 16
#: Least and most fingerprints that make a shard (8 bytes each).
LEAST_ROWS, SHARD_ROWS = 1_000, 500_000
#: Fingerprints sampled for a round of splits.
SAMPLE_ROWS = 60_000
LEAF = 256  # fingerprints compared pair by pair


def simhash(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the shingles of lower-cased words, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in
                          zip(starts[:n].tolist(), (ends[shingle - 1:] - 1).tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at:at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def simhash_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint's 64 bits as a long."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts), np.uint64)
        for i, t in enumerate(texts):
            t = t.as_py()
            out[i] = simhash(t.encode(), shingle) if t else 0
        return pa.array(out.view(np.int64))

    return fingerprint(text)


def hex_column(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _split(points: np.ndarray, radius: int, rng: np.random.Generator):
    """(vantage, m) of the least overlap among a few tries; None if no split makes both sides smaller."""
    best = None
    for vantage in rng.choice(points, min(6, len(points)), replace=False):
        d = _distance(points, vantage)
        counts = np.bincount(d, minlength=65)
        inner = np.cumsum(counts)
        for m in np.unique(np.quantile(d, (0.4, 0.5, 0.6)).astype(int)):
            low = int(inner[m])
            high = len(points) - (int(inner[m - radius]) if m >= radius else 0)
            worst = max(low, high)
            if worst < 0.9 * len(points) and (best is None or low + high < best[0]):
                best = (low + high, vantage, int(m))
    return best and best[1:]


@dataclass
class VpTree:
    """Nodes by number: a leaf has inner = -1 and its shard; others a vantage point and two children."""

    vantage: list[int]
    m: list[int]
    inner: list[int]
    outer: list[int]
    radius: int

    @staticmethod
    def leaf(radius: int) -> VpTree:
        return VpTree([0], [0], [-1], [-1], radius)

    def grow(self, node: int, sample: np.ndarray, rows: float, shard_rows: int, rng) -> None:
        """Split a leaf as long as the ``rows`` that its sample stands for are too many."""
        if rows <= shard_rows or len(sample) < 32:
            return
        found = _split(sample, self.radius, rng)
        if found is None:
            return
        vantage, m = found
        d = _distance(sample, vantage)
        children = (sample[d <= m], sample[d > m - self.radius])
        ids = []
        for _ in children:
            ids.append(len(self.vantage))
            for column, value in ((self.vantage, 0), (self.m, 0), (self.inner, -1), (self.outer, -1)):
                column.append(value)
        self.vantage[node], self.m[node] = int(vantage), m
        self.inner[node], self.outer[node] = ids
        for child, part in zip(ids, children):
            self.grow(child, part, rows * len(part) / len(sample), shard_rows, rng)

    def route(self, points: np.ndarray, node: int = 0):
        """(leaf, the points that it holds) for all leaves that hold any."""
        stack = [(node, points)]
        while stack:
            node, part = stack.pop()
            if not len(part):
                continue
            if self.inner[node] < 0:
                yield node, part
                continue
            d = _distance(part, np.uint64(self.vantage[node]))
            stack.append((self.inner[node], part[d <= self.m[node]]))
            stack.append((self.outer[node], part[d > self.m[node] - self.radius]))


class _Union:
    """Union by smallest member over the points that have links."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _link_block(points: np.ndarray, radius: int, union: _Union) -> None:
    """Compare a block with itself; join each row with its first neighbour and neighbours' labels."""
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    linked = np.flatnonzero(near.sum(axis=1) > 1)
    if not len(linked):
        return
    near = near[np.ix_(linked, linked)]
    label = np.arange(len(linked))
    while True:  # min label over neighbours until nothing changes
        new = np.where(near, label[None, :], len(linked)).min(axis=1)
        if (new == label).all():
            break
        label = new
    values = points[linked].tolist()
    for i, root in enumerate(label.tolist()):
        union.join(values[i], values[root])


def _link_cross(a: np.ndarray, b: np.ndarray, radius: int, union: _Union) -> None:
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        for j in np.flatnonzero(near[i]).tolist():
            union.join(int(a[i]), int(b[j]))


def link_points(points: np.ndarray, radius: int, union: _Union, rng) -> None:
    """Join all pairs within ``radius`` of distinct fingerprints, by the same tree in memory."""
    stack = [points]
    while stack:
        part = stack.pop()
        if len(part) <= LEAF:
            _link_block(part, radius, union)
            continue
        picks = part if len(part) <= 2048 else rng.choice(part, 2048, replace=False)
        found = _split(picks, radius, rng)
        if found is not None:
            d = _distance(part, found[0])
            inner, outer = part[d <= found[1]], part[d > found[1] - radius]
        if found is None or max(len(inner), len(outer)) >= len(part):
            # too close together for any ball to divide: compare in blocks
            blocks = [part[i:i + LEAF] for i in range(0, len(part), LEAF)]
            for i, a in enumerate(blocks):
                _link_block(a, radius, union)
                for b in blocks[i + 1:]:
                    _link_cross(a, b, radius, union)
            continue
        stack += [inner, outer]


def _route(members: DataFrame, tree: VpTree) -> DataFrame:
    """(shard, fp): every fingerprint with each leaf below its shard that must hold it."""
    shared = members.sparkSession.sparkContext.broadcast(tree)  # some nodes a shard

    def route(batches):
        for batch in batches:
            at, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for node in np.unique(at).tolist():
                for shard, part in shared.value.route(fp[at == node], node):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), shard, np.int32)), pa.array(part.view(np.int64))],
                        names=["shard", "fp"])

    return members.select("shard", "fp").mapInArrow(route, "shard int, fp long")


def shards(points: DataFrame, rows: int, radius: int, shard_rows: int | None = None) -> DataFrame:
    """(shard, fp): every fingerprint with each shard that must hold it.

    A round samples up to SAMPLE_ROWS fingerprints (those of the smallest hash) of the
    shards that are too large, grows the tree there and deals out their rows. It ends
    when no shard holds over twice ``shard_rows`` or a split no longer helps.
    """
    shard_rows = shard_rows or min(SHARD_ROWS, max(LEAST_ROWS, rows // SHARDS))
    tree, rng = VpTree.leaf(radius), np.random.default_rng(11)
    members = points.select(F.lit(0).alias("shard"), "fp")
    large, stuck = ({0: rows} if rows > shard_rows else {}), set()
    while large:
        every = max(1, sum(large.values()) // SAMPLE_ROWS)
        sample = members.where(F.col("shard").isin(*large) & (
            F.pmod(F.xxhash64("fp", F.lit(len(tree.vantage))), F.lit(every)) == 0)).toArrow()
        shard, fp = sample["shard"].to_numpy(), sample["fp"].to_numpy().view(np.uint64)
        grown = []
        for s, n in large.items():
            before = len(tree.vantage)
            tree.grow(s, fp[shard == s], n, shard_rows, rng)
            (grown.append if len(tree.vantage) > before else stuck.add)(s)
        if grown:
            again = F.col("shard").isin(*grown)
            members = checkpoint(members.where(~again).unionByName(_route(members.where(again), tree)))
        counts = members.groupBy("shard").count().where(F.col("count") > 2 * shard_rows).collect()
        large = {r["shard"]: r["count"] for r in counts if r["shard"] not in stuck}
    return members


def _shard_forest(radius: int):
    def spanning(table: pa.Table) -> pa.Table:
        union = _Union()
        link_points(np.unique(table["fp"].to_numpy()).view(np.uint64), radius, union,
                    np.random.default_rng(3))
        a = np.fromiter(union.parent, np.uint64, len(union.parent))
        b = np.fromiter(map(union.find, list(union.parent)), np.uint64, len(union.parent))
        apart = a != b
        return pa.table({"a": pa.array(a[apart].view(np.int64)), "b": pa.array(b[apart].view(np.int64))})

    return spanning


def forest(points: DataFrame, radius: int, shard_rows: int | None = None) -> DataFrame:
    """(a, b): links that span the components of each shard, a <> b."""
    return (shards(points, points.count(), radius, shard_rows).groupBy("shard")
            .applyInArrow(_shard_forest(radius), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for all nodes that have a link.

    Rounds of large-star and small-star: every edge moves to the smallest
    neighbour known, until the edges are stars. Edges are joined back to minima
    that were aggregated first, so a hub's edges are never gathered.
    """
    def star(edges: DataFrame) -> DataFrame:
        """edges (u, v): v moves to the smallest of u and its neighbours."""
        least = edges.groupBy("u").agg(F.min("v").alias("w")).select(
            "u", F.least("u", "w").alias("w"))
        return edges.join(least, "u")

    def mark(edges: DataFrame):
        return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    # edges from the larger to the smaller end
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .where("u <> v").distinct())
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        large = large.where("u <> v").distinct()
        small = star(large)
        small = (small.select(F.col("v").alias("u"), F.col("w").alias("v"))
                 .union(small.select("u", F.col("w").alias("v")))
                 .where("u <> v").distinct())
        edges = checkpoint(small)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def link_fingerprints(rows: DataFrame, radius: int = 2) -> DataFrame:
    """``rows`` (doc_id, fp, any more) with root (a fingerprint) and component_id (smallest doc_id)."""
    by_fp = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(forest(by_fp, radius))
    classes = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = checkpoint(classes.join(smallest, "root").select("fp", "root", "component_id"))
    return rows.join(known, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    rows = checkpoint(docs.select("doc_id", simhash_column(F.col("text"), shingle).alias("fp")))
    return link_fingerprints(rows, radius).select(
        "doc_id", hex_column(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each component.

    The row of the smallest doc_id stays (null last), then of the smallest hash
    of its text; of rows equal in both, one.
    """
    th = fresh_name(docs, "text_hash")
    rows = checkpoint(docs.select("doc_id", F.xxhash64("text").alias("th"),
                                  simhash_column(F.col("text"), shingle).alias("fp")))
    kept = (link_fingerprints(rows, radius).groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
            .select(F.col("k.doc_id").alias("kept_id"), F.col("k.th").alias("kept_th")))
    marked = docs.withColumn(th, F.xxhash64("text"))
    return (marked.join(kept, marked["doc_id"].eqNullSafe(kept["kept_id"])
                        & (marked[th] == kept["kept_th"]), "left_semi")
            .dropDuplicates(["doc_id", th]).drop(th))

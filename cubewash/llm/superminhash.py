"""MinHash near-duplicates with SuperMinHash signatures.

A document's set is its distinct word shingles. Each shingle walks a random
permutation of the ``SIZE`` signature places (a Fisher-Yates shuffle drawn from
its hash) and leaves rank + fraction at step ``rank``; a place keeps the
least value. As the ranks of one shingle are a permutation, places are
correlated negatively and estimates vary less than with independent minima. No
later step can change a signature whose places are all below the next rank, so
texts stop early: a long text after one or two steps. All shingles of a group of
texts walk a step together.

The signature is cut into ``BANDS`` bands of ``ROWS`` places. Texts of one set are
one node. Two nodes of Jaccard similarity 0.85 share no band with probability
(1 - 0.85**6)**36 = 4e-8 at most. Nodes of a shared band are verified on their
full sets, and the links are joined into components (union-find inside a task, star
contraction between tasks):

1. Every node of a bucket against the bucket's least node: pairs as many as
   entries, most of them the same pair in several bands. This settles buckets of
   two and draws most of a dense group together.
2. Buckets of three or more that still hold several components, ``SLICES`` of
   bands one after another: members meet in a task with their texts, and only
   members of different components are compared, until one component is left or
   no pair is. Buckets above ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles are
   dealt out as pairs of blocks, so that no task's work space grows with a bucket.

Nothing emits the pairs of a group: step 2 returns a spanning forest.

Edge cases: null and empty texts, or texts of white space alone, have no set:
n_shingles 0, linked with nothing. Fewer words than a shingle make one shingle of
them all. Rows that repeat a doc_id are rows of their own; a null doc_id becomes
a component's id only if all its rows have none. Very long texts are read whole. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubewash.llm.common import LOWER, RollingHash, Staging, doc_groups, mix, text_bytes
from cubewash.llm.simhash_vptree import components

SHINGLE = 3
#: Links need 100 * intersection >= LEAST * union.
LEAST = 85
BANDS, ROWS = 36, 6
SIZE = BANDS * ROWS
#: Bands whose open buckets are settled together.
SLICES = ((0, 6), (6, BANDS))
#: Members of a bucket, and shingles of their sets, that a task holds from either side.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000

_STEP = np.uint64(0xD1342543DE82EF95)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def shingle_set(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased words."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = np.frombuffer(b" ".join(words), np.uint8)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(RollingHash(line, 21).between(starts[:len(words) - size + 1], ends[size - 1:]))


def super_minhash(hashes: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Signatures [text, place] of the sets hashes[offsets[i]:offsets[i + 1]], none of them empty.

    A value holds the rank in its upper and the fraction in its lower 32 bits.
    """
    texts = len(offsets) - 1
    least = np.full(texts * size, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    h, place = hashes, None
    for rank in range(size):
        with np.errstate(over="ignore"):
            draw = mix(h ^ (np.uint64(rank + 1) * _STEP))
        pick = rank + ((draw & _LOW) * np.uint64(size - rank) >> _32).astype(np.int64)
        if rank == 0:
            at = pick
        else:
            every = np.arange(len(h))
            at = place[every, pick].astype(np.int64)
            place[every, pick] = place[:, rank]
        np.minimum.at(least, owner * size + at, (np.uint64(rank) << _32) | (draw >> _32))
        # no value of a later rank is below rank + 1
        open_text = least.reshape(texts, size).max(axis=1) >= np.uint64(rank + 1) << _32
        still = open_text[owner]
        if not still.any():
            break
        if rank == 0:
            h, owner, pick = h[still], owner[still], pick[still]
            place = np.tile(np.arange(size, dtype=np.uint16), (len(h), 1))
            place[np.arange(len(h)), pick] = 0
        elif 2 * still.sum() < len(h):
            h, owner, place = h[still], owner[still], place[still]
    return least.reshape(texts, size)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """[text, band] -> 64 bits of the band's number and places."""
    n, size = signatures.shape
    parts = signatures.reshape(n, bands, size // bands)
    key = mix(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy())
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            key = mix(key * _STEP + parts[:, :, i])
    return key.view(np.int64)


def _prints(shingle: int):
    """From (doc_id, tid, text): (doc_id, tid, n, node, bands); no set: a null node."""
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            # work space is 2 bytes a place and shingle
            for i, j in doc_groups(offsets, 1 << 19):
                sets = [shingle_set(data[a:b].tobytes(), shingle) for a, b in zip(
                    offsets[i:j].tolist(), offsets[i + 1:j + 1].tolist())]
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                nodes, keys = [None] * len(sets), np.zeros((0, BANDS), np.int64)
                if len(some):
                    ends = np.concatenate([[0], np.cumsum(sizes[some])])
                    keys = band_keys(super_minhash(np.concatenate([sets[k] for k in some]), ends))
                for k in some.tolist():
                    nodes[k] = xxhash.xxh3_128_digest(sets[k].tobytes())
                bounds = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[i:j], batch.column(1)[i:j], pa.array(sizes), pa.array(nodes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.ravel()))],
                    names=["doc_id", "tid", "n", "node", "bands"])
    return run


def similar(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether two sorted sets have 100 * intersection >= least * union."""
    if 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both)


def _verified(shingle: int, least: int):
    """From pairs (a, b, ta, tb) with their texts: the pairs that are links."""
    def run(batches):
        known: tuple = (None, None)  # pairs of one a come together
        for batch in batches:
            ids = [batch.column(i).to_numpy() for i in (0, 1)]
            raw = [text_bytes(batch.column(i)) for i in (2, 3)]
            of = lambda side, k: shingle_set(
                raw[side][0][raw[side][1][k]:raw[side][1][k + 1]].tobytes(), shingle)
            linked = np.zeros(batch.num_rows, bool)
            for k, a in enumerate(ids[0].tolist()):
                if known[0] != a:
                    known = (a, of(0, k))
                linked[k] = similar(known[1], of(1, k), least)
            yield pa.RecordBatch.from_arrays([pa.array(x[linked]) for x in ids], names=["a", "b"])
    return run


def _settle(table: pa.Table, shingle: int, least: int) -> pa.Table:
    """Spanning links of one bucket or pair of blocks between members of different components.

    Rows: id, root (the component so far), side (0: both, 1 and 2: compared across), text.
    """
    data, offsets = text_bytes(table["text"])
    sets = [shingle_set(data[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    sizes = np.array([len(s) for s in sets], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    _, label = np.unique(table["root"].to_numpy(), return_inverse=True)
    side, ids = table["side"].to_numpy(), table["id"].to_numpy()
    links, held = [], np.zeros(len(words), np.int8)
    for k in range(len(sets)):
        apart = (label != label[k]) & (side != 2 if side[k] == 2 else side != 1 if side[k] == 1 else True)
        apart[:k] = False  # a pair of earlier members has been compared
        apart &= 100 * np.minimum(sizes, sizes[k]) >= least * np.maximum(sizes, sizes[k])
        if not apart.any():
            continue
        held[flat[bounds[k]:bounds[k + 1]]] = 1
        both = np.add.reduceat(held[flat], bounds[:-1], dtype=np.int64)
        held[flat[bounds[k]:bounds[k + 1]]] = 0
        near = np.flatnonzero(apart & (100 * both >= least * (sizes + sizes[k] - both)))
        for other in near.tolist():
            if label[other] != label[k]:
                links.append((ids[k], ids[other]))
                label[label == label[other]] = label[k]
        if (label == label[0]).all():
            break
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _slice_links(entries: DataFrame, labels: DataFrame, texts: DataFrame, staging: Staging,
                 shingle: int, least: int) -> DataFrame:
    """Links inside the buckets of ``entries`` (key, id, n) that hold several components."""
    named = entries.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", "n", F.coalesce("root", "id").alias("root"))
    still = named.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"),
                                     F.min("root").alias("lo"), F.max("root").alias("hi"))
    still = staging.write(still.where("members > 2 AND lo < hi").select("key", "members", "shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    others = F.sequence(F.lit(0), blocks - 1)
    meets = F.transform(others, lambda k: F.struct(
        F.least(own, k).alias("i"), F.greatest(own, k).alias("j"),
        F.when(own == k, 0).when(own < k, 1).otherwise(2).alias("side")))
    dealt = (named.join(still, "key").select("key", "id", "root", F.explode(meets).alias("m"))
             .select("key", "id", "root", "m.*").join(texts, "id"))
    return dealt.select("key", "i", "j", "id", "root", "side", "text").groupBy("key", "i", "j").applyInArrow(
        lambda table: _settle(table, shingle, least), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    staging = Staging(docs.sparkSession, "superminhash")
    key_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.md5("text").alias("tid"), F.col("text").cast("string").alias("text"))
    prints = staging.write(texts.mapInArrow(
        _prints(shingle), f"doc_id {key_type}, tid string, n long, node binary, bands array<long>"))
    sets = staging.write(prints.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.min(F.struct("doc_id", "tid")).alias("from_row")).withColumn("id", F.monotonically_increasing_id()))

    entries = sets.select("id", "n", F.posexplode("bands").alias("band", "key"))
    # written first: a join of two plain shuffles can be split where a bucket is hot
    heads = staging.write(entries.groupBy("key").agg(
        F.min(F.struct("id", "n")).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    shared = staging.write(entries.join(heads, "key"))
    pairs = shared.where("id <> head.id").where(
        100 * F.least("n", "head.n") >= least * F.greatest("n", "head.n")).select(
        F.col("head.id").alias("a"), F.col("id").alias("b")).distinct()
    # the texts of the nodes that share a bucket, one for each node
    asked = sets.join(shared.select("id").distinct(), "id", "left_semi").select("id", "from_row.*")
    held = staging.write(texts.alias("t").join(
        asked.alias("q"), (F.col("t.tid") == F.col("q.tid")) & F.col("t.doc_id").eqNullSafe(F.col("q.doc_id")))
        .select("id", "text").dropDuplicates(["id"]))
    first, second = (held.select(F.col("id").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    links = staging.write(pairs.join(second, "b").join(first, "a").select("a", "b", "ta", "tb").mapInArrow(
        _verified(shingle, least), "a long, b long"))

    labels = components(links)
    open_entries = shared.where("members > 2").select("band", "key", "id", "n")
    for low, high in SLICES:
        more = staging.write(_slice_links(
            open_entries.where(F.col("band").between(low, high - 1)), labels, held, staging, shingle, least))
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)

    classes = sets.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "node", "least", F.coalesce("root", "id").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = staging.write(classes.join(smallest, "root").select("node", "component_id"))
    linked = prints.where("n > 0").join(known, "node").select("doc_id", "n", "component_id")
    alone = prints.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

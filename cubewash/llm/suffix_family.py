"""Repeated byte strings, found with a logarithmic family of suffix arrays.

A string of ``length`` bytes that starts in two places is found by suffixes it
holds. Of every ``WINDOW`` neighbouring suffixes of a text the one whose first
``GRAM`` bytes have the smallest hash is indexed (the choice depends on the
bytes alone, so both places choose alike); an indexed suffix stands for the
run of starts that chose it, and lies in each of their strings with its first
``length - WINDOW + 1`` bytes. These sampled suffix arrays (ordered by the
first 8 bytes, then by a hash of that prefix) form a logarithmic family: each
batch of documents gets an array, which is merge-scanned against every level
for equal prefixes; levels of one size are merged into one of twice the size.
Levels are tables bucketed and sorted by their order, so scans and merges read
them side by side without a shuffle.

Matched suffixes are then settled exactly, by 128-bit hashes of the bytes. A
run whose whole stretch occurs twice repeats at every start. The others are cut
into blocks of ``BLOCK`` starts at fixed distances from the suffix: a block
whose stretch occurs twice repeats at every start, one whose core (the bytes
that all its strings share) occurs once repeats at none, and only for what is
left each start's string is compared. No step gathers the rows of one key:
hashes are counted with map-side sums and joined back. Suspect texts are
written once, bucketed by row key, so these steps do not shuffle them again.

A byte is removed if a repeated string covers it. Strings never cross
documents; overlaps count; strings are judged on the input.

A :class:`SuffixFamily` takes further batches at any time: inserting one reads the
levels and the new batch only, never the texts of earlier ones.

Edge cases: null and empty texts, and texts shorter than ``length``, lose
nothing. Very long texts are read whole, one at a time. An empty table gives an empty
result. Rows are texts of their own: two rows of the same text repeat each
other, also under one doc_id or none. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewash.llm.common import RollingHash, Staging, checkpoint, doc_groups, shuffle_partitions, text_bytes

WINDOW = 256  # at most length // 2 is used for short lengths
GRAM = 16
BATCHES = 4
BLOCK = 16


def _window(length: int) -> tuple[int, int]:
    """(suffixes of which one is indexed, bytes of the hashed gram)."""
    window = min(WINDOW, length // 2 + 1)
    return window, min(GRAM, length - window + 1)


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:len(keys) - done], keys[done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[:len(keys) - rest], keys[rest:]) if rest else keys


def indexed_suffixes(data: np.ndarray, offsets: np.ndarray, length: int):
    """Arrays (document, suffix position, first start, last start), positions in ``data``."""
    window, gram = _window(length)
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < length:
        return none
    grams = RollingHash(data, 9).windows(gram)
    # 32 bits of hash, then the position: equal hashes give the leftmost
    keys = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_sliding_min(keys, window) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.arange(len(data) - length + 1)
    whole = doc[:len(starts)] == doc[length - 1:]  # the string ends in its own document
    starts = starts[whole]
    if not len(starts):
        return none
    chosen, doc = chosen[starts], doc[starts]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], chosen[first], starts[first], starts[last]


def _lead(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first 8 bytes of suffixes as signed longs in byte order (shifted so that signs sort)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lead = np.zeros(len(at), np.uint64)
    for j in range(8):
        lead = (lead << np.uint64(8)) | padded[at + j].astype(np.uint64)
    return (lead ^ np.uint64(1 << 63)).view(np.int64)


def _suffix_batches(length: int):
    """Rows (rid, doc_id, n_bytes, sha, suffixes): the distinct indexed suffixes of each text, counted."""
    prefix = length - _window(length)[0] + 1

    def run(batches):
        for batch in batches:
            all_data, all_offsets = text_bytes(batch.column(2))
            for i, j in doc_groups(all_offsets):
                data, offsets = all_data[all_offsets[i]:all_offsets[j]], all_offsets[i:j + 1] - all_offsets[i]
                doc, at, _, _ = indexed_suffixes(data, offsets, length)
                sig = RollingHash(data, 10).between(at, at + prefix).view(np.int64)
                lead = _lead(data, at)
                order = np.lexsort((sig, lead, doc))
                doc, lead, sig = doc[order], lead[order], sig[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (lead[1:] != lead[:-1]) | (sig[1:] != sig[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(doc)))
                bounds = np.searchsorted(doc[first], np.arange(j - i + 1))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[i:j], batch.column(1)[i:j], pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets, offsets[1:])],
                             pa.string()),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(
                        [pa.array(lead[first]), pa.array(sig[first]), pa.array(np.minimum(n, 2).astype(np.int32))],
                        names=["lead", "sig", "n"]))],
                    names=["rid", "doc_id", "n_bytes", "sha", "suffixes"])
    return run


class SuffixFamily:
    """Levels of sampled suffix arrays; level k stands for 2**k batches.

    A level is a table (lead, sig, n), bucketed and sorted by (lead, sig), with
    one row per distinct prefix and n = how often it was seen (2: or more).
    """

    def __init__(self, staging: Staging, buckets: int):
        self._staging, self._buckets = staging, buckets
        self.levels: dict[int, tuple[str, str]] = {}

    @property
    def spark(self) -> SparkSession:
        return self._staging.spark

    def _table(self, df: DataFrame) -> tuple[str, str]:
        return self._staging.write_bucketed(df, self._buckets, "lead", "sig")

    def insert(self, suffixes: DataFrame) -> DataFrame:
        """Add a batch (lead, sig, n); returns the (lead, sig) that it repeats within or from before."""
        # capped after each sum, so a frequent prefix stays a small number
        counted = (suffixes.groupBy("lead", "sig").agg(F.sum("n").alias("n"))
                   .select("lead", "sig", F.least("n", F.lit(2)).cast("int").alias("n")))
        batch = self._table(counted.repartition(self._buckets, "lead", "sig"))
        scan = self.spark.table(batch[0]).withColumnRenamed("n", "seen")
        for name, _ in self.levels.values():  # merge-scan: both sides lie in the same order
            level = self.spark.table(name)
            scan = (scan.join(level, ["lead", "sig"], "left")
                    .select("lead", "sig", (F.col("seen") + F.coalesce("n", F.lit(0))).alias("seen")))
        repeated = checkpoint(scan.where(F.col("seen") > 1).select("lead", "sig"))
        depth = 0
        while depth in self.levels:
            older = self.levels.pop(depth)
            a, b = (self.spark.table(x[0]).withColumnRenamed("n", n) for x, n in ((older, "x"), (batch, "y")))
            merged = a.join(b, ["lead", "sig"], "full").select(
                "lead", "sig", F.least(F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0)), F.lit(2)).alias("n"))
            into = self._table(merged)
            self._staging.drop(older)
            self._staging.drop(batch)
            batch, depth = into, depth + 1
        self.levels[depth] = batch
        return repeated

    def drop(self) -> None:
        for level in self.levels.values():
            self._staging.drop(level)
        self.levels = {}


def _stretches(length: int):
    """From (rid, text, sigs): each matched run with a 128-bit hash of its whole stretch."""
    prefix = length - _window(length)[0] + 1

    def run(batches):
        for batch in batches:
            rows, keys, parts = [], [], []
            data, offsets = text_bytes(batch.column(1))
            for row in range(batch.num_rows):
                text = data[offsets[row]:offsets[row + 1]]
                _, at, lo, hi = indexed_suffixes(text, np.array([0, len(text)]), length)
                sig = RollingHash(text, 10).between(at, at + prefix).view(np.int64)
                keep = np.isin(sig, batch.column(2)[row].values.to_numpy())
                part, raw = np.stack([sig, at, lo, hi])[:, keep], text.tobytes()
                rows += [row] * part.shape[1]
                parts.append(part)
                keys += [xxhash.xxh3_128_digest(raw[a:b + length]) for a, b in part[2:].T.tolist()]
            part = np.concatenate([np.zeros((4, 0), np.int64), *parts], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x) for x in part],
                 pa.array(keys, pa.binary())], names=["rid", "sig", "at", "lo", "hi", "key"])
    return run


def _blocks(length: int):
    """From (rid, text, runs): the blocks of each run with hashes of their stretch and core."""
    def run(batches):
        for batch in batches:
            rows, out, cores, fulls = [], [], [], []
            data, offsets = text_bytes(batch.column(1))
            for row in range(batch.num_rows):
                raw = data[offsets[row]:offsets[row + 1]].tobytes()
                for r in batch.column(2)[row].as_py():
                    at, lo, hi = r["at"], r["lo"], r["hi"]
                    for b in range((at - hi) // BLOCK, (at - lo) // BLOCK + 1):
                        # starts of the block lie b * BLOCK .. b * BLOCK + BLOCK - 1 bytes before the suffix
                        first, last = at - b * BLOCK - BLOCK + 1, at - b * BLOCK
                        tag = b.to_bytes(2, "big")
                        a, z = max(first, lo), min(last, hi)
                        rows.append(row)
                        out.append((a, z, r["weight"]))
                        cores.append(xxhash.xxh3_128_digest(tag + raw[last:first + length]))
                        fulls.append(xxhash.xxh3_128_digest(tag + bytes([a - first, last - z]) + raw[a:z + length]))
            lo, hi, weight = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
                 pa.array(weight, pa.int32()), pa.array(cores, pa.binary()), pa.array(fulls, pa.binary())],
                names=["rid", "lo", "hi", "weight", "core", "full"])
    return run


def _strings(length: int):
    """From (rid, text, blocks): the hash of the string at every start of the blocks asked for."""
    def run(batches):
        for batch in batches:
            rows, starts, weights, keys = [], [], [], []
            data, offsets = text_bytes(batch.column(1))
            for row in range(batch.num_rows):
                raw = data[offsets[row]:offsets[row + 1]].tobytes()
                for r in batch.column(2)[row].as_py():
                    for s in range(r["lo"], r["hi"] + 1):
                        rows.append(row)
                        starts.append(s)
                        weights.append(r["weight"])
                        keys.append(xxhash.xxh3_128_digest(raw[s:s + length]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),
                 pa.array(weights, pa.int32()), pa.array(keys, pa.binary())],
                names=["rid", "start", "weight", "key"])
    return run


def covered_spans(starts: list[tuple[int, int]], length: int, n_bytes: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes that strings at the given ranges of starts cover."""
    spans: list[list[int]] = []
    for lo, hi in sorted(starts):
        end = min(hi + length, n_bytes)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([lo, end])
    return [tuple(s) for s in spans]


def _removals(length: int, with_kept: bool):
    """From (rid, text, starts): spans removed and what is left."""
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            spans, shas, kepts = [], [], []
            for row in range(batch.num_rows):
                raw = data[offsets[row]:offsets[row + 1]].tobytes()
                own = covered_spans([(r["lo"], r["hi"]) for r in batch.column(2)[row].as_py()], length, len(raw))
                kept = b"".join(raw[a:b] for a, b in zip([0, *[e for _, e in own]], [*[s for s, _ in own], len(raw)]))
                spans.append([{"start": a, "end": b} for a, b in own])
                shas.append(hashlib.sha256(kept).hexdigest())
                kepts.append(kept if with_kept else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(shas, pa.string()), pa.array(kepts, pa.binary())],
                names=["rid", "spans", "kept_sha256", "kept"])
    return run


def _twice(rows: DataFrame, key: str, weight) -> DataFrame:
    """The keys that occur twice or more.

    Materialised, so that a join with them has a plain shuffle on either side and can be
    split where a very common stretch gives one key to a large part of the rows.
    """
    return checkpoint(rows.groupBy(key).agg(F.sum(weight).alias("n")).where("n > 1").select(key))


def remove_repeats(docs: DataFrame, length: int = 400, batches: int = BATCHES,
                   with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (removed, [start, end) in bytes), kept_sha256, kept of every row.

    ``kept`` (the remaining bytes) is null unless asked for, and for texts that lose nothing.
    """
    spark = docs.sparkSession
    staging, buckets = Staging(spark, "suffix_family"), shuffle_partitions(spark)
    key_type = docs.schema["doc_id"].dataType.simpleString()
    # rid: 128 bits of the row's doc_id and text; rows equal in both are told apart by their count alone
    rid = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"),
                                 F.coalesce(F.col("text"), F.lit("")))))
    texts = docs.select(rid.alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    indexed = staging.write(texts.mapInArrow(
        _suffix_batches(length), f"rid binary, doc_id {key_type}, n_bytes long, sha string, "
        "suffixes array<struct<lead: long, sig: long, n: int>>"))
    entries = indexed.select("rid", F.explode("suffixes").alias("s")).select("rid", "s.*")

    # The family takes the documents batch by batch and returns what each batch repeats.
    family = SuffixFamily(staging, buckets)
    matched = None
    for k in range(batches):
        found = family.insert(entries.where(F.pmod(F.hash("rid"), F.lit(batches)) == k)
                              .select("lead", "sig", "n"))
        matched = found if matched is None else matched.union(found)
    family.drop()

    # Only texts that hold a matched suffix go on; a suffix list is no longer than its text.
    held = (entries.join(matched.distinct(), ["lead", "sig"])
            .groupBy("rid").agg(F.collect_set("sig").alias("sigs")))
    suspects = staging.write_bucketed(texts.select("rid", "text").join(held, "rid").select(
        "rid", "text", "sigs"), buckets, "rid")
    suspect = spark.table(suspects[0])
    text_of = suspect.select("rid", "text")
    known = checkpoint(indexed.select("rid", "doc_id", "n_bytes", "sha"))

    runs = staging.write(suspect.mapInArrow(
        _stretches(length), "rid binary, sig long, at long, lo long, hi long, key binary"))
    stretches = checkpoint(runs.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("sig").alias("sig"),
        F.min(F.struct("rid", "at", "lo", "hi")).alias("where")))
    repeated = staging.write(runs.join(stretches.where("n > 1").select("key"), "key").select("rid", "lo", "hi"))

    # Suffixes with a stretch that occurs once: their stretches block by block. Weight 1 is open.
    open_sigs = stretches.where("n = 1").select("sig").distinct()
    asked = (stretches.join(open_sigs, "sig", "left_semi")
             .select("where.*", F.least("n", F.lit(2)).cast("int").alias("weight"))
             .groupBy("rid").agg(F.collect_list(F.struct("at", "lo", "hi", "weight")).alias("runs")))
    blocks = staging.write(text_of.join(asked, "rid").select("rid", "text", "runs").mapInArrow(
        _blocks(length), "rid binary, lo long, hi long, weight int, core binary, full binary"))
    shared = blocks.join(_twice(blocks, "core", "weight"), "core")
    settled = shared.join(_twice(blocks, "full", "weight").withColumn("whole", F.lit(True)), "full", "left")
    settled = checkpoint(settled.select("rid", "lo", "hi", "weight", "core", "whole"))
    repeated = repeated.union(settled.where("weight = 1 AND whole").select("rid", "lo", "hi"))

    # Blocks whose core repeats and whose stretch does not: start by start.
    open_cores = settled.where("weight = 1 AND whole IS NULL").select("core").distinct()
    singly = (settled.join(open_cores, "core", "left_semi").groupBy("rid")
              .agg(F.collect_list(F.struct("lo", "hi", "weight")).alias("blocks")))
    strings = checkpoint(text_of.join(singly, "rid").select("rid", "text", "blocks").mapInArrow(
        _strings(length), "rid binary, start long, weight int, key binary"))
    single = strings.where("weight = 1").join(_twice(strings, "key", "weight"), "key")
    repeated = repeated.union(staging.write(single.select("rid", F.col("start").alias("lo"), F.col("start").alias("hi"))))

    starts = repeated.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    cut = checkpoint(text_of.join(starts, "rid").select("rid", "text", "starts").mapInArrow(
        _removals(length, with_kept),
        "rid binary, spans array<struct<start: long, end: long>>, kept_sha256 string, kept binary")
        .dropDuplicates(["rid"]))
    staging.drop(suspects)
    staging.close()
    none = F.array().cast("array<struct<start: long, end: long>>")
    return known.join(cut, "rid", "left").select(
        "doc_id", "n_bytes", F.coalesce("spans", none).alias("spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")


def removal_digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return remove_repeats(docs, length).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256")

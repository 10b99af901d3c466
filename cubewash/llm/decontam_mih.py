"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

For every benchmark item, windows of the item's length (in words) slide over
each whole document. A window's SimHash is the sign of the summed shingle-hash
bits, from running sums over the text. Fingerprints are looked up in a
multi-index: the 64 bits are cut into BLOCKS blocks, and by the pigeonhole
principle a fingerprint within RADIUS of an item's agrees with it in some block
up to RADIUS // BLOCKS bits, so the tables of all blocks return every item
within the radius. Candidates are verified by the exact weighted-shingle
similarity, sum(min) / sum(max) over the shingle counts of window and item.

Windows without a shingle of an item of their length have similarity 0, so
fingerprints are only taken where one occurs; that skips nothing that could
pass. Words are lower-cased (A-Z), shingles are ``SHINGLE`` words (a shorter
item is one shingle, of its own length), and similarity is 0.8 or more.

The benchmark is held by every task, so it is cut into parts of at most
``PART_WORDS`` words and each part scans the documents once; a usual benchmark
is one part. The similarity is that of a sequence of whole words.

Edge cases: null and empty texts and items without words match nothing. Items
repeated under one or more ids are all reported. Documents that repeat a
doc_id are reported row by row. An empty benchmark leaves every document clean.
Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubewash.llm.common import LOWER, SPACES, RollingHash, doc_groups, fresh_name, mix, text_bytes

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 a bit differs with a chance of about 0.15; 24 of 64 is five deviations beyond.
RADIUS = 24
BLOCKS = 8  # of 8 bits: some block differs in at most RADIUS // BLOCKS bits
PART_WORDS = 200_000

_LOW = np.frombuffer(LOWER, np.uint8)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """(hash of each word, document of each word, words before each document)."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    data = _LOW[data]
    letter = ~_IS_SPACE[data]
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    starts[firsts] = letter[firsts]
    ends = letter.copy()  # the last byte of each word
    ends[:-1] &= ~letter[1:]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    ends[lasts] = letter[lasts]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    before = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    return RollingHash(data, 5).between(start, end), doc, before


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out = out * np.uint64(0x100000001B3) + words[j:j + n]
    return mix(out)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """(n, 64) of 1 and -1."""
    raw = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return raw.astype(np.int32) * 2 - 1


def _signs(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 sums."""
    return np.packbits(sums > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two bags of shingles."""
    least = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return least / (a.total() + b.total() - least)


@dataclass
class ItemClass:
    """Items of one word count: their shingles, fingerprints and block tables."""

    words: int
    shingle: int
    ids: list[list[int]]  # doc-visible ids of each distinct item
    bags: list[Counter]
    known: np.ndarray  # sorted hashes of all their shingles
    prints: np.ndarray
    tables: np.ndarray  # (BLOCKS, 256, items): the item is within reach of the block's value

    @staticmethod
    def of(words: int, texts: dict[bytes, list[int]]) -> ItemClass:
        shingle = min(SHINGLE, words)
        bags, prints = [], []
        for text in texts:
            data = np.frombuffer(text, np.uint8)
            hashes, _, _ = word_hashes(data, np.array([0, len(data)]))
            shingles = shingle_hashes(hashes, shingle)
            bags.append(Counter(shingles.tolist()))
            prints.append(_signs(_bits(shingles).sum(axis=0, keepdims=True))[0])
        prints = np.array(prints, np.uint64)
        values = np.arange(256, dtype=np.uint8)
        blocks = prints.astype(">u8").view(np.uint8).reshape(-1, BLOCKS)
        tables = np.stack([np.bitwise_count(values[:, None] ^ blocks[None, :, k]) <= RADIUS // BLOCKS
                           for k in range(BLOCKS)])
        known = np.unique(np.fromiter((s for bag in bags for s in bag), np.uint64))
        return ItemClass(words, shingle, list(texts.values()), bags, known, prints, tables)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS bits."""
        blocks = prints.astype(">u8").view(np.uint8).reshape(-1, BLOCKS)
        probed = self.tables[0, blocks[:, 0]]
        for k in range(1, BLOCKS):
            probed |= self.tables[k, blocks[:, k]]
        window, item = np.nonzero(probed)
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], item[near]

    def matches(self, shingles: np.ndarray, hits: np.ndarray) -> dict[int, float]:
        """Best similarity by item, for one document's shingles and where they are known."""
        best: dict[int, float] = {}
        n, span = len(shingles), self.words - self.shingle  # a window holds span + 1 shingles
        last = n - 1 - span  # of a window's first shingle
        if last < 0:
            return best
        at = np.flatnonzero(hits)
        # stretches of window starts that hold a known shingle, joined where they touch
        low, high = np.maximum(at - span, 0), np.minimum(at, last)
        new = np.concatenate([[True], low[1:] > high[:-1] + 1])
        for a, b in zip(low[new], np.append(high[np.flatnonzero(new)[1:] - 1], high[-1])):
            for s in range(a, b + 1, 8192):  # bounds the running sums
                e = min(s + 8191, b)
                part = shingles[s:e + span + 1]
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(part), axis=0, dtype=np.int32)])
                windows = sums[span + 1:] - sums[:len(part) - span]
                window, item = self.within(_signs(windows))
                self._verify(part, span, window, item, best)
        return best

    def _verify(self, part, span, window, item, best) -> None:
        bag: Counter = Counter()
        held = -1
        for w, i in zip(window.tolist(), item.tolist()):
            if w != held:
                bag = Counter(part[w:w + span + 1].tolist())
                held = w
            s = similarity(bag, self.bags[i])
            if s >= SIMILARITY and s > best.get(i, 0):
                best[i] = s


class BenchmarkIndex:
    """All item classes of one part of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        by_words: dict[int, dict[bytes, list[int]]] = {}
        for item_id, text in items:
            words = (text or "").encode().translate(LOWER).split()
            if words:
                by_words.setdefault(len(words), {}).setdefault(b" ".join(words), []).append(item_id)
        self.classes = [ItemClass.of(n, texts) for n, texts in sorted(by_words.items())]
        self.lengths = sorted({c.shingle for c in self.classes})
        self.known = {k: np.unique(np.concatenate([c.known for c in self.classes if c.shingle == k]))
                      for k in self.lengths}

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[list[int], float]]:
        """(item ids, best similarity) of each document."""
        out: list[tuple[list[int], float]] = []
        for i, j in doc_groups(offsets, 1 << 19):
            out += self._search(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        return out

    def _search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[list[int], float]]:
        words, doc, before = word_hashes(data, offsets)
        found: list[dict[int, float]] = [{} for _ in range(len(offsets) - 1)]
        for length in self.lengths:
            shingles = shingle_hashes(words, length)
            known = self.known[length]
            place = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            # a shingle over the end of a document is none
            hit = (known[place] == shingles) & (doc[:len(shingles)] == doc[length - 1:])
            for d in np.unique(doc[:len(shingles)][hit]):
                a, b = before[d], before[d + 1] - length + 1
                own = shingles[a:b]
                for c in self.classes:
                    if c.shingle == length:
                        hits = np.isin(own, c.known)
                        if hits.any():
                            for item, s in c.matches(own, hits).items():
                                for item_id in c.ids[item]:
                                    found[d][item_id] = max(s, found[d].get(item_id, 0))
        return [(sorted(f), max(f.values(), default=0.0)) for f in found]


def benchmark_parts(benchmark: DataFrame, part_words: int = PART_WORDS) -> list[list[tuple[int, str]]]:
    """The items, in parts of bounded size, read one item at a time."""
    parts, size = [[]], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        words = len((r["text"] or "").split())
        if parts[-1] and size + words > part_words:
            parts.append([])
            size = 0
        parts[-1].append((r["item_id"], r["text"]))
        size += words
    return parts


def match_column(spark, items: list[tuple[int, str]], text: Column) -> Column:
    """struct<item_ids, similarity> of each whole text against one part of the benchmark."""
    shared = spark.sparkContext.broadcast(BenchmarkIndex(items))  # bounded by PART_WORDS

    @F.arrow_udf("item_ids array<long>, similarity double")
    def match(texts: pa.Array) -> pa.Array:
        found = shared.value.search(*text_bytes(texts))
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.list_(pa.int64())),
             pa.array([f[1] for f in found], pa.float64())], names=["item_ids", "similarity"])

    return match(text)


def _with_matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of its matches over all parts."""
    spark, name = docs.sparkSession, fresh_name(docs, "matches")
    parts = [match_column(spark, p, F.col("text")) for p in benchmark_parts(benchmark)]
    return docs.withColumn(name, F.array(*parts)), name


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), similarity (largest; 0 if none) of every row."""
    marked, name = _with_matches(docs.select("doc_id", "text"), benchmark)
    return (marked.select("doc_id", F.array_sort(F.flatten(F.col(f"{name}.item_ids"))).alias("item_ids"),
                          F.array_max(F.col(f"{name}.similarity")).alias("similarity"))
            .select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window like a benchmark item."""
    marked, name = _with_matches(docs, benchmark)
    return marked.where(F.size(F.flatten(F.col(f"{name}.item_ids"))) == 0).drop(name)

"""LM scoring with a probabilistic suffix tree over words.

Tokens are the lower-cased (A-Z) words of a whole text and one end token. The
tree's root is the unigram distribution of all training tokens, smoothed by
0.5. A node is a context: the last 1 to ``DEPTH`` tokens. Every context that
occurs ``CONTEXT_COUNT`` times is a candidate and every next token that follows it
``LEAST_COUNT`` times is tested: absolute counts, so the tree grows with the
corpus. A next token is listed if the Poisson deviance of its count from what the
suffix state predicts is ``TOKEN_DEVIANCE`` or more; a context stays in the tree
if the deviances of its listed tokens reach ``CONTEXT_DEVIANCE`` together. A listed
token's probability is its count smoothed towards the suffix state; all others
share what is left in proportion to the suffix state, so every state's
distribution sums to 1.

A text's score is the sum of log10 P(token | longest suffix state in the tree).
As every state scales its suffix state or lists a token instead, log10 P is the
root's value plus terms that belong to one n-gram each: ``scale`` of every context
before the token, and for a listed token the difference to its scaled suffix. So
the tree is a table (key of n-gram, weight), and a score is the unigram score
plus the weights of all n-grams of the text, repeats included.

On Spark: a level is a table (g, sfx, n, cum): key of an n-gram, of its suffix,
its count, and log10 P of its last token after the rest. The next level counts
(context, next token) per task and deals the counts by context into parts, each for about
``PART_TOKENS`` tokens (a hot context: into several, by token), as compressed lists; a part is added
up at a time, and what counts ``LEAST_COUNT`` joins the level before it for the context's
count and the suffix state's prediction. Two Bloom filters of fixed size
(``FILTER_BITS``) spare tasks most n-grams that cannot count often enough; they only
ever let too much through. For scoring, the weights of n-grams of at least ``HOT_SHARE``
of all tokens (at most its inverse for each length) are broadcast; a text's other
n-grams that pass a filter of all weights are dealt by key into parts, like the table, and looked up a part at a
time, in ``SLICES`` shares one after another. Likewise words: those of at least
``FREQUENT_SHARE`` (at most its inverse) are broadcast, rare ones are joined. Tables on the way and shuffle
files go as soon as nothing reads them.

Keys are 64-bit hashes (frequent words: small numbers); n-grams whose keys collide are
counted as one, which takes billions of them to happen at all. All counts are over all
training texts; nothing is sampled.

Edge cases: a null or empty text has the end token alone. Texts of any length are
scored whole; work space follows the longest text. Rows that repeat a
doc_id (or have none) are scored row by row. Without training rows N and V are
0 and both scores are 0 for every text, as no distribution is defined. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubewash.llm.common import (
    LOWER, RollingHash, Staging, doc_groups, freed_shuffles, shuffle_partitions, text_bytes, training_fold,
)

DEPTH = 3
CONTEXT_COUNT = 8
LEAST_COUNT = 3  # fewer occurrences are no evidence
FREQUENT_SHARE = 2e-6
TOKEN_DEVIANCE = 6.0
CONTEXT_DEVIANCE = 12.0
SMOOTHING = 4.0
FILTER_BITS = 1 << 26
HOT_SHARE = 5e-7
HELD_PAIRS = 1 << 19  # (context, token) pairs that a task holds before it hands them on
PART_TOKENS = 1 << 20  # a part of the counts is that of so many tokens
SLICES = 2  # shares of the keys that are joined with the texts one after another
END = "\n"  # cannot be a word

# The multipliers of XXH64, which Spark's xxhash64 uses.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

_LOW = np.frombuffer(LOWER, np.uint8)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_long(values: np.ndarray, seed=42) -> np.ndarray:
    """xxhash64 of longs as Spark computes it; ``seed`` may be an array."""
    with np.errstate(over="ignore"):
        h = np.asarray(seed).astype(np.uint64) + _P5 + np.uint64(8)
        h = _turn(h ^ (_turn(values.astype(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def joined_key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the keys of all but its last token and of that: xxhash64(context, token)."""
    return hash_long(token, hash_long(context))

def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words and one END per text, offsets) of a string column; null is empty."""
    # lower-cased in numpy: the Arrow kernel misreads arrays whose first offset is not 0
    data, starts = text_bytes(texts)
    texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(starts), pa.py_buffer(_LOW[data]))
    lists = pc.ascii_split_whitespace(texts).cast(pa.large_list(pa.large_string()))
    words, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    word = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(word)])
    ends = before[offsets[1:]] + np.arange(len(texts))  # where each END goes
    total = int(before[-1]) + len(texts)
    # take: the words in order, and END (appended as the last value) at its places
    index = np.empty(total, np.int64)
    is_end = np.zeros(total, bool)
    is_end[ends] = True
    index[~is_end] = np.flatnonzero(word)
    index[is_end] = len(words)
    values = pa.concat_arrays([words, pa.array([END], pa.large_string())])
    return values.take(pa.array(index)), np.concatenate([[0], ends + 1])


def _groups(batch: pa.RecordBatch, column: int):
    """Rows of a batch in groups of bounded text size: (first, last + 1, tokens, offsets)."""
    _, offsets = text_bytes(batch.column(column))
    for i, j in doc_groups(offsets, 1 << 21):
        yield (i, j, *tokens(batch.column(column)[i:j]))


def _count_words(batches):
    for batch in batches:
        for _, _, words, _ in _groups(batch, 0):
            seen = words.value_counts()
            yield pa.RecordBatch.from_arrays([seen.field("values").cast(pa.string()),
                                              seen.field("counts")], names=["word", "n"])


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all training tokens, END included."""
    return (train.select("text").mapInArrow(_count_words, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("c")))


@dataclass
class Vocabulary:
    """The frequent words, from the most frequent; their number is their key."""

    words: pa.Array
    counts: np.ndarray
    total: int  # N
    distinct: int  # V

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def ids(self, words: pa.Array) -> np.ndarray:
        """Number of each frequent word, -1 for rare ones."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(
            zero_copy_only=False).astype(np.int64)

    def keys(self, words: pa.Array, ids: np.ndarray) -> np.ndarray:
        """Keys of words: a frequent word's number, a hash below zero for a rare one."""
        data, offsets = text_bytes(words)
        hashes = RollingHash(data).between(offsets[:-1], offsets[1:]) | np.uint64(1 << 63)
        return np.where(ids >= 0, ids, hashes.view(np.int64))


def vocabulary(counts: DataFrame) -> Vocabulary:
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = whole["n"] or 0, whole["v"]
    frequent = (counts.where(F.col("c") >= FREQUENT_SHARE * total).orderBy(F.desc("c"), "word").toArrow())
    return Vocabulary(frequent["word"].combine_chunks().cast(pa.large_string()),
                      frequent["c"].to_numpy().astype(np.int64), total, distinct)


def _word_keys(shared):
    def run(batches):
        for batch in batches:
            words = batch.column(0).cast(pa.large_string())
            keys = shared.value.keys(words, shared.value.ids(words))
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(1)], names=["g", "n"])
    return run


def filter_of(staging: Staging, keys: DataFrame) -> np.ndarray:
    """Bloom filter of the column ``g``, two bits a key: at most FILTER_BITS / 64 numbers come to the driver."""
    places = keys.select(F.xxhash64("g").alias("h")).select(F.explode(F.array(
        F.col("h").bitwiseAND(FILTER_BITS - 1),
        F.shiftrightunsigned("h", 32).bitwiseAND(FILTER_BITS - 1))).alias("p"))
    stored = staging.write(places.groupBy(F.shiftright("p", 6).alias("at"))
                           .agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("bits")))
    words = stored.toArrow()
    staging.free(stored)
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    h = hash_long(keys).view(np.uint64)
    places = (h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1))
    found = [bits.view(np.uint64)[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) for p in places]
    return (found[0] & found[1] & np.uint64(1)).astype(bool)


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, is there) of keys in a sorted array."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, first bytes of all numbers first: small numbers take little."""
    raw = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueezed(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of all rows of a column of :func:`_squeezed` bytes."""
    raw = [pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)
           for x in column.to_pylist()]
    width = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind).ravel()
                           for x in raw])


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each key, sum of its n)."""
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return order[new], np.add.reduceat(n[order], new)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True] * bool(len(values)), values[1:] != values[:-1]]).astype(bool))


def _part_order(part: np.ndarray, key: np.ndarray, parts: int) -> np.ndarray:
    """Order by part, then by key."""
    order = np.argsort(key)
    return order[np.argsort(part[order].astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")]


def _runs(key: np.ndarray) -> list[bytes]:
    """Sorted keys: each one's difference to the one before, and how often it occurs."""
    new = _starts(key)
    return [_squeezed(np.diff(key[new], prepend=np.int64(0))),
            _squeezed(np.diff(np.append(new, len(key))).astype(np.int32))]


def _by_part(parts: int, salted: tuple[np.ndarray, np.ndarray], held: list[tuple]) -> pa.RecordBatch:
    """One row per part: its contexts, the length of each one's list, and the listed tokens with their counts."""
    key, context, token = (np.concatenate(x) for x in zip(*held))
    first, n = _summed(key, np.ones(len(key), np.int32))
    context, token = context[first], token[first]
    at, hot = lookup(salted[0], context)
    salt = np.zeros(len(context), np.int64)
    salt[hot] = token[hot] % salted[1][at[hot]]
    part = joined_key(context, salt).view(np.uint64) % np.uint64(parts)
    order = _part_order(part, context, parts)
    context, token, n, part = context[order], token[order], n[order].astype(np.int32), part[order].astype(np.int32)
    begin = _starts(part)
    rows = []
    for i, j in zip(begin, np.append(begin[1:], len(part))):
        tok = token[i:j]
        often = tok >= 0
        rows.append([*_runs(context[i:j]), *(_squeezed(x) for x in (
            often, tok[often].astype(np.int32), tok[~often], n[i:j]))])
    return pa.RecordBatch.from_arrays(
        [pa.array(part[begin]), *(pa.array(x, pa.binary()) for x in zip(*rows))],
        names=["part", "ctx", "size", "often", "ids", "rare", "n"])


def _count_next(shared, depth: int, parts: int):
    """Per task: counts of (context, next token) that may be tested at ``depth``, by part."""
    def run(batches):
        known, contexts, suffixes, salted = shared.value
        held, size = [], 0
        for batch in batches:
            for _, _, words, offsets in _groups(batch, 0):
                coded = words.dictionary_encode()
                word_keys, index = known.keys(coded.dictionary, known.ids(coded.dictionary)), coded.indices.to_numpy()
                token = word_keys[index]
                place = np.arange(len(token)) - np.repeat(offsets[:-1], np.diff(offsets))
                gram = token  # key of the n-gram of ``depth`` tokens that ends at a position
                for back in range(1, depth):
                    gram = np.concatenate([gram[:1], joined_key(gram[:-1], token[1:])])
                at = np.flatnonzero(place >= depth)
                if depth > 1:
                    at = at[in_filter(contexts, gram[at - 1])]
                    at = at[in_filter(suffixes, gram[at])]
                else:  # words: once each
                    at = at[in_filter(contexts, word_keys)[index[at - 1]]]
                    at = at[in_filter(suffixes, word_keys)[index[at]]]
                if len(at):
                    context, last = gram[at - 1], token[at]
                    held.append((joined_key(context, last), context, last))
                    size += len(at)
                if size > HELD_PAIRS:
                    yield _by_part(parts, salted, held)
                    held, size = [], 0
        if held:
            yield _by_part(parts, salted, held)
    return run


def _add_part(lists: pa.Table) -> pa.Table:
    """(context, next token, n) of one part, from the lists of all tasks."""
    # each row's contexts are differences from 0 on
    context = np.concatenate([np.cumsum(_unsqueezed(lists["ctx"].slice(i, 1), np.int64)) for i in range(len(lists))])
    context = np.repeat(context, _unsqueezed(lists["size"], np.int32))
    often = _unsqueezed(lists["often"], np.bool_)
    token = np.empty(len(context), np.int64)
    token[often] = _unsqueezed(lists["ids"], np.int32)
    token[~often] = _unsqueezed(lists["rare"], np.int64)
    first, n = _summed(joined_key(context, token), _unsqueezed(lists["n"], np.int32).astype(np.int64))
    first, n = first[n >= LEAST_COUNT], n[n >= LEAST_COUNT]
    return pa.table({"ctx": context[first], "tok": token[first], "n": n})


def _next_level(staging: Staging, train: DataFrame, known: Vocabulary, below: DataFrame,
                depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(level, weights) of the n-grams of ``depth`` + 1 tokens, from the level below; also the kept contexts."""
    sc = train.sparkSession.sparkContext
    contexts = below.where(F.col("n") >= CONTEXT_COUNT)
    # Parts of a fixed share of work: as many as the tokens ask for; a hot context lies in several.
    salted = below.where(F.col("n") >= PART_TOKENS // 4).orderBy("g").select("g", "n").toArrow()
    salted = (salted["g"].to_numpy(), salted["n"].to_numpy() * 4 // PART_TOKENS + 1)
    parts = max(shuffle_partitions(train.sparkSession), known.total // PART_TOKENS + 1)
    shared = sc.broadcast((known, filter_of(staging, contexts.select("g")),
                           filter_of(staging, below.select("g")), salted))
    counted = (train.mapInArrow(_count_next(shared, depth, parts), "part int, ctx binary, size binary, often binary, "
                                "ids binary, rare binary, n binary")
               .groupBy("part").applyInArrow(_add_part, "ctx long, tok long, n long"))
    suffix = F.col("tok") if depth == 1 else F.xxhash64("ctx_sfx", "tok")
    pairs = (counted.join(contexts.select(F.col("g").alias("ctx"), F.col("n").alias("ctx_n"),
                                          F.col("sfx").alias("ctx_sfx")), "ctx")
             .select("ctx", "tok", "n", "ctx_n", suffix.alias("sfx"))
             .join(below.select(F.col("g").alias("sfx"), F.col("cum").alias("low")), "sfx"))
    expected = "(ctx_n * power(10D, low))"
    pairs = staging.write(pairs)
    tested = (pairs
              .withColumn("deviance", F.expr(f"n * ln(n / {expected}) - n + {expected}"))
              .withColumn("listed", F.col("deviance") >= TOKEN_DEVIANCE))
    # What the listed tokens leave, over what they leave of the suffix state.
    kept = (tested.where("listed").groupBy("ctx", "ctx_n")
            .agg(F.sum("deviance").alias("strength"), F.sum("n").alias("listed_n"),
                 F.expr("greatest(1 - sum(power(10D, low)), 1e-12D)").alias("rest"))
            .where(F.col("strength") >= CONTEXT_DEVIANCE)
            .select("ctx", F.col("ctx_n").alias("n"), F.expr(
                f"log10((ctx_n - listed_n + {SMOOTHING}D * rest) / ((ctx_n + {SMOOTHING}D) * rest))").alias("scale")))
    kept = staging.write(kept)
    smoothed = F.expr(f"log10((n + {SMOOTHING}D * power(10D, low)) / (ctx_n + {SMOOTHING}D))")
    # Of the deepest level only the weights are needed, so only listed tokens of kept contexts.
    deepest = depth == DEPTH
    level = ((tested.where("listed") if deepest else tested)
             .join(kept.select("ctx", "scale"), "ctx", "inner" if deepest else "left")
             .select(F.xxhash64("ctx", "tok").alias("g"),
                     F.when(F.col("n") >= CONTEXT_COUNT, F.col("sfx")).alias("sfx"), "n",
                     F.when(F.col("scale").isNull(), F.col("low")).when(F.col("listed"), smoothed)
                     .otherwise(F.col("low") + F.col("scale")).alias("cum"),
                     F.when(F.col("scale").isNotNull() & F.col("listed"), smoothed - F.col("low") - F.col("scale"))
                     .alias("weight")))
    level = staging.write(level.drop("sfx", "cum") if deepest else level)
    staging.free(pairs)
    return level, (level.where("weight IS NOT NULL").select("g", "n", "weight")
                   .unionAll(kept.select("ctx", "n", "scale"))), kept


def fit(staging: Staging, train: DataFrame, counts: DataFrame, known: Vocabulary) -> DataFrame:
    """The tree as (g, n, weight): key of an n-gram, its count, and what it adds to a text's score."""
    shared = train.sparkSession.sparkContext.broadcast(known)
    below = staging.write(counts.where(F.col("c") >= LEAST_COUNT).select("word", "c")
                          .mapInArrow(_word_keys(shared), "g long, n long")
                          .select("g", F.lit(0).cast("long").alias("sfx"), "n",
                                  F.log10((F.col("n") + 0.5) / known.denominator).alias("cum")))
    weights = below.where("false").select("g", "n", F.col("cum").alias("weight"))
    used = [below]
    for depth in range(1, DEPTH + 1):
        below, found, kept = _next_level(staging, train, known, below, depth)
        used += [below, kept]
        weights = weights.unionAll(found)
    tree = staging.write(weights.groupBy("g").agg(F.max("n").alias("n"), F.sum("weight").alias("weight")))
    staging.free(*used)
    return tree


@dataclass
class HotWeights:
    """What every task gets of the tree: weights by sorted key, and a filter of all keys."""

    keys: np.ndarray
    weights: np.ndarray
    every: np.ndarray


def hot_weights(staging: Staging, weights: DataFrame, total: int) -> tuple[HotWeights, DataFrame]:
    """(broadcast part, weights that must be joined)."""
    hot = F.col("n") >= HOT_SHARE * total
    got = weights.where(hot).select("g", "weight").toArrow()
    key, value = got["g"].to_numpy(), got["weight"].to_numpy()
    order = np.argsort(key)
    return (HotWeights(key[order], value[order], filter_of(staging, weights.select("g"))),
            weights.where(~hot).select(F.col("g").alias("key"), "weight"))


def _lists(doc, rows: int, columns: list[pa.Array], names: list[str]) -> pa.ListArray:
    """Structs that are sorted by ``doc`` as one list for each of ``rows`` rows."""
    first = np.searchsorted(doc, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(columns, names=names))


def _cold_lists(key: np.ndarray, doc: np.ndarray, rows: int, parts: int) -> pa.ListArray:
    """N-grams of ``rows`` texts by part, all with the first text: keys, how often each occurs, and in which texts."""
    part = hash_long(key) % parts
    order = _part_order(part, key, parts)
    key, doc, part = key[order], doc[order].astype(np.int32), part[order].astype(np.int32)
    begin = _starts(part)
    found = [[*_runs(key[i:j]), _squeezed(doc[i:j])] for i, j in zip(begin, np.append(begin[1:], len(part)))]
    return _lists(np.zeros(len(begin), np.int64), rows, [
        pa.array(part[begin]), *(pa.array(x, pa.binary()) for x in (list(zip(*found)) or [()] * 3))],
        ["part", "keys", "size", "docs"])


def _add_cold(lists: pa.Table, tree: pa.Table) -> pa.Table:
    """Per list: the number of its first row, texts, and what the n-grams of one part add to their scores."""
    known, weight = tree["key"].to_numpy(), tree["weight"].to_numpy()
    order = np.argsort(known)
    known, weight = known[order], weight[order]
    found = []
    for i, row in enumerate(lists["row"].to_pylist() if len(known) else []):
        keys, size, doc = (_unsqueezed(lists[x].slice(i, 1), kind) for x, kind in (
            ("keys", np.int64), ("size", np.int32), ("docs", np.int32)))
        at, there = lookup(known, np.cumsum(keys))
        doc = doc[np.repeat(there, size)]
        if len(doc):
            gain = np.bincount(doc, np.repeat(weight[at[there]], size[there]))
            some = np.flatnonzero(np.bincount(doc))
            found.append((row, _squeezed(some.astype(np.int32)), _squeezed(gain[some])))
    row, docs, gains = list(zip(*found)) or [()] * 3
    return pa.table([pa.array(row, pa.int64()), pa.array(docs, pa.binary()), pa.array(gains, pa.binary())],
                    names=["row", "docs", "gains"])


def _add_rows(lists: pa.Table) -> pa.Table:
    """(row, gain) of one group of rows, from all parts."""
    doc, gain = _unsqueezed(lists["docs"], np.int32), _unsqueezed(lists["gains"], np.float64)
    some = np.flatnonzero(np.bincount(doc))
    return pa.table({"row": lists["row"][0].as_py() + some, "gain": np.bincount(doc, gain)[some]})


def _score_hot(shared, parts: int):
    """Per row: what the broadcast parts give, and the rare words with counts; per group of rows: other n-grams."""
    def run(batches):
        known, hot = shared.value
        log_root = np.log10((known.counts + 0.5) / known.denominator)
        for batch in batches:
            for i, j, words, offsets in _groups(batch, 1):
                coded = words.dictionary_encode()
                index, size = coded.indices.to_numpy(), len(coded.dictionary)
                word_ids = known.ids(coded.dictionary)
                word_keys = known.keys(coded.dictionary, word_ids)
                ids, token = word_ids[index], word_keys[index]
                doc = np.repeat(np.arange(j - i), np.diff(offsets))
                place = np.arange(len(ids)) - offsets[doc]
                often = ids >= 0
                base = np.bincount(doc[often], log_root[ids[often]], minlength=j - i).astype(np.float64)
                count = np.bincount(doc[often], minlength=j - i)
                pair, times = np.unique(doc[~often] * size + index[~often], return_counts=True)
                rare = _lists(pair // size, j - i, [
                    coded.dictionary.take(pa.array(pair % size)).cast(pa.string()),
                    pa.array(times.astype(np.int32))], ["word", "times"])
                gain, cold = np.zeros(j - i), []
                gram = token
                for length in range(1, DEPTH + 2):
                    if length > 1:
                        gram = np.concatenate([gram[:1], joined_key(gram[:-1], token[1:])])
                        at = np.flatnonzero(place >= length - 1)
                        at = at[in_filter(hot.every, gram[at])]
                    else:  # words: once each
                        at = np.flatnonzero(in_filter(hot.every, word_keys)[index])
                    key, where = np.unique(gram[at], return_inverse=True)
                    spot, found = lookup(hot.keys, key)
                    value = np.zeros(len(key))
                    value[found] = hot.weights[spot[found]]
                    gain += np.bincount(doc[at], value[where], minlength=j - i)
                    at = at[~found[where]]
                    cold.append((doc[at], gram[at]))
                cold_doc, cold_key = (np.concatenate(x) for x in zip(*cold))
                other = _cold_lists(cold_key, cold_doc, j - i, parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(np.diff(offsets)), pa.array(count.astype(np.int64)),
                     pa.array(base), pa.array(gain), rare, other],
                    names=["doc_id", "n_tokens", "n_known", "base", "gain", "rare", "other"])
    return run


def score(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    with freed_shuffles(docs.sparkSession):
        return _score(docs, folds, held_out)


def _score(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    train = docs.where(training_fold("doc_id", folds) != held_out).select("text")
    staging = Staging(docs.sparkSession, "pst_lm")
    counts = staging.write(word_counts(train))
    known = vocabulary(counts)
    hot, colder = hot_weights(staging, fit(staging, train, counts, known), known.total)
    parts = max(shuffle_partitions(docs.sparkSession), known.total // (4 * PART_TOKENS) + 1)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = (docs.select("doc_id", "text").mapInArrow(
        _score_hot(docs.sparkSession.sparkContext.broadcast((known, hot)), parts),
        f"doc_id {id_type}, n_tokens long, n_known long, base double, gain double, "
        "rare array<struct<word string, times int>>, "
        "other array<struct<part int, keys binary, size binary, docs binary>>"))
    # The number of a row is written with it, so it no longer changes.
    rows = staging.write(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    other = rows.select("row", F.explode("other").alias("r")).select("row", "r.*")
    colder = colder.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    # One join after another, each over a share of the keys and stored as sums by row: its shuffle files go
    # before the next begins.
    c, zero = F.coalesce("c", F.lit(0)), F.lit(0.0)
    sums = []
    for k in range(SLICES):
        words, share = F.pmod(F.xxhash64("word"), F.lit(SLICES)) == k, F.col("part") % SLICES == k
        found = (
            rare.where(words).join(counts.where(words).hint("shuffle_hash"), "word", "left")
            .select("row", F.when(c > 0, F.col("times")).otherwise(0).cast("long").alias("known"),
                    (F.col("times") * F.log10((c + 0.5) / known.denominator)).alias("base"), zero.alias("gain")),
            other.where(share).groupBy("part").cogroup(colder.where(share).groupBy("part"))
            .applyInArrow(_add_cold, "row long, docs binary, gains binary")
            .groupBy("row").applyInArrow(_add_rows, "row long, gain double")
            .select("row", F.lit(0).cast("long").alias("known"), zero.alias("base"), "gain"))
        sums += [staging.write(x.groupBy("row").agg(*(F.sum(y).alias(y) for y in ("known", "base", "gain"))))
                 for x in found]
    summed = (reduce(DataFrame.unionAll, sums).groupBy("row")
              .agg(*(F.sum(x).alias(f"more_{x}") for x in ("known", "base", "gain"))))
    base = F.col("base") + F.coalesce("more_base", zero) if known.total else zero
    gain = F.col("gain") + F.coalesce("more_gain", zero)
    return (rows.drop("rare", "other").join(summed, "row", "left")
            .select("doc_id", (training_fold("doc_id", folds) == held_out).alias("held_out"), "n_tokens",
                    (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    F.lit(known.total).cast("long").alias("train_tokens"), base.alias("base_score"),
                    (base + gain).alias("score")))

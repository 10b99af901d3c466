"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring symbols that stand side by side inside no vocabulary token can
never be merged over, so the place between them is a certain cut. Each word is
cut there first, the fragments are encoded independently, and their tokens are
concatenated. Words and runs between white space repeat, so both are cached per
Python worker, in caches bounded by their bytes.

The tokenizer file (vocabulary, merges, word-end suffix, special tokens) is a
parameter; results equal those of the tokenizers library for files of the
``word_bpe`` kind: NFC, white space collapsed, lower case, the word pattern
below, byte-level symbols, and a suffix on each word's last symbol.

Edge cases: a null or empty text, or one of white space alone, has no tokens
(the hashes are those of the empty string). Special-token strings inside a text
become their special token, as in the library's default. Very long texts are encoded
in segments of whole runs. Repeated rows give repeated results; rows need no
identity; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewash.llm.common import doc_groups, sha256_hex, text_bytes

#: Fixed value: the word pattern of the tokenizer file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Bytes that each generation of a worker's two caches holds, and those of an entry beside its text.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 200
#: Characters of a text that are resolved at a time.
SEGMENT = 1 << 20

NO_MERGE = 1 << 30


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass(frozen=True)
class BpeModel:
    """What encoding needs from a tokenizer file; a few MB, whatever the corpus."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str
    special: dict[str, int]

    @staticmethod
    def load(path: str) -> BpeModel:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: expected a BPE tokenizer with a word-end suffix")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        return BpeModel(model["vocab"], pairs, model["end_of_word_suffix"],
                        {t["content"]: t["id"] for t in spec["added_tokens"]})


class BoundedCache:
    """Strings by string, in two generations bounded by their bytes.

    When the young generation is full it becomes the old one, and the old one
    goes; what is asked for again moves to the young one, so frequent entries stay.
    """

    def __init__(self, limit: int):
        self._limit, self._bytes = limit, 0
        self._young: dict[str, str] = {}
        self._old: dict[str, str] = {}

    def put(self, key: str, value: str) -> str:
        if self._bytes > self._limit:
            self._old, self._young, self._bytes = self._young, {}, 0
        self._young[key] = value
        self._bytes += len(key) + len(value) + ENTRY_BYTES
        return value

    def take(self, keys: set[str]) -> tuple[dict[str, str], list[str]]:
        """(what is known of ``keys``, those that are not)."""
        known, unknown = {}, []
        young, old = self._young, self._old
        for key in keys:
            value = young.get(key)
            if value is None:
                value = old.get(key)
                if value is None:
                    unknown.append(key)
                    continue
                self.put(key, value)
            known[key] = value
        return known, unknown


class ForcedBoundaryBpe:
    """Encoder and decoder of one model, with caches of words and of runs between white space.

    Words that the caches lack are encoded together: their symbols stand in one
    flat array, cuts are found by a table of pairs that occur inside tokens, and
    all fragments of one length merge side by side, lowest rank first.
    """

    def __init__(self, model: BpeModel):
        self.model = model
        vocab, suffix = model.vocab, model.suffix
        letters = byte_symbols()
        self._inner = np.array([vocab[c] for c in letters], np.int64)
        self._final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self._size = max(vocab.values()) + 1
        keys = np.array([vocab[x] * self._size + vocab[y] for x, y in model.merges], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order
        self._made = np.array([vocab[x + y] for x, y in model.merges], np.int64)
        self._inside = self._pairs_inside_tokens()
        self._pattern = regex.compile(WORD_PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, model.special))) if model.special else None
        self._token = {i: t for t, i in {**vocab, **model.special}.items()}
        self._id_text = {i: str(i) for i in self._token}
        self._token_of_text = {str(i): t for i, t in self._token.items()}
        self._words, self._chunks = BoundedCache(CACHE_BYTES), BoundedCache(CACHE_BYTES)

    def _pairs_inside_tokens(self) -> np.ndarray:
        """[last, x, y]: some token holds byte x before byte y, where y ends a word or not."""
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        suffix = self.model.suffix
        inside = np.zeros((2, 256, 256), bool)
        for token in self.model.vocab:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            body = [byte_of[c] for c in (token[:-len(suffix)] if ends else token)]
            for i, pair in enumerate(zip(body, body[1:]), 2):
                inside[(int(ends and i == len(body)), *pair)] = True
        return inside

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self._size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._ranks[at], NO_MERGE)

    def _merge(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of fragments of one length (a row each) and how many each row has."""
        rows, width = symbols.shape
        done, lengths = np.full((rows, width), -1, np.int64), np.full(rows, width)
        row = np.arange(rows)
        symbols = np.concatenate([symbols, np.full((rows, 1), -1, np.int64)], axis=1)
        ranks = self._rank_of(symbols[:, :-1], symbols[:, 1:])  # the last is of no pair
        columns = np.arange(width + 1)
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            ended = best == NO_MERGE
            done[row[ended]] = symbols[ended, :width]
            row, symbols, ranks, at, best = (x[~ended] for x in (row, symbols, ranks, at, best))
            if not len(row):
                break
            here = np.arange(len(row))
            symbols[here, at] = self._made[best]
            # drop the right half of the pair: what stands after it moves one to the left
            source = np.minimum(columns + (columns > at[:, None]), width)
            symbols = np.take_along_axis(symbols, source, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(source[:, :width], width - 1), axis=1)
            ranks[:, -1] = NO_MERGE
            ranks[here, at] = self._rank_of(symbols[here, at], symbols[here, at + 1])
            left = np.maximum(at - 1, 0)
            ranks[here, left] = np.where(at > 0, self._rank_of(symbols[here, left], symbols[here, left + 1]),
                                         ranks[here, left])
            lengths[row] -= 1
        return done, lengths

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word (without white space, already normalised)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        last = np.zeros(len(data), bool)
        last[ends - 1] = True
        symbols = np.where(last, self._final[data], self._inner[data])
        cut = last.copy()  # a fragment ends here: the word does, or no token holds the pair
        cut[:-1] |= ~self._inside[last[1:].astype(np.int8), data[:-1], data[1:]]
        stops = np.flatnonzero(cut) + 1
        starts = np.concatenate([[0], stops[:-1]])
        sizes = stops - starts
        tokens: list[list[int]] = [[]] * len(starts)
        for width in np.unique(sizes):
            group = np.flatnonzero(sizes == width)
            step = max(1, 2_000_000 // int(width) ** 2)
            for i in range(0, len(group), step):
                part = group[i:i + step]
                done, lengths = self._merge(symbols[starts[part][:, None] + np.arange(width)])
                for k, ids, n in zip(part.tolist(), done.tolist(), lengths.tolist()):
                    tokens[k] = ids[:n]
        first = np.searchsorted(stops, ends - [len(r) for r in raw], side="right")
        bounds = np.append(first, len(stops)).tolist()
        return [tokens[i] if j == i + 1 else [t for f in tokens[i:j] for t in f]
                for i, j in zip(bounds, bounds[1:])]

    def _resolve(self, chunks: set[str]) -> dict[str, str]:
        """Decimal ids, joined by a space, of runs between white space; learns those that the caches lack."""
        known, lacking = self._chunks.take(chunks)
        parts = {}
        for chunk in lacking:
            if chunk.isascii():
                lower = chunk.lower()
            else:  # lower case is taken character by character, so no final-sigma rule applies
                lower = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            parts[chunk] = [lower] if lower.isalpha() else self._pattern.findall(lower)
        words, new = self._words.take({w for ws in parts.values() for w in ws})
        for at in range(0, len(new), 50_000):
            some = new[at:at + 50_000]
            for word, ids in zip(some, self._encode_words(some)):
                words[word] = self._words.put(word, " ".join([self._id_text[i] for i in ids]))
        for chunk, ws in parts.items():
            known[chunk] = self._chunks.put(chunk, words[ws[0]] if len(ws) == 1 else " ".join([words[w] for w in ws]))
        return known

    def _segments(self, text: str):
        """The text cut at special-token strings, and into segments of whole runs: (part, is a special token)."""
        at, found = 0, []
        if self._special is not None and self._special.search(text):
            found = [m.span() for m in self._special.finditer(text)]
        for start, end in [*found, (len(text), len(text))]:
            while at < start:
                cut = start
                if start - at > SEGMENT:
                    white = _WHITE.search(text, at + SEGMENT, start)
                    cut = white.end() if white else start
                yield text[at:cut], False
                at = cut
            if end > start:
                yield text[start:end], True
            at = end

    def encode_texts(self, texts: list[str]) -> list[str]:
        """Decimal ids, joined by a space, of each text; short texts are resolved together."""
        short = [len(t) <= SEGMENT and not (self._special and self._special.search(t)) for t in texts]
        runs = [split_white(t) if s else [] for t, s in zip(texts, short)]
        known = self._resolve({c for r in runs for c in r})
        return [" ".join([known[c] for c in r]) if s else self._encode_long(t)
                for t, r, s in zip(texts, runs, short)]

    def _encode_long(self, text: str) -> str:
        out = []
        for part, special in self._segments(text):
            if special:
                out.append(str(self.model.special[part]))
                continue
            run = split_white(part)
            known = self._resolve(set(run))
            out += [known[c] for c in run]
        return " ".join(out)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_texts([text])[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: files of this kind name no decoder."""
        return " ".join(self._token[i] for i in ids)

    def decode_text(self, ids: str) -> str:
        """The same of decimal ids joined by a space."""
        return " ".join(map(self._token_of_text.__getitem__, ids.split(" "))) if ids else ""


_WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def split_white(text: str) -> list[str]:
    """Runs between Unicode white space. str.split() also cuts at U+001C-U+001F, which is not."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in _WHITE.split(text) if c]
    return text.split()


_made: dict[int, ForcedBoundaryBpe] = {}


def _worker_bpe(shared) -> ForcedBoundaryBpe:
    """One encoder per Python worker and broadcast model; its caches outlive a task."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _made:
        _made.clear()
        _made[key] = ForcedBoundaryBpe(shared.value)
    return _made[key]


def share(spark: SparkSession, path: str):
    """The model as a broadcast; its size is that of the tokenizer file, not of the data."""
    return spark.sparkContext.broadcast(BpeModel.load(path))


def _encoded(shared, texts: pa.Array):
    """(encoder, ids of each text as text) for small groups of texts, in order."""
    bpe = _worker_bpe(shared)
    _, offsets = text_bytes(texts)
    for i, j in doc_groups(offsets):
        yield bpe, bpe.encode_texts([t or "" for t in texts[i:j].to_pylist()])


def _id_lists(encoded: list[str]) -> pa.Array:
    """list<int32> of ids that stand as text."""
    lists = [np.fromstring(e, np.int32, sep=" ") if e else np.zeros(0, np.int32) for e in encoded]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))


def encode_column(shared, text: Column) -> Column:
    """array<int> of token ids of each whole text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        parts = [_id_lists(encoded) for _, encoded in _encoded(shared, texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return ids(text)


_BOTH = pa.struct([("token_ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])


def encode_decode_column(shared, text: Column) -> Column:
    """struct<token_ids, decoded_sha256>: ids of each whole text, and the SHA-256 of what they decode to.

    One function for both, so ids do not travel to Spark and back to be decoded.
    """

    @F.arrow_udf("token_ids array<int>, decoded_sha256 string")
    def both(texts: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays(
            [_id_lists(encoded), pa.array([sha256_hex(bpe.decode_text(e).encode()) for e in encoded], pa.string())],
            fields=list(_BOTH)) for bpe, encoded in _encoded(shared, texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], _BOTH)

    return both(text)


def decode_column(shared, ids: Column) -> Column:
    """Text of each array of token ids; null for null."""

    @F.arrow_udf("string")
    def text(arrays: pa.Array) -> pa.Array:
        bpe = _worker_bpe(shared)
        return pa.array([None if not a.is_valid else bpe.decode(a.values.to_pylist()) for a in arrays], pa.string())

    return text(ids)


_DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest_column(shared, text: Column) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> without shipping ids and text back to Spark."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pa.Array) -> pa.Array:
        counts, ids, decoded = [], [], []
        for bpe, encoded in _encoded(shared, texts):
            counts += [e.count(" ") + 1 if e else 0 for e in encoded]
            ids += [sha256_hex(e.encode()) for e in encoded]
            decoded += [sha256_hex(bpe.decode_text(e).encode()) for e in encoded]
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                                           pa.array(decoded, pa.string())], fields=list(_DIGEST))

    return digests(text)


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text)."""
    shared = share(docs.sparkSession, tokenizer_path)
    return (docs.select("doc_id", digest_column(shared, F.col("text")).alias("d"))
            .select("doc_id", "d.*"))

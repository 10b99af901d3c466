"""Language ID with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one row of bits per slot and one bit per language
in each row. An n-gram looks up its slots and ANDs the rows: the bits that stay
are all languages whose filter holds it. Over a document, every language gets
its popcount of n-grams, corrected for the false positives that the fill of its
own slice makes expected; the largest corrected share decides.

n-grams are ``N`` letters (bytes of lower-cased UTF-8 letters, with one space
between words; punctuation, symbols and emoji count as space). All training texts are
counted. An n-gram enters the filter of a language if its rate there is at least
``SHARE`` of its highest rate in any language, so a passage quoted in a foreign
text does not blur the filters. The filter has as many rows as keep the slice of the
language with most n-grams half empty, a byte a row for eight languages; that is all
that leaves Spark. N letters are 32 bits and real alphabets a small part of them; above
``MOST_SLOTS`` rows (some 4 million n-grams a language) slices would fill further.

Edge cases: a null text, or one without a letter (by Unicode, whatever n-grams it
holds), gets ``und`` and score 0. A text with letters but without any n-gram that a
filter holds gets the language of most training documents with score 0. Without
training rows all rows get ``und``. Null languages are not learned; null doc_ids count
as the text 'null' in the fold. Ties go to the language that sorts first. Repeated rows
are rows of their own; very long texts are read whole; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubewash.llm.common import checkpoint, doc_groups, fresh_name, mix, text_bytes, training_fold

N = 4
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 24
HASHES = 3
SHARE = 0.2
MIN_COUNT = 3  # an n-gram seen less often in a language is not evidence

#: Lower-cases A-Z; ASCII that is no letter becomes a space; other bytes stay.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
                  for b in range(256)], np.uint8)
#: Second bytes of Latin-1 capitals after 0xC3 that have a small letter 0x20 further on.
_LATIN = np.array([b + 32 if 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256)], np.uint8)


def _symbol_bytes(data: np.ndarray) -> np.ndarray:
    """Places of the bytes of common symbols: U+0080-U+00BF but for three letters, U+00D7, U+00F7,
    U+2000-U+2BFF and U+3000-U+303F (punctuation, signs, arrows), U+1F000-U+1FFFF (emoji)."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    first, second = data[:-1], data[1:]
    two = np.flatnonzero(((first == 0xC2) & ~np.isin(second, (0xAA, 0xB5, 0xBA)))
                         | ((first == 0xC3) & np.isin(second, (0x97, 0xB7))))
    three = np.flatnonzero(((first == 0xE2) & (second <= 0xAF)) | ((first == 0xE3) & (second == 0x80)))
    four = np.flatnonzero((first == 0xF0) & (second == 0x9F))
    at = np.concatenate([(places[:, None] + np.arange(n)).ravel() for n, places in ((2, two), (3, three), (4, four))])
    return at[at < len(data)]


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, document of each code): every N letters of every text, one space between words."""
    if len(data) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    low = _FOLD[data]
    low[_symbol_bytes(data)] = 32
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    low[after] = _LATIN[low[after]]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    space = low == 32
    keep = np.ones(len(low), bool)  # of a run of spaces only the first stays
    keep[1:] = ~(space[1:] & space[:-1]) | (doc[1:] != doc[:-1])
    low, doc = low[keep].astype(np.uint32), doc[keep]
    if len(low) < N:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    n = len(low) - N + 1
    codes = low[:n].copy()
    for j in range(1, N):
        codes |= low[j:j + n] << np.uint32(8 * j)
    inside = doc[:n] == doc[N - 1:]
    return codes[inside], doc[:n][inside]


def slots(codes: np.ndarray, size: int) -> list[np.ndarray]:
    """The HASHES slots of each code, from two halves of one mixed hash."""
    h = mix(codes.astype(np.uint64) + np.uint64(1))
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64) for i in range(HASHES)]


def slots_for(held: int) -> int:
    """Rows at which a slice of ``held`` n-grams is half empty, as a power of two."""
    need = HASHES * held / np.log(2)
    return int(min(max(LEAST_SLOTS, 1 << int(np.ceil(np.log2(max(need, 1))))), MOST_SLOTS))


@dataclass
class LanguageFilters:
    languages: list[str]
    rows: np.ndarray  # (slots, bytes) uint8: bit l of a row is language l
    default: str  # of most training documents; 'und' without any

    @property
    def false_positive(self) -> np.ndarray:
        """Chance that an unknown n-gram passes the slice of each language."""
        bits = np.unpackbits(self.rows, axis=1, bitorder="little")[:, :len(self.languages)]
        return bits.mean(axis=0) ** HASHES

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index or -1, score) of each text."""
        docs, langs = len(offsets) - 1, len(self.languages)
        best, score = np.full(docs, -1), np.zeros(docs)
        if not langs:
            return best, score
        fpr = np.minimum(self.false_positive, 0.999)
        for i, j in doc_groups(offsets, 1 << 18):
            codes, doc = ngrams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            if not len(codes):
                continue
            held = None
            for slot in slots(codes, len(self.rows)):
                found = self.rows[slot]
                held = found if held is None else held & found
            counts = np.bincount(doc, minlength=j - i)
            hits = np.stack([np.bincount(doc, (held[:, k // 8] >> np.uint8(k % 8)) & 1, minlength=j - i)
                             for k in range(langs)], axis=1)
            share = np.maximum(0, hits / np.maximum(counts, 1)[:, None] - fpr) / (1 - fpr)
            top = share.argmax(axis=1)
            most = share[np.arange(j - i), top]
            best[i:j] = np.where(most > 0, top, -1)
            # How far the winner leads: 1 if no other language holds any of its n-grams, 1/langs in a tie of all.
            score[i:j] = np.where(most > 0, most / np.maximum(share.sum(axis=1), 1e-12), 0)
        return best, np.clip(score, 0, 1)


_COUNTS = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])


def _count_batches(batches):
    """Per task: how often each n-gram occurs in each language, summed before the shuffle."""
    pending: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([c for c, _ in pending[lang]])
        counts = np.concatenate([n for _, n in pending[lang]])
        unique, inverse = np.unique(codes, return_inverse=True)
        return unique, np.bincount(inverse, counts).astype(np.int64)

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in dict.fromkeys(langs):
            data, offsets = text_bytes(batch.column(1).filter(pa.array(langs == lang)))
            for i, j in doc_groups(offsets):
                codes, _ = ngrams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                pending.setdefault(lang, []).append(np.unique(codes, return_counts=True))
            if len(pending[lang]) > 8:
                pending[lang] = [merged(lang)]
    for lang in pending:
        codes, counts = merged(lang)
        for at in range(0, len(codes), 50_000):
            part = codes[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()), pa.array(part.astype(np.int64)),
                 pa.array(counts[at:at + 50_000])], schema=_COUNTS)


def train(docs: DataFrame, folds: int = 4, held_out: int = 2) -> LanguageFilters:
    """Count n-grams of all training texts and set the filters' bits."""
    train_rows = (docs.select("doc_id", "text", "lang")
                  .where(F.col("lang").isNotNull() & (training_fold("doc_id", folds) != held_out)))
    seen = train_rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = sorted(r["lang"] for r in seen)
    if not languages:
        return LanguageFilters([], np.zeros((LEAST_SLOTS, 1), np.uint8), "und")
    counts = (train_rows.select("lang", "text")
              .mapInArrow(_count_batches, "lang string, code long, n long")
              .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    # One row per n-gram, its counts by language side by side (one value per language).
    by_code = counts.groupBy("code").agg(F.collect_list(F.struct("lang", "n")).alias("by_lang"))
    totals = {r["lang"]: r["n"] for r in
              counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    number = F.create_map(*[x for k, lang in enumerate(languages) for x in (F.lit(lang), F.lit(k))])
    total = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(float(totals.get(lang, 1))))])
    rated = F.transform("by_lang", lambda x: F.struct(
        number[x["lang"]].alias("lang"), x["n"].alias("n"), (x["n"] / total[x["lang"]]).alias("rate")))
    held = (by_code.select("code", rated.alias("r"))
            .select("code", "r", F.array_max(F.transform("r", lambda x: x["rate"])).alias("top"))
            .select("code", F.explode(F.filter("r", lambda x: (x["n"] >= MIN_COUNT)
                                               & (x["rate"] >= SHARE * F.col("top")))).alias("x"))
            .select("code", F.col("x.lang").alias("lang")))
    held = checkpoint(held)
    size = slots_for(max((r["count"] for r in held.groupBy("lang").count().collect()), default=0))
    width = -(-len(languages) // 8)
    # Slots are set by task and ORed; the driver gets at most `size` rows of `width` bytes.
    planes = (held.mapInArrow(_slot_batches(size), "slot int, plane int, bits int")
              .groupBy("slot", "plane").agg(F.bit_or("bits").alias("bits")).toArrow())
    rows = np.zeros((size, width), np.uint8)
    rows[planes["slot"].to_numpy(), planes["plane"].to_numpy()] = planes["bits"].to_numpy()
    return LanguageFilters(languages, rows, seen[0]["lang"])


def _slot_batches(size: int):
    def run(batches):
        for batch in batches:
            codes, lang = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for slot in slots(codes.astype(np.uint64), size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot.astype(np.int32)), pa.array((lang // 8).astype(np.int32)),
                     pa.array((1 << (lang % 8)).astype(np.int32))], names=["slot", "plane", "bits"])
    return run


def letter_rows(texts: pa.Array) -> np.ndarray:
    """Which texts hold a letter; only those without an ASCII letter are looked at character by character."""
    data, offsets = text_bytes(texts)
    found = np.zeros(len(texts), bool)
    for i, j in doc_groups(offsets, 1 << 18):
        small = data[offsets[i]:offsets[j]] | np.uint8(0x20)
        letters = np.flatnonzero((small >= 97) & (small <= 122))
        found[i:j] = np.diff(np.searchsorted(letters, offsets[i:j + 1] - offsets[i])) > 0
    for row in np.flatnonzero(~found):
        found[row] = any(c.isalpha() for c in texts[int(row)].as_py() or "")
    return found


def language_column(spark, filters: LanguageFilters, text: Column) -> Column:
    """struct<lang_pred, score> of each whole text."""
    shared = spark.sparkContext.broadcast(filters)  # a byte a row for 8 languages

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        model = shared.value
        best, score = model.predict(*text_bytes(texts))
        letters = letter_rows(texts)
        score[~letters] = 0
        names = ["und" if not has else model.languages[k] if k >= 0 and s > 0 else model.default
                 for has, k, s in zip(letters, best, score)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)],
                                          names=["lang_pred", "score"])

    return predict(text)


def predict_language(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang)."""
    filters = train(docs, folds, held_out)
    made = fresh_name(docs, "prediction")
    return (docs.select("doc_id", (training_fold("doc_id", folds) == held_out).alias("held_out"),
                        language_column(docs.sparkSession, filters, F.col("text")).alias(made))
            .select("doc_id", "held_out", f"{made}.*"))

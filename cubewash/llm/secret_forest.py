"""Secret scans: candidates from wide patterns, false positives removed by a random forest.

Candidates are tokens of known formats, whatever a secret-like key is given
(quoted or not, of any length), quoted values after = or :, and long runs of
token characters that hold a digit, without the key that they are assigned to.
The forest alone judges each, by its length, its transitions between character classes,
how much of it a dictionary covers, whether it looks like a path, and the words beside
it. It is trained from labelled findings: at most ``MAX_ROWS`` of each label. A caller may
give its own (candidate, before, after, label). By default evidence that no feature reads
labels them: a token of a known format is a secret; so is what a secret-like key is given,
unless it stands for nothing (null, a variable's name) or consists of words that the
corpus uses at least ``PLAIN_USES`` times, which are descriptions ("password: required").
Everything else is a false positive. The dictionary is the ``DICTIONARY_WORDS`` most
frequent words of all texts.

Candidates, features, forest and redaction are DataFrame expressions within the
row of a document; the forest is a set of nested conditions. Whole texts are
scanned once for words, once to train (both labels are drawn from one checkpoint of
candidates) and once to score, without a shuffle of text; words are counted before
they are shuffled.

Positions are code points, ends exclusive. Edge cases: null and empty texts have
no candidate (a redacted null stays null). Rows that repeat a doc_id or have none are rows of
their own. If the findings have one label alone, that label holds for all
candidates; without any finding there is no candidate either.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubewash.llm.common import checkpoint, fresh_name
from cubewash.llm.native_spans import (
    Matches, count_of, fit_trees, flag, forest_text, sample_rows)

MAX_ROWS = 3000
DICTIONARY_WORDS = 5_000
PLAIN_USES = 20
#: Buckets that the nearest words before and after a candidate are dealt into.
BEFORE, AFTER = 16, 6
THRESHOLD = 0.5
MARK = "[SECRET]"

_RUN = "[A-Za-z0-9+/_-]"
_KEY = (r"(?i:(?:token|secret|passw(?:or)?d|passphrase|pwd|credential|(?:api|access|private|secret|auth|signing|"
        r"encryption|account)[_-]?key)s?(?:[_-]?[0-9]{1,3})?)")
_GIVES = r"[\"']?\s{0,3}(?:=>|:=|[=:]{1,2})\s{0,3}"
#: Formats that are secrets without a key beside them.
_BLOCK = r"-----BEGIN\x20[A-Z\x20]{0,20}PRIVATE\x20KEY-----[A-Za-z0-9+/=\s\\]++-----END\x20[A-Z\x20]{0,20}PRIVATE\x20KEY-----"
_FORMATS = (r"(?<!\w)(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{30,}+|github_pat_\w{22,}+"
            r"|glpat-[\w-]{20,}+|xox[abeoprs]-[A-Za-z0-9-]{10,}+|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+"
            r"|AIza[\w-]{35}|eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]++)")
TOKEN = f"{_BLOCK}|{_FORMATS}"
_GIVEN = rf"{_KEY}{_GIVES}"


def _quoted(q: str, least: int) -> str:
    """A value to its closing quote; a backslash keeps the next character in it."""
    return rf"(?<={q})(?:[^{q}\\\r\n]|\\.){{{least},}}+(?={q})"


#: To the next blank or quote, without closing punctuation or the next parameter of an address.
_VALUE = r"(?![=:>])(?:[^\s\"',;&<)}\]]|[,;)}\]<](?=[^\s\"',;&<)}\]])|&(?=\S)(?!\w{1,40}=))++"
#: Quoted text in which something is a secret by itself is no value as a whole.
_HOLDS = rf"(?:{_GIVEN}[\"']?[^\s\"']|{TOKEN})"
_OTHERS = "|".join([
    _FORMATS,
    # whatever a secret-like key gives
    rf"(?<=[=:>]\s{{0,3}}[\"']?)(?<={_GIVEN}[\"']?)(?:{_quoted('\"', 1)}|{_quoted("'", 1)}|{_VALUE})",
    *[rf"(?<=[=:]\x20?{q})(?![^{q}\r\n]*?{_HOLDS}){_quoted(q, 8)}" for q in "\"'"],
    rf"(?<=[=:]\x20?[\"'])(?![^\"'\s]*?{_HOLDS})[^\"'\s]{{8,}}+",
    # a run, with padding; one that is given a value is a key
    rf"(?<!{_RUN})(?=[A-Za-z+/_-]*+[0-9]){_RUN}{{16,}}+(?!=[\"']?[A-Za-z0-9+/_$-]|[\"']?\x20=\x20|[\"']\x20?:"
    rf"|(?<={_KEY}){_GIVES})={{0,2}}+"])
#: But for a block, nothing starts behind a word character.
CANDIDATE = rf"{_BLOCK}|(?<!\w)(?:{_OTHERS})"
#: Keys whose assigned values are labelled secrets by default.
SECRET_KEY = rf"{_GIVEN}[\"']?$"
#: Values that stand for no secret.
_NONE = (r"^(?:(?i:none|null|nil|true|false|undefined|empty|x+|\*+|\.+)|\$\{[^}]*\}|\$[A-Z_][A-Z0-9_]*"
         r"|%[A-Z_]+%|<[^>]*>|\{\{.*\}\})$")
FEATURES = ["length", "transitions", "digits", "upper", "lower", "symbols", "hex", "blanks", "dictionary", "slashes",
            "dots", "path_before", "quoted", "closed", "gap", "plain_before",
            *[f"before_{k}" for k in range(BEFORE)], *[f"after_{k}" for k in range(AFTER)]]
_WORD = "[a-z]{3,}+"


def _words(text: Column) -> Column:
    """Lower-case words of three letters or more; a capital after a small letter begins one."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), F.lit(_WORD), F.lit(0))


def word_array(words: list[str]) -> Column:
    """Words (of a-z alone) as one constant; a text is parsed at once, thousands of literals are not."""
    return F.expr(f"CAST(array({', '.join(repr(w) for w in words)}) AS array<string>)")


def _covered(words: Column, dictionary: Column) -> Column:
    """Letters of ``words`` that are words of the dictionary."""
    known = F.filter(words, lambda w: F.array_contains(dictionary, w))
    return F.aggregate(known, F.lit(0), lambda n, w: n + F.length(w)).cast("double")


def _features(m: Column, before: Column, after: Column, dictionary: Column) -> Column:
    classes = F.regexp_replace(m, "[a-z]++|[A-Z]++|[0-9]++|[^A-Za-z0-9]++", "x")
    length = F.length(m).cast("double")
    ahead, behind = _words(before), _words(after)
    bucket = lambda w, n: F.pmod(F.xxhash64(w), F.lit(n))
    last, first = bucket(F.try_element_at(ahead, F.lit(-1)), BEFORE), bucket(F.try_element_at(behind, F.lit(1)), AFTER)
    values = {
        "length": length, "transitions": (F.length(classes) - 1) / length, "digits": count_of(m, "[0-9]") / length,
        "upper": count_of(m, "[A-Z]") / length, "lower": count_of(m, "[a-z]") / length,
        "symbols": count_of(m, "[^A-Za-z0-9]") / length, "hex": flag(m.rlike("^[0-9A-Fa-f]++$")),
        "blanks": count_of(m, r"\s"), "dictionary": _covered(_words(m), dictionary) / length,
        "slashes": count_of(m, "/"), "dots": count_of(m, "[.]"), "path_before": flag(before.rlike(r"[/\\.]$")),
        "quoted": flag(before.rlike("[\"']$")), "closed": flag(after.rlike("^[\"']")),
        "gap": F.length(F.regexp_extract(before, "[^A-Za-z0-9]*+$", 0)).cast("double"),
        "plain_before": _covered(ahead, dictionary) / F.greatest(F.length(before), F.lit(1)),
        **{f"before_{k}": flag((F.size(ahead) > 0) & (last == k)) for k in range(BEFORE)},
        **{f"after_{k}": flag((F.size(behind) > 0) & (first == k)) for k in range(AFTER)},
    }
    return F.struct(*[values[f].alias(f) for f in FEATURES])


def _matches(docs: DataFrame, text: str, name: str) -> tuple[DataFrame, Matches]:
    scan = Matches(name, CANDIDATE, F.col(text).rlike(f"[0-9=:]|{TOKEN}"))
    return scan.add(docs, text), scan


def frequent_words(docs: DataFrame) -> list[tuple[str, int]]:
    """The most frequent words of all texts with their counts, most frequent first."""
    words = (docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("w"))
             .groupBy("w").count().orderBy(F.desc("count"), "w").limit(DICTIONARY_WORDS).collect())
    return [(r["w"], r["count"]) for r in words]


def labelled_secret(m: Column, before: Column, plain: Column) -> Column:
    """Whether a candidate is a secret by its format, or by a key and by not being plain words."""
    words = F.regexp_extract_all(F.lower(m), F.lit("[^\\s]+"), F.lit(0))
    short = "^[a-z]{1,2}$"  # the dictionary does not count these
    described = F.exists(words, lambda w: F.array_contains(plain, w)) & F.forall(
        words, lambda w: F.array_contains(plain, w) | w.rlike(short))
    return m.rlike(TOKEN) | (before.rlike(SECRET_KEY) & ~m.rlike(_NONE) & ~described)


def default_findings(docs: DataFrame, plain: list[str]) -> DataFrame:
    """(candidate, before, after, label) of every candidate, labelled by evidence."""
    scanned, scan = _matches(docs.select("doc_id", "text"), "text", "c")
    # materialised by row: exploded at once, the optimizer would scan each text several times
    held = checkpoint(scanned.select(F.col(scan.spans).alias("spans")))
    return (held.select(F.explode("spans").alias("c"))
            .select(F.col("c.m").alias("candidate"), "c.before", "c.after",
                    flag(labelled_secret(F.col("c.m"), F.col("c.before"), word_array(plain))).alias("label")))


class SecretForest:
    """A trained judge of candidates, as a column expression."""

    def __init__(self, docs: DataFrame, findings: DataFrame | None = None):
        words = frequent_words(docs)
        self.dictionary = word_array([w for w, _ in words])
        found = default_findings(docs, [w for w, n in words if n >= PLAIN_USES]) if findings is None else findings
        rows = found.select(
            F.xxhash64("candidate", "before", "after").alias("h"), F.col("label").cast("double").alias("label"),
            "candidate", "before", "after")
        sample = checkpoint(sample_rows(rows, "h", "label", MAX_ROWS).select(
            "label", _features(F.col("candidate"), F.col("before"), F.col("after"), self.dictionary).alias("f"))
            .select("label", "f.*"))
        self.model = fit_trees(RandomForestClassifier(numTrees=40, maxDepth=8, seed=3, featureSubsetStrategy="sqrt"),
                               sample, FEATURES, "label")
        only = sample.agg(F.max("label")).first()[0] if self.model is None else None
        self.constant = 0.0 if only is None else float(only)
        self.judgement = "" if self.model is None else forest_text(self.model, FEATURES, "f")

    def judge(self, docs: DataFrame, text: str, prefix: str) -> tuple[DataFrame, str, Matches]:
        """Adds, beside the candidates, an array of P(secret) per candidate."""
        df, scan = _matches(docs, text, prefix)
        name, features = f"{prefix}_p", f"{prefix}_features"
        df = df.withColumn(features, F.transform(F.col(scan.spans), lambda c: _features(
            c["m"], c["before"], c["after"], self.dictionary)))
        judged = f"{self.constant!r}D" if self.model is None else self.judgement
        return df.withColumn(name, F.expr(f"transform({features}, f -> {judged})")).drop(features), name, scan


def _redacted(scan: Matches, p: str, threshold: float) -> Column:
    """The text rebuilt from pieces and candidates, secrets replaced."""
    parts = F.transform(F.col(scan.spans), lambda c, i: F.concat(
        F.element_at(F.col(scan.pieces), i + 1),
        F.when(F.element_at(F.col(p), i + 1) >= threshold, MARK).otherwise(c["m"])))
    return F.concat(F.array_join(parts, ""), F.element_at(F.col(scan.pieces), -1))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, candidates, secrets (array<struct<start, end, p>>), redacted of every row."""
    forest = SecretForest(docs, findings)
    df, p, scan = forest.judge(docs.select("doc_id", "text"), "text", "c")
    scored = F.zip_with(F.col(scan.spans), F.col(p), lambda c, q: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), q.alias("p")))
    empty = F.array().cast("array<struct<start: long, end: long, p: double>>")
    return df.withColumn("scored", F.coalesce(scored, empty)).select(
        "doc_id", "scored", F.filter("scored", lambda c: c["p"] >= threshold).alias("secrets"),
        F.when(F.col("text").isNotNull(), _redacted(scan, p, threshold)).alias("redacted")).withColumnRenamed(
        "scored", "candidates")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start:end of secrets, comma-joined), redacted_sha256."""
    return scan_secrets(docs).select(
        "doc_id", F.size("candidates").cast("long").alias("n_candidates"),
        F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(F.transform("secrets", lambda c: F.concat_ws(":", c["start"], c["end"])), ",").alias("spans"),
        F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"))


def redact_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, with secrets in ``text`` replaced by ``MARK``."""
    forest = SecretForest(docs, findings)
    prefix = fresh_name(docs, "secret_scan")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    df, p, scan = forest.judge(docs, "text", prefix)
    return df.withColumn("text", F.when(F.col("text").isNotNull(), _redacted(scan, p, threshold))).select(*[
        F.col(f"`{c}`") for c in docs.columns])

"""Personal data: base patterns, and boosted trees over high-recall candidates.

Base spans are the leftmost non-overlapping matches of a pattern per kind that
pass the kind's check. Generators then propose many more, overlapping spans:
everything that the base patterns match, number runs with loose separators, and
addresses with a written-out "at". Gradient-boosted trees score each candidate
from its format (length, digits, groups, separators, signs) and its context
(what touches it, key words before it). They are trained on the candidates of all
documents: equal ones are counted, and the counts are the weights. No group (those
that overlap a base span, others of either label) weighs more than ``GROUP_WEIGHT``
in all, so that none takes the room of another. Right are those that overlap a base span, and of the others those with
evidence that the base patterns do not hold: a written-out address, a national
number by format or by the key word before it, a card in groups or named one
with a right check digit. Half of the candidates are held back, and the threshold of
a kind is the lowest score at which the held-back candidates of that kind that
overlap no base span are right in ``PRECISION`` of cases. Candidates with
evidence or above the threshold that overlap no base span are added; base spans
stay.

Everything is DataFrame expressions: patterns, checks, features, and the trees
as nested conditions, all within the row of a document. Scanned texts are left
behind in a checkpoint that holds only the candidates. Patterns are written with
possessive runs, so that very long texts cost linear time and no deep stack;
their matches are those of the contract's patterns.

Positions are code points, ends exclusive. Edge cases: null and empty texts have
no span. Rows that repeat a doc_id or have none are rows of their own. With
candidates of one label alone only those with evidence are added. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubewash.llm.common import checkpoint
from cubewash.llm.native_spans import (
    Matches, boosted_probability, count_of, digits_of, fit_trees, flag, luhn)

KINDS = ["email", "ip", "card", "phone"]
GROUP_WEIGHT = 3000
CASES_A_TASK = 50_000  # distinct cases that a training task reads
PRECISION = 0.98
LEAST_CALIBRATION = 20  # held-back candidates of a kind without which nothing of it is added

#: The contract's patterns. Where one starts, a longer run cannot: the look-behind saves retries.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide generators: (pattern, what a text must hold).
WIDE = {
    "number": r"[+(]?[0-9][0-9().\x20/_-]{5,40}[0-9]",
    "written": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:[(\[]at[)\]]|@)\s?[A-Za-z0-9-]++"
               r"(?:(?:\.|\x20\.\x20|\s?[(\[]dot[)\]]\s?)[A-Za-z0-9-]++)++",
}
_CALLED = r"(?i)\b(?:tele)?(?:phone|tel|call|fax|mobile|cell)s?\b[^0-9]{0,12}$"
FEATURES = ["length", "digits", "letters", "groups", "dots", "dashes", "blanks", "at", "plus", "brackets",
            "joined_before", "joined_after", "quoted", "mail_word", "phone_word", "card_word", "net_word",
            "four_parts", "checks"]


def _valid_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
                    & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))


def _valid_card(m: Column) -> Column:
    d = digits_of(m)
    return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)


def _valid_phone(m: Column) -> Column:
    return F.length(digits_of(m)).between(8, 15)


CHECKS = {"email": lambda m: F.lit(True), "ip": _valid_ip, "card": _valid_card, "phone": _valid_phone}


def _features(c: Column) -> Column:
    m, before, after = c["m"], c["before"], c["after"]
    d = digits_of(m)
    word = lambda p: flag(before.rlike(f"(?i){p}"))
    values = {
        "length": F.length(m).cast("double"), "digits": F.length(d).cast("double"),
        "letters": count_of(m, "[A-Za-z]"),
        "groups": F.size(F.split(m, "[^0-9]+")).cast("double"), "dots": count_of(m, "[.]"),
        "dashes": count_of(m, "[-]"), "blanks": count_of(m, r"[\x20]"), "at": flag(m.rlike("@|at[)\\]]")),
        "plus": flag(m.startswith("+")), "brackets": count_of(m, "[()]"),
        "joined_before": flag(before.rlike("[A-Za-z0-9_+/=.-]$")),
        "joined_after": flag(after.rlike("^[A-Za-z0-9_+/=-]")),
        "quoted": flag(before.rlike("[\"']$") | after.rlike("^[\"']")),
        "mail_word": word("mail|contact"), "phone_word": word("phone|tel|call|fax|mobile"),
        "card_word": word("card|visa|account|iban"), "net_word": word(r"\bip\b|host|addr|server"),
        "four_parts": flag(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")),
        "checks": flag(F.when(F.length(d).between(13, 19), luhn(d))),
    }
    return F.struct(*[values[f].alias(f) for f in FEATURES])


def _kind_of(generator: str, c: Column) -> Column:
    """The kind that a wide candidate would be a case of."""
    if generator == "written":
        return F.lit("email")
    m, n = c["m"], F.length(digits_of(c["m"]))
    return F.when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip").when(
        (n >= 13) & ~((n <= 15) & c["before"].rlike(_CALLED)), "card").otherwise("phone")


def _evidence(generator: str, c: Column) -> Column:
    """Whether key words, check digits or the format say that a wide candidate is personal data.

    The base patterns hold none of it.
    """
    m, before = c["m"], c["before"]
    if generator == "written":
        top = m.rlike(r"(?i)(?:\.\x20?|dot[)\]]\s?)[a-z]{2,}$")
        return top & (m.rlike(r"(?i)[(\[]at[)\]]") | before.rlike(r"(?i)\b(?:e-?mail|contact|write)\b"))
    if generator != "number":
        return F.lit(False)
    d = digits_of(m)
    date = m.rlike(r"^(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})\b")
    national = m.rlike(r"^(?:\([0-9]{2,5}\)\x20?|[0-9]{3}[-.])[0-9]{3,4}[-.\x20][0-9]{4}$")
    phone = F.length(d).between(7, 15) & (national | before.rlike(_CALLED)) & ~date
    grouped = m.rlike(r"^[0-9]{4}([^0-9])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([^0-9])[0-9]{6}\2[0-9]{5}$")
    card = F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False) & (
        grouped | before.rlike(r"(?i)\b(?:card|visa|mastercard|amex)\b"))
    kind = _kind_of(generator, c)
    return F.when(kind == "phone", phone).when(kind == "card", card).otherwise(False)


def _scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates) of every row: spans that pass, and all proposals with features."""
    t = F.col("text")
    digit = t.rlike("[0-9]")
    may = {"email": F.instr(t, "@") > 0, "ip": digit, "card": digit, "phone": F.instr(t, "+") > 0,
           "number": digit, "written": F.lower(t).rlike(r"@|[(\[]at[)\]]")}
    scans = {name: Matches(name, pattern, may[name]) for name, pattern in {**PATTERNS, **WIDE}.items()}
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for scan in scans.values():
        df = scan.add(df, "text").drop(scan.pieces, scan.found)

    def passing(kind: str) -> Column:
        kept = F.filter(scans[kind].spans, lambda c: CHECKS[kind](c["m"]))
        return F.transform(kept, lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"),
                                                    c["end"].alias("end")))

    def proposals(name: str, scan: Matches) -> Column:
        kind = (lambda c: F.lit(name)) if name in KINDS else (lambda c: _kind_of(name, c))
        overlaps = lambda c: F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return F.transform(scan.spans, lambda c: F.struct(
            kind(c).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            _features(c).alias("f"), overlaps(c).alias("is_base"), _evidence(name, c).alias("evidence")))

    df = df.withColumn("base", F.concat(*[passing(k) for k in KINDS]))
    proposed = F.concat(*[proposals(name, scan) for name, scan in scans.items()])
    return checkpoint(df.select("doc_id", "base", proposed.alias("candidates")))


def _cases(scanned: DataFrame) -> DataFrame:
    """All candidates: the distinct ones of each half, and how many there are (n)."""
    half = F.pmod(F.xxhash64("doc_id", "c.kind", "c.start", "c.end"), F.lit(2)) == 0
    rows = scanned.select("doc_id", F.explode("candidates").alias("c")).select(
        half.alias("half"), "c.kind", "c.f.*", "c.is_base",
        flag(F.col("c.is_base") | F.col("c.evidence")).alias("label"))
    return checkpoint(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))


def _fit(cases: DataFrame):
    """Trees of all cases of the training half, None if they have one label alone."""
    groups = cases.groupBy("is_base", "label").agg(F.sum("n").alias("total"))  # three rows at most
    train = cases.where("half").join(F.broadcast(groups), ["is_base", "label"]).withColumn(
        "weight", F.col("n") * F.least(F.lit(1.0), F.lit(GROUP_WEIGHT) / F.col("total")))
    parts = -(-max(1, cases.count()) // CASES_A_TASK)
    train = train.coalesce(parts).sortWithinPartitions("label", "is_base", "kind", *FEATURES)
    return fit_trees(GBTClassifier(maxIter=12, maxDepth=4, seed=3), train, FEATURES, "label", "weight", parts)


def _thresholds(held_back: DataFrame, score: Column) -> dict[str, float]:
    """Per kind, the lowest score above which PRECISION of the held-back candidates are right."""
    scores = held_back.groupBy("kind", score.alias("score")).agg(
        F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("every"))
    down = Window.partitionBy("kind").orderBy(F.desc("score"))  # a row per different score
    sums = scores.select("kind", "score", F.sum("right").over(down).alias("right"), F.sum("every").over(down).alias("every"))
    enough = (F.col("every") >= LEAST_CALIBRATION) & (F.col("right") / F.col("every") >= PRECISION)
    return {r["kind"]: r["score"] for r in sums.where(enough).groupBy("kind").agg(F.min("score").alias("score")).collect()}


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, added: arrays of struct<kind, start, end>, each by kind as listed, then start."""
    scanned = _scan(docs)
    cases = _cases(scanned)
    model = _fit(cases)
    chosen = lambda c: c["evidence"]
    if model is not None:
        held_back = cases.where(~F.col("half") & ~F.col("is_base")).select(
            "kind", "label", "n", F.struct(*FEATURES).alias("f"))
        limits = _thresholds(held_back, boosted_probability(model, FEATURES, F.col("f")))
        if limits:
            least = lambda kind: F.coalesce(*[F.when(kind == k, v) for k, v in limits.items()], F.lit(2.0))
            chosen = lambda c: c["evidence"] | (
                boosted_probability(model, FEATURES, c["f"]) >= least(c["kind"]))
    picked = F.filter("candidates", lambda c: ~c["is_base"] & chosen(c))
    # equal spans of two generators are one; of overlapping ones all stay, as redaction joins them
    added = F.array_distinct(F.transform(picked, lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    return scanned.select("doc_id", _ordered(F.col("base")).alias("base"), _ordered(added).alias("added"))


def _ordered(spans: Column) -> Column:
    """By kind as listed, then start and end."""
    place = F.array(*map(F.lit, KINDS))
    sortable = F.transform(spans, lambda c: F.struct(
        F.array_position(place, c["kind"]).alias("place"), c["start"].alias("start"), c["end"].alias("end"),
        c["kind"].alias("kind")))
    return F.transform(F.array_sort(sortable), lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")


def _count_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long")


def personal_data_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans (base and added) of every row."""
    found = find_personal_data(docs)
    every = _ordered(F.concat("base", "added"))
    return found.select(
        "doc_id", *[_count_kind(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))

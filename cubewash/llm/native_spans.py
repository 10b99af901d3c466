"""Candidate spans and tree ensembles as DataFrame expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters kept on either side of a candidate.
CONTEXT = 24
_BLOCK = 256


def running_sums(lengths: Column) -> Column:
    """Inclusive running sums of an array of longs.

    Appending to an array copies it, so sums run within blocks and over the
    blocks' totals; a text with very many matches stays cheap.
    """
    zero = F.lit(0).cast("long")
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))),
        lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    totals = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda acc, v: acc + v))
    before = F.aggregate(totals, F.array(zero), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    return F.flatten(F.transform(blocks, lambda x, b: F.slice(F.aggregate(
        x, F.array(F.element_at(before, b + 1)),
        lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))), 2, F.size(x))))


class Matches:
    """Columns of the leftmost non-overlapping matches of a pattern: pieces between them, and spans.

    ``may`` is a cheap condition without which there is no match.
    """

    def __init__(self, name: str, pattern: str, may: Column):
        self.name, self.pattern, self.may = name, pattern, may
        self.pieces, self.found, self.spans = f"{name}_pieces", f"{name}_found", f"{name}_spans"

    def add(self, df: DataFrame, text: str) -> DataFrame:
        """Adds ``pieces``, ``found`` and ``spans``: array<struct<start, end, m, before, after>>."""
        t, pattern = F.col(text), F.lit(self.pattern)
        df = df.withColumn(self.found, F.when(self.may, F.regexp_extract_all(t, pattern, F.lit(0)))
                           .otherwise(F.array().cast("array<string>")))
        some = F.size(self.found) > 0
        df = df.withColumn(self.pieces, F.when(some, F.split(t, self.pattern, -1)).otherwise(F.array(t)))
        ends = f"{self.name}_ends"
        df = df.withColumn(ends, F.when(some, running_sums(F.zip_with(
            F.slice(F.col(self.pieces), 1, F.size(self.found)), F.col(self.found),
            lambda p, m: (F.length(p) + F.length(m)).cast("long")))).otherwise(F.array().cast("array<long>")))
        pieces, end = F.col(self.pieces), F.col(ends)
        spans = F.transform(F.col(self.found), lambda m, i: F.struct(
            (F.element_at(end, i + 1) - F.length(m)).alias("start"), F.element_at(end, i + 1).alias("end"),
            m.alias("m"), F.right(F.element_at(pieces, i + 1), F.lit(CONTEXT)).alias("before"),
            F.left(F.element_at(pieces, i + 2), F.lit(CONTEXT)).alias("after")))
        return df.withColumn(self.spans, spans).drop(ends)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    doubled = F.array(*[F.lit(2 * d if d < 5 else 2 * d - 9) for d in range(10)])
    value = lambda c: c.cast("int")
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""),
                    lambda c, i: F.when(c == "", 0).when(i % 2 == 1, F.element_at(doubled, value(c) + 1))
                    .otherwise(value(c))),
        F.lit(0), lambda acc, v: acc + v)
    return total % 10 == 0


def count_of(m: Column, pattern: str) -> Column:
    """Characters of ``m`` that a class of characters holds."""
    return (F.length(m) - F.length(F.regexp_replace(m, pattern, ""))).cast("double")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def sample_rows(rows: DataFrame, by: str, label: str, most: int) -> DataFrame:
    """At most ``most`` rows of each label, those of the smallest ``by`` (a hash)."""
    parts = [rows.where(F.col(label) == v).orderBy(by, *rows.columns).limit(most) for v in (0.0, 1.0)]
    return parts[0].unionByName(parts[1])


def fit_trees(classifier, rows: DataFrame, features: list[str], label: str, weight: str | None = None, parts: int = 1):
    """A fitted tree ensemble, or None if the rows do not have both labels.

    ``weight`` names what a row counts for (1 without); the rows are read in at most ``parts`` tasks.
    """
    data = VectorAssembler(inputCols=features, outputCol="_features").transform(rows).select(
        "_features", F.col(label).alias("_label"), (F.col(weight) if weight else F.lit(1.0)).alias("_weight"))
    data = data.coalesce(parts).cache()
    try:
        if data.select("_label").distinct().count() < 2:
            return None
        if weight:
            classifier.setWeightCol("_weight")
        return classifier.setFeaturesCol("_features").setLabelCol("_label").fit(data)
    finally:
        data.unpersist()


def _node(node, leaf, of: Column, features: list[str]) -> Column:
    if not hasattr(node, "split") or node.subtreeDepth() == 0:
        return F.lit(float(leaf(node)))
    split = node.split()
    return F.when(of[features[split.featureIndex()]] <= float(split.threshold()),
                  _node(node.leftChild(), leaf, of, features)).otherwise(
        _node(node.rightChild(), leaf, of, features))


def boosted_probability(model, features: list[str], of: Column) -> Column:
    """P(label 1) of gradient-boosted trees, as nested conditions on fields of ``of``."""
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights):
        margin = margin + float(weight) * _node(tree._java_obj.rootNode(), lambda n: n.prediction(), of, features)
    return 1 / (1 + F.exp(-2 * margin))


def forest_text(model, features: list[str], of: str) -> str:
    """P(label 1) of a random forest as SQL text over fields of the struct ``of``: the mean over
    trees of the leaf's share of label 1. A text is parsed at once; built from Columns, some
    thousand conditions take Python longer than the scan."""
    def node(n) -> str:
        if n.subtreeDepth() == 0:
            stats = list(n.impurityStats().stats())
            return f"{stats[1] / sum(stats)!r}D"
        split = n.split()
        return (f"CASE WHEN {of}.{features[split.featureIndex()]} <= {float(split.threshold())!r}D "
                f"THEN {node(n.leftChild())} ELSE {node(n.rightChild())} END")

    trees = [node(tree._java_obj.rootNode()) for tree in model.trees]
    return f"({' + '.join(f'({t})' for t in trees)}) / {float(len(trees))}D"

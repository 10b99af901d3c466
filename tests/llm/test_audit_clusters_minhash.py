"""Filter audit, centroid clustering and SuperMinHash against brute force, with their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubewash.llm import centroid_clusters, filter_audit, superminhash

SPACES = " \t\n\x0b\x0c\r"


def words_of(text: str) -> list[str]:
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- filter audit ---------------------------------------------------------------------

AUDIT_SCHEMA = "doc_id long, text string, lang string, digest string, good string, n int"


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        k = rng.choice([40, 99, 100, 130, 400])
        words = [rng.choice(vocabulary[: rng.choice([30, 400])]) for _ in range(k)]
        if i % 7 == 0:
            words = [w.upper() + "ABC" for w in words]
        text = " ".join(words) + ("" if i % 3 else " a|b")
        rows.append((i, text, rng.choice(["en", "de", None, ""])))
    rows += [(100, rows[4][1], "en"), (101, rows[4][1], "de"), (2, rows[4][1], "en"), (100, rows[4][1], "en"),
             (None, rows[4][1], "en"), (None, None, None), (102, None, "fr"), (103, "", "fr"), (104, " \t", "fr"),
             (105, "é" * 30 + "AB", "fr"), (106, "Word " * 200_000, "xx"), (107, "a b " * 120, "xx")]
    return rows


def brute_audit(rows, labels):
    def fails(doc_id, text):
        text = text or ""
        w = words_of(text)
        out = set()
        if len(w) < 100:
            out.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            out.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            out.add("C")
        if any(c in text for c in "#$%&*|"):
            out.add("D")
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows):
            out.add("E")
        return out

    judged = [(lang or "", fails(d, t), any(x == d and q == 1 for x, q, _ in labels if d is not None),
               any(x == d and t == 1 for x, _, t in labels if d is not None)) for d, t, lang in rows]
    want = {}
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                redundant = sum(f in j[1] for j in own) - len(gone)
                left = [j for j in left if f not in j[1]]
                shapley[f] += len(gone)
                want[part, order, step] = [len(left), len(gone), redundant, sum(j[1] == {f} for j in own),
                                           sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, step), values in want.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return want


def test_audit_equals_brute_force(spark, audit_rows):
    labels = [(i, i % 2, (i // 3) % 2) for i in range(0, 110, 2)] + [(4, 1, 0), (4, None, 1), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in audit_rows], AUDIT_SCHEMA)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, digest string")
    got = filter_audit.audit(docs, marks).collect()
    want = brute_audit(audit_rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want
    assert len(got) == len(want)


def test_audit_of_one_hot_text_and_of_nothing(spark):
    rows = [(i, "same text", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, none).collect()}
    assert got["EABCD", 1]["removed"] == 299 and got["EABCD", 2]["removed"] == 1 and got["EABCD", 2]["redundant"] == 299
    assert got["ABCDE", 5]["redundant"] == 299 and got["ABCDE", 5]["unique_fails"] == 0
    assert filter_audit.audit(docs.where("false"), none).count() == 0


def test_removal_steps_are_the_min_plus_product():
    orders = np.array(list(itertools.permutations(range(3))))
    got = filter_audit.removal_steps(np.arange(8), orders)
    for fails in range(8):
        for k, order in enumerate(orders.tolist()):
            steps = [i for i, f in enumerate(order, 1) if fails >> f & 1]
            assert got[fails, k] == min(steps, default=4)


# --- centroid clustering --------------------------------------------------------------

def brute_clusters(rows, dim, clusters, rounds, seed):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode())
                                        .hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == k]
            if own:
                centroids[k] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    total = sum(d for d, _ in found)
    return sorted((str(i), k, d, sum(x for x, c in found if c == k), total,
                   hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())
                  for (i, _), (d, k) in zip(kept, found))


@pytest.mark.parametrize("count", [0, 3, 90])
def test_clusters_equal_brute_force(spark, count):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(count)]
    if count > 50:
        rows[20:30] = [(i, rows[7][1]) for i in range(20, 30)]  # ties and equal centroids
        rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (200, None), (201, [1.0] * 4), (202, []),
                 (203, [1.0, None, 1.0, 1.0, 1.0]), (204, [float("nan")] * 5), (205, [float("-inf")] + [1.0] * 4),
                 (206, [0.0] * 5), (207, [-1000.5] * 5)]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows],
                               "vec_id long, embedding array<float>, cluster int, x string")
    got = centroid_clusters.cluster_vectors(df, dim=5, clusters=8, rounds=6)
    assert dict(got.dtypes)["cluster"] == "int"
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute_clusters(rows, 5, 8, 6, 3)


def test_clusters_of_doubles_use_their_whole_precision(spark):
    df = spark.createDataFrame([(1, [0.9999999999 / 1024]), (2, [1.0 / 1024])], "vec_id long, embedding array<double>")
    assert [r["x"] for r in centroid_clusters.integer_vectors(df, dim=1).orderBy("vec_id").collect()] == [[0], [1]]


# --- SuperMinHash ---------------------------------------------------------------------

def reference_signature(hashes, size):
    """The walk of one shingle after another, without early stop."""
    least = [2**64] * size
    for h in hashes.tolist():
        place = list(range(size))
        for rank in range(size):
            with np.errstate(over="ignore"):
                draw = int(superminhash.mix(np.array([h], np.uint64) ^ (np.uint64(rank + 1) * superminhash._STEP))[0])
            pick = rank + ((draw & 0xFFFFFFFF) * (size - rank) >> 32)
            place[rank], place[pick] = place[pick], place[rank]
            least[place[rank]] = min(least[place[rank]], rank << 32 | draw >> 32)
    return least


def test_signatures_equal_the_walk_without_early_stop():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 7, 40, 300)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = superminhash.super_minhash(np.concatenate(sets), offsets, 24)
    assert [g.tolist() for g in got] == [reference_signature(s, 24) for s in sets]


def test_signatures_estimate_with_less_variance_than_independent_minima():
    rng = np.random.default_rng(7)
    errors = []
    for _ in range(300):
        pool = rng.integers(0, 2**63, 30, dtype=np.uint64)
        a, b = np.unique(pool[:24]), np.unique(pool[6:])
        x, y = (superminhash.super_minhash(s, np.array([0, len(s)]), 64)[0] for s in (a, b))
        errors.append((x == y).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02
    assert np.var(errors) < 0.8 * 0.6 * 0.4 / 64


def brute_near(rows, shingle=3):
    sets = []
    for _, text in rows:
        w = words_of(lowered(text or ""))
        sets.append({" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = (min(ids) if ids else None) if sets[i] else doc_id
        out.append((str(doc_id), len(sets[i]), str(component), doc_id == component))
    return sorted(out)


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "the in on er st".split() for b in range(60)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 90)))) for i in range(60)]
    for i in range(160):  # a dense group: some pairs link, most do not
        w = list(base)
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((500 - i, " ".join(w).replace("the", "The")))
    rows += [(5000 + i, " ".join(base[i:i + 120])) for i in range(0, 30, 2)]  # a chain
    rows += [(i, rows[3][1]) for i in range(2000, 2030)]
    rows += [(7, None), (8, None), (9, ""), (10, " \t\r\n"), (None, ""), (11, "one"), (12, "ONE"), (13, "one two"),
             (14, "one two"), (1000, rows[0][1]), (1000, rows[1][1]), (None, rows[2][1]), (None, "alone null row here"),
             (15, "é ß é ß é"), (16, "É ß é ß é"), (17, "z" * 30_000 + " y x w"), (18, "ab cd ef " * 30_000),
             (19, "ab cd ef " * 9_000), (20, "one\x1ctwo"), (21, "one two")]
    return rows


@pytest.mark.parametrize("block", [512, 20])
def test_near_duplicates_equal_brute_force(spark, near_rows, block, monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK", block)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in near_rows],
                                 "doc_id long, text string, node string, n int, id int")
    got = superminhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got.collect()) == brute_near(near_rows)


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert superminhash.near_duplicates(docs).count() == 0
    blank = spark.createDataFrame([(3, None), (4, " ")], "doc_id long, text string")
    assert sorted(map(tuple, superminhash.near_duplicates(blank).collect())) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_band_settling_compares_across_components_only(spark):
    rows = [(1, "a b c d e f g h", 1), (2, "a b c d e f g h i", 2), (3, "a b c d e f g h j", 2), (4, "q r s t u", 4)]
    import pyarrow as pa

    table = pa.table({"id": pa.array([r[0] for r in rows]), "root": pa.array([r[2] for r in rows]),
                      "side": pa.array([0] * 4), "text": pa.array([r[1] for r in rows])})
    assert superminhash._settle(table, 3, 85).to_pydict() == {"a": [1], "b": [2]}
    apart = table.set_column(2, "side", pa.array([1, 1, 2, 2]))
    assert superminhash._settle(apart, 3, 85).to_pydict() == {"a": [1], "b": [3]}


def test_plan_of_the_audit_counts_before_it_shuffles_texts(spark, audit_rows):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in audit_rows], AUDIT_SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = filter_audit.failure_weights(docs, none)
    assert weights.groupBy().agg(F.sum("weight")).first()[0] == len(audit_rows)

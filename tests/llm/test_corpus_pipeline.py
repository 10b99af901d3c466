"""The corpus pipeline, stage by stage: whole input, decisions that take effect, edge cases."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cubewash.llm import byte_cnn_quality, simhash_vptree
from cubewash.llm.queries import tokenizer_path

#: Columns beside text that have names the stages might want for themselves.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, matches int, text_hash string, "
          "score double, secret_scan string, token_ids string, fp long")
SECRET = "0123456789abcdef0123456789abcdef01234567"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(10)
    words = ["the", "thing", "on", "river", "station", "quiet", "letter", "morning", "under", "garden", "walks"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "ly", "s"]) for _ in range(n))
    junk = lambda n: "".join(rng.choice("#$%&*|0123456789@@") for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(rng.randint(30, 90))) for i in range(80)]
    rows += [(100 + i, junk(rng.randint(80, 300))) for i in range(60)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1]), (202, f"{prose(20)} {passage} {prose(20)}"),
             (203, f'{prose(30)} token = "{SECRET}" {prose(30)}'), (204, None), (205, None), (206, ""), (207, " \n\t"),
             (None, prose(40)), (None, None), (208, prose(40_000)), (209, "é ß " * 50 + prose(40))]
    labels = [(i, 1 if i < 80 else 0, 0) for i in [*range(80), *range(100, 160)]]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 0.5, "y", "z", 7) for i, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path, passage


@pytest.fixture(scope="module")
def stages(spark, folder):
    """[(name, input, output)] of every stage, each written and read as the next one's docs."""
    path, _ = folder
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/stage-{k}")
        result = spark.read.parquet(f"{path}/stage-{k}")
        out.append((name, docs, result))
        docs = result
    return out


def keys(df):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.select("doc_id", "text").collect())


def test_stages_are_the_dealt_ones_and_keep_the_columns(stages):
    assert [name for name, _, _ in stages] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "bpe_encode_decode"]
    for _, docs, result in stages[:-1]:
        assert result.dtypes == docs.dtypes and set(keys(result)) - set(keys(docs)) <= {
            k for k in keys(result) if "[SECRET]" in k[1]}


def test_quality_rejects_what_its_score_rejects(spark, folder, stages):
    path, _ = folder
    _, docs, kept = stages[0]
    scored = byte_cnn_quality.score_quality(docs.withColumnRenamed("score", "other"),
                                            spark.read.parquet(f"{path}/labels.parquet"))
    assert kept.count() == scored.where("predicted = 1").count()
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & set(range(80))) >= 78 and len(ids & set(range(100, 160))) <= 2


def test_one_row_of_each_group_stays(stages):
    _, docs, kept = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    prints = [simhash_vptree.simhash((t or "").encode()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for i, (doc_id, text) in enumerate(rows):
        least = (doc_id is None, doc_id if doc_id is not None else 0)
        first[group[i]] = min(first.get(group[i], least), least)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(first.values())


def test_passages_go_and_clean_documents_stay(folder, stages):
    _, passage = folder
    _, docs, kept = stages[2]
    assert [k for k in keys(docs) if k not in keys(kept)] == [k for k in keys(docs) if passage in k[1]]


def test_secrets_are_replaced_and_nothing_else_is(stages):
    _, docs, kept = stages[3]
    assert sorted((k, t.replace(SECRET, "[SECRET]")) for k, t in keys(docs)) == keys(kept)
    assert kept.where(F.col("text").contains(SECRET)).count() == 0


def test_tokens_equal_the_library(stages):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    _, docs, result = stages[4]
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(r["doc_id"]), len(ids), ids, hashlib.sha256(text.encode()).hexdigest()))
    assert result.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"]
    assert sorted((str(r[0]), r[1], list(r[2]), r[3]) for r in result.collect()) == sorted(want)


def test_run_applies_all_stages(spark, folder, stages):
    path, _ = folder
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in corpus_pipeline.run(spark, path).collect())
    assert got == sorted((str(r["doc_id"]), r["n_tokens"]) for r in stages[4][2].collect())


def test_an_empty_table_goes_through(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

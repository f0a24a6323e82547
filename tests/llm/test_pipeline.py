"""The corpus pipeline's stages on odd rows, and from end to end."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, spark, labels):
    path = tmp_path_factory.mktemp("tables")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_on_odd_rows(spark, odd, sf_dir):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count(), name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_stages_on_no_rows(spark, empty, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_one_of_each_group_stays(spark, odd, sf_dir):
    kept = corpus_pipeline.near_duplicate_stage(spark, odd, sf_dir)
    assert kept.where("doc_id in (4, 5)").count() == 1 and kept.where(F.col("doc_id") == 1).count() == 1


def test_repeats_cut_text(spark, odd, sf_dir):
    kept = {r["doc_id"]: r for r in corpus_pipeline.repeats_stage(spark, odd.where("doc_id >= 9"), sf_dir).collect()}
    assert kept[10]["text"] == "y" and kept[10]["n_chars"] == 1 and len(kept[9]["text"]) == 120 and kept[10]["source"] == "b"


def test_repeats_keep_other_columns(spark):
    line = "a passage of more than fifty bytes that two documents share, word by word"
    sql = f"""
        SELECT 1L AS doc_id, 'x {line}' AS text, timestamp'2020-01-02 03:04:05.123456' AS at, map(1, 'a', 2, 'b') AS m, named_struct('a b', 1, 'c.d', array(1.5D)) AS `s t`, 7L AS row, 'k' AS kept
        UNION ALL SELECT 2L, 'y {line}', NULL, map(3, 'c'), NULL, 8L, NULL UNION ALL SELECT NULL, 'z', NULL, NULL, NULL, 9L, 'q'"""
    docs = spark.sql(sql)
    out = corpus_pipeline.repeats_stage(spark, docs, "")
    assert out.schema.simpleString() == docs.schema.simpleString()
    got, want = {r["row"]: r for r in out.collect()}, {r["row"]: r for r in docs.collect()}
    assert got[7] == want[7] and got[9] == want[9] and got[8]["text"] == "y" and got[8]["m"] == {3: "c"}
    assert got[7]["at"].microsecond == 123456 and got[7]["s t"]["c.d"] == [1.5]


def test_a_text_is_never_lost(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    for rows in ([(3, b), (5, b), (5, a)], [(None, a), (1, a)], [(None, a), (1, a), (None, b), (None, b)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        kept = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
        assert sorted(t for _, t in kept) == sorted({t for _, t in rows})
        assert all(i is not None for i, t in kept if any(j is not None for j, u in rows if u == t))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables are not here")
def test_run(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert pieces.count() > 0 and pieces.where("length <= 0").count() == 0


def by_rule(texts):
    """Components of five-word shingle sets with a Jaccard similarity of 0.8 or more, by comparing all pairs."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near_copies_by_rule(spark):
    rng = np.random.default_rng(1)
    texts = []
    for family in range(30):
        first = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for changed in range(10):  # up to nine words: similarities on both sides of 0.8
            words = list(first)
            for at in rng.choice(200, changed, replace=False):
                words[at] = f"x{family}-{changed}-{at}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == set(by_rule(texts)) and 30 < len(kept) < 200


def test_rows_with_one_id_are_judged_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (None, b), (None, c), (3, b), (1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == [(1, a), (1, b), (None, c)]

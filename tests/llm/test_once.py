"""What a stage's tasks hold and move: texts meet a UDF once, rows of few are found without a shuffle."""

import numpy as np
from pyspark.sql import functions as F

from transloom.llm import partenum, suffix_dedup, toxicity
from transloom.llm.common import among

corpus_pipeline = __import__("pytest").importorskip("corpus_pipeline")


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_texts_meet_a_function_once(spark, odd, tmp_path):
    """A filter on a UDF's result makes no second Python worker a task."""
    rows = corpus_pipeline.repeats_stage(spark, odd, str(tmp_path))
    assert plan(rows).count("ArrowEvalPython") == 1
    assert plan(suffix_dedup.remove_repeats(odd).where(F.length("kept") > 0)).count("ArrowEvalPython") == 1
    found = toxicity._having(odd, {"=copy": 1.0, "=word": 0.5})
    assert plan(found).count("ArrowEvalPython") == 1
    assert {r["doc_id"]: r["found"] for r in found.where("doc_id in (4, 7)").distinct().collect()} == {4: ["=copy"], 7: ["=word"]}


def test_among(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 65536, (3 << 33) + 5, (3 << 33) + 32768]
    rows = spark.createDataFrame([(n + d, f"text {n + d}") for n in numbers for d in (0, 100_000)], "node long, text string")
    ids = spark.createDataFrame([(n,) for n in numbers[::2] + numbers[:1]], "node long")
    found = among(rows, ids, "node")
    assert found.columns == rows.columns
    assert sorted(found.collect()) == sorted(rows.join(ids.distinct(), "node", "left_semi").collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(among(rows, ids, "node"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert among(rows, ids.where("false"), "node").count() == 0


def test_cells_tell_long_texts_apart(spark):
    """Two sets of 2,000 features of which half are common never meet."""
    x = np.random.default_rng(3).integers(0, 1 << 63, 3050, dtype=np.uint64)
    sets = [x[:2000], x[1000:3000], x[50:2050]]
    nodes = spark.createDataFrame([(i, len(s), bytearray(partenum.cells(s).tobytes())) for i, s in enumerate(sets)], "node long, size int, cells binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "u long, v long")
    assert [tuple(r) for r in partenum.differ_little(pairs, nodes).collect()] == [(0, 2)]

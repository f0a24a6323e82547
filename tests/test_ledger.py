"""Hours under a ledger, backfills by hour, and powers of the network's matrix."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from transloom.operators import network
from transloom.sources import ledger, sinks

T0 = datetime(2019, 9, 1)
TRIP = "id long, timestamp timestamp_ntz, delay double"


def at(h, minute=0):
    return T0 + timedelta(hours=h, minutes=minute)


@pytest.fixture
def trees(tmp_path):
    return [f"{tmp_path}/{t}" for t in ("landing", "buffer", "ledger")]


def table(spark, *rows):
    return spark.createDataFrame(list(rows), TRIP)


def read(spark, tree, book, *args, **more):
    return sorted((r["id"], r["part_ts"], r["batch"]) for r in ledger.read_committed(spark, tree, book, *args, **more).collect())


def test_failure_between_the_trees_is_repaired_by_the_replay(spark, trees, monkeypatch):
    landing, buffer, book = trees
    with pytest.raises(FileNotFoundError):
        ledger.read_committed(spark, buffer, book)
    assert ledger.commit_hours(table(spark, (1, at(0, 5), 1.0), (1, at(0, 5), 1.0), (2, at(1), None)), *trees, 0)
    first = [(1, at(0), 0), (1, at(0), 0), (2, at(1), 0)]
    write, calls = ledger._write, []

    def fails(rows, tree):
        calls.append(tree)
        if tree == buffer:
            raise OSError("lost")
        write(rows, tree)

    monkeypatch.setattr(ledger, "_write", fails)
    with pytest.raises(OSError, match="lost"):
        ledger.commit_hours(table(spark, (3, at(1, 30), 2.0), (4, at(2), 2.0)), *trees, 1)
    monkeypatch.undo()
    # neither tree shows the open batch, although one has its files
    assert calls == [landing, buffer]
    assert read(spark, landing, book) == read(spark, buffer, book) == first
    # the replay has one hour less than the attempt; nothing of the attempt is left
    assert ledger.commit_hours(table(spark, (3, at(1, 30), 2.0)), *trees, 1)
    now = [*first[:2], (3, at(1), 1)]
    assert read(spark, landing, book) == read(spark, buffer, book) == now
    assert read(spark, landing, book, below=1) == first
    assert read(spark, landing, book, at(1), at(2)) == now[2:]
    assert read(spark, landing, book, at(5), at(9)) == []
    assert not ledger.commit_hours(table(spark, (9, at(1), 0.0)), *trees, 1)
    assert read(spark, landing, book) == now
    entries = {(r["hour"], r["batch"]): r["n"] for r in ledger.read_ledger(spark, book).collect()}
    assert entries == {(at(0), 0): 2, (at(1), 0): 1, (at(1), 1): 1}
    # a sweep takes the replaced hour only, retention works on the buffer alone
    assert ledger.sweep(spark, landing, book) == 1
    assert read(spark, landing, book) == now
    assert sinks.trim_retention(spark, buffer, at(2), 1) == 1
    assert read(spark, buffer, book) == now[2:] and read(spark, landing, book) == now


def test_trees_that_differ_do_not_complete(spark, trees, monkeypatch):
    landing, buffer, book = trees
    write = ledger._write
    monkeypatch.setattr(ledger, "_write", lambda rows, tree: write(rows.withColumn("delay", F.lit(0.0)) if tree == buffer else rows, tree))
    with pytest.raises(OSError, match="differs between the trees in 1 hours"):
        ledger.commit_hours(table(spark, (1, at(0), 1.0), (2, at(1), 0.0)), *trees, 0)
    assert ledger.read_ledger(spark, book).count() == 0


def test_odd_batches(spark, trees):
    assert ledger.commit_hours(table(spark), *trees, 0)
    assert not ledger.commit_hours(table(spark, (1, at(0), 0.0)), *trees, 0)
    assert ledger.read_ledger(spark, trees[2]).count() == 0 and ledger.sweep(spark, trees[0], trees[2]) == 0
    with pytest.raises(Exception, match="no timestamp"):
        ledger.commit_hours(table(spark, (1, None, 0.0)), *trees, 1)
    with pytest.raises(ValueError, match="batch"):
        ledger.commit_hours(table(spark).withColumn("batch", F.lit(1)), *trees, 1)


def test_micro_batches_merge_into_their_hours(spark, trees):
    landing, buffer, book = trees
    ledger.ingest_batch(table(spark, (1, at(0), 1.0), (2, at(1), 1.0)), 0, *trees, ["id"])
    late = table(spark, (3, at(0, 50), 1.0), (1, at(0), 5.0))
    assert ledger.ingest_batch(late, 1, *trees, ["id"]) and not ledger.ingest_batch(late, 1, *trees, ["id"])
    rows = sorted((r["id"], r["delay"], r["batch"]) for r in ledger.read_committed(spark, buffer, book).collect())
    assert rows == [(1, 5.0, 1), (2, 1.0, 0), (3, 1.0, 1)]
    ledger.ingest_batch(table(spark), 2, *trees, ["id"])
    assert len(read(spark, buffer, book)) == 3


def test_a_broken_file_fails_its_hour_only(spark, tmp_path, trees):
    source, outcomes = f"{tmp_path}/source", f"{tmp_path}/outcomes"
    rows = table(spark, *[(i, at(h, i), 1.0) for h in range(20) if h != 7 for i in range(h % 3 + 1)])
    sinks.write_hour_partition(rows, source)
    for h in (3, 12):
        for file in (tmp_path / "source" / "y=2019" / "m=9" / "d=1" / f"h={h}").iterdir():
            if file.suffix == ".crc":
                file.unlink()
            else:
                file.write_bytes(b"no Parquet at all")
    runs = []

    def land(some, run):
        runs.append((run, sorted({r[0].hour for r in some.select("timestamp").collect()})))
        return ledger.commit_hours(some, *trees, run)

    def once():
        report = ledger.backfill(spark, ledger.hour_source(spark, source, rows.schema), rows.schema, at(20, 30), outcomes, land, 20)
        return {r["hour"].hour: (r["n"], r["status"], r["error"] is not None, r["runs"]) for r in report.collect()}

    untried = ledger.backfill_report(spark, outcomes, at(20), 20)
    assert {(r["status"], r["runs"]) for r in untried.collect()} == {("untried", 0)}
    expected = {h: (h % 3 + 1, "ok", False, 1) for h in range(20)} | {7: (0, "empty", False, 1), 3: (0, "failed", True, 1), 12: (0, "failed", True, 1)}
    assert once() == expected
    sinks.write_hour_partition(table(spark, (1, at(3), 1.0), (2, at(7), 1.0)), source)
    assert once() == expected | {3: (1, "ok", False, 2), 7: (1, "ok", False, 2), 12: (0, "failed", True, 2)}
    assert [r[0] for r in runs] == [1, 2] and runs[1][1] == [3, 7]
    assert len({r[1] for r in read(spark, trees[1], trees[2])}) == 19
    # a run that landed but lost its outcome goes again as the next one
    (tmp_path / "outcomes" / "run=2" / "_SUCCESS").unlink()
    assert once() == expected | {3: (1, "ok", False, 2), 7: (1, "ok", False, 2), 12: (0, "failed", True, 2)}
    assert [r[0] for r in runs][2:] == [2, 3]


def test_hops_are_powers_of_one_matrix(spark):
    edges = [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 0.5), ("c", "b", 0.5), ("c", "d", 0.25), ("b", "c", 0.5), ("e", "a", 0.1)]
    values = [(0, "a", 3.0), (0, "b", None), (0, "d", -1.0), (1, "c", 2.0), (1, "e", 4.0), (2, "d", None)]
    w, d_out, d_in = {}, {}, {}
    for s, t, x in edges:
        w[s, t] = w.get((s, t), 0) + x
        d_out[s] = d_out.get(s, 0) + x
        d_in[t] = d_in.get(t, 0) + x
    features, table = spark.createDataFrame(values, "snapshot_ts int, node string, v double"), spark.createDataFrame(edges, "src string, dst string, count_norm double")
    expected = {(t, n): v for t, n, v in values}
    for hops in range(1, 6):
        step = {}
        for (s, t), x in w.items():
            for (at_, n), v in expected.items():
                if n == s:
                    step.setdefault((at_, t), []).append(None if v is None else v * x / (d_out[s] * d_in[t]) ** 0.5)
        expected = {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in step.items()}
        got = network.neighbor_aggregate(features, table, ["v"], hops)
        assert {(r["snapshot_ts"], r["node"]): r["v"] if r["v"] is None else pytest.approx(r["v"]) for r in got.collect()} == expected
        if hops == 4:
            # the matrix is a checkpoint by then: one join, that of the features
            assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert network.neighbor_aggregate(features, table, ["v"], 0) is features

"""Digests of a growing table in runs that are merged."""

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tablewright.streaming import signature_log
from tablewright.streaming.signature_log import SignatureLog, digest, next_merge, valid_runs


def test_a_thousand_batches_leave_few_runs():
    runs, rewritten = [(0, -1, -1)], 0
    for batch in range(1000):
        while part := next_merge([r for r in runs if r[2] < batch]):
            runs = [r for r in runs if r not in part] + [(part[0][0] + 1, part[0][1], part[-1][2])]
            rewritten += part[-1][2] - part[0][1] + 1
        runs.append((0, batch, batch))
        assert len(runs) <= 7 * 4 + 1
    assert sorted(b for r in runs for b in range(r[1], r[2] + 1)) == list(range(-1, 1000)) and rewritten <= 3.5 * 1001


def test_covered_runs_do_not_count():
    assert valid_runs([(0, 1, 1), (1, 0, 7), (0, 8, 8), (0, 3, 3)]) == [(1, 0, 7), (0, 8, 8)]
    assert next_merge([(0, 1, 1), (1, 0, 7), (0, 8, 8)], fan=2) == []


@pytest.fixture
def log(spark, tmp_path):
    return SignatureLog(spark, str(tmp_path / "log"), "sig", fan=3)


def rows(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").select(digest(F.col("text")).alias("sig"))


def held(log, batch):
    return sorted(bytes(r.sig) for r in log.before(batch).collect())


def want(spark, *texts):
    return sorted(bytes(r.sig) for r in rows(spark, *texts).collect())


def test_batches_see_what_came_before(spark, log, monkeypatch):
    monkeypatch.setattr(signature_log, "ROWS_PER_FILE", 3)
    assert held(log, 0) == [] and log.compact(0) == 0
    for batch in range(-1, 12):
        log.compact(batch)
        log.add(rows(spark, f"a{batch}", f"b{batch}", f"a{batch}"), batch)
    every = [f"{x}{b}" for b in range(-1, 12) for x in "ab"]
    assert held(log, 12) == want(spark, *every)
    assert len(log.runs()) <= 6 and held(log, 13) == held(log, 12)


def test_a_batch_that_is_run_again(spark, log):
    """After a failure a batch sees the same digests, whatever was merged or half written before."""
    for batch in range(-1, 2):
        log.add(rows(spark, f"x{batch}"), batch)
    log.add(rows(spark, "half done"), 2)  # batch 2 fails after this
    assert log.compact(2) == 1 and log.compact(2) == 0
    assert held(log, 2) == want(spark, "x-1", "x0", "x1")
    log.add(rows(spark, "x2"), 2)
    assert held(log, 3) == want(spark, "x-1", "x0", "x1", "x2")
    # the parts of a merged run are still there, and a merge without its mark is none
    log._write(rows(spark, "x0"), (0, 0, 0), 1)
    log._write(rows(spark, "wrong"), (1, 2, 4), 1)
    import os

    os.remove(f"{log._folder((1, 2, 4))}/_SUCCESS")
    assert held(log, 5) == want(spark, "x-1", "x0", "x1", "x2")


def test_rows_of_a_small_run_come_from_many_tasks(spark, log):
    """One task writes; what leads to the digests stays where it was."""
    task = F.udf(lambda i: bytes([TaskContext.get().partitionId()]), "binary").asNondeterministic()
    log._write(spark.range(0, 100, 1, 4).select(task("id").alias("sig")), (0, 0, 0), 100)
    assert log.before(1).distinct().count() == 4

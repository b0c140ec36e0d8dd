"""Streams that stop and start anew, against their batch twins."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from reelgraph.sources import tables
from reelgraph.sources.versions import VersionedTable
from reelgraph.streaming import jobs

ROW = "info_source string, id_source string, title string, place long"


class Killed(Exception):
    pass


def landed(spark, folder, batches, schema):
    """One file a batch; a stream of them takes one after the other."""
    import os
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        for name in os.listdir(f"{folder}/{k}"):
            os.utime(f"{folder}/{k}/{name}", (time.time() - 1000 + k, time.time() - 1000 + k))
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def fails(monkeypatch, method, after, before_it):
    """The method of VersionedTable stops the stream in its call after `after` calls, before or after it has worked."""
    calls, works = [0], getattr(VersionedTable, method)

    def run(self, *args):
        calls[0] += 1
        if calls[0] == after + 1 and before_it:
            raise Killed
        out = works(self, *args)
        if calls[0] == after + 1:
            raise Killed
        return out

    monkeypatch.setattr(VersionedTable, method, run)


@pytest.mark.parametrize("before_it", [True, False])
def test_upserts_are_killed_and_start_anew(spark, tmp_path, monkeypatch, before_it):
    draw = random.Random(3)
    batches = [[("s", str(draw.randrange(30)), f"t{b}-{k}", k) for k in range(25)] for b in range(5)]
    stream = landed(spark, tmp_path / "in", batches, ROW)
    old = spark.createDataFrame([("s", str(k), "old") for k in range(10, 60)], "info_source string, id_source string, title string")
    make = lambda: VersionedTable(spark, str(tmp_path / "table"), old.schema, tables.IDENTITY, 4)
    make().create(old)
    for after in (2, 1):
        with monkeypatch.context() as m, pytest.raises(Exception, match="Killed"):
            fails(m, "commit", after, before_it)
            jobs.stream_upsert(stream(), make(), str(tmp_path / "progress"), place=["place"])
    jobs.stream_upsert(stream(), make(), str(tmp_path / "progress"), place=["place"])
    want = {str(k): "old" for k in range(10, 60)} | {i: title for rows in batches for _, i, title, _ in rows}
    assert {r["id_source"]: r["title"] for r in make().read().collect()} == want and make().read().count() == len(want)
    # Nothing new: nothing is written.
    n = make().manifest().count()
    jobs.stream_upsert(stream(), make(), str(tmp_path / "progress"), place=["place"])
    make().create(old)
    assert make().manifest().count() == n and not make().merge(4, old, lambda a, b: b)


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "k long, v string", ["k"], 16)
    assert table.manifest() is None and table.read().count() == 0
    table.create(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    last, at = table.state()
    assert last == -1 and len(at) == 16
    merge = lambda old, new: tables.upsert(old, new, ["k"], keep=())
    assert table.merge(0, spark.createDataFrame([(5, "b"), (2000, "c")], "k long, v string"), merge)
    assert sum(p != at[b] for b, p in table.state()[1].items()) in (1, 2)
    assert table.merge(1, spark.createDataFrame([], "k long, v string"), merge) and table.state()[0] == 1
    rows = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(rows) == 1001 and rows[5] == "b" and rows[2000] == "c" and rows[6] == "a"


STEP = "target_type string, target_id long, ts timestamp, id long, delta int"
START = datetime.datetime(2024, 1, 1)


def by_steps(rows, counts=None):
    counts = dict(counts or {})
    for kind, target, _, _, delta in sorted(rows, key=lambda r: (r[2], r[3])):
        counts[kind, target] = max(0, counts.get((kind, target), 0) + delta)
    return counts


def test_counters_floor_every_step(spark):
    at = lambda k: START + datetime.timedelta(seconds=20 * k)
    rows = [("post", 1, at(k), k, d) for k, d in enumerate((1, -1, -1, 1))] + [("post", 2, at(k), k, d) for k, d in enumerate((-1, -1, -1))] + [("post", 3, at(1), k, d) for k, d in enumerate((2, -5, 3, -1))]
    got = {(r["target_type"], r["target_id"]): r["n"] for r in jobs.batch_counters(spark.createDataFrame(rows, STEP)).collect()}
    assert got == by_steps(rows) == {("post", 1): 1, ("post", 2): 0, ("post", 3): 2}


def test_counters_of_random_steps_in_spans_of_any_length(spark):
    draw = random.Random(5)
    rows = [("post", draw.randrange(4), START + datetime.timedelta(seconds=draw.randrange(3000)), k, draw.choice((-2, -1, -1, 1, 1, 2))) for k in range(3000)]
    df = spark.createDataFrame(rows, STEP).repartition(5)
    for span in ("1 second", "1 minute", "2 hours"):
        assert {(r["target_type"], r["target_id"]): r["n"] for r in jobs.batch_counters(df, span).collect()} == by_steps(rows)


def test_counters_across_batches_and_a_kill(spark, tmp_path, monkeypatch):
    draw = random.Random(7)
    batches = [[("post", draw.randrange(3), START + datetime.timedelta(seconds=draw.randrange(500)), 100 * b + k, draw.choice((-1, -1, 1))) for k in range(40)] for b in range(4)]
    batches[0] = [("like", 1, START, 1, 1), ("like", 1, START + datetime.timedelta(seconds=1), 2, -1)] + batches[0]
    batches[2] = [("like", 1, START, 3, -1), ("like", 1, START + datetime.timedelta(hours=1), 4, 1)] + batches[2]
    stream = landed(spark, tmp_path / "in", batches, STEP)
    make = lambda: VersionedTable(spark, str(tmp_path / "table"), "target_type string, target_id long, n long", jobs.TARGET, 4)
    with monkeypatch.context() as m, pytest.raises(Exception, match="Killed"):
        fails(m, "commit", 1, False)
        jobs.stream_counters(stream(), make(), str(tmp_path / "progress"))
    jobs.stream_counters(stream(), make(), str(tmp_path / "progress"))
    want = {}
    for rows in batches:
        want = by_steps(rows, want)
    assert {(r["target_type"], r["target_id"]): r["n"] for r in make().read().collect()} == want and want["like", 1] == 1

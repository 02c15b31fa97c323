"""Keyed state of streams: several micro-batches, a batch that is run again, and state that is dropped."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlens.streaming import keyed, streams

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, confidence double"


def write_batches(spark, folder, batches):
    """One file a batch, in order of their times of change."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
        for path in glob.glob(f"{folder}/{i}/*.parquet"):
            os.makedirs(f"{folder}/in", exist_ok=True)
            os.rename(path, f"{folder}/in/{i}.parquet")
            os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def stream_of(spark, folder, delay):
    stream = streams.packet_stream(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1, delay=delay)
    return stream


def events(seed, n=240, users=4, hours=30):
    """Rows in order of time, a busy source with a third of them, dealt to six batches; some rows come a batch late."""
    rng = random.Random(seed)
    times = sorted(rng.sample(range(hours * 3600), n))
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(users), START + timedelta(seconds=t), rng.randrange(100) / 100) for i, t in enumerate(times)]
    batches = [rows[i: i + n // 6] for i in range(0, n, n // 6)]
    return rows, batches


def run_twice(spark, folder, stream):
    """All batches, then the last one once more as after a failure before its commit; both results."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    table = streams.BatchTable(f"{folder}/out", schema)
    results = []
    for again in (False, True):
        if again:
            commits = [int(os.path.basename(p)) for p in glob.glob(f"{folder}/checkpoint/commits/[0-9]*")]
            assert len(commits) >= 6
            for name in (str(max(commits)), f".{max(commits)}.crc"):
                if os.path.exists(f"{folder}/checkpoint/commits/{name}"):
                    os.remove(f"{folder}/checkpoint/commits/{name}")
        streams.run_available(stream, f"{folder}/checkpoint", each=table.write)
        results.append(sorted((tuple(r) for r in table.read(spark).drop("batch").collect()), key=repr))
    return results


def plain_sessions(rows, gap):
    out = []
    for user in {r[1] for r in rows}:
        times = sorted(r[2] for r in rows if r[1] == user)
        runs = [[times[0]]]
        for t in times[1:]:
            if t - runs[-1][-1] < timedelta(seconds=gap):
                runs[-1].append(t)
            else:
                runs.append([t])
        out += [(user, run[0], run[-1], len(run)) for run in runs]
    return out


def micros(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_sessions_close_by_timer(spark, tmp_path):
    rows, batches = events(1)
    late = [batches[1].pop(), batches[2].pop(0)]
    batches[2] += late  # out of order, within the delay
    write_batches(spark, tmp_path, batches)
    first, again = run_twice(spark, tmp_path, keyed.sessions(stream_of(spark, tmp_path, "2 hours"), "user_id", "ts", 900))
    want = [(u, micros(a), micros(b), n) for u, a, b, n in plain_sessions(rows, 900)]
    mark = micros(rows[-1][2]) - 7_200_000_000
    assert first == again == sorted((w for w in want if w[2] + 900_000_000 < mark), key=repr)
    held = sorted(tuple(r) for r in keyed.open_sessions(spark, f"{tmp_path}/checkpoint", "user_id").collect())
    assert held == sorted(w for w in want if w[2] + 900_000_000 >= mark) and 0 < len(held) < len(want) / 2


def test_rows_after_the_watermark_open_nothing(spark, tmp_path):
    hour = lambda h: START + timedelta(hours=h)
    write_batches(spark, tmp_path, [[(1, 1, hour(0), 0.0)], [(2, 2, hour(50), 0.0)], [(3, 2, hour(100), 0.0)], [(4, 1, hour(3), 0.0)], [(5, 3, hour(101), 0.0)], [(6, 3, hour(102), 0.0)]])
    first, again = run_twice(spark, tmp_path, keyed.sessions(stream_of(spark, tmp_path, "1 hour"), "user_id", "ts", 60))
    assert first == again and [(r[0], r[3]) for r in sorted(first)] == [(1, 1), (2, 1), (2, 1)]


def plain_blocks(rows, threshold, block_s):
    """Row by row, in order of time."""
    out, until = [], {}
    for event_id, user, ts, confidence in sorted(rows, key=lambda r: (r[2], r[0])):
        if ts >= until.get(user, START):
            alert = confidence > threshold
            out.append((event_id, user, alert))
            if alert:
                until[user] = ts + timedelta(seconds=block_s) if block_s else datetime.max
    return sorted(out)


@pytest.mark.parametrize("block_s", [None, 7200.0])
def test_blocks_over_batches(spark, tmp_path, block_s):
    rows, batches = events(2)
    write_batches(spark, tmp_path, batches)
    found = keyed.blocked(stream_of(spark, tmp_path, "1 hour"), "user_id", "ts", "event_id", "confidence", 0.9, block_s)
    first, again = run_twice(spark, tmp_path, found)
    assert first == again
    got = sorted((r[0], r[1], r[4]) for r in first)
    assert got == plain_blocks(rows, 0.9, block_s) and 0 < len(got) < len(rows)
    if block_s:
        state = spark.read.format("statestore").option("stateVarName", "block").load(f"{tmp_path}/checkpoint")
        assert state.count() < 4  # most blocks are over and dropped


def test_a_late_alert_moves_the_block(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    write_batches(spark, tmp_path, [[(1, 7, at(10), 0.95), (2, 7, at(11), 0.1)], [(3, 7, at(5), 0.95), (4, 7, at(7), 0.2), (5, 7, at(3), 0.2)], [(6, 7, at(4), 0.3), (7, 7, at(6), 0.3), (8, 8, at(1), 0.5)]])
    found = keyed.blocked(stream_of(spark, tmp_path, None), "user_id", "ts", "event_id", "confidence")
    table = streams.BatchTable(f"{tmp_path}/out", f"{SCHEMA}, blocks boolean")
    streams.run_available(found, f"{tmp_path}/checkpoint", each=table.write)
    assert sorted((r.event_id, r.blocks) for r in table.read(spark).collect()) == [(1, True), (3, True), (5, False), (6, False), (8, False)]


@pytest.mark.parametrize("by", [None, ["user_id"]])
def test_latest_rows_over_batches(spark, tmp_path, by):
    rows, batches = events(3)
    write_batches(spark, tmp_path, batches[3:] + batches[:3])  # out of order
    order = ["ts", "event_id"]
    first, again = run_twice(spark, tmp_path, keyed.ring(stream_of(spark, tmp_path, None), order, 7, by, shards=3))
    assert first == again
    got = keyed.latest(streams.BatchTable(f"{tmp_path}/out", SCHEMA).read(spark).drop("batch"), order, 7, by)
    newest = sorted(rows, key=lambda r: (r[2], r[0]), reverse=True)
    want = newest[:7] if not by else [r for u in range(4) for r in [x for x in newest if x[1] == u][:7]]
    assert sorted(r.event_id for r in got.select(F.col("event_id")).collect()) == sorted(r[0] for r in want)


def test_a_source_has_one_timer_whatever_its_sessions(spark, tmp_path):
    """Timers that are registered, counted by a handle that stands in for the engine's."""
    class Handle:
        def __init__(self):
            self.timers, self.calls, self.held = set(), 0, None

        def getValueState(self, *_):
            return self

        getListState = getValueState
        get = lambda self: self.held
        exists = lambda self: self.held is not None

        def update(self, value):
            self.held = value

        put = update

        def clear(self):
            self.held = None

        def registerTimer(self, at):
            self.timers.add(at)
            self.calls += 1

        def deleteTimer(self, at):
            self.timers.discard(at)

    class Times:
        getCurrentWatermarkInMs = lambda self: 0

    import pandas as pd

    handle, sessions = Handle(), keyed.Sessions("user_id", 1_000_000)
    sessions.init(handle)
    starts = [i * 10_000_000 for i in range(50)]
    list(sessions.handleInputRows((7,), iter([pd.DataFrame({"first": starts, "last": starts, "n": 1})]), Times()))
    assert handle.timers == {1001} and handle.calls == 1


def test_a_source_has_one_ring(spark, tmp_path):
    rows, batches = events(4)
    write_batches(spark, tmp_path, batches)
    run_twice(spark, tmp_path, keyed.ring(stream_of(spark, tmp_path, None), ["ts", "event_id"], 2, ["user_id"]))
    held = spark.read.format("statestore").option("stateVarName", "rows").option("flattenCollectionTypes", True).load(f"{tmp_path}/checkpoint")
    assert held.count() == 2 * len({r[1] for r in rows})


def test_blocks_of_many_rows_take_no_pass_each(spark):
    """A source with a block every few rows, in one call, as row by row; no step per block that copies the rest of the rows."""
    import time

    import pandas as pd

    class Handle:
        getValueState = lambda self, *_: self
        exists = lambda self: False
        update = registerTimer = lambda self, _: None

    rows = [(i, 1, START + timedelta(seconds=5 * i), 0.95 if i % 3 == 0 else 0.1) for i in range(20_000)]
    blocks = keyed.Blocks("ts", "event_id", "confidence", 0.9, 10.0, ["event_id", "user_id"])
    blocks.init(Handle())
    begun = time.process_time()
    got = pd.concat(blocks.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["event_id", "user_id", "ts", "confidence"])]), None))
    assert time.process_time() - begun < 5
    assert sorted(got.itertuples(index=False, name=None)) == plain_blocks(rows, 0.9, 10.0)

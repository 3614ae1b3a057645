"""Streams over several triggers and restarts, beside their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnstone.streaming import counters as C
from tarnstone.streaming import sessions as L

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def made(seed, n=400, users=6, hours=40):
    rnd = random.Random(seed)
    begin = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = sorted(rnd.uniform(0, hours * 3600) for _ in range(n))
    return [(i, begin + dt.timedelta(seconds=round(t, 3)), rnd.randrange(users), rnd.choice(["view", "click", "buy", "buy", "buy"])) for i, t in enumerate(at)]


def arrive(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(f"{folder}/*")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def run(spark, tmp_path, batches, start, schema):
    """Starts the query anew, on the same checkpoint, for each batch of rows."""
    for k, rows in enumerate(batches):
        arrive(spark, tmp_path / "in", rows, f"b{k}")
        start(stream(spark, tmp_path / "in"), str(tmp_path / "checkpoint"), str(tmp_path / "out")).awaitTermination()
    return spark.read.schema(schema).parquet(str(tmp_path / "out"))


def test_gate_over_restarts(spark, tmp_path):
    rows = made(1)
    told = run(spark, tmp_path, [rows[:90], rows[90:91], rows[91:300], rows[300:]], L.gate_stream, "session long, event_id long, accepted boolean")
    assert rows_of(told) == rows_of(C.session_states(spark.createDataFrame(rows, SCHEMA)))


def sessions_by_hand(rows, upto):
    out = []
    for user in {r[2] for r in rows}:
        times = sorted(r[1] for r in rows if r[2] == user)
        groups = [[times[0]]]
        for t in times[1:]:
            if t - groups[-1][-1] < dt.timedelta(minutes=60):
                groups[-1].append(t)
            else:
                groups.append([t])
        out += [(user, g[0], g[-1], len(g)) for g in groups if g[-1] + dt.timedelta(minutes=60) <= upto]
    return out


@pytest.mark.parametrize("start", [L.life_stream, L.session_stream])
def test_sessions_over_restarts(spark, tmp_path, start):
    rows = made(2)
    schema = "user_id long, start timestamp, last timestamp, n long, beats long" if start is L.life_stream else "user_id long, start timestamp, n long"
    told = run(spark, tmp_path, [rows[:150], rows[150:260], rows[260:]], start, schema).collect()
    want = sessions_by_hand(rows, rows[-1][1] - dt.timedelta(minutes=10))
    stamp = lambda t: t.replace(tzinfo=dt.timezone.utc).timestamp() if t.tzinfo else t.astimezone().timestamp()
    assert sorted((r.user_id, stamp(r.start), r.n) for r in told) == sorted((u, s.timestamp(), n) for u, s, _, n in want) and len(want) > 20
    if start is L.life_stream:
        beats = {(u, s.timestamp()): int(((e - s).total_seconds() + 3600) // 25) for u, s, e, _ in want}
        assert all(r.beats == beats[r.user_id, stamp(r.start)] for r in told)


def test_late_events_are_left_out(spark, tmp_path):
    begin = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda m: begin + dt.timedelta(minutes=m)
    first = [(1, at(0), 1, "view"), (2, at(200), 1, "view")]
    late = [(3, at(5), 1, "view"), (4, at(195), 1, "buy"), (5, at(400), 1, "view")]
    told = run(spark, tmp_path, [first, late], C.window_stream, "start timestamp, tool string, n long").collect()
    # 5 minutes lies behind the watermark of 190 and its window was told; 195 does not.
    assert sorted((r.tool, r.n) for r in told) == [("buy", 1), ("view", 1), ("view", 1)]
    windows = run(spark, tmp_path / "life", [first, late], L.life_stream, "user_id long, start timestamp, last timestamp, n long, beats long").collect()
    assert sorted(r.n for r in windows) == [1, 2]


def test_counters_over_restarts_and_replays(spark, tmp_path):
    rows = made(3)
    sink = str(tmp_path / "out")
    for k, part in enumerate((rows[:100], rows[100:150], rows[150:])):
        arrive(spark, tmp_path / "in", part, f"b{k}")
        C.count_stream(stream(spark, tmp_path / "in"), str(tmp_path / "checkpoint"), sink).awaitTermination()
        base = spark.createDataFrame([("buy", 1000), ("old", 7)], "tool string, total long")
        so_far = spark.createDataFrame(rows[: (100, 150, len(rows))[k]], SCHEMA).groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("total"))
        assert rows_of(C.flushed_counters(spark, sink)) == rows_of(so_far)
        assert rows_of(C.flushed_counters(spark, sink, base)) == rows_of(C.merge_counters(base, so_far))
    done = C.epochs(spark, sink)
    held = spark.read.parquet(f"{sink}/epoch={done[-2]}")
    before, old = rows_of(C.flushed_counters(spark, sink)), rows_of(held)
    changed = spark.read.parquet(f"{sink}/epoch={done[-1]}").filter(F.col("changed") == done[-1]).select("tool", "total")
    C.flush_counters(spark.createDataFrame(changed.collect(), changed.schema), done[-1], sink)
    assert rows_of(C.flushed_counters(spark, sink)) == before and rows_of(held) == old and C.epochs(spark, sink) == done
    # A flush that was not written whole is not read.
    (tmp_path / f"out/epoch={done[-1] + 5}").mkdir()
    assert rows_of(C.flushed_counters(spark, sink)) == before


def test_told_and_open_windows_are_all_windows(spark, tmp_path):
    rows = made(4)
    schema = "start timestamp, tool string, n long"
    told = run(spark, tmp_path, [rows[:200], rows[200:]], C.window_stream, schema)
    held = C.open_windows(spark, str(tmp_path / "checkpoint"))
    want = C.tumbling(spark.createDataFrame(rows, SCHEMA)).select("start", "tool", "n")
    assert rows_of(told.unionByName(held)) == rows_of(want) and 0 < held.count() < told.count()


def test_stream_windows_tells_the_newest_windows(spark, sf):
    import __spark_entry__ as entry

    newest = spark.read.parquet(f"{sf}/events.parquet").agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("t")).scalar()
    assert entry.queries()["stream_windows"](spark, sf).filter(F.col("start") >= newest).count() > 0

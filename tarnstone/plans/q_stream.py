"""Queries over events: counters, windows, sessions and requests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnstone.plans.base import ORACLE_SQL, QUERIES, query, shared_folder
from tarnstone.sources.files import differences
from tarnstone.streaming import counters as C
from tarnstone.streaming import sessions as L

EV = ("events",)


@query("tool_stats", "SELECT event_type AS tool, count(*) AS total, CAST(sum(count(*)) OVER () AS BIGINT) AS grand_total FROM events GROUP BY event_type", *EV)
def _(events):
    return C.tool_stats(events)


@query("counter_load", "SELECT event_type AS tool, CAST(greatest(0, count(*) - 100) AS BIGINT) AS total FROM events GROUP BY event_type", *EV)
def _(events):
    counts = events.groupBy("event_type").agg((F.count(F.lit(1)) - 100).alias("n"))
    text = counts.select(F.concat(F.lit('{"'), "event_type", F.lit('":'), F.col("n").cast("string"), F.lit("}")).alias("json"))
    return C.load_counters(events.sparkSession, text)


@query("counter_flush", "SELECT event_type AS tool, count(*) + 5 AS total FROM events GROUP BY event_type", *EV)
def _(events):
    delta = events.groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("total"))
    return C.merge_counters(delta.select("tool", F.lit(5).cast("long").alias("total")), delta)


@query("tumbling_30m", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, event_type AS tool, count(*) AS n FROM events GROUP BY ALL", *EV)
def _(events):
    return C.tumbling(events)


@query("session_60m", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 60 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""", *EV)
def _(events):
    return C.sessions(events)


@query("session_state", """WITH s AS (SELECT user_id AS session, event_id, event_type, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS begun FROM events)
SELECT session, event_id, begun = 1 OR event_type = 'click' AS accepted FROM s""", *EV)
def _(events):
    return C.session_states(events)


@query("rpc_batch", "SELECT user_id AS batch_id, event_id AS id, event_type AS method FROM events", *EV)
def _(events):
    one = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("method")))
    bodies = events.groupBy(F.col("user_id").alias("batch_id"), F.floor(F.col("event_id") / 16).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("body"))
    return C.request_batches(bodies)


@query("rpc_status", "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'error' WHEN value < 10 THEN 'isError' ELSE 'result' END AS status FROM events", *EV)
def _(events):
    return C.request_status(events.select("event_id", F.col("event_type").alias("method"), (F.col("value") < 10).alias("failed")), ["click", "view"]).select("event_id", "status")


def _is_dir(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory()


def _streamed(name: str, oracle: str):
    """Registers a function of (events as a stream of files, a new folder) that runs a stream to its end and reads what it has told."""

    def put(run):
        def build(spark, sf_dir):
            path = f"{sf_dir}/events.parquet"
            whole = _is_dir(spark, path)
            events = C.stream_events(spark, path if whole else sf_dir, spark.read.parquet(path).schema, "*" if whole else "events.parquet")
            return run(spark, events, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")

        QUERIES[name] = build
        ORACLE_SQL[name] = oracle
        return run

    return put


@_streamed("stream_tool_counts", "SELECT event_type AS tool, count(*) AS total FROM events GROUP BY event_type")
def _(spark, events, folder):
    """A file stream counted with state and a checkpoint, flushed, and read back."""
    C.count_stream(events, f"{folder}/checkpoint", f"{folder}/counts").awaitTermination()
    return C.flushed_counters(spark, f"{folder}/counts")


@_streamed("stream_windows", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, event_type AS tool, count(*) AS n FROM events GROUP BY ALL")
def _(spark, events, folder):
    """Windows of a stream under a watermark: those that it has told when they closed, and those that it still holds open."""
    C.window_stream(events, f"{folder}/checkpoint", f"{folder}/windows").awaitTermination()
    told = spark.read.schema("start timestamp, tool string, n long").parquet(f"{folder}/windows")
    return told.unionByName(C.open_windows(spark, f"{folder}/checkpoint")).withColumn("start", F.col("start").cast("timestamp_ntz"))


CLOSED = """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 60 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
c AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 60 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE)"""


@_streamed("stream_sessions", f"{CLOSED} SELECT user_id, start, n FROM c")
def _(spark, events, folder):
    """Sessions of a stream, each told once when the watermark has passed its idle time."""
    L.session_stream(events, f"{folder}/checkpoint", f"{folder}/sessions").awaitTermination()
    return spark.read.schema("user_id long, start timestamp, n long").parquet(f"{folder}/sessions").withColumn("start", F.col("start").cast("timestamp_ntz"))


@_streamed("stream_heartbeats", f"{CLOSED} SELECT user_id, start, last, n, CAST(floor((epoch_us(last) - epoch_us(start) + 3600000000) / 25000000) AS BIGINT) AS beats FROM c")
def _(spark, events, folder):
    """Sessions by state variables and timers, with the heartbeats that each got until it closed."""
    L.life_stream(events, f"{folder}/checkpoint", f"{folder}/sessions").awaitTermination()
    told = spark.read.schema("user_id long, start timestamp, last timestamp, n long, beats long").parquet(f"{folder}/sessions")
    return told.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")})


@_streamed("stream_session_state", ORACLE_SQL["session_state"])
def _(spark, events, folder):
    """The gate of session_state with its state in the stream."""
    L.gate_stream(events, f"{folder}/checkpoint", f"{folder}/requests").awaitTermination()
    return spark.read.schema("session long, event_id long, accepted boolean").parquet(f"{folder}/requests")


@query("listing_changes", """WITH m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events),
b AS (SELECT user_id, max(ts) AS modified, count(*) AS length FROM events, m WHERE ts < middle GROUP BY user_id), a AS (SELECT user_id, max(ts) AS modified, count(*) AS length FROM events, m WHERE ts >= middle GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS path, CASE WHEN b.length IS NULL THEN 'added' WHEN a.length IS NULL THEN 'gone' ELSE 'changed' END AS kind FROM b FULL JOIN a USING (user_id) WHERE b.length IS NULL OR a.length IS NULL OR b.modified <> a.modified OR b.length <> a.length""", *EV)
def _(events):
    """What a subscriber is told when each user's events of the first half of the time are a file, and of the second half the next state of it."""
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    middle = span.select((F.col("a") + F.floor((F.col("b") - F.col("a")) / 2))).scalar()
    listed = lambda rows: rows.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max("ts").alias("modified"), F.count(F.lit(1)).alias("length"))
    return differences(listed(events.filter(time < middle)), listed(events.filter(time >= middle)))

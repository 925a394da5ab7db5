"""Queries over the events table as streams of updates, requests and work, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh
from ..streaming import state
from ..streaming.store import RecordStore
from . import graph_view as g
from .queries import query

BATCHES = 5


@query(
    "record_store_merge",
    f"""
    WITH u AS (SELECT user_id, (event_id % {BATCHES}) * 1000000000000 + event_id AS k, event_type, value FROM events WHERE user_id IS NOT NULL)
    SELECT user_id AS id, arg_max(event_type, k) FILTER (event_type <> 'view') AS last_event,
        arg_max({{'v': CASE WHEN event_type = 'purchase' THEN value END}}, k) FILTER (event_type IN ('purchase', 'error')).v AS last_value
    FROM u GROUP BY user_id
    """.replace("arg_max({'v'", "(arg_max({'v'").replace("'error')).v", "'error'))).v"),
)
def record_store_merge(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01, SNK-02, STR-12: events as updates of a record for each user, in batches, merged meanwhile; an error clears the value"""
    e = g.table(spark, d, "events")
    kind = F.col("event_type")
    updates = e.select("event_id", F.col("user_id").alias("id"), F.when(kind != "view", kind).alias("last_event"), F.when(kind == "purchase", F.col("value")).alias("last_value"), F.when(kind == "error", F.array(F.lit("last_value"))).alias("cleared"), F.col("event_id").alias("seq"))
    store = RecordStore(spark, fresh(spark, "records"), "id", "id long, last_event string, last_value double", fan=3)
    for number in range(BATCHES):
        store.append(updates.filter(F.col("event_id") % BATCHES == number).drop("event_id"), number)
    store.compact()
    return store.read()


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of requests and work: projects, sections and pieces by number."""
    # a pattern, so that the table may be one file or a folder
    stream = spark.readStream.schema(g.table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    kind, n = F.col("event_type"), F.col("event_id")
    return stream.select(F.concat(F.lit("p"), (n % 50).cast("string")).alias("project"), F.col("ts").alias("at"), n.alias("seq"), kind.alias("event_type"), n.alias("request_id"), (F.col("value") > 50).alias("force"), F.concat(F.lit("s"), (F.floor(n / 64) % 3).cast("string")).alias("section"), F.concat(F.lit("n"), (F.floor(n / 50) % 4).cast("string")).alias("id"), F.floor(n / 2000).cast("long").alias("generation"))


@query("coalesced_requests")
def coalesced_requests(spark: SparkSession, d: str) -> DataFrame:
    """STR-08: views, clicks and signups ask for a section, purchases are replies, errors end the service until the next signup"""
    e = _events(spark, d)
    kind = F.when(F.col("event_type") == "purchase", "reply").when(F.col("event_type") == "error", "down").when(F.col("event_type") == "signup", "up").otherwise("request")
    return state.run_to_end(state.processed(e.select("project", "at", "seq", kind.alias("kind"), "request_id", "section", "force", F.lit("ok").alias("message")), state.Coalescer(3_600_000)), "requests")


_RELAY_MS = 100_000_000


@query(
    "relayed_requests",
    f"""
    WITH e AS (
        SELECT event_id AS n, 'p' || (event_id % 50) AS project, epoch_us(ts) // 1000 AS ms, 's' || (event_id // 64 % 3) AS section,
            CASE event_type WHEN 'click' THEN 'reply' WHEN 'error' THEN 'down' ELSE 'request' END AS kind FROM events
    ), ends AS (  -- what may end a request: the reply to it, and the project's next end of service
        SELECT q.n, r.n AS by_n, r.ms, CASE WHEN r.section = q.section THEN 'ok' ELSE 'mismatched' END AS status FROM e q JOIN e r ON r.project = q.project AND r.kind = 'reply' AND r.n - 100 = q.n WHERE q.kind = 'request' AND (r.ms, r.n) > (q.ms, q.n)
        UNION ALL SELECT q.n, d.n, d.ms, 'exited' FROM e q JOIN e d ON d.project = q.project AND d.kind = 'down' WHERE q.kind = 'request' AND (d.ms, d.n) > (q.ms, q.n)
    ), first AS (SELECT n, arg_min({{'ms': ms, 'status': status}}, {{'ms': ms, 'n': by_n}}) AS x FROM ends GROUP BY n)
    SELECT project, e.n AS request_id, section, CASE WHEN x IS NULL OR e.ms + {_RELAY_MS} <= x.ms THEN 'timed-out' ELSE x.status END AS status, CASE WHEN x IS NULL OR e.ms + {_RELAY_MS} <= x.ms THEN e.ms + {_RELAY_MS} ELSE x.ms END AS at_ms
    FROM e LEFT JOIN first USING (n) WHERE kind = 'request' AND (x.ms IS NOT NULL OR e.ms + {_RELAY_MS} <= (SELECT max(ms) FROM e))
    """,
)
def relayed_requests(spark: SparkSession, d: str) -> DataFrame:
    """STR-17: most events ask, clicks reply to the request a hundred numbers before, errors end the service"""
    e = _events(spark, d)
    kind = F.when(F.col("event_type") == "click", "reply").when(F.col("event_type") == "error", "down").otherwise("request")
    asked = F.when(kind == "reply", F.col("request_id") - 100).otherwise(F.col("request_id"))
    return state.run_to_end(state.processed(e.select("project", "at", "seq", kind.alias("kind"), asked.alias("request_id"), "section", F.lit("ok").alias("message")), state.Relay(_RELAY_MS)), "relay")


@query("work_queue")
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    """STR-01 to STR-04, AGG-27: views ask for work, clicks urgently; other events are results, errors degenerate ones"""
    e = _events(spark, d)
    kind = F.when(F.col("event_type").isin("view", "click"), "submit").when(F.col("seq") % 2000 == 0, "generation").otherwise("finish")
    return state.run_to_end(state.processed(e.select("project", "at", "seq", kind.alias("kind"), "id", (F.col("event_type") == "click").alias("urgent"), "generation", F.when(F.col("event_type") == "error", "degenerate").otherwise("ok").alias("message")), state.WorkQueue(2, 3_600_000)), "work")

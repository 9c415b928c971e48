"""Streaming jobs run over all landed events, against the batch result."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import functions as F

from tesserae.operators import relational as R
from tesserae.plans.registry import query
from tesserae.sources.tables import Tables
from tesserae.streaming import jobs as J
from tesserae.streaming import tokens as K


def place(t: Tables) -> str:
    """A fresh folder in the shared checkpoint folder of the cluster; a local one only where none is named and all run on this machine."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not t.spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    return f"{base}/streams/{uuid.uuid4().hex}"


def saver(t: Tables):
    """Writes tables into a fresh shared folder and reads them back."""
    where, number = place(t), count()

    def save(df):
        path = f"{where}/{next(number)}"
        df.write.parquet(path)
        return t.spark.read.schema(df.schema).parquet(path)

    return save


def landed(t: Tables):
    """The events table as a stream; a folder or a single file."""
    return J.read_events(t.spark, f"{t.folder}/events.parquet*")


@query("ST4", "SELECT day, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type FROM events) GROUP BY 1, 2 HAVING day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def st4(t: Tables):
    return J.run_once(J.volume(landed(t)), t.spark, place(t), "volume", "append")


#: A token a user: issued at the user's first event, used at the events of the next half hour; ends of validity and purges count once the stream's watermark has passed them.
@query("ST3", """WITH e AS (SELECT user_id, ts, date_trunc('millisecond', ts) AS ms FROM events), f AS (SELECT user_id, min(ts) AS issued, min(ms) AS from_ms FROM e GROUP BY 1), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
u AS (SELECT user_id, ts, ms, from_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e JOIN f USING (user_id) WHERE ts > issued),
o AS (SELECT user_id AS token, 'issued' AS outcome, issued AS moment FROM f
UNION ALL SELECT user_id, CASE WHEN ms >= from_ms + INTERVAL 24 HOUR THEN 'unknown' WHEN k > 1 AND min(ms) OVER (PARTITION BY user_id) < from_ms + INTERVAL 15 MINUTE THEN 'used before' WHEN ms < from_ms + INTERVAL 15 MINUTE THEN 'used' ELSE 'too late' END, ts FROM u
UNION ALL SELECT user_id, 'expired', from_ms + INTERVAL 15 MINUTE FROM f, m WHERE (from_ms + INTERVAL 15 MINUTE <= mark OR user_id IN (SELECT user_id FROM u WHERE ms >= from_ms + INTERVAL 24 HOUR)) AND user_id NOT IN (SELECT user_id FROM u WHERE ms < from_ms + INTERVAL 15 MINUTE)
UNION ALL SELECT user_id, 'purged', from_ms + INTERVAL 24 HOUR FROM f, m WHERE from_ms + INTERVAL 24 HOUR <= mark OR user_id IN (SELECT user_id FROM u WHERE ms >= from_ms + INTERVAL 24 HOUR))
SELECT token, outcome, moment FROM o""")
def st3(t: Tables):
    """The first event of a user issues the user's token, all later ones try to use it; all files arrive in one batch, so nothing is purged between them."""
    first = t.raw("events").groupBy("user_id").agg(F.min("ts").alias("issued"))
    where = place(t)
    t.raw("events").join(first, "user_id").select(F.col("user_id").alias("token"), "ts", F.when(F.col("ts") == F.col("issued"), "issue").otherwise("use").alias("action")).write.parquet(f"{where}/landed")
    stream = t.spark.readStream.schema("token long, ts timestamp, action string").parquet(f"{where}/landed")
    return K.run_tokens(K.one_shot(stream), t.spark, where)[0]


@query("ST2", """WITH RECURSIVE a AS (SELECT user_id, value > 10 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, 0.3::DOUBLE * (ok::INT::DOUBLE - 0.5::DOUBLE) AS theta FROM a WHERE i = 1 UNION ALL SELECT a.user_id, a.i, r.theta + 0.3::DOUBLE * (a.ok::INT::DOUBLE - 1 / (1 + exp(-r.theta))) FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1)
SELECT user_id, round(arg_max(theta, i), 6) AS theta, max(i) AS n FROM r GROUP BY 1""")
def st2(t: Tables):
    """The last state of each user, after however many batches."""
    states = J.run_once(J.ability(landed(t)), t.spark, place(t), "ability", "update")
    return R.distinct_on(states, ["user_id"], [F.desc("n")])


@query("ST1", "SELECT event_id, user_id, ts, value FROM events")
def st1(t: Tables):
    """All events, upserted by batches into a bucketed table, as the table has them in the end."""
    where = place(t)
    items = landed(t).select("event_id", "user_id", "ts", "value")
    q = J.ingest(items, f"{where}/items", "event_id").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return J.read_table(t.spark, f"{where}/items", items.schema)

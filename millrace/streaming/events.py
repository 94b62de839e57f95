"""Structured Streaming over the event table, run to completion with availableNow and read back.

An event without a time is in no window and no session. Events without an id count as repeats of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.registering import Queries
from millrace.sources.roundtrip import _scratch
from millrace.sources.tables import table

query = Queries("stream_")
END = "__end"


def stream(spark, d):
    """The events as a stream, with a timestamp that watermarks accept."""
    # A glob, as the table may be one file or a folder of files.
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def closed(spark, d):
    """The same with one event of another kind a year later, by which watermarks close every window of the others."""
    path, events = _scratch(spark), table(spark, d, "events")
    end = events.agg((F.max("ts") + F.expr("interval 1 year")).alias("ts")).filter("ts is not null")
    end.select(*[F.col("ts") if f.name == "ts" else F.lit(END if f.name == "event_type" else None).cast(f.dataType).alias(f.name) for f in events.schema]).write.parquet(path)
    last = spark.readStream.schema(events.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream(spark, d).union(last)


def drain(spark, df: DataFrame) -> DataFrame:
    """All that a stream appends, through files: state is bounded by watermarks, and nothing goes to the driver."""
    path = _scratch(spark)
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{path}-c").option("path", path).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def tumbling_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and kind. Events later than `late` behind the latest one of earlier batches are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: an event exactly `gap` after the one before still belongs to it."""
    return events.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    return drain(spark, tumbling_counts(closed(spark, d))).filter(~F.col("event_type").eqNullSafe(END)).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start")
def sliding(spark, d):
    g = closed(spark, d).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return drain(spark, g).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s
""")
def sessions(spark, d):
    return drain(spark, session_counts(closed(spark, d))).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, user_id, event_type FROM events")
def deduplicated(spark, d):
    s = stream(spark, d)
    return drain(spark, s.union(s).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"))


@query("""
SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
  AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY
""")
def interval_join(spark, d):
    """Watermarks on both sides and the bound on time let old rows leave the state."""
    kind = lambda k, name: stream(spark, d).filter(F.col("event_type") == k).select(F.col("event_id").alias(name), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", "1 hour")
    near = F.expr("click_user = purchase_user and purchase_ts > click_ts and purchase_ts <= click_ts + interval 1 day")
    return drain(spark, kind("click", "click").join(kind("purchase", "purchase"), near).select("click", "purchase"))


@query("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY user_id")
def custom_state(spark, d):
    """A state of one's own for each user: events so far and the greatest value; each batch appends what has changed."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, most = state.get if state.exists else (0, float("-inf"))
        for f in frames:
            n, most = n + len(f), max(most, float(f.value.max()))
        state.update((n, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": [most]})

    got = stream(spark, d).groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, most double", "n long, most double", "append", "NoTimeout")
    return drain(spark, got).groupBy("user_id").agg(F.max("n").alias("n"), F.max("most").alias("most"))


@query("SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def stream_static_join(spark, d):
    return drain(spark, stream(spark, d).join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"))


QUERIES, SQL = query.queries, query.sql

"""Streams over files that come one by one: late rows, and gaps of exactly the sessions' length."""

import datetime

import pytest

from millrace.streaming import events

DDL = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def arriving(spark, tmp_path):
    """Batches of (minute, user) as a stream of one file a batch, in order, and one event a year later."""

    def make(*batches):
        path, n, base = tmp_path / "in", 0, datetime.datetime(2024, 1, 1)
        for batch in [*batches, [(60 * 24 * 365, -1)]]:
            rows = [(n + i, base + datetime.timedelta(minutes=m), u, "view" if u >= 0 else events.END, 1.0, "{}") for i, (m, u) in enumerate(batch)]
            n += len(rows)
            spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(path))
        s = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(path))
        return s.withColumn("ts", s["ts"].cast("timestamp"))

    return make


def test_late_rows_are_dropped(spark, arriving):
    # 300 sets the watermark to 240: 250 is late but within it, 10 is beyond. Each of several batches takes one file.
    got = events.drain(spark, events.tumbling_counts(arriving([(300, 1)], [(310, 1)], [(250, 1), (10, 1)]))).filter("event_type = 'view'")
    hours = {(r["window"]["start"].hour): r["n"] for r in got.collect()}
    assert hours == {4: 1, 5: 2}


def test_session_gaps(spark, arriving):
    got = events.drain(spark, events.session_counts(arriving([(0, 1), (29, 1), (90, 1), (120, 1), (0, 2)]))).filter("user_id >= 0")
    # 29 and exactly 30 minutes belong together, 61 don't.
    assert sorted((r["user_id"], r["n"]) for r in got.collect()) == [(1, 2), (1, 2), (2, 1)]


def test_empty_stream(spark, arriving):
    assert events.drain(spark, events.tumbling_counts(arriving())).filter("event_type = 'view'").count() == 0


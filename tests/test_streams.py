"""Watermarked streams over restarts, against plain Python."""

import datetime as dt

from tapeloom.streaming import windows as st

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def batch(spark, *rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(hours=h), u, "view", 1.0) for i, h, u in rows], SCHEMA)


def test_late_rows_are_dropped_after_a_restart(spark):
    arrivals = [batch(spark, (1, 1, 0), (2, 30, 0)), batch(spark, (3, 60, 0), (4, 5, 0)), batch(spark, (5, 2, 0), (6, 40, 0), (7, 100, 0))]
    # the first watermark is 6 h: row 4 (its day ends at 24) still counts; the second is 36 h: row 5 is late, row 6 isn't
    got = sorted((r.start, r.n) for r in st.run(spark, arrivals, st.tumbling).collect())
    assert got == [(T0, 2), (T0 + dt.timedelta(days=1), 2), (T0 + dt.timedelta(days=2), 1)]


def test_sessions_end_after_their_gap(spark):
    arrivals = [batch(spark, (1, 0, 1), (2, 5, 1), (3, 5, 2)), batch(spark, (4, 10, 1), (5, 20, 1)), batch(spark, (6, 90, 3))]
    got = sorted((r.user_id, r.start, r.end, r.n) for r in st.run(spark, arrivals, st.sessions).collect())
    h = lambda x: T0 + dt.timedelta(hours=x)
    assert got == [(1, h(0), h(16), 3), (1, h(20), h(26), 1), (2, h(5), h(11), 1)]


def test_duplicates_within_the_watermark(spark):
    arrivals = [batch(spark, (1, 1, 0), (1, 1, 0), (2, 30, 0)), batch(spark, (1, 10, 0), (3, 80, 0)), batch(spark, (3, 80, 0), (4, 20, 0))]
    got = sorted(r.event_id for r in st.run(spark, arrivals, st.distinct_events).collect())
    assert got == [1, 2, 3]


def test_empty_arrivals(spark):
    assert st.run(spark, [batch(spark, (1, 1, 0)).limit(0)] * 2, st.tumbling).count() == 0

"""Streams with watermarks over the events as they arrive, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.windows import rounded, rounded_sql
from tapeloom.plans.catalog import query
from tapeloom.sources import market as m
from tapeloom.streaming import windows as st

r = rounded_sql
_US = "epoch_us(ts)"
#: Arrivals as streaming/windows.py makes them; wm is the watermark that a batch finds, over the one after all.
_ARRIVED = f"""WITH ends AS (SELECT min({_US}) AS a, max({_US}) AS b FROM events),
q AS (SELECT e.*, CAST(least(3, (({_US} - a) * 4) // greatest(b - a, 1)) AS INTEGER) AS quarter FROM events e, ends),
arrived AS (SELECT q.* EXCLUDE (quarter), CASE WHEN event_id % 97 = 0 THEN least(3, quarter + 2) ELSE quarter END AS batch FROM q, range(2) c(copy) WHERE copy = 0 OR event_id % 10 = 0),
marks AS (SELECT k AS batch, (SELECT max(ts) FROM arrived WHERE batch < k) - INTERVAL 1 DAY AS wm FROM range(5) b(k)), over AS (SELECT wm AS closed FROM marks WHERE batch = 4)"""


@query(
    "st12_tumbling",
    f"""{_ARRIVED} SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, {r('sum(value)', 4)} AS value FROM arrived JOIN marks USING (batch), over
WHERE (wm IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > wm) AND date_trunc('day', ts) + INTERVAL 1 DAY <= closed GROUP BY ALL""",
)
def tumbling(spark, d):
    """Daily windows of events that come in four arrivals, some of them late."""
    t = st.run(spark, st.arriving(spark, d), st.tumbling)
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(F.col("value"), 4).alias("value"))


@query(
    "st12_sessions",
    f"""{_ARRIVED}, once AS (SELECT * FROM q), g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM once),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n, {r('sum(value)', 4)} AS value FROM s GROUP BY user_id, run HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def sessions(spark, d):
    """Sessions of users whose events come in four arrivals, none late or doubled."""
    t = st.run(spark, st.arriving(spark, d, delayed=None, doubled=None), st.sessions)
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n", rounded(F.col("value"), 4).alias("value"))


@query("st12_distinct_events", f"{_ARRIVED} SELECT DISTINCT event_id, user_id, ts FROM arrived JOIN marks USING (batch) WHERE wm IS NULL OR ts > wm")
def distinct_events(spark, d):
    """Each event once, as long as it doesn't come after the watermark."""
    t = st.run(spark, st.arriving(spark, d), st.distinct_events)
    return t.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("st10_expiry", f"WITH {m.SIGNALS_SQL}, now AS (SELECT max(ts) AS t FROM signals) SELECT id, symbol, ts + to_hours(CAST(12 + 12 * direction AS BIGINT)) < t AS expired FROM signals, now")
def expiry(spark, d, hours: int = 12):
    """Whether a signal has expired by the last one's time: directions up hold a day, neutral ones half, others not at all."""
    s = m.signals(spark, d)
    now = s.agg(F.max("ts").alias("now"))
    end = F.col("ts") + F.make_dt_interval(hours=hours + hours * F.col("direction"))
    return s.crossJoin(F.broadcast(now)).select("id", "symbol", (end < F.col("now")).alias("expired"))

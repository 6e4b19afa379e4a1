"""Streaming queries, run over what is there and compared with batch SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siltflow.registry import query
from siltflow.streaming import windows as S
from siltflow.tables import load

_FMT = "'%Y-%m-%d %H:%M:%S'"


def _named(df, *cols):
    return df.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *cols)


@query("stream_tumbling", f"SELECT strftime(date_trunc('day', ts), {_FMT}) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return _named(S.drain(S.windowed_counts(S.event_stream(spark, sf_dir), "ts", ["event_type"], "1 day"), "complete"), "event_type", "n", "total")


@query("stream_sliding", f"SELECT strftime(time_bucket(INTERVAL 1 DAY, ts) - INTERVAL (k) DAY, {_FMT}) AS start, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events, range(2) t(k) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    return _named(S.drain(S.windowed_counts(S.event_stream(spark, sf_dir), "ts", [], "2 days", "1 day"), "complete"), "n", "total")


_SESSION = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS o FROM events), s AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"


@query("stream_session", f"{_SESSION} SELECT strftime(min(ts), {_FMT}) AS start, user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def stream_session(spark, sf_dir):
    return _named(S.drain(S.sessions(S.event_stream(spark, sf_dir), "ts", ["user_id"], "6 hours"), "complete"), "user_id", "n")


@query("stream_late_drop", f"SELECT strftime(date_trunc('day', ts), {_FMT}) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_late_drop(spark, sf_dir):
    """Append mode: only windows that the watermark has closed come out."""
    return _named(S.drain(S.windowed_counts(S.event_stream(spark, sf_dir), "ts", ["event_type"], "1 day", late="1 hour")), "event_type", "n", "total")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    return S.drain(S.distinct_stream(S.event_stream(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days")).select("user_id", "event_type")


@query("stream_static_join", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_static_join(spark, sf_dir):
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return S.drain(S.event_stream(spark, sf_dir).where("event_type = 'purchase'").join(cust, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"))


@query("stream_stream_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def stream_stream_join(spark, sf_dir):
    e = S.event_stream(spark, sf_dir)
    return S.drain(S.matched(e.where("event_type = 'click'"), S.event_stream(spark, sf_dir).where("event_type = 'purchase'"), "user_id", "1 HOUR").select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b")))


@query("stream_state_counts", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def stream_state_counts(spark, sf_dir):
    def update(key, batches, state):
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    out = S.drain(S.running(S.event_stream(spark, sf_dir).select("user_id"), "user_id", update, "user_id long, n long", "n long"), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"))


@query("stream_word_count", "SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY 1")
def stream_word_count(spark, sf_dir):
    words = S.event_stream(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("word"))
    return S.drain(words.groupBy("word").agg(F.count("*").alias("n")), "complete")

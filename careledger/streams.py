"""Stateful and late streams. The state of what has been idle for long ends, by timers of event time (ts)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MOST_PRESENTATIONS = 4
#: How long a session or question may be idle before its state goes; nothing more is expected of it then.
IDLE_MINUTES = 120
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Idle(StatefulProcessor):
    """One row of state per key. With event time it ends when the key has been idle; turns without a time have nothing to tell that by."""

    schema = ""

    def __init__(self, by_event_time: bool, idle_minutes: int):
        self.by_event_time, self.idle_ms = by_event_time, idle_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def keep(self, value: tuple, rows: pd.DataFrame) -> None:
        self.state.update(value)
        if self.by_event_time:
            latest = int(rows["ts"].max().timestamp() * 1000)
            timers = list(self.handle.listTimers())
            # A late row never brings the end nearer.
            latest = max([latest + self.idle_ms, *timers])
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Touch(_Idle):
    schema = "presentations long, mode string"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shown, mode = self.state.get() if self.state.exists() else (0, "voice")
        rows = pd.concat(list(rows)).sort_values("seq")
        for outcome in rows["outcome"]:
            if mode in ("answered", "given up"):
                break
            shown += 1
            if outcome == "answered":
                mode = "answered"
            elif shown >= MOST_PRESENTATIONS:
                mode = "given up"
            elif outcome == "failed":
                mode = "touch"
        self.keep((shown, mode), rows)
        yield pd.DataFrame({"session_id": [key[0]], "question_id": [key[1]], "presentations": [shown], "mode": [mode]})


class _Priority(_Idle):
    schema = "rank long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        rank = max([int(rows["rank"].max()), *(self.state.get() if self.state.exists() else ())])
        self.keep((rank,), rows)
        yield pd.DataFrame({"session_id": [key[0]], "rank": [rank]})


def _with_state(turns: DataFrame, keys: list[str], processor: type, out: str, late: str, idle_minutes: int) -> DataFrame:
    """``turns`` through a processor of one row of state per key. Such states need the RocksDB store, which is set where the session has none of its own."""
    spark: SparkSession = turns.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    by_event_time = "ts" in turns.columns
    turns = turns.withWatermark("ts", late) if by_event_time else turns
    return turns.groupBy(*keys).transformWithStateInPandas(processor(by_event_time, idle_minutes), out, "Update", "EventTime" if by_event_time else "None")


def stream_touch_fallback(turns: DataFrame, late: str = "10 minutes", idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """A stream of turns (session_id, question_id, seq, outcome: failed, heard or answered; ts, if they have one) to how the question is asked next.

    Each turn presents its question once. Failed speech forces touch until an answer; after four presentations without one it is
    given up. Nothing follows an answer or giving up. State is one short row per session and question, and goes ``idle_minutes`` after the
    question's last turn by ts; without ts it stays. A batch of turns gives the same rows by ranks alone: no more than the first presentations of a question matter.
    """
    if not turns.isStreaming:
        first = Window.partitionBy("session_id", "question_id").orderBy("seq")
        shown = turns.withColumn("nth", F.row_number().over(first).cast("long")).filter(F.col("nth") <= MOST_PRESENTATIONS)
        by = shown.groupBy("session_id", "question_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("outcome") == "answered", F.col("nth"))).alias("answered"), F.bool_or(F.col("outcome") == "failed").alias("failed"))
        mode = F.when(F.col("answered").isNotNull(), "answered").when(F.col("n") >= MOST_PRESENTATIONS, "given up").when(F.col("failed"), "touch").otherwise("voice")
        return by.select("session_id", "question_id", F.coalesce("answered", "n").alias("presentations"), mode.alias("mode"))
    id_type = turns.schema["session_id"].dataType.simpleString()
    return _with_state(turns, ["session_id", "question_id"], _Touch, f"session_id {id_type}, question_id string, presentations long, mode string", late, idle_minutes)


def stream_priority(turns: DataFrame, late: str = "10 minutes", idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """The highest rank that a session has had so far; it only rises. Turns: session_id, rank, and ts if they have one; state goes ``idle_minutes`` after the last, and stays without ts."""
    if not turns.isStreaming:
        return turns.groupBy("session_id").agg(F.max("rank").alias("rank"))
    id_type = turns.schema["session_id"].dataType.simpleString()
    return _with_state(turns, ["session_id"], _Priority, f"session_id {id_type}, rank long", late, idle_minutes)


def stream_documents(papers: DataFrame, late: str = "1 day") -> DataFrame:
    """Documents per day of arrival (ts) and year of their own date: lateness is judged by arrival, so an old paper is never late."""
    day = F.window("ts", "1 day").alias("w")
    by = papers.withWatermark("ts", late).groupBy(day, F.year("document_date").alias("document_year")).agg(F.count(F.lit(1)).alias("documents"))
    return by.select(F.col("w.start").alias("arrived"), "document_year", "documents")


def register(query) -> None:
    """The queries of this module, over whole tables read as a batch."""

    @query("""WITH r AS (SELECT user_id AS session_id, 'q' || event_type AS question_id, event_id % 9 AS o, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events),
        s AS (SELECT session_id, question_id, count(*) AS n, min(nth) FILTER (o = 8) AS a, bool_or(o < 5) AS failed FROM r WHERE nth <= 4 GROUP BY 1, 2)
        SELECT session_id, question_id, coalesce(a, n) AS presentations, CASE WHEN a IS NOT NULL THEN 'answered' WHEN n >= 4 THEN 'given up' WHEN failed THEN 'touch' ELSE 'voice' END AS mode FROM s""")
    def stream_touch_fallback(t):
        outcome = F.when(F.col("event_id") % 9 == 8, "answered").when(F.col("event_id") % 9 < 5, "failed").otherwise("heard")
        turns = t("events").select(F.col("user_id").alias("session_id"), F.concat(F.lit("q"), "event_type").alias("question_id"), F.col("event_id").alias("seq"), outcome.alias("outcome"))
        return globals()["stream_touch_fallback"](turns)

    @query("""SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS arrived, 2000 + event_id % 7 AS document_year, count(*) AS documents FROM events GROUP BY 1, 2""")
    def stream_documents(t):
        return globals()["stream_documents"](t("events").withColumn("document_date", F.make_date((2000 + F.col("event_id") % 7).cast("int"), F.lit(5), F.lit(2))))

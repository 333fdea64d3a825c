"""Alerts that depend on earlier alerts. A critical event alerts when no *alert* of its title lies in the days before;
an event that didn't alert holds nothing back.

In batch, events become one row a title and day first, so that a title's history is as long as the calendar, however
many events it has; a fold over a title's sorted days then takes each that lies more than the quiet days after the last
one taken. In a stream, a title's days wait in state until the watermark has passed them, because a late event may come
before one that is known; a timer of each day then decides it. Both give the same alerts over one history.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.parsing import strip_accents

#: No second alert of a title within so many days.
QUIET_DAYS = 30


def title_key(title: Column) -> Column:
    """A title but for case, accents and blanks; an empty one is null, and never alerts."""
    return F.nullif(F.trim(F.regexp_replace(strip_accents(F.lower(title)), r"\s+", " ")), F.lit(""))


def critical(events: DataFrame, title: Column, is_critical: Column, time: str, event_id: str) -> DataFrame:
    """title, ts, event_id of critical events with a title and a time."""
    told = events.filter(F.coalesce(is_critical, F.lit(False))).select(title_key(title).alias("title"), F.col(time).cast("timestamp").alias("ts"), F.col(event_id).cast("string").alias("event_id"))
    return told.filter("title IS NOT NULL AND ts IS NOT NULL")


def alert_chain(told: DataFrame, quiet_days: int = QUIET_DAYS, alerted: DataFrame | None = None) -> DataFrame:
    """title, day, event_id (a day's first event) of the alerts. told: see critical().

    alerted: title and day (null counts as recent: nothing of that title alerts) of alerts that were sent before.
    """
    days = told.groupBy("title", F.to_date("ts").alias("day")).agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    history = days.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("day", "event_id"))).alias("days"))  # as long as the calendar
    if alerted is not None:
        before = alerted.select(title_key(F.col("title")).alias("title"), F.col("day").cast("date").alias("day")).groupBy("title").agg(F.max("day").alias("last"), F.max(F.col("day").isNull()).alias("undated"))
        history = history.join(before, "title", "left").filter("NOT coalesce(undated, false)")
    else:
        history = history.withColumn("last", F.lit(None).cast("date"))
    nothing = F.array().cast("array<struct<day:date,event_id:string>>")
    start = F.struct(F.col("last").alias("last"), nothing.alias("taken"))

    def take(state: Column, x: Column) -> Column:
        is_new = state["last"].isNull() | (F.datediff(x["day"], state["last"]) > quiet_days)
        return F.when(is_new, F.struct(x["day"].alias("last"), F.concat(state["taken"], F.array(x)).alias("taken"))).otherwise(state)

    chain = history.select("title", F.aggregate("days", start, take, lambda s: s["taken"]).alias("taken"))
    return chain.select("title", F.explode("taken").alias("x")).select("title", "x.day", "x.event_id")


def _ms(day: date) -> int:
    """The first millisecond after a day."""
    return int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000) + 86_400_000


class AlertChain(StatefulProcessor):
    """State of a title: the days that wait, each with its first event, and the last day that alerted."""

    def __init__(self, quiet_days: int = QUIET_DAYS):
        self.quiet_days = quiet_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day date", "ts timestamp, event_id string")
        self.last = handle.getValueState("last", "day date")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            frame = frame.sort_values(["ts", "event_id"])
            for day, own in frame.groupby(frame["ts"].dt.date, sort=True):
                first = (own["ts"].iloc[0].to_pydatetime(), own["event_id"].iloc[0])
                known = self.waiting.getValue((day,)) if self.waiting.containsKey((day,)) else None
                if known is None or first < (known[0], known[1]):
                    self.waiting.updateValue((day,), first)
                self.handle.registerTimer(_ms(day))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Decides all days that are over, in order, whatever the order of the timers."""
        upto = expiredTimerInfo.getExpiryTimeInMs()
        over = sorted(((k[0], v) for k, v in self.waiting.iterator() if _ms(k[0]) <= upto), key=lambda x: x[0])
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for day, (_, event_id) in over:
            if last is None or day - last > timedelta(self.quiet_days):
                last = day
                out.append((key[0], day, event_id))
            self.waiting.removeKey((day,))
        if out:
            self.last.update((last,))
            yield pd.DataFrame(out, columns=["title", "day", "event_id"])

    def close(self) -> None:
        pass


def alert_stream(told: DataFrame, delay: str, quiet_days: int = QUIET_DAYS) -> DataFrame:
    """The alerts of a stream, each when the watermark has passed its day. told: see critical().

    The session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass). Sessions run in UTC.
    """
    return told.withWatermark("ts", delay).groupBy("title").transformWithStateInPandas(AlertChain(quiet_days), outputStructType="title string, day date, event_id string", outputMode="Append", timeMode="EventTime")

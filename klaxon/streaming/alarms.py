"""Streaming forms. Late rows beyond the watermark are dropped, as in any Spark stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.alarms import active

EPISODES = "tag string, level string, start_us long, end_us long, implicit boolean"


def flood_windows(alarms: DataFrame, window_min: int = 10, threshold: int = 10, late: str = "10 minutes") -> DataFrame:
    """Windows with more than `threshold` alarms; ts is a timestamp with zone, as a watermark needs."""
    counts = active(alarms).withWatermark("ts", late).groupBy(F.window("ts", f"{window_min} minutes")).agg(F.count("*").alias("alarm_count"))
    return counts.select(F.col("window.start").alias("window_start"), "alarm_count").where(F.col("alarm_count") > threshold)


def incident_sessions(alarms: DataFrame, site: str = "site", gap_min: int = 15, min_alarms: int = 3, min_tags: int = 2, priorities: tuple[str, ...] = ("CRITICAL", "HIGH"), late: str = "15 minutes", exact: bool = False) -> DataFrame:
    """Sessions of each site that qualify as incidents; they are numbered downstream, in batch. A session's state has a fixed size: whether it has two
    tags is told by its least and its greatest, and `tags` comes from a sketch (within 1 % or so). With `exact`, and for more than two tags
    asked for, it holds the session's distinct tags."""
    rows = active(alarms).withWatermark("ts", late)
    exact = exact or min_tags > 2
    tags = F.size(F.collect_set("tag")) if exact else F.approx_count_distinct("tag", 0.01).cast("int")
    out = rows.groupBy(F.session_window("ts", f"{gap_min} minutes").alias("w"), site).agg(F.count("*").alias("alarm_count"), tags.alias("tags"), F.max(F.col("priority").isin(*priorities)).alias("significant"), F.min("tag").alias("low"), F.max("tag").alias("high"))
    enough = F.col("tags") >= min_tags if exact else F.lit(min_tags) <= F.when(F.col("low") < F.col("high"), 2).otherwise(F.when(F.col("low").isNull(), 0).otherwise(1))
    return out.where((F.col("alarm_count") >= min_alarms) & enough & F.col("significant")).select(site, F.col("w.start").alias("start_ts"), F.col("w.end").alias("closed_ts"), "alarm_count", F.greatest("tags", F.lit(min_tags)).alias("tags"))


class EpisodeProcessor(StatefulProcessor):
    """Keeps the open raise of each (tag, level), and rows that the watermark has not reached, since earlier ones may still come. What it has passed is
    in order, and the batch rule goes over it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "us long")
        self.waiting = handle.getMapState("waiting", "us long, seq long", "transition string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for us, seq, transition in zip(part["us"].tolist(), part["seq"].tolist(), part["transition"].tolist(), strict=True):
                self.waiting.updateValue((us, seq), (transition,))
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues)

    def _release(self, key, timerValues) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator())
        ready = [x for x in held if x[0] <= reached]
        if len(ready) < len(held):
            self.handle.registerTimer(-(-held[len(ready)][0] // 1000))  # when the next of them is reached
        if not ready:
            return
        for us, seq, _ in ready:
            self.waiting.removeKey((us, seq))
        r = pd.DataFrame(ready, columns=["us", "seq", "transition"])
        start = self.open.get()[0] if self.open.exists() else None
        # Whether an episode is open, and since when, depends on the row before alone; the first row's is the kept state.
        clears = r["transition"] == "A2N"
        was_open = (~clears).shift(fill_value=start is not None)
        since = r["us"].shift(fill_value=0 if start is None else start)
        done = clears | (was_open & (r["transition"] == "A2A"))
        out = pd.DataFrame({"start_us": since.where(was_open, r["us"]), "end_us": r["us"], "implicit": ~was_open})[done]
        if clears.iloc[-1]:
            self.open.clear()
        else:
            self.open.update((int(r["us"].iloc[-1]),))
        yield out.assign(tag=key[0], level=key[1])[["tag", "level", "start_us", "end_us", "implicit"]]

    def close(self) -> None:
        pass


def closed_episodes(tx: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Episodes as they close, from a stream of transitions in any order of arrival; needs the RocksDB state store. Rows wait in the state until the
    watermark, `late` behind the newest time, has passed them, and are then taken by (ts, seq); a row that comes after that is dropped.
    What a key holds are its rows of the last `late`, and its open raise."""
    rows = tx.withWatermark("ts", late).select("tag", "level", F.unix_micros("ts").alias("us"), "seq", "transition", "ts")
    found = rows.groupBy("tag", "level").transformWithStateInPandas(EpisodeProcessor(), EPISODES, "append", "eventTime")
    return found.select("tag", "level", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "implicit")

"""Event capture, session memory and counters, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from scriptorium.functions import rules
from scriptorium.operators.style import text_analysis
from scriptorium.session import ship

RETENTION_HOURS, TURNS, TURN_CHARS = 12, 30, 2000


def captured(turns: DataFrame) -> DataFrame:
    """Stateless: each inbound turn with its intent, whether it makes a note and whether it
    needs work (anything but confident chat)."""
    of = rules.event_intent(F.col("text"), F.lit("text"), F.lit(0.0), F.col("turn") > 0, F.lit(None).cast("string"))
    rows = turns.where("role = 'user'").withColumn("_i", of)
    return rows.select("conv_id", "turn", F.col("_i.intent").alias("intent"), F.col("_i.intent").isin("correction", "meta").alias("note"), ((F.col("_i.intent") != "chat") | ~F.col("_i.confident")).alias("work"))


def capture_stream(turns: DataFrame, write: Callable[[str, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The same over a stream: a batch goes to the sinks raw, notes and work by `write`, which
    gets the batch's number and can so repeat a batch without effect."""

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        write("raw", batch, number)
        write("notes", batch.where("note"), number)
        write("work", batch.where("work"), number)
        batch.unpersist()

    return captured(turns).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_memory(events: DataFrame, key: str, ts: str, event_id: str, reset: Column) -> DataFrame:
    """Adds position: the newest 30 turns after the last reset and within 12 hours of the
    newest event, oldest first. Bounds come from an aggregate; only 30 rows a key are ranked."""
    bounds = events.groupBy(key).agg(F.max(ts).alias("_now"), F.max(F.when(reset, F.col(ts))).alias("_reset"))
    live = events.where(~reset).join(bounds, key).where((F.col(ts) > F.col("_now") - F.expr(f"INTERVAL {RETENTION_HOURS} HOURS")) & (F.col("_reset").isNull() | (F.col(ts) > F.col("_reset"))))
    newest = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(event_id))
    kept = live.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= TURNS)
    oldest = Window.partitionBy(key).orderBy(ts, event_id)
    return kept.withColumn("position", F.row_number().over(oldest)).drop("_k", "_now", "_reset")


def session_stream(events: DataFrame, key: str, ts: str, event_id: str, reset: Column) -> DataFrame:
    """The same over a stream, in update mode: key, version (events of the key so far), event_id, position of
    the memory after each batch (an empty memory is a row of position 0). The state of a key is its 30 newest live turns, its newest event and
    its last reset, in any order of arrival; it expires with the retention."""
    ship(events.sparkSession)
    keep = RETENTION_HOURS * 3600 * 1_000_000  # microseconds
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(ts, f"{RETENTION_HOURS} hours").select(F.col(key).alias("key"), ts, F.unix_micros(ts).alias("at"), F.col(event_id).alias("id"), reset.alias("reset"))

    def run(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, cleared, seen, times, ids = state.get if state.exists else (-1, -1, 0, [], [])
        turns = list(zip(times, ids))
        for pdf in batches:
            seen += len(pdf)
            now = max(now, int(pdf["at"].max()))
            cleared = max([cleared, *pdf.loc[pdf["reset"], "at"].tolist()])
            turns += zip(*(pdf.loc[~pdf["reset"], c].tolist() for c in ("at", "id")))
            turns = sorted(t for t in turns if t[0] > now - keep and t[0] > cleared)[-TURNS:]
        state.update((now, cleared, seen, [t for t, _ in turns], [i for _, i in turns]))
        state.setTimeoutTimestamp(max((now + keep) // 1000, state.getCurrentWatermarkMs() + 1))
        made = [(of[0], seen, i, place) for place, (_, i) in enumerate(turns, 1)] or [(of[0], seen, None, 0)]
        yield pd.DataFrame(made, columns=["key", "version", "event_id", "position"]).astype({"event_id": "Int64"})

    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, version long, event_id long, position int", "now long, cleared long, seen long, times array<long>, ids array<long>", "update", "EventTimeTimeout")


def due_checks(events: DataFrame, least: int) -> DataFrame:
    """Events since a subject's last check (signup), and whether a check is due."""
    last = events.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("run_at"))
    since = F.count_if((F.col("event_type") != "signup") & (F.col("run_at").isNull() | (F.col("ts") > F.col("run_at"))))
    return events.join(last, "user_id", "left").groupBy("user_id").agg(since.alias("since")).withColumn("due", F.col("since") >= least)


class _Times(StatefulProcessor):
    """The times of a key's turns after its last reset, in any order of arrival, and of the last `keep` microseconds
    before its newest event if there is such a limit. The state of a key ends by a timer once the watermark
    is RETENTION_HOURS beyond its newest event."""

    def __init__(self, keep: int | None, due: int | None) -> None:
        self.keep, self.due = keep, due

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.of = handle.getValueState("of", "newest long, cleared long, seen long")
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest, cleared, seen = self.of.get() if self.of.exists() else (-1, -1, 0)
        before, new = (newest, cleared), []
        for pdf in rows:
            seen += len(pdf)
            newest = max(newest, int(pdf["at"].max()))
            cleared = max([cleared, *pdf.loc[pdf["reset"], "at"].tolist()])
            new += pdf.loc[~pdf["reset"], "at"].tolist()
        least = max(cleared, newest - self.keep if self.keep else -1)
        held = [t for (t,) in self.times.get()] if self.times.exists() else []
        live = [t for t in [*held, *new] if t > least]
        if before != (newest, cleared) and len(live) < len(held) + len(new):  # something fell out
            if live:
                self.times.put([(t,) for t in live])
            else:
                self.times.clear()
        elif kept := [t for t in new if t > least]:
            self.times.appendList([(t,) for t in kept])
        self.of.update((newest, cleared, seen))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(newest // 1000 + RETENTION_HOURS * 3_600_000, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, seen, len(live))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, _, seen = self.of.get()
        self.of.clear()
        self.times.clear()
        yield self._row(key, seen, 0)

    def _row(self, key, seen: int, live: int) -> pd.DataFrame:
        made = {"key": [key[0]], "version": [seen], "live": [live]}
        return pd.DataFrame(made if self.due is None else made | {"due": [live >= self.due]})

    def close(self) -> None:
        pass


def _counted(events: DataFrame, key: str, ts: str, reset: Column, keep: int | None, due: int | None) -> DataFrame:
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(ts, f"{RETENTION_HOURS} hours").select(F.col(key).alias("key"), ts, F.unix_micros(ts).alias("at"), reset.alias("reset"))
    names = f"key {kind}, version long, live long" + ", due boolean" * (due is not None)
    return rows.groupBy("key").transformWithStateInPandas(_Times(keep, due), names, "Update", "EventTime")


def cadence_stream(events: DataFrame, key: str, ts: str, reset: Column, least: int) -> DataFrame:
    """due_checks over a stream, in update mode: key, version (events so far), live (those since the last check,
    which is a row of `reset`) and due. Rows later than the watermark don't count."""
    return _counted(events, key, ts, reset, None, least)


def live_stream(events: DataFrame, key: str, ts: str) -> DataFrame:
    """The live side of `retention` over a stream, in update mode: key, version, live (turns within the
    retention of the newest one). A key that the watermark passes by the retention has none and no state."""
    return _counted(events, key, ts, F.lit(False), RETENTION_HOURS * 3_600_000_000, None)


def retention_streams(events: DataFrame, key: str, ts: str, raw: str, live: Callable[[DataFrame, int], None], checkpoint: str) -> tuple[StreamingQuery, StreamingQuery]:
    """Both sides of the retention: every turn, late ones too, is appended to the Parquet folder `raw` and never
    taken out, and beside it the live counts go to `live` batch by batch and expire."""
    stored = events.writeStream.format("parquet").option("path", raw).option("checkpointLocation", f"{checkpoint}/raw").trigger(availableNow=True).start()
    counts = live_stream(events, key, ts).writeStream.foreachBatch(live).outputMode("update").option("checkpointLocation", f"{checkpoint}/live").trigger(availableNow=True).start()
    return stored, counts


def hourly(events: DataFrame) -> DataFrame:
    """Tumbling counts by type; on a stream with the retention as watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", f"{RETENTION_HOURS} hours")
    counts = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "n")


def retention(events: DataFrame, key: str, ts: str) -> DataFrame:
    """key, stored, live: all turns stay stored; live ones are within the retention of the newest."""
    newest = events.groupBy(key).agg(F.max(ts).alias("_now"))
    live = F.count_if(F.col(ts) > F.col("_now") - F.expr(f"INTERVAL {RETENTION_HOURS} HOURS"))
    return events.join(newest, key).groupBy(key).agg(F.count("*").alias("stored"), live.alias("live"))


def running_style(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """Running counters of words, sentences and lines; on a stream in update or complete mode."""
    return text_analysis(texts, [key], text_col)


def first_of_each(stream: DataFrame, id_col: str, ts: str) -> DataFrame:
    """Replays without effect: a content id counts once (on a stream, within the retention)."""
    if not stream.isStreaming:
        return stream.dropDuplicates([id_col])
    return stream.withWatermark(ts, f"{RETENTION_HOURS} hours").dropDuplicatesWithinWatermark([id_col])

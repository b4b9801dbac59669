"""Entry-exit pairing on a stream, with the semantics of the batch barrier pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerline import skew
from ledgerline.functions import clocks
from ledgerline.operators import sequence as S
from ledgerline.operators.sequence import MAX_FARE_JOURNEY_S

OUT_SCHEMA = "user_id long, entry_station int, exit_station int, entry_s long, exit_s long"
OPEN_SCHEMA = "s long, station int"
EVENT_SCHEMA = "s long, seq long, kind string, station int"
#: The state API stores its variables in RocksDB.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def settle(open_s: int, open_station: int, events: list[tuple[int, int, str, int]], limit_s: int, max_s: int):
    """Consumes the events before ``limit_s`` in order; returns pairs, the open entry and the waiting events."""
    ready = sorted(e for e in events if e[0] < limit_s)
    waiting = [e for e in events if e[0] >= limit_s]
    times = [e[0] for e in ready]
    pairs = []
    for i, (at, _seq, kind, station) in enumerate(ready):
        repeated = (i > 0 and times[i - 1] == at) or (i + 1 < len(ready) and times[i + 1] == at)
        if kind == "EXIT" and not repeated and open_s >= 0 and at - open_s <= max_s:
            pairs.append((open_station, station, open_s, at))
        open_s, open_station = (at, station) if kind == "ENTRY" and not repeated else (-1, -1)
    return pairs, open_s, open_station, waiting


class Pairing(StatefulProcessor):
    """State of a user: one open entry, and a list of the events that the watermark has not passed yet.

    The list is no longer than the events inside the delay, however many a user has had.
    A timer wakes the user when the watermark passes the first waiting event, or when no
    exit can close the open entry any more.
    """

    def __init__(self, max_s: int):
        self.max_s = max_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN_SCHEMA)
        self.waiting = handle.getListState("waiting", EVENT_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [e for pdf in rows for e in zip(pdf["s"].tolist(), pdf["seq"].tolist(), pdf["kind"].tolist(), pdf["station"].tolist(), strict=True)]
        yield from self._advance(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, [], timerValues)

    def _advance(self, key, new: list[tuple], times) -> Iterator[pd.DataFrame]:
        at = times.getCurrentWatermarkInMs()
        open_s, open_station = self.open.get() if self.open.exists() else (-1, -1)
        held = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        pairs, open_s, open_station, held = settle(open_s, open_station, held + new, at // 1000, self.max_s)
        if not held and open_s >= 0 and open_s + self.max_s < at // 1000:
            open_s = -1
        if held:
            self.waiting.put(held)
        else:
            self.waiting.clear()
        if open_s >= 0:
            self.open.update((open_s, open_station))
        else:
            self.open.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held or open_s >= 0:
            wake = min(e[0] for e in held) if held else open_s + self.max_s
            self.handle.registerTimer(max(wake * 1000 + 1000, at + 1000))
        if pairs:
            out = pd.DataFrame(pairs, columns=["entry_station", "exit_station", "entry_s", "exit_s"])
            yield out.assign(user_id=key[0])[["user_id", "entry_station", "exit_station", "entry_s", "exit_s"]]

    def close(self) -> None:
        pass


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store that ``pair_stream`` needs; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set(*STATE_STORE)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


def pair_stream(events: DataFrame, delay: str = "0 seconds", max_s: int = MAX_FARE_JOURNEY_S) -> DataFrame:
    """Pairs of a stream with (user_id, ts timestamp, s long, seq long, kind, station).

    Events wait until the watermark has passed their timestamp, because a later
    arrival with the same timestamp would void them. The frame must belong to a
    session as ``stream_session`` gives it.
    """
    return events.withWatermark("ts", delay).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Pairing(max_s), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="EventTime")


def flush(spark: SparkSession, progress: str, max_s: int = MAX_FARE_JOURNEY_S) -> DataFrame:
    """The pairs still open when a run has ended: what its state holds, settled as if nothing more came.

    Reads the state by the checkpoint of the run and pairs it in one batch; the state
    stays, so a later run goes on from it as if there had been no flush.
    """
    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("path", progress).option("stateVarName", name).load()

    user = F.col("key.user_id").alias("user_id")
    open_ = state("open").select(user, F.col("value.s").alias("s"), F.lit(-1).cast("long").alias("seq"), F.lit("ENTRY").alias("kind"), F.col("value.station").alias("station"))
    waiting = state("waiting").select(user, *[F.col(f"list_element.{c}").alias(c) for c in ("s", "seq", "kind", "station")])
    pairs = S.barrier_pairs(open_.unionByName(waiting), "user_id", "s", "seq", "kind", ["station"], skew.span("s", clocks.DAY_S), max_s=max_s)
    return pairs.select("user_id", "entry_station", "exit_station", "entry_s", "exit_s")


def pair_files(spark: SparkSession, events, out: str, progress: str, delay: str = "0 seconds", max_s: int = MAX_FARE_JOURNEY_S) -> DataFrame:
    """Runs the stream that ``events`` makes of a session to the end of what is there, and returns all pairs, those of its last instants included."""
    stream = pair_stream(events(stream_session(spark)), delay, max_s)
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return spark.read.schema(OUT_SCHEMA).parquet(out).unionByName(flush(stream_session(spark), progress, max_s))

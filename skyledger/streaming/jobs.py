"""Structured Streaming forms of the operators. Batch results over the same events are the reference.

Every stream uses ``ts`` (TIMESTAMP) for watermarks and ``us`` for exact arithmetic. Micro-batches are bounded by the
source options (files or offsets per trigger), so a hot key brings at most one batch of rows into its state task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from skyledger.functions.columns import MINUTE, is_read_action
from skyledger.operators.rules import match_rules
from skyledger.session import checkpoint_root


def read_events(spark: SparkSession, path: str, schema, name_filter: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    """File stream of event rows in parquet."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(path)


def bounded_dedup(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival per (source, event_id), remembered for the watermark delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source", "event_id"])


def stream_rules(events: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Stateless rule matching, appended as events arrive."""
    return match_rules(events, rules)


def stream_new_geo(events: DataFrame, countries: DataFrame, delay: str = "30 days") -> DataFrame:
    """Known principal from a new country, once per (principal, country) within the watermark."""
    hits = events.filter("geo <> ''").join(countries, "principal").filter(~F.array_contains("known_geos", F.col("geo")))
    return hits.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["principal", "geo"]).select("principal", "geo", "event_id", "us")


# ---------------------------------------------------------------- keyed, ordered state

#: Microseconds of event time whose waiting rows of a key are one state entry.
SLICE = 5 * MINUTE


class _Ordered(StatefulProcessor):
    """Rows of a key in event-time order. They wait in one state entry per time slice; a timer at the end of the slice hands them on.

    A busy key has many small entries, each read and removed once. What a subclass remembers between slices is one row (``memory``).
    """

    columns: list[str]
    waiting: str
    memory: str
    output: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slices = handle.getMapState("slices", "slice LONG", f"rows ARRAY<STRUCT<{self.waiting}>>")
        self.remembered = handle.getValueState("memory", self.memory)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for part, new in frame.groupby(frame["us"] // SLICE):
                at = (int(part),)
                known = self.slices.getValue(at) if self.slices.containsKey(at) else None
                self.slices.updateValue(at, ([*(tuple(r) for r in (known[0] if known else [])), *new[self.columns].itertuples(index=False, name=None)],))
                if known is None:
                    self.handle.registerTimer((int(part) + 1) * SLICE // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = (expiredTimerInfo.getExpiryTimeInMs() * 1000 // SLICE - 1,)
        if self.slices.containsKey(at):
            rows = sorted(tuple(r) for r in self.slices.getValue(at)[0])
            self.slices.removeKey(at)
            known, out = self.walk(key[0], self.remembered.get() if self.remembered.exists() else None, rows)
            self.remembered.update(known)
            if out:
                yield pd.DataFrame(out, columns=self.output)

    def walk(self, key, known: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """What to remember, and what to emit for the rows of a slice in order."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Travel(_Ordered):
    columns, waiting, memory = ["us", "seq", "geo", "event_id"], "us: LONG, seq: LONG, geo: STRING, event_id: STRING", "geo STRING, us LONG"
    output = ["principal", "event_id", "us", "from_geo", "to_geo", "minutes"]

    def __init__(self, gap: int):
        self.gap = gap

    def walk(self, key, known, rows):
        last_geo, last_us = known or (None, None)
        out = []
        for us, _seq, geo, event_id in rows:
            if last_geo is not None and last_geo != geo and us - last_us <= self.gap:
                out.append((key, event_id, us, last_geo, geo, (us - last_us) // MINUTE))
            last_geo, last_us = geo, us
        return (last_geo, last_us), out


def stream_impossible_travel(events: DataFrame, max_gap_minutes: int = 60, delay: str = "1 hour") -> DataFrame:
    """Country change within the gap per principal, in event-time order behind the watermark. Needs the RocksDB state store."""
    return (events.filter("geo <> ''").withWatermark("ts", delay).select("principal", "us", "seq", "geo", "event_id", "ts").groupBy("principal").transformWithStateInPandas(
        _Travel(max_gap_minutes * MINUTE), "principal STRING, event_id STRING, us BIGINT, from_geo STRING, to_geo STRING, minutes BIGINT", "Append", "EventTime"))


class _Bursts(_Ordered):
    """Remembers the latest call per API name, bounded by the API vocabulary, not the calls of the window."""

    columns, waiting = ["us", "seq", "event", "event_id"], "us: LONG, seq: LONG, event: STRING, event_id: STRING"
    memory, output = "names ARRAY<STRING>, times ARRAY<LONG>, firing BOOLEAN", ["principal", "event_id", "us", "distinct_names", "names"]

    def __init__(self, window: int, threshold: int):
        self.window, self.threshold = window, threshold

    def walk(self, key, known, rows):
        names, times, firing = known or ([], [], False)
        latest, out = dict(zip(names, times, strict=True)), []
        for us, _seq, event, event_id in rows:
            latest[event] = us
            latest = {n: t for n, t in latest.items() if us - t <= self.window}
            hit = len(latest) >= self.threshold
            if hit and not firing:
                out.append((key, event_id, us, len(latest), ",".join(sorted(latest))))
            firing = hit
        return (list(latest), list(latest.values()), firing), out


def stream_enumeration_bursts(events: DataFrame, window_minutes: int = 5, distinct_threshold: int = 8, delay: str = "1 hour") -> DataFrame:
    """Rising edges of distinct read APIs in the trailing window. Needs the RocksDB state store."""
    reads = events.filter(is_read_action(F.col("event"))).withWatermark("ts", delay).select("principal", "us", "seq", "event", "event_id", "ts")
    return reads.groupBy("principal").transformWithStateInPandas(
        _Bursts(window_minutes * MINUTE, distinct_threshold), "principal STRING, event_id STRING, us BIGINT, distinct_names BIGINT, names STRING", "Append", "EventTime")


# ---------------------------------------------------------------- windows

def stream_case_sessions(detections: DataFrame, window_minutes: int = 60, delay: str = "2 hours") -> DataFrame:
    """Detection sessions per principal or address; an event exactly at the gap still belongs to the session."""
    keys = F.array(F.struct(F.lit("principal").alias("kind"), F.col("principal").alias("value")), F.struct(F.lit("src_ip").alias("kind"), F.col("src_ip").alias("value")))
    keyed = detections.withWatermark("ts", delay).select("ts", "us", "det_id", "confidence", F.explode(keys).alias("k")).select("ts", "us", "det_id", "confidence", "k.*").filter("value <> ''")
    return (keyed.groupBy(F.session_window("ts", f"{window_minutes} minutes"), "kind", "value")
            .agg(F.count("*").alias("n"), F.min("us").alias("us_start"), F.max("us").alias("us_end"), F.min("det_id").alias("first_det")).drop("session_window"))


def stream_s3_daily(events: DataFrame, profile: DataFrame, sigma: float = 3.0, minimum_get_delta: int = 20,
                    minimum_byte_delta: int = 50 * 1024 * 1024, delay: str = "1 hour") -> DataFrame:
    """Daily read totals per principal against the learned profile."""
    daily = (events.filter("event = 'GetObject'").withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "principal")
             .agg(F.count("*").alias("get_count"), F.sum("bytes").alias("bytes")).select("principal", F.col("window.start").alias("day"), "get_count", "bytes"))
    d = daily.join(profile, "principal")
    count_limit = F.greatest(F.col("daily_get_mean") + sigma * F.col("daily_get_std"), F.col("daily_get_mean") + minimum_get_delta)
    byte_limit = F.greatest(F.col("daily_bytes_mean") + sigma * F.col("daily_bytes_std"), F.col("daily_bytes_mean") + minimum_byte_delta)
    return d.filter((F.col("get_count") > count_limit) | (F.col("bytes") > byte_limit)).select("principal", "day", "get_count", "bytes")


# ---------------------------------------------------------------- sinks

def start_append(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet files, exactly once through the checkpoint; stops when the source is drained."""
    return (stream.writeStream.outputMode("append").format("parquet").option("path", output).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def start_case_feed(changed: DataFrame, root: str, checkpoint: str, key: str = "case_id", version: str = "version") -> StreamingQuery:
    """Keyed case rows kept up to date: each micro-batch is merged into the buckets of its keys."""
    from skyledger.sources.store import upsert

    def merge(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            upsert(batch, root, key, version, f"{checkpoint}#{epoch}")

    return changed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all available input into the shared folder and return what it wrote."""
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    start_append(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store with timers and map state, for the streams started inside."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def drain_to_the_end(build: Callable[[str], DataFrame], rows: DataFrame, marker: DataFrame, name: str) -> DataFrame:
    """Run the stream ``build(folder)`` over ``rows`` landed in a folder, and then past their end.

    ``marker``: rows of a later time that the stream's filters let through. They are landed after everything else; the restarted query takes them
    in, its watermark passes all rows before, and what waited for it comes out.
    """
    spark = rows.sparkSession
    root = f"{checkpoint_root(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/in")
    with rocks(spark):
        start_append(build(f"{root}/in"), f"{root}/out", f"{root}/state").awaitTermination()
        marker.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = build(f"{root}/in")
        start_append(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def complete(stream: DataFrame, name: str) -> DataFrame:
    """Run a windowed stream over all available input and return its full result, open windows included."""
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    last: list[str] = []

    def keep(batch: DataFrame, epoch: int) -> None:
        path = f"{root}/out/{epoch}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [path]

    (stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(*last)

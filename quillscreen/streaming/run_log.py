"""The event log of runs as a stateful stream: one summary per run, kept up to date while events arrive.

Events are masked before anything is stored. Each run has a state of its own: its totals, the events per stage, and the ids seen lately, so an event
that is delivered twice counts once. Ids are forgotten, by a timer, when the watermark has passed their event by the allowed delay, as a repeat
that late is dropped anyway; so the state of a run does not grow with its events. Every micro-batch writes the summaries it changed to a folder
of its own number, and a batch that is run again after a failure replaces that folder: the newest row of each run is the state of the log.

Defined cases: events without a run or a time are left out; an event without an id always counts; a missing stage counts as ''; late events, older than the watermark,
are dropped by the engine; an empty log gives no rows. The summaries of a stream that got all its events in time equal ``summarise``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillscreen.sources.sinks import redacted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT = "run string, event_id string, ts timestamp, level string, stage string, message string, details map<string,string>"
CHANGED = "run string, n_events long, n_errors long, n_masked long, stages map<string,bigint>, first_us long, last_us long, last_details string"
RUN = "n_events long, n_errors long, n_masked long, first_us long, last_us long, last_id string, last_details string, stages array<string>, counts array<bigint>, ids array<string>, us array<bigint>, apart boolean"
SUMMARY = "run string, n_events long, n_errors long, n_masked long, stages map<string,bigint>, first_ts timestamp, last_ts timestamp, last_details string"
#: Parts of the names of details that hold secrets, and what stands for their values.
SECRET_MARKERS, MASK = ("api_key", "apikey", "token", "secret", "password", "key_input"), "[redacted]"
#: Ids of a run that are kept as one value.
TOGETHER = 1_000
#: The state store that keyed state needs.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def mask(value: Any) -> Any:
    """A nested value of the driver with the values of secret-looking keys masked, at every depth."""
    if isinstance(value, dict):
        return {k: MASK if any(m in str(k).lower() for m in SECRET_MARKERS) else mask(v) for k, v in value.items()}
    return [mask(v) for v in value] if isinstance(value, (list, tuple)) else value


def write(events: DataFrame, path: str) -> None:
    """Adds events to a log as JSON files, to the microsecond."""
    events.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def append(spark: SparkSession, path: str, run: str, stage: str, message: str, details: dict[str, Any] | None = None, level: str = "info", event_id: str | None = None) -> None:
    """Adds one event to the log of a run: a new JSON file in its folder, masked before it is written."""
    import json
    import uuid

    flat = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str) for k, v in mask(details or {}).items()}
    row = (run, event_id or uuid.uuid4().hex, level, stage, message, flat)
    one = spark.createDataFrame([row], "run string, event_id string, level string, stage string, message string, details map<string,string>")
    write(one.withColumn("ts", F.current_timestamp()).coalesce(1), path)


def clean(events: DataFrame) -> DataFrame:
    """Masked events with a run and a time."""
    shown = F.coalesce(redacted(F.col("details")), F.create_map().cast("map<string,string>"))
    kept = events.filter("run IS NOT NULL AND ts IS NOT NULL")
    return kept.select("run", "event_id", "ts", F.coalesce("level", F.lit("")).alias("level"), F.coalesce("stage", F.lit("")).alias("stage"), F.to_json(_sorted(shown)).alias("details"), F.size(F.filter(F.map_values(shown), lambda v: v == MASK)).cast("long").alias("n_masked"))


def _sorted(details):
    return F.map_from_entries(F.array_sort(F.map_entries(details)))


def read(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The stream of the event files in a folder."""
    reader = spark.readStream.schema(EVENT)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


class RunSummary(StatefulProcessor):
    """State and summary of one run.

    Each call of the state passes a socket, so a run's events are counted first, and its state is one value that is read and written once for all of them. It has the
    first ``TOGETHER`` ids; more are kept one by one, so that a run of many events is never held as a whole.
    """

    def __init__(self, delay_ms: int) -> None:
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)
        self.seen = handle.getMapState("seen", "event_id string", "us long")
        # What checkpoints from before the one value hold.
        self.totals = handle.getValueState("totals", "n_events long, n_errors long, n_masked long, first_us long, last_us long, last_id string, last_details string")
        self.stages = handle.getMapState("stages", "stage string", "n long")

    def _kept(self) -> tuple[tuple, dict[str, int], dict[str, int], bool]:
        """The totals, the events by stage, the ids kept together with their times, and whether others are kept one by one."""
        kept = self.run.get()
        if kept is not None:
            *totals, stages, counts, ids, us, apart = kept
            return tuple(totals), dict(zip(stages, counts, strict=True)), dict(zip(ids, us, strict=True)), apart
        if self.totals.exists():
            return self.totals.get(), {k[0]: v[0] for k, v in self.stages.iterator()}, {}, True
        return (0, 0, 0, None, None, "", ""), {}, {}, False

    def _keep(self, totals: tuple, stages: dict[str, int], recent: dict[str, int], apart: bool) -> None:
        self.run.update((*totals, list(stages), list(stages.values()), list(recent), list(recent.values()), apart))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N803  (Spark's name)
        (n, errors, masked, first, last, last_id, details), stages, recent, apart = self._kept()
        latest = None
        for part in rows:
            for r in part.itertuples(index=False):
                us = int(r.us)
                if r.event_id is not None:
                    if r.event_id in recent or (apart and self.seen.containsKey((r.event_id,))):
                        continue
                    if len(recent) < TOGETHER:
                        recent[r.event_id] = us
                    else:
                        apart = True
                        self.seen.updateValue((r.event_id,), (us,))
                    latest = us if latest is None else max(latest, us)
                n, errors, masked = n + 1, errors + (r.level == "error"), masked + int(r.n_masked)
                stages[r.stage] = stages.get(r.stage, 0) + 1
                first = us if first is None else min(first, us)
                # Of events at one time the largest id is the last, whatever order they came in.
                if last is None or (us, r.event_id or "") >= (last, last_id):
                    last, last_id, details = us, r.event_id or "", r.details
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + self.delay_ms)
        if n:
            self._keep((n, errors, masked, first, last, last_id, details), stages, recent, apart)
            yield self._row(key, (n, errors, masked, first, last, last_id, details), stages)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        until = (expiredTimerInfo.getExpiryTimeInMs() - self.delay_ms) * 1000 + 999
        totals, stages, recent, apart = self._kept()
        left = {k: us for k, us in recent.items() if us > until}
        if apart:
            apart = False
            for (event_id,), (us,) in list(self.seen.iterator()):
                if us <= until:
                    self.seen.removeKey((event_id,))
                else:
                    apart = True
        self._keep(totals, stages, left, apart)
        return iter([])

    def _row(self, key: Any, totals: tuple, stages: dict[str, int]) -> pd.DataFrame:
        n, errors, masked, first, last, _, details = totals
        return pd.DataFrame({"run": [key[0]], "n_events": [n], "n_errors": [errors], "n_masked": [masked], "stages": [stages], "first_us": [first], "last_us": [last], "last_details": [details]})

    def close(self) -> None:
        pass


def summaries(events: DataFrame, delay: int = 600) -> DataFrame:
    """The stream of changed summaries of a stream of events that may come up to ``delay`` seconds late."""
    d = clean(events).withWatermark("ts", f"{delay} seconds").withColumn("us", F.unix_micros("ts"))
    changed = d.groupBy("run").transformWithStateInPandas(statefulProcessor=RunSummary(delay * 1000), outputStructType=CHANGED, outputMode="Update", timeMode="EventTime")
    return changed.select("run", "n_events", "n_errors", "n_masked", "stages", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "last_details")


def follow(events: DataFrame, sink: str, checkpoint: str, delay: int = 600) -> None:
    """Brings the summaries in ``sink`` up to the events there are, and ends; a later call with the same checkpoint goes on from there."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER)

    def store(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    spark.conf.set(PROVIDER, ROCKS)
    try:  # the provider of a stream is fixed when it starts
        running = summaries(events, delay).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    finally:
        spark.conf.set(PROVIDER, before)
    running.awaitTermination()


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """The newest summary of each run."""
    kept = spark.read.schema(SUMMARY + ", batch long").option("basePath", sink).parquet(sink)
    names = [c for c in kept.columns if c not in ("run", "batch")]
    newest = kept.groupBy("run").agg(F.max_by(F.struct(*names), "batch").alias("s"))
    return newest.select("run", "s.*")


def summarise(events: DataFrame) -> DataFrame:
    """The same summaries of a complete log, in one batch."""
    d = clean(events)
    # Of two deliveries of an event the one kept matters only if they differ; the smallest does.
    once = d.filter("event_id IS NOT NULL").groupBy("run", "event_id").agg(F.min(F.struct("ts", "level", "stage", "details", "n_masked")).alias("e")).select("run", "event_id", "e.*")
    every = once.unionByName(d.filter("event_id IS NULL"))
    counts = every.groupBy("run", "stage").agg(
        F.count("*").alias("n"), F.count_if(F.col("level") == "error").alias("e"), F.sum("n_masked").alias("m"), F.min("ts").alias("a"), F.max(F.struct("ts", F.coalesce("event_id", F.lit("")).alias("i"), "details")).alias("z")
    )
    return counts.groupBy("run").agg(
        F.sum("n").alias("n_events"), F.sum("e").alias("n_errors"), F.sum("m").alias("n_masked"), _sorted(F.map_from_entries(F.collect_list(F.struct("stage", "n")))).alias("stages"), F.min("a").alias("first_ts"), F.max("z.ts").alias("last_ts"), F.max("z").alias("z")
    ).withColumn("last_details", F.col("z.details")).drop("z")

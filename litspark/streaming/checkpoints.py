"""Operations over many items as state machines: what is done, what failed, what stalled, across restarts.

Items are dealt by hash to a fixed number of buckets; a bucket is a key with a state of its own (transformWithState): the
last event and the counts of each of its items, as one Arrow table that a batch reads, merges in pandas and writes once.
So calls to the state store grow with the buckets, not with the items.  An item's events may come in any order and any
number of micro-batches; the last one by (at, seq) decides, errors are counted, and the bucket's event-time timer, set to
the earliest item that is due, marks items that were started and then heard of no more.  A change of an item is one
appended row, so the table of changes is written exactly once by the file sink, and a stopped or killed query goes on from
its checkpoint.  A batch rewrites the buckets that it touches, whole: for many small batches over very many items take more
buckets (a checkpoint keeps the number that it began with).

Item states: ``active`` (started, or failed but to be tried again), ``interrupted`` (active, then silent for longer than
``stall``), ``failed`` (as many errors as ``attempts``), ``completed``.  A later event takes an item out of any state.

Events: operation_id, item_key, event (started, ok, error), at (timestamp), seq (long, breaks ties of at), message.  Rows
without operation_id, item_key, event or at are left out; other events than the three count as started; equal events that
repeat count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["operation_id", "item_key"]
BUCKETS = 4096
LAST = ["event", "us", "seq", "message"]  # us: microseconds since 1970
STATE = pa.schema([
    *((c, pa.string()) for c in KEY), ("event", pa.string()), ("us", pa.int64()), ("seq", pa.int64()), ("message", pa.string()),
    ("errors", pa.int64()), ("oks", pa.int64()), ("version", pa.int64()), ("state", pa.string()),
])
CHANGES = "operation_id string, item_key string, version long, state string, errors int, oks int, at timestamp, message string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def merged(*parts: pd.DataFrame) -> pd.DataFrame:
    """One row an item: the last event by (us, seq), of equals the later part's, and the sums of errors and oks."""
    rows = pd.concat(parts, ignore_index=True)
    sums = rows.groupby(KEY, sort=False)[["errors", "oks"]].sum()
    last = rows.sort_values(["us", "seq"], kind="stable").drop_duplicates(KEY, keep="last")
    return last[[*KEY, *LAST]].join(sums, on=KEY)


class ItemMachine(StatefulProcessor):
    """The items of one bucket; rows are merged as they come, so an item may have any number of events in a batch."""

    def __init__(self, attempts: int, stall_ms: int):
        self.attempts, self.stall_ms = attempts, stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getValueState("items", "items binary")

    def _load(self) -> pd.DataFrame:
        with pa.ipc.open_stream(bytes(self.items.get()[0])) as stream:
            return stream.read_pandas()

    def _save(self, items: pd.DataFrame) -> None:
        """Keep the items, and a timer for the first active one that is due."""
        out, table = pa.BufferOutputStream(), pa.Table.from_pandas(items, STATE, preserve_index=False)
        with pa.ipc.new_stream(out, STATE) as stream:
            stream.write_table(table)
        self.items.update((out.getvalue().to_pybytes(),))
        active = items["us"][items["state"] == "active"]
        if len(active):
            self.handle.registerTimer(int(active.min()) // 1000 + self.stall_ms)

    @staticmethod
    def _rows(items: pd.DataFrame) -> pd.DataFrame:
        out = items[[*KEY, "version", "state", "errors", "oks"]].astype({"errors": "int32", "oks": "int32"})
        return out.assign(at=pd.to_datetime(items["us"], unit="us", utc=True), message=items["message"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = None
        for part in rows:
            part = part[[*KEY, *LAST]].assign(errors=(part["event"] == "error").astype("int64"), oks=(part["event"] == "ok").astype("int64"))
            new = merged(part) if new is None else merged(new, part)
        rest = None
        if self.items.exists():
            old = self._load()
            touched = pd.MultiIndex.from_frame(old[KEY]).isin(pd.MultiIndex.from_frame(new[KEY]))
            rest, old = old[~touched], old[touched]
            new = merged(old[new.columns], new).join(old.set_index(KEY)["version"], on=KEY)
            new["version"] = new["version"].fillna(0).astype("int64") + 1
        else:
            new["version"] = 1
        new["state"] = "active"
        new.loc[(new["event"] == "error") & (new["errors"] >= self.attempts), "state"] = "failed"
        new.loc[new["event"] == "ok", "state"] = "completed"
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._save(new if rest is None else pd.concat([rest, new], ignore_index=True))
        yield self._rows(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        items = self._load()
        due = items["us"] // 1000 + self.stall_ms
        over = (items["state"] == "active") & ((due <= expiredTimerInfo.getExpiryTimeInMs()) | (due < timerValues.getCurrentWatermarkInMs()))
        items.loc[over, "state"] = "interrupted"
        items.loc[over, "version"] += 1
        self._save(items)
        if over.any():
            yield self._rows(items[over])

    def close(self) -> None:
        pass


def item_changes(events: DataFrame, attempts: int = 3, stall: str = "1 hour", late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """The changes of every item of a stream of events; stall: how long after an active item's last event, as event time
    passes, it counts as interrupted.  Event time is the newest event's, less ``late``: what the source may be out of order
    by.  An event that comes later than that is left out by Spark (and counted in the query's progress)."""
    rows = events.selectExpr(
        "cast(operation_id as string) operation_id", "cast(item_key as string) item_key", "case when event in ('ok', 'error') then event else 'started' end event",
        "cast(at as timestamp) at", "cast(coalesce(seq, 0) as long) seq", "cast(coalesce(message, '') as string) message",
    ).filter("operation_id is not null and item_key is not null and at is not null")
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket")
    rows = rows.select("*", F.unix_micros("at").alias("us"), bucket).withWatermark("at", late)
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=ItemMachine(attempts, int(pd.Timedelta(stall).total_seconds() * 1000)), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime"
    )


def track(spark: SparkSession, events: DataFrame, target: str, checkpoint: str, attempts: int = 3, stall: str = "1 hour", late: str = "1 day", buckets: int = BUCKETS) -> None:
    """Work off what is there of a stream of events and append the changes to target; calls go on where the last one,
    finished or killed, stopped."""
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)  # needed by transformWithState; a query keeps the one it began with
    query = item_changes(events, attempts, stall, late, buckets).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    query.trigger(availableNow=True).start(target).awaitTermination()


def item_states(changes: DataFrame) -> DataFrame:
    """The last change of every item."""
    value = F.struct(*(c for c in changes.columns if c not in KEY))
    return changes.groupBy(*KEY).agg(F.max_by(value, "version").alias("_s")).select(*KEY, "_s.*")


def operation_states(planned: DataFrame, states: DataFrame) -> DataFrame:
    """planned (operation_id, item_key) and item states -> per operation total, pending (never heard of), active, interrupted,
    failed, completed, errors and its state: active while an item is or, unless one is interrupted, while some are pending;
    else interrupted, failed (nothing completed) or completed.  Items that were not planned don't count."""
    cast = [F.col(c).cast("string").alias(c) for c in KEY]
    rows = planned.select(*cast).distinct().join(states.select(*cast, "state", "errors"), KEY, "left")
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    out = rows.groupBy("operation_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("state").isNull()).alias("pending"), n("active"), n("interrupted"), n("failed"), n("completed"),
        F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("errors"),
    )
    state = (
        F.when(F.col("active") > 0, "active").when(F.col("interrupted") > 0, "interrupted").when(F.col("pending") > 0, "active")
        .when((F.col("completed") == 0) & (F.col("failed") > 0), "failed").otherwise("completed")
    )
    return out.withColumn("state", state)


def to_do(planned: DataFrame, states: DataFrame) -> DataFrame:
    """What a restarted operation still has to do: planned items that are neither completed nor failed."""
    cast = [F.col(c).cast("string").alias(c) for c in KEY]
    done = states.filter(F.col("state").isin("completed", "failed")).select(*cast)
    return planned.select(*cast).distinct().join(done, KEY, "left_anti")

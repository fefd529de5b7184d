"""Steps of work assembled by a stream: events wait in state until the watermark has passed them, then run in their order
through an open step of their key, which is emitted when the next one opens or when the key has been idle. Keys share state
by buckets of their hash, so that an event costs no call of its own to the state store."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..storage import new_path, set_conf

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fifty years: by default only the end of a source ends a last step.
IDLE_MS = 50 * 365 * 86_400_000
STEP = "key string, step int, first bigint, last bigint, ended bigint"
#: Buckets of keys that have their state in common, of which a task holds one at a time; events that a task packs at once.
BUCKETS, PACKED = 1024, 1 << 18
_EVENT = pa.schema([("key", pa.string()), ("at", pa.int64()), ("opens", pa.bool_()), ("ends", pa.bool_())])
_STEP = pa.schema([("key", pa.string()), ("step", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("ended", pa.int64())])
#: In place of the end of a step that has none yet.
_NEVER = np.iinfo(np.int64).min


def _packed(table: pa.Table) -> list[tuple[bytes]]:
    return [(b.serialize().to_pybytes(),) for b in table.to_batches() if len(b)]


def _unpacked(rows: Iterable[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(r[0])), schema) for r in rows], schema).combine_chunks()


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, first moment and events as one packed table, of some events at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= PACKED:
            yield _dealt(held)
            held, n = [], 0
    if n:
        yield _dealt(held)


def _dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    bucket = table.column("bucket").to_numpy()
    order = np.argsort(bucket, kind="stable")
    events = table.select(_EVENT.names).take(pa.array(order)).cast(_EVENT).combine_chunks().to_batches()[0]
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    sizes = np.diff(np.append(starts, len(order)))
    packed = [events.slice(at, size).serialize().to_pybytes() for at, size in zip(starts.tolist(), sizes.tolist(), strict=True)]
    first = np.minimum.reduceat(events.column("at").to_numpy(), starts)
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][starts]), pa.array(first), pa.array(packed, pa.binary())], names=["bucket", "first", "events"])


def assemble(held: pa.Table, events: pa.Table, passed: int, idle_ms: int) -> tuple[pa.Table, pa.Table, pa.Table, int | None]:
    """Finished steps, open ones, events that wait on, and when to look again (ms), from the open steps of some keys and
    their events, when the watermark has passed `passed`. At one moment, events that open come last."""
    at, n = events.column("at").to_numpy(), held.num_rows
    ready = at // 1000 < passed
    keys = pa.concat_arrays([t.column("key").combine_chunks() for t in (held, events)]).dictionary_encode(null_encoding="encode")
    key = keys.indices.to_numpy().astype(np.int64)
    waits = np.zeros(len(keys.dictionary), bool)
    waits[key[n:][~ready]] = True
    later, now = events.filter(pa.array(~ready)), at[ready]
    opens, ends = (events.column(c).to_numpy()[ready] for c in ("opens", "ends"))
    old = {c: held.column(c).fill_null(_NEVER if c == "ended" else 0).to_numpy() for c in ("step", "first", "last", "ended")}
    # An open step comes before its key's events and stands for those that it has had.
    none = np.zeros(n, bool)
    key, event = np.concatenate([key[:n], key[n:][ready]]), np.concatenate([none, np.ones(len(now), bool)])
    first, last, ended = np.concatenate([old["first"], now]), np.concatenate([old["last"], now]), np.concatenate([old["ended"], np.where(ends, now, _NEVER)])
    number, opens = np.concatenate([old["step"].astype(np.int64), opens.astype(np.int64)]), np.concatenate([none, opens])
    order = np.lexsort((np.concatenate([none, ends]), opens, first, event, key))
    key, first, last, ended, number, opens = (x[order] for x in (key, first, last, ended, number, opens))
    fresh = np.diff(key, prepend=-1) != 0
    starts = np.flatnonzero(fresh | opens)
    key, first, fresh = key[starts], first[starts], fresh[starts]
    last = last[np.append(starts, len(last))[1:] - 1]
    ended = np.maximum.reduceat(ended, starts) if len(starts) else ended
    # Numbers go on by one from the first of a key.
    more = np.where(fresh, number[starts], 1)
    total = np.cumsum(more)
    number = total - np.repeat((total - more)[fresh], np.diff(np.append(np.flatnonzero(fresh), len(fresh))))
    final = np.diff(key, append=-1) != 0
    over = ~final | ((last // 1000 + idle_ms < passed) & ~waits[key])

    def steps(some: np.ndarray) -> pa.Table:
        columns = [keys.dictionary.take(pa.array(key[some])), number[some].astype(np.int32), first[some], last[some], pa.array(ended[some], mask=ended[some] == _NEVER)]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_STEP)

    moments = [(last[~over & ~waits[key]] // 1000 + idle_ms + 1), (at[~ready] // 1000 + 1)]
    wake = min((int(m.min()) for m in moments if len(m)), default=None)
    return steps(over), steps(~over), later, wake


class Assembler(StatefulProcessor):
    """State of a bucket of keys, as packed tables: events not yet in order (waiting), and the open steps: key, number, first
    and last event, last end. Events before the watermark of the bucket's last steps are late."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.open = handle.getListState("open", "steps binary")
        self.alarm = handle.getValueState("alarm", "at bigint")
        self.passed = handle.getValueState("passed", "at bigint")

    def _wake(self, ms: int) -> None:
        """One timer for each bucket: the earliest that it needs."""
        now = self.alarm.get() if self.alarm.exists() else None
        if now is None or ms < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(ms)
            self.alarm.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = self.passed.get()[0] if self.passed.exists() else None
        moments = []
        for part in rows:
            for first, events in zip(part["first"].tolist(), part["events"], strict=True):
                if passed is None or first // 1000 >= passed:
                    self.waiting.appendValue((bytes(events),))
                    moments.append(first)
                    continue
                table = _unpacked([(events,)], _EVENT)
                table = table.filter(pa.array(table.column("at").to_numpy() // 1000 >= passed))
                if table.num_rows:
                    self.waiting.appendList(_packed(table))
                    moments.append(pc.min(table.column("at")).as_py())
        if moments:
            self._wake(min(moments) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.alarm.clear()
        self.passed.update((passed,))
        held, events = _unpacked(self.open.get(), _STEP), _unpacked(self.waiting.get(), _EVENT)
        over, still, later, wake = assemble(held, events, passed, self.idle_ms)
        for state, table in ((self.open, still), (self.waiting, later)):
            if table.num_rows:
                state.put(_packed(table))
            else:
                state.clear()
        if wake is not None:
            self._wake(wake)
        if over.num_rows:
            yield over.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    def close(self) -> None:
        pass


def stream_steps(events: DataFrame, key: str, at: str, opens: Column, ends: Column, late: str = "10 minutes", idle_ms: int = IDLE_MS, buckets: int = BUCKETS) -> DataFrame:
    """key, step, first, last, ended (microseconds) of each finished step of a stream of events. An event that opens starts
    a step, work before a first opener is one of its own. A step ends with the next one, or when the watermark is idle_ms
    past its last event; events later than `late` may be lost, as in any stream under a watermark. buckets: of keys, for state; a
    stream that goes on keeps the number it began with."""
    rows = events.withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.unix_micros(at).alias("at"), F.coalesce(opens, F.lit(False)).alias("opens"), F.coalesce(ends, F.lit(False)).alias("ends"))
    packed = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).mapInArrow(_pack, "bucket int, first bigint, events binary")
    return packed.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Assembler(idle_ms), outputStructType=STEP, outputMode="Append", timeMode="EventTime")


def run_steps(spark: SparkSession, source: DataFrame, end: DataFrame, key: str, at: str, opens: Column, ends: Column, **options) -> DataFrame:
    """Runs the stream over a source until it is used up, and then over `end`, whose events move the watermark past all
    others; the finished steps, from a Parquet sink."""
    sink, kept = new_path(spark, "steps-sink"), new_path(spark, "steps-checkpoint")
    with set_conf(spark, spark__sql__streaming__stateStore__providerClass=PROVIDER):
        found = stream_steps(source.unionByName(end), key, at, opens, ends, **options)
        found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", kept).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(STEP).parquet(sink)

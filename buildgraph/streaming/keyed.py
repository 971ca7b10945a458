"""Stateful processors on the engine's own state store, one per log operator.

State lives in the store of each key's partition; a batch writes the keys it touched and no others.  Rows of a key reach
a processor unordered, so the rows of one key and micro-batch are sorted in the task: the source's
limit per trigger bounds them, and state carries over from batch to batch.  Timers run on processing time.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings a stateful query takes when it starts: the store, and changes instead of snapshots per batch.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": STORE,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def start(
    rows: DataFrame, root: str, name: str, timers: bool = False, each: Callable[[DataFrame, int], None] | None = None, **trigger
) -> StreamingQuery:
    """Append the rows of a stateful stream to the table below ``root/output``, or hand each batch to ``each``.

    ``trigger`` is passed on; by default all available data is processed and the query ends.  With
    ``timers`` the query goes on after that, so that timers fire; :func:`drain` ends it.
    """
    spark = rows.sparkSession
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    wanted = {**SETTINGS, idle: str(timers or bool(trigger)).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        out = rows.writeStream.option("checkpointLocation", f"{root}/checkpoint")
        out = out.foreachBatch(each) if each else out.format("parquet").option("path", f"{root}/output")
        # A query takes its settings along when it starts.
        return out.queryName(name).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(query: StreamingQuery, wait_ms: int = 0, poll: float = 0.05) -> None:
    """Wait until all available rows are processed and timers up to ``wait_ms`` later have fired, then stop.

    A query with timers runs batches without input when it has read everything; they are what fires timers.
    """
    idle = None
    while query.isActive:
        last = query.lastProgress
        if last:
            began = datetime.fromisoformat(last["timestamp"].replace("Z", "+00:00")).timestamp() * 1000
            idle = None if last["numInputRows"] else began if idle is None else idle
            if idle is not None and began > idle + wait_ms:
                break
        time.sleep(poll)
    if query.exception():
        raise query.exception()
    query.stop()


def output(spark: SparkSession, root: str) -> DataFrame:
    """What the stream has written so far, each batch once."""
    return spark.read.parquet(f"{root}/output")


def state(spark: SparkSession, root: str, variable: str) -> DataFrame:
    """A state variable as of the last finished batch, by the engine's reader of state stores."""
    return spark.read.format("statestore").option("stateVarName", variable).load(f"{root}/checkpoint")


class Bindings(StatefulProcessor):
    """What each id of a run is bound to: rows come out with the last binding a start made.

    Rows have seq, is_start, closing and, for starts, the fields of the binding as bind_<name>.  A closing row is not
    passed on; ``linger_ms`` later, unless the id starts again, its state goes.
    """

    def __init__(self, columns: Sequence[str], binding: str, linger_ms: int):
        self.columns, self.binding, self.linger = list(columns), binding, linger_ms
        self.bind = [f"bind_{f.split()[0]}" for f in binding.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The binding and the timer that will drop it.
        self.bound = handle.getValueState("bound", f"{self.binding}, timer bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A start without an id (then alone in its key) binds nothing and leaves no state.
        lone = key[1] is None
        old = None if lone else self.bound.get()
        bound, timer = (tuple(old[:-1]), old[-1]) if old else (None, None)
        before, closed, out = (bound, timer), timer is not None, []
        for row in sorted(rows, key=lambda r: r.seq):
            if row.closing:
                closed = True
                continue
            if row.is_start:
                bound, closed = tuple(row[b] for b in self.bind), False
            out.append(Row(**{c: row[c] for c in self.columns}, bound=bound))
        if not lone and bound is not None:
            if timer is not None and not closed:
                self.handle.deleteTimer(timer)
                timer = None
            elif closed and timer is None:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.linger
                self.handle.registerTimer(timer)
            if (bound, timer) != before:
                self.bound.update((*bound, timer))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.bound.clear()
        return iter(())

    def close(self) -> None:
        pass


class Throttle(StatefulProcessor):
    """Updates of a key at least ``gap`` microseconds apart, and a closing one when nothing follows.

    The state is the last emission, the last event and the timer set.  A timer that fires
    ``closing_ms`` after the last batch with events of the key emits its last event, if it was not emitted.
    """

    def __init__(self, key: str, gap: int, closing_ms: int):
        self.key, self.gap, self.closing = key, gap, closing_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts_us bigint, seq bigint, last_us bigint, last_seq bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.seen.get()
        emitted, last, timer = ((old[0], old[1]), (old[2], old[3]), old[4]) if old else (None, None, None)
        for t, o in sorted((r.ts_us, r.seq) for r in rows):
            if emitted is None or t >= emitted[0] + self.gap:
                emitted = (t, o)
                yield Row(**{self.key: key[0]}, ts_us=t, seq=o, closing=False)
            last = max((t, o), last or (t, o))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None
        if last != emitted:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.closing
            self.handle.registerTimer(timer)
        self.seen.update((*emitted, *last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        t, o, last_us, last_seq, _ = self.seen.get()
        self.seen.update((t, o, last_us, last_seq, None))
        yield Row(**{self.key: key[0]}, ts_us=last_us, seq=last_seq, closing=True)

    def close(self) -> None:
        pass


class LiveTarget(StatefulProcessor):
    """State, exit code and build times of one target; a row comes out whenever a batch touched it.

    A span runs from the first start since the last result to the result that ends it.
    """

    FIELDS = "seq bigint, state string, exit_code bigint, duration_total_ms bigint, duration_latest_ms bigint"
    STATES = {"started": "building", "substitution": "succeeded"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Beside what is reported: where the open span began, and the latest start of all.
        self.live = handle.getValueState("live", f"{self.FIELDS}, open_us bigint, last_us bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.live.get()
        seq, state, code, total, latest, opened, last = tuple(old) if old else (None, None, None, 0, None, None, None)
        for r in sorted(rows, key=lambda r: r.seq):
            seq, state = r.seq, self.STATES.get(r.status, r.status)
            if r.status == "failed":
                code = r.exit_code
            if r.status == "started":
                opened, last = (r.ts_us if opened is None else opened), r.ts_us
            elif r.status in ("succeeded", "failed", "substitution"):
                total += 0 if opened is None else (r.ts_us - opened) // 1000
                latest = None if last is None else (r.ts_us - last) // 1000
                opened = None
        self.live.update((seq, state, code, total, latest, opened, last))
        yield Row(tree_path=key[0], seq=seq, state=state, exit_code=code, duration_total_ms=total, duration_latest_ms=latest)

    def close(self) -> None:
        pass


class LastLines(StatefulProcessor):
    """The last ``buffer`` lines of a key, cut whenever they are written; nothing comes out.

    With ``keep_ms`` a key's lines go so long after they were written last.
    """

    def __init__(self, buffer: int, keep_ms: int | None):
        self.buffer, self.keep = buffer, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "seq bigint, line string", self.keep)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        import heapq

        # No more than the buffer is held, however many lines a batch brings.
        kept = heapq.nlargest(self.buffer, (n for part in (self.lines.get(), ((r.seq, r.line) for r in rows)) for n in part), key=lambda n: n[0])
        self.lines.put([tuple(n) for n in reversed(kept)])
        return iter(())

    def close(self) -> None:
        pass


def with_state(rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str | StructType) -> DataFrame:
    """Rows a processor emits for the rows of each key."""
    return rows.groupBy(*keys).transformWithState(processor, schema, "Append", "ProcessingTime")

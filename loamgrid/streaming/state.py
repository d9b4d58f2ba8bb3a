"""Keyed rules whose order is their meaning, as streams with state and as batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.loops import walked

WATERMARK = "10 seconds"
#: A key that is silent for so long begins anew; a stream frees its state then.
IDLE_MS = 24 * 3600 * 1000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memory:
    """What a rule knows of one key: ``value``, a small tuple, and ``items``, tuples by tuple keys. Only items that change are written. ``scratch`` may hold what a rule derives from the items; it is None whenever a micro-batch begins or all is cleared."""

    def __init__(self, value: tuple, items: dict[tuple, tuple] | None = None, last: int | None = None) -> None:
        self.value, self.items, self.last, self.changed, self.scratch = value, items or {}, last, set(), None

    def put(self, key: tuple, item: tuple) -> None:
        self.items[key] = item
        self.changed.add(key)

    def drop(self, key: tuple) -> None:
        del self.items[key]
        self.changed.add(key)

    def clear(self) -> None:
        self.changed |= set(self.items)
        self.items, self.scratch = {}, None


Step = Callable[[Memory, tuple], list[tuple]]


class Rule(StatefulProcessor):
    """A step over rows in the order of a column of milliseconds. State: a value, a map of items, and a timer that frees both."""

    def __init__(self, step: Step, start: tuple, output: list[str], order: str, value: str, items: tuple[str, str] | None, idle_ms: int, pack: Callable[[Memory], tuple] | None = None) -> None:
        self.step, self.start, self.output, self.order = step, start, output, order
        self.value_schema, self.item_schemas, self.idle_ms, self.pack = value, items, idle_ms, pack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"last long, {self.value_schema}")
        self.items = handle.getMapState("items", *self.item_schemas) if self.item_schemas else None

    def stepped(self, memory: Memory, row: tuple) -> tuple[Memory, list[tuple]]:
        """One row: a key that was silent for over idle_ms begins anew."""
        at = int(getattr(row, self.order))
        if memory.last is not None and at - memory.last > self.idle_ms:
            memory.value, memory.scratch = self.start, None
            memory.clear()
        memory.last = at
        return memory, self.step(memory, row)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, *value = self.value.get() if self.value.exists() else (None, *self.start)
        memory = Memory(tuple(value), dict(self.items.iterator()) if self.items else {}, last)
        out: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values(self.order, kind="stable").itertuples(index=False):
            memory, more = self.stepped(memory, row)
            out += more
        self.value.update((memory.last, *(self.pack(memory) if self.pack else memory.value)))
        for k in memory.changed:
            if k in memory.items:
                self.items.updateValue(k, memory.items[k])
            elif self.items.containsKey(k):
                self.items.removeKey(k)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(memory.last + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=self.output)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        if self.items:
            self.items.clear()
        yield pd.DataFrame([], columns=self.output)

    def close(self) -> None:
        pass


def stateful(rows: DataFrame, keys: list[str], output: str, step: Step, start: tuple, value: str, order: str, items: tuple[str, str] | None = None, idle_ms: int = IDLE_MS, pack: Callable[[Memory], tuple] | None = None) -> DataFrame:
    """Rows of each key in the order of ``order`` (milliseconds) through step(memory, row) -> rows out.

    A stream keeps value and items in Spark's state (transformWithState on RocksDB): a micro-batch reads the items of its
    keys and writes those that change; ``pack`` gives the value from the scratch once a micro-batch. An event-time timer frees a key idle_ms after its last row. A batch walks sorted
    rows from the start; it gives the same rows where no row comes late. Late rows are dropped: streaming.late keeps them.
    """
    rule = Rule(step, start, [x.split()[0] for x in output.split(", ")], order, value, items, idle_ms, pack)
    if not rows.isStreaming:
        return walked(rows, keys, order, output, lambda: Memory(start), rule.stepped)
    rocks(rows.sparkSession)
    # Spark's watermark begins at 0 and takes what is not behind it for late.
    timed = rows.where(F.col(order).isNotNull()).withColumn("__at", F.timestamp_millis(F.greatest(F.col(order).cast("long"), F.lit(1)))).withWatermark("__at", WATERMARK)
    return timed.groupBy(*keys).transformWithStateInPandas(rule, output, "Append", "EventTime")


def rocks(spark: SparkSession) -> None:
    """Keyed state with maps and timers needs the RocksDB store; one that the session names is kept."""
    if spark.conf.get(_STORE, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(_STORE, ""):
        spark.conf.set(_STORE, _ROCKS)

"""Steps of items in order, as a stream: steps may come in any order, twice, late or never.

Each item has its next step and last output as a value state, the steps that came too early as a map state, and one timer.  A step that stays away for longer than
``patience`` is given up when the timer rings: a row says so, and the item goes on with the next step that is there.  One that comes after that is reported as late; one that
comes again is dropped.  An item that hears nothing for ``idle`` loses all its state, so state doesn't grow with the items that ever were.

Times are processing times, and a timer rings with the first batch after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: From the last kept text (None at first) and a step's number and text: the text to keep, and the step's values, if it gives a row.
Made = Callable[[str | None, int, str], tuple[str, tuple | None]]
#: Stateful processors need this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    def __init__(self, item: str, step: str, text: str, values: list[str], made: Made, first: int, patience: int | None, idle: int | None, across: bool) -> None:
        self.item, self.step, self.text, self.values, self.made = item, step, text, values, made
        self.first, self.patience, self.idle, self.across = first, patience, idle, across

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, last string")
        self.waiting = handle.getMapState("waiting", "step long", "text string")
        self.missed = handle.getMapState("missed", "begin long", "end long")
        self.timer = handle.getValueState("timer", "rings long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        at, last = self.at.get() if self.at.exists() else (self.first, None)
        came: dict[int, str] = {}
        out = []
        for frame in rows:
            for step, text in zip(frame[self.step].tolist(), frame[self.text].tolist(), strict=True):
                if step is None or step != step:
                    continue  # no number, no place
                if step >= at:
                    came.setdefault(int(step), text if isinstance(text, str) else "")
                elif self._was_missed(int(step)):
                    out.append(self._row(key, int(step), None, "late"))
        early = self.waiting.exists()
        if early:
            for step in list(came):
                if self.waiting.containsKey((step,)):
                    del came[step]
        at, last, made = self._advanced(key, at, last, came, early)
        for step, text in came.items():
            self.waiting.updateValue((step,), (text,))
        self.at.update((at, last))
        self._wind(timerValues)
        yield from self._frames(out + made)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.timer.exists():
            self.timer.clear()
        out = []
        if self.waiting.exists():
            at, last = self.at.get()
            begin, at = at, min(step for (step,) in self.waiting.keys())
            self.missed.updateValue((begin,), (at,))
            out.append(self._row(key, begin, None, "missing"))
            at, last, made = self._advanced(key, at, last if self.across else None, {}, True)
            out += made
            self.at.update((at, last))
            self._wind(timerValues)
        else:
            for state in (self.at, self.waiting, self.missed):
                if state.exists():
                    state.clear()
        yield from self._frames(out)

    def close(self) -> None:
        pass

    def _advanced(self, key: tuple, at: int, last: str | None, came: dict[int, str], early: bool) -> tuple[int, str | None, list[tuple]]:
        """Takes the steps that are there, from what came and from what waits."""
        out = []
        while True:
            if at in came:
                text = came.pop(at)
            elif early and self.waiting.containsKey((at,)):
                text = self.waiting.getValue((at,))[0]
                self.waiting.removeKey((at,))
            else:
                return at, last, out
            last, values = self.made(last, at, text)
            if values is not None:
                out.append(self._row(key, at, values, "made"))
            at += 1

    def _was_missed(self, step: int) -> bool:
        return self.missed.exists() and any(begin <= step < end for (begin,), (end,) in self.missed.iterator())

    def _wind(self, timers: TimerValues) -> None:
        """One timer at a time: patience starts anew with each batch that has rows of the item."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        span = self.patience if self.waiting.exists() else self.idle
        if span is not None:
            rings = timers.getCurrentProcessingTimeInMs() + span
            self.handle.registerTimer(rings)
            self.timer.update((rings,))

    def _row(self, key: tuple, step: int, values: tuple | None, status: str) -> tuple:
        return (key[0], step, *(values or (None,) * len(self.values)), status)

    def _frames(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[self.item, "step", *self.values, "status"])


def in_order(steps: DataFrame, item: str, step: str, text: str, values: T.StructType, made: Made, *, first: int = 0, patience: int | None = None, idle: int | None = None, across: bool = True) -> DataFrame:
    """``item, step, values, status`` of steps, numbered from ``first``, as they can be taken in order.

    ``status`` is ``made`` for a step's own row; ``missing`` for the first of the steps that were given up after ``patience`` milliseconds (None: wait for ever), ``late`` for one of these that
    came after all.  ``idle`` milliseconds without a row end an item's state if nothing waits (None: never).  With ``across`` the step after a gap goes on from the one before it, else from nothing.
    Null texts are empty, rows without a step number are left out.
    """
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = T.StructType([steps.schema[item], T.StructField("step", T.LongType()), *values.fields, T.StructField("status", T.StringType())])
    processor = InOrder(item, step, text, values.names, made, first, patience, idle, across)
    mode = "None" if patience is None and idle is None else "ProcessingTime"
    return steps.select(item, step, text).groupBy(item).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)

"""Ordered folds: a request limiter and a browser's history. A key's rows stream in order through a task, by a loop in Python
over Arrow batches, and only the fold's state is held."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

DAY_LIMIT, BURST_LIMIT, BURST_SECONDS = 500, 3, 60


class Limiter:
    """At most DAY_LIMIT accepted requests a day; a request within BURST_SECONDS of the last accepted one counts
    on, and beyond BURST_LIMIT it is rejected. A rejected request leaves the time of the last accepted as it is."""

    def __init__(self, day: int | None = None, today: int = 0, last: float | None = None, burst: int = 0):
        self.day, self.today, self.last, self.burst = day, today, last, burst

    def ask(self, ts: float) -> bool:
        day = int(ts // 86400)
        if day != self.day:
            self.day, self.today = day, 0
        if self.today >= DAY_LIMIT:
            return False
        if self.last is not None and ts - self.last < BURST_SECONDS:
            self.burst += 1
            if self.burst > BURST_LIMIT:
                return False
        else:
            self.burst = 1
        self.last, self.today = ts, self.today + 1
        return True


class History:
    """Back and forward over visited places; a visit cuts what lies ahead."""

    def __init__(self):
        self.places: list[str] = []
        self.at = -1

    def step(self, action: str, place: str | None) -> str | None:
        """The place after the action: visit, back or forward. Other actions change nothing."""
        if action == "visit" and place is not None:
            del self.places[self.at + 1 :]
            self.places.append(place)
            self.at = len(self.places) - 1
        elif action == "back" and self.at > 0:
            self.at -= 1
        elif action == "forward" and self.at < len(self.places) - 1:
            self.at += 1
        return self.places[self.at] if self.at >= 0 else None


def _folded(rows: DataFrame, key: str, order: list[str], start, step, out: str, kind: pa.DataType, sql: str) -> DataFrame:
    """rows with a column that step(state, row) gives, state anew for each key. Rows of a key stream through in
    order; only the state is held."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if row[key] != last:
                    last, state = row[key], start()
                made.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"{out} {sql}"])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def rate_limited(requests: DataFrame, key: str = "user", ts: str = "ts", order: str = "id") -> DataFrame:
    """requests with accepted: what the limiter of each key says, in order of time in seconds."""
    return _folded(requests, key, [ts, order], Limiter, lambda s, row: s.ask(row[ts]), "accepted", pa.bool_(), "boolean")


def visited(actions: DataFrame, key: str = "user", order: str = "id", action: str = "action", place: str = "place") -> DataFrame:
    """actions with current: the place that a session is at after each."""
    return _folded(actions, key, [order], History, lambda s, row: s.step(row[action], row[place]), "current", pa.string(), "string")

"""Event counts and the request limiter over streams; the batch forms are in operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import Limiter


def period_counts(events: DataFrame, ts: str = "ts", period: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(period, n) of events in tumbling windows; events later than `late` are dropped, and state goes with them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, period).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("period"), "n")


def rate_limited(requests: DataFrame, key: str = "user", ts: str = "ts") -> DataFrame:
    """(key, ts, accepted) of requests with times in seconds; each key's limiter is its state.

    Requests of one batch are taken in order of time; one that comes in a later batch comes after them.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, today, last, burst = state.get if state.exists else (None, 0, None, 0)
        limiter = Limiter(day, today, last, burst)
        rows = pd.concat(list(batches)).sort_values(ts)
        yield pd.DataFrame({key: k[0], ts: rows[ts], "accepted": [limiter.ask(float(t)) for t in rows[ts]]})
        state.update((limiter.day, limiter.today, limiter.last, limiter.burst))

    kind = requests.schema
    out = f"`{key}` {kind[key].dataType.simpleString()}, `{ts}` {kind[ts].dataType.simpleString()}, accepted boolean"
    return requests.groupBy(key).applyInPandasWithState(fold, out, "day long, today long, last double, burst long", "append", GroupStateTimeout.NoTimeout)

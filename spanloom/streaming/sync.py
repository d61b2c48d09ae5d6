"""Streams of review events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SYNC = "key string, wanted boolean, remote boolean, action string"


def viewed_sync(events: DataFrame) -> DataFrame:
    """Two-way sync of a viewed flag per file: ``events(key, side, viewed)`` with side ``local`` or ``remote``.

    After each batch of a key: ``write`` if the local wish differs from what the remote shows, ``settled`` if they agree,
    ``take`` if only the remote has spoken. State is two booleans a key.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wanted, remote = state.get if state.exists else (None, None)
        for frame in frames:
            for side, viewed in zip(frame["side"], frame["viewed"], strict=True):
                if side == "local":
                    wanted = bool(viewed)
                else:
                    remote = bool(viewed)
        state.update((wanted, remote))
        action = "take" if wanted is None else "settled" if wanted == remote else "write"
        yield pd.DataFrame([(key[0], wanted, remote, action)], columns=["key", "wanted", "remote", "action"])

    return events.groupBy("key").applyInPandasWithState(update, SYNC, "wanted boolean, remote boolean", "update", GroupStateTimeout.NoTimeout)


def latest_runs(results: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Newest run per key and time window of a stream of results ``(key, run, ts)``; late runs beyond the watermark are dropped by it."""
    return results.withWatermark("ts", delay).groupBy(F.window("ts", "5 minutes"), "key").agg(F.max_by("run", "ts").alias("run"), F.max("ts").alias("ts"))


#: What a run publishes, in order.
PUBLISHED = ("pending", "resolved", "final")


_RUN = "run string, stage string, payload string, ts timestamp"


def published(results: DataFrame, delay: str = "10 minutes", forget_ms: int = 86_400_000) -> DataFrame:
    """Per run the latest of its published results and how far it is: ``run, stage, payload, ts``, updated as they come.

    ``results`` is a stream ``run, stage, payload, ts`` with stages of :data:`PUBLISHED`; a stage that comes late does not take the place of a
    later one, and of one stage the newest counts. State is one row a run, whatever days it spans; it is forgotten ``forget_ms``
    behind the watermark after its newest result. A batch without news of a run has no row of it.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = before = state.get if state.exists else (0, None, None, None)
        for frame in frames:
            for stage, payload, ts in zip(frame["stage"], frame["payload"], frame["ts"], strict=True):
                rank, at = PUBLISHED.index(stage) + 1, pd.Timestamp(ts).value // 1000
                if best[0] == 0 or (rank, at) >= (best[0], best[3]):
                    best = (rank, stage, payload, at)
        state.update(best)
        state.setTimeoutTimestamp(max(best[3] // 1000, state.getCurrentWatermarkMs()) + forget_ms)
        if best != before:
            yield pd.DataFrame([(key[0], best[1], best[2], pd.Timestamp(best[3] * 1000))], columns=["run", "stage", "payload", "ts"])

    known = results.where(F.col("stage").isin(*PUBLISHED) & F.col("run").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    return known.groupBy("run").applyInPandasWithState(update, _RUN, "rank int, stage string, payload string, at long", "update", GroupStateTimeout.EventTimeTimeout)

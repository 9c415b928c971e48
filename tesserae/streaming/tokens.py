"""One-shot tokens as keyed state with event-time timers: issued, used once, expired, purged."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

VALID_MS, KEPT_MS = 15 * 60_000, 24 * 3_600_000
OUT = "token long, outcome string, moment timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _ms(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


class OneShotTokens(StatefulProcessor):
    """State of one token: when it was issued and when it was used (0: not yet).

    Two timers a token: its end of validity, and the purge, after which the token is unknown.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.token = handle.getValueState("token", "issued long, used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Rows (token, ts, action) of one token, taken in order of time, an issue before a use of the same time."""
        events = pd.concat(list(rows)).sort_values(["ts", "action"])
        state = self.token.get() if self.token.exists() else None
        out = []
        for ts, action in zip(events["ts"], events["action"], strict=True):
            now = _ms(ts)
            if state is not None and now >= state[0] + KEPT_MS:  # the purge is due, whether or not its timer has come
                if not state[1] and timerValues.getCurrentWatermarkInMs() < state[0] + VALID_MS:
                    self.handle.deleteTimer(state[0] + VALID_MS)
                    out.append(("expired", pd.Timestamp(state[0] + VALID_MS, unit="ms")))
                out.append(("purged", pd.Timestamp(state[0] + KEPT_MS, unit="ms")))
                self.handle.deleteTimer(state[0] + KEPT_MS)
                self.token.clear()
                state = None
            if action == "issue":
                if state is None:
                    state = (now, 0)
                    self.handle.registerTimer(now + VALID_MS)
                    self.handle.registerTimer(now + KEPT_MS)
                    out.append(("issued", ts))
            elif state is None:
                out.append(("unknown", ts))
            elif state[1]:
                out.append(("used before", ts))
            elif now >= state[0] + VALID_MS:
                out.append(("too late", ts))
            else:
                state = (state[0], now)
                out.append(("used", ts))
        if state is not None:
            self.token.update(tuple(state))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The end of validity tells of tokens that were never used; the purge forgets the token."""
        out, fired = [], expiredTimerInfo.getExpiryTimeInMs()
        if self.token.exists():
            issued, used = self.token.get()
            at = pd.Timestamp(fired, unit="ms")
            if fired == issued + KEPT_MS:
                self.token.clear()
                out.append(("purged", at))
            elif not used:
                out.append(("expired", at))
        yield self._rows(key, out)

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"token": pd.Series([key[0]] * len(out), dtype="int64"), "outcome": pd.Series([o for o, _ in out], dtype="object"), "moment": pd.Series([a for _, a in out], dtype="datetime64[ns]")})


def one_shot(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """``token, outcome, moment`` of a stream of ``token`` long, ``ts`` and ``action`` (``issue`` or ``use``).

    A token is valid for 15 minutes and for one use; the first issue counts. Uses are ``used``, ``used
    before``, ``too late`` or ``unknown``; without a use a token is ``expired``; it is ``purged`` 24
    hours after its issue. After that it is unknown, and can be issued anew. Rows more than ``late`` behind the stream are dropped and counted.
    """
    keyed = events.select("token", "ts", "action").withWatermark("ts", late).groupBy("token")
    return keyed.transformWithStateInPandas(OneShotTokens(), OUT, "append", "eventTime")


def run_tokens(outcomes: DataFrame, spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """All that is available now: its outcomes as a table, and how many late rows were dropped.

    Timers need the RocksDB state store, which is set for this stream alone.
    """
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = outcomes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/tokens").trigger(availableNow=True).start(f"{folder}/outcomes")
        q.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    dropped = sum(int(s.numRowsDroppedByWatermark) for p in q.recentProgress for s in p.stateOperators)
    return spark.read.schema(outcomes.schema).parquet(f"{folder}/outcomes"), dropped

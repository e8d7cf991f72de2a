"""Folding answer events per request while they stream in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOLDED = ("request_id string, n_sources int, answer string, refused boolean, error string, "
          "outcome string")
# What is known of a request besides its texts, which are a list of their own: a new text is
# appended to it and the earlier ones are not written again. ``latest`` is the newest event time,
# ``closed_at`` that of its closing event, ``timer`` when it ends if nothing more comes.
FACTS = ("n_sources bigint, sources_at bigint, refused boolean, done_at bigint, error string, "
         "error_at bigint, latest bigint, closed_at bigint, timer bigint")
TEXTS = "seq bigint, text string"
NEVER = -(1 << 62)
EMPTY = (0, NEVER, None, NEVER, None, NEVER, 0, NEVER, NEVER)
#: Lists and timers need the state store that keeps single values apart.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldAnswers(StatefulProcessor):
    """Folds the events of one request until its timer says that nothing more can come."""

    def __init__(self, timeout: int, slack: int):
        self.timeout, self.slack = timeout, slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", FACTS)
        self.texts = handle.getListState("texts", TEXTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.facts.get() if self.facts.exists() else EMPTY
        (n_sources, sources_at, refused, done_at, error, error_at, latest, closed_at, timer) = held
        for frame in rows:
            times = (frame["ts"].astype("int64") // _per_milli(frame["ts"])).tolist()
            fresh = []
            for at, e in zip(times, frame.itertuples(index=False)):
                seq = int(e.seq)
                if e.type == "delta":
                    fresh.append((seq, e.text))
                elif e.type == "sources" and seq > sources_at:
                    n_sources, sources_at = int(e.n_sources), seq
                elif e.type == "done" and seq > done_at:
                    refused, done_at = bool(e.refused), seq
                elif e.type == "error" and seq > error_at:
                    error, error_at = e.error, seq
                if e.type in ("done", "error"):
                    closed_at = max(closed_at, at)
                latest = max(latest, at)
            if fresh:
                self.texts.appendList(fresh)
        ends = closed_at + self.slack if closed_at > NEVER else latest + self.timeout
        ends = max(ends, timerValues.getCurrentWatermarkInMs()) + 1
        if ends != timer:
            if timer > NEVER:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
        self.facts.update((n_sources, sources_at, refused, done_at, error, error_at, latest,
                           closed_at, ends))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.facts.exists():
            return iter(())
        n_sources, _, refused, done_at, error, error_at, *_ = self.facts.get()
        found = [tuple(t) for t in self.texts.get()] if self.texts.exists() else []
        self.facts.clear()
        self.texts.clear()
        return iter([_row(key[0], n_sources, [s for s, _ in found], [t for _, t in found], refused,
                          error, done_at, error_at)])

    def close(self) -> None:
        pass


def stream_answers(events: DataFrame, timeout: str = "10 minutes",
                   lateness: str = "1 minute") -> DataFrame:
    """One row per request: once the watermark has passed its closing ('done' or 'error')
    event, or as 'interrupted' when no event has come for ``timeout`` of event time.

    ``events``: request_id, seq, type, n_sources, text, refused, error, ts. Events may come
    in any order over any batches, as long as they are not later than ``lateness``; ``seq``
    orders them, and the last sources, done and error events count, as in the batch fold.
    A batch writes what it brings: texts are appended to the request's list. The session's state
    store is set to the one that can do that.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        events.withWatermark("ts", lateness).groupBy("request_id")
        .transformWithStateInPandas(FoldAnswers(_millis(timeout), _millis(lateness)), FOLDED,
                                    "append", "eventTime")
    )


def _row(request_id, n_sources, seqs, texts, refused, error, done_at, error_at) -> pd.DataFrame:
    text = "".join(t for _, t in sorted(zip(seqs, texts), key=lambda p: p[0]) if t is not None)
    outcome = "error" if error_at > NEVER else "done" if done_at > NEVER else "interrupted"
    return pd.DataFrame({
        "request_id": [request_id], "n_sources": pd.Series([n_sources], dtype="int32"),
        "answer": [text], "refused": pd.Series([refused], dtype="object"), "error": [error],
        "outcome": [outcome]})


def _per_milli(times: pd.Series) -> int:
    return {"ns": 1_000_000, "us": 1000, "ms": 1}[getattr(times.dtype, "unit", "ns")]


def _millis(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def event_columns(events: DataFrame) -> DataFrame:
    """Answer events with the source list reduced to its length."""
    return events.select(
        "request_id", "seq", "type", F.size("sources").alias("n_sources"), "text", "refused",
        "error", "ts")

"""State by event time: the events of a key are folded in the order of their time, once the watermark has passed them.

Late and shuffled input therefore gives the result of the batch twin. Events wait in a list state, what is remembered of a key is a value
state, and event-time timers bring both up: at the next waiting event's time, and when what is remembered has run out, so an
idle key leaves the state. The state store has to be RocksDB's (session.local_session sets it; a cluster's session brings it).

All take a stream of session_id (long), event_id (long), kind (string), ts with a watermark; ties in time go by event_id. Rows
without a key or time are left out, rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND, HOUR = 1_000_000, 3_600_000_000  # microseconds
OUTPUT = "session_id long, event_id long, ts timestamp, value long"
#: Unproven claims in a day from which on a session is warned, and from which on proof is mandatory.
TIERS = ((5, "mandatory"), (3, "warn"))


class Fold:
    """What is remembered of a key: `times` (a list of moments), `number` and `at`; all moments are microseconds."""

    def event(self, held: dict, at: int, kind: str) -> int | None:
        """Take one event in; its value, if it gives a row."""
        raise NotImplementedError

    def expires(self, held: dict) -> int | None:
        """When nothing need be remembered any more; none if that is now."""
        raise NotImplementedError


class RateLimit(Fold):
    """1 for each request that is accepted: fewer than `most` accepted ones in the last `seconds`; rejected ones don't count."""

    def __init__(self, most: int, seconds: float):
        self.most, self.span = most, int(seconds * SECOND)

    def event(self, held, at, kind):
        held["times"] = [t for t in held["times"] if at - t < self.span]
        ok = len(held["times"]) < self.most
        held["times"] += [at] if ok else []
        return int(ok)

    def expires(self, held):
        return held["times"][-1] + self.span if held["times"] else None


class RecentCalls(Fold):
    """How many calls the session made in the `seconds` up to each call, `most` at most."""

    def __init__(self, seconds: float, most: int):
        self.most, self.span = most, int(seconds * SECOND)

    def event(self, held, at, kind):
        held["times"] = [*(t for t in held["times"] if at - t <= self.span), at][-self.most :]
        return len(held["times"])

    def expires(self, held):
        return held["times"][-1] + self.span if held["times"] else None


class Score(Fold):
    """Unproven claims of a session; a day without one ends the count."""

    def __init__(self, hours: float):
        self.span = int(hours * HOUR)

    def event(self, held, at, kind):
        if kind != "unproven":
            return None
        held["number"] = held["number"] + 1 if held["number"] and at - held["at"] <= self.span else 1
        held["at"] = at
        return held["number"]

    def expires(self, held):
        return held["at"] + self.span if held["number"] else None


class Pending(Fold):
    """1 where an unproven claim makes verification pending, 0 where a proof ends it; other events give no row."""

    def __init__(self, hours: float):
        self.span = int(hours * HOUR)

    def event(self, held, at, kind):
        pending = held["number"] == 1 and at - held["at"] <= self.span
        if kind == "claim":
            held["number"], held["at"] = 1, at
            return None if pending else 1
        if kind == "proof" and pending:
            held["number"] = 0
            return 0
        return None

    def expires(self, held):
        return held["at"] + self.span if held["number"] else None


class Recovery(Fold):
    """The compaction (its time) that a session start recovers from: the last one, once, if it is younger than `hours`."""

    def __init__(self, hours: float):
        self.span = int(hours * HOUR)

    def event(self, held, at, kind):
        if kind == "compaction":
            held["number"], held["at"] = 1, at
        if kind != "start" or not held["number"]:
            return None
        held["number"] = 0
        return held["at"] if at - held["at"] < self.span else None

    def expires(self, held):
        return held["at"] + self.span if held["number"] else None


class InOrder(StatefulProcessor):
    """A fold over the events of a key in the order of their time."""

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, kind string")
        self.held = handle.getValueState("held", "times array<long>, number long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), int(i), k) for pdf in rows for at, i, k in zip(pdf["at"], pdf["event_id"], pdf["kind"], strict=True)]
        self.waiting.appendList(new)
        self._wake(min(at for at, _, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [w for w in waiting if w[0] <= mark], [w for w in waiting if w[0] > mark]
        times, number, at = self.held.get() if self.held.exists() else ([], 0, 0)
        held = {"times": list(times), "number": number, "at": at}
        out = [(key[0], i, pd.Timestamp(t, unit="us"), value) for t, i, kind in ready if (value := self.fold.event(held, t, kind)) is not None]
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        end = self.fold.expires(held)
        if end is None or (end < mark and not later):  # what waits may still need what is held
            self.held.clear()
        else:
            self.held.update((held["times"], held["number"], held["at"]))
            self._wake(end)
        if later:
            self._wake(later[0][0])
        if out:
            yield pd.DataFrame(out, columns=["session_id", "event_id", "ts", "value"])

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, fold: Fold) -> DataFrame:
    """session_id, event_id, ts, value of the rows that the fold gives. events: a stream with a watermark on ts."""
    rows = events.where("session_id IS NOT NULL AND ts IS NOT NULL").select("session_id", "event_id", "kind", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("session_id").transformWithStateInPandas(InOrder(fold), OUTPUT, "append", "EventTime")


def rate_limited(requests: DataFrame, most: int = 120, seconds: float = 60) -> DataFrame:
    """X3 by event time: session_id, event_id, ts, accepted."""
    return in_order(requests, RateLimit(most, seconds)).select("session_id", "event_id", "ts", (F.col("value") == 1).alias("accepted"))


def recent_calls(calls: DataFrame, seconds: float = 300, most: int = 20) -> DataFrame:
    """session_id, event_id, ts, recent."""
    return in_order(calls, RecentCalls(seconds, most)).withColumnRenamed("value", "recent")


def _tier(score):
    return F.coalesce(*(F.when(score >= n, name) for n, name in TIERS), F.lit("none"))


def scores(events: DataFrame, hours: float = 24) -> DataFrame:
    """session_id, event_id, ts, score, tier after each unproven claim (kind `unproven`)."""
    return in_order(events, Score(hours)).withColumnRenamed("value", "score").withColumn("tier", _tier(F.col("score")))


def scores_in_batch(events: DataFrame, hours: float = 24) -> DataFrame:
    """X6's batch twin."""
    order = W.partitionBy("session_id").orderBy("ts", "event_id")
    rows = events.where("kind = 'unproven' AND session_id IS NOT NULL AND ts IS NOT NULL")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order) > int(hours * HOUR)
    island = rows.withColumn("_i", F.sum(F.when(gap, 1).otherwise(0)).over(order))
    scored = island.withColumn("score", F.row_number().over(W.partitionBy("session_id", "_i").orderBy("ts", "event_id")).cast("long"))
    return scored.select("session_id", "event_id", "ts", "score", _tier(F.col("score")).alias("tier"))


def pending(events: DataFrame, hours: float = 24) -> DataFrame:
    """session_id, event_id, ts, pending where that changes: by an unproven claim (kind `claim`) or a proof (kind `proof`)."""
    return in_order(events, Pending(hours)).select("session_id", "event_id", "ts", (F.col("value") == 1).alias("pending"))


def pending_in_batch(events: DataFrame, hours: float = 24) -> DataFrame:
    """X7's batch twin: a claim or a proof follows a claim within the hours, or it doesn't."""
    order = W.partitionBy("session_id").orderBy("ts", "event_id")
    rows = events.where("kind IN ('claim', 'proof') AND session_id IS NOT NULL AND ts IS NOT NULL")
    age = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)
    held = (F.lag("kind").over(order) == "claim") & (age <= int(hours * HOUR))
    rows = rows.withColumn("_held", F.coalesce(held, F.lit(False)))
    return rows.where((F.col("kind") == "claim") != F.col("_held")).select("session_id", "event_id", "ts", (F.col("kind") == "claim").alias("pending"))


def recoveries(events: DataFrame, hours: float = 2) -> DataFrame:
    """session_id, event_id, started, compacted: the first start (kind `start`) after a compaction (kind `compaction`), once, within the hours."""
    return in_order(events, Recovery(hours)).select("session_id", "event_id", F.col("ts").alias("started"), F.timestamp_micros("value").alias("compacted"))


def recoveries_in_batch(events: DataFrame, hours: float = 2) -> DataFrame:
    """X8's batch twin: starts whose last event before them is a compaction, young enough."""
    order = W.partitionBy("session_id").orderBy("ts", "event_id")
    rows = events.where("kind IN ('compaction', 'start') AND session_id IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withColumns({"_kind": F.lag("kind").over(order), "compacted": F.lag("ts").over(order)})
    young = F.unix_micros("ts") - F.unix_micros("compacted") < int(hours * HOUR)
    return rows.where((F.col("kind") == "start") & (F.col("_kind") == "compaction") & young).select("session_id", "event_id", F.col("ts").alias("started"), "compacted")

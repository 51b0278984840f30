"""The control plane as state: leases of runs over a log of commands, and calls admitted in order of time.

A log of commands is replayed in a batch, or read as a stream with a state for each run and a timer for each lease; both
take the same step for each command, so they end in the same states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A command: run, event_id (unique), ms (its time), kind (start, claim, renew, stop, fail, override), owner, steal, reason.
COMMANDS = "run string, event_id bigint, ms bigint, kind string, owner string, steal boolean, reason string"
OUTCOMES = "run string, event_id bigint, ms bigint, kind string, outcome string, state string, owner string, expires bigint"
LEASE_MS = 3_600_000

#: (state, owner, expires, overrides); no run: None. No lease: owner "" and expires 0.
Held = tuple[str, str, int, int] | None


def lapse(held: Held, ms: int) -> Held | None:
    """What becomes of a lease that is over at `ms`: the run stays as it was, held by no one; None if it is not over."""
    return (held[0], "", 0, held[3]) if held and held[1] and held[2] <= ms else None


def step(held: Held, ms: int, kind: str, owner: str, steal: bool, reason: str, lease_ms: int = LEASE_MS) -> tuple[str, Held]:
    """(outcome, what is held then) of one command.

    start opens a run or opens it again, claim takes one over; both are refused while another owner's lease is live, but
    a claim may steal it. renew, stop and fail are the holder's. stop and fail give the lease back. An override needs a
    reason. What is refused changes nothing.
    """
    live = held is not None and held[1] != "" and held[2] > ms
    if kind == "start":
        if live and held[1] != owner:
            return "lease_held", held
        return "ok", ("running", owner, ms + lease_ms, held[3] if held else 0)
    if held is None:
        return "run_unknown", None
    if kind == "claim":
        if live and held[1] != owner and not steal:
            return "lease_held", held
        return "stolen" if live and held[1] != owner else "ok", ("running", owner, ms + lease_ms, held[3])
    if kind == "override":
        if not (reason or "").strip():
            return "override_reason_required", held
        return "ok", (*held[:3], held[3] + 1)
    if not live or held[1] != owner:
        return "not_the_holder", held
    if kind == "renew":
        return "ok", (held[0], owner, ms + lease_ms, held[3])
    if kind in ("stop", "fail"):
        return "ok", ({"stop": "stopped", "fail": "failed"}[kind], "", 0, held[3])
    return "command_unknown", held


def taken(held: Held, row: tuple, lease_ms: int) -> tuple[list[tuple], Held]:
    """Outcome rows of one command, a lapse before it included, and what is held then."""
    run, event_id, ms, kind, owner, steal, reason = row
    out, over = [], lapse(held, ms)
    if over:
        out.append((run, -1, held[2], "lapse", "ok", over[0], "", 0))
        held = over
    outcome, held = step(held, ms, kind, owner or "", bool(steal), reason or "", lease_ms)
    out.append((run, event_id, ms, kind, outcome, held[0] if held else None, held[1] if held else "", held[2] if held else 0))
    return out, held


NAMES = [c.split()[0] for c in OUTCOMES.split(", ")]


def replayed(log: DataFrame, horizon: int | None = None, lease_ms: int = LEASE_MS) -> DataFrame:
    """The outcome of every command of a log, and a lapse row (event_id -1) where a lease ran out before the next command
    or, at the log's end, by `horizon` (ms). Commands of a run are taken by time, then event_id; a run's commands pass
    through one task in batches, none is held."""
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, last = None, None, []
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if row[0] != now:
                    out += ended(now, held)
                    now, held = row[0], None
                rows, held = taken(held, tuple(row), lease_ms)
                out += rows
            yield pd.DataFrame(out, columns=NAMES)
        last = ended(now, held)
        if last:
            yield pd.DataFrame(last, columns=NAMES)

    def ended(run: str | None, held: Held) -> list[tuple]:
        over = lapse(held, horizon) if held and horizon is not None else None
        return [(run, -1, held[2], "lapse", "ok", over[0], "", 0)] if over else []

    names = [c.split()[0] for c in COMMANDS.split(", ")]
    return log.select(*names).repartition(parts, "run").sortWithinPartitions("run", "ms", "event_id").mapInPandas(run_all, OUTCOMES)


class Leases(StatefulProcessor):
    """A run's lease as state, and a timer at its end."""

    def __init__(self, lease_ms: int = LEASE_MS):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("held", "state string, owner string, expires bigint, overrides bigint")

    def held(self) -> Held:
        v = self.value.get() if self.value.exists() else None
        return None if v is None else (v[0], v[1], int(v[2]), int(v[3]))

    def keep(self, before: Held, held: Held) -> None:
        """Store what is held, and move the timer if the lease's end has moved."""
        was, is_ = before[2] if before else 0, held[2] if held else 0
        if was != is_:
            if was:
                self.handle.deleteTimer(was)
            if is_:
                self.handle.registerTimer(is_)
        if held is not None and held != before:
            self.value.update(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = held = self.held()
        out = []
        for row in pd.concat(list(rows)).sort_values(["ms", "event_id"])[[c.split()[0] for c in COMMANDS.split(", ")]].itertuples(index=False):
            one, held = taken(held, tuple(row), self.lease_ms)
            out += one
        self.keep(before, held)
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        over = lapse(held, expiredTimerInfo.getExpiryTimeInMs())
        if over:
            self.value.update(over)
            yield pd.DataFrame([(key[0], -1, held[2], "lapse", "ok", over[0], "", 0)], columns=NAMES)

    def close(self) -> None:
        pass


def streamed(log: DataFrame, late: str = "0 seconds", lease_ms: int = LEASE_MS) -> DataFrame:
    """`replayed` over a stream of commands with a time column `at`: outcomes as they happen. Leases that no command ends
    lapse when the watermark, `late` behind the newest command, has passed them. Needs the RocksDB state store."""
    timed = log.withWatermark("at", late)
    return timed.groupBy("run").transformWithStateInPandas(statefulProcessor=Leases(lease_ms), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")


def admitted(calls: DataFrame, quota: int, per_question: int) -> DataFrame:
    """calls (caller, period, question, at, call_id, of paid tools) with admitted, reason and reads_remaining.

    Calls are taken in order of time, then id. One is admitted if its question has had fewer than per_question calls
    admitted and its caller fewer than quota in the period; a refused call uses nothing up. So of a question the first
    per_question calls can be admitted, and of a period's calls that can be, the first quota are: two numberings, exact
    for any order. A call refused by both says question_exhausted. reads_remaining: the lesser of what both leave.
    """
    who = ["caller", "period"]
    own = Window.partitionBy(*who, "question").orderBy("at", "call_id")
    c = calls.withColumn("nth", F.row_number().over(own)).withColumn("may", F.col("nth") <= per_question)
    run = Window.partitionBy(*who).orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("asked", F.sum(F.col("may").cast("long")).over(run))
    ok = F.col("may") & (F.col("asked") <= quota)
    c = c.withColumn("admitted", ok).withColumn("reason", F.when(~F.col("may"), "question_exhausted").when(~F.col("admitted"), "quota_exhausted"))
    spent = F.sum(F.col("admitted").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    left = F.least(F.lit(quota) - F.least(F.col("asked"), F.lit(quota)), F.lit(per_question) - spent)
    return c.withColumn("reads_remaining", left).drop("nth", "may", "asked")

"""Stateful monitors: retry guard and ledger chain, in batch and on streams.

The batch forms are window plans in bands. The stream forms are stateful
processors with one small state per key; rows of a micro-batch are ordered by
``seq`` within the key and rows older than the state are reported as late
instead of changing it. With a time to live, a state counts only so long after
the event that made it, whatever the micro-batches are, and an event-time timer
removes it once the watermark has passed that time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import skew
from ..functions.common import first_reason

HASH = "^[0-9a-f]{64}$"
HEADER = "0" * 64
# fixed values: verification modes that never recreate anything
VERIFY_MODES = ["verify-only", "complete-from-primary-readback"]
STATUSES = ["artifact_ready", "transient_retry", "hard_fail", "review_only"]
# in the order of the event schema
STATE_FIELDS = ["plan_path", "adapter_fingerprint", "status", "max_retries", "retry_count", "ready_fingerprint", "allow_new", "baseline", "delivery"]
EVENT_SCHEMA = ("task_id bigint, seq bigint, kind string, tool string, mode string, fingerprint string, plan_path string, adapter_fingerprint string, "
                "status string, max_retries int, retry_count int, ready_fingerprint string, allow_new boolean, baseline string, delivery string")
DECISION_SCHEMA = "task_id bigint, seq bigint, decision string, reason string"


def fingerprint(explicit: list[Column], selected: list[str]) -> Column:
    """First explicit value that is a SHA-256, else the digest of the selected fields that are present."""
    given = [F.when(c.rlike(HASH), c) for c in explicit]
    return F.coalesce(*given, F.sha2(F.to_json(F.struct(*sorted(selected))), 256))


def _state_error(s: Column) -> Column:
    ready = s["status"] == "artifact_ready"
    return first_reason(
        (s.isNull(), "state_missing"), (~F.coalesce(s["status"].isin(STATUSES), F.lit(False)), "status_unsupported"),
        (F.coalesce(s["max_retries"] < 0, F.lit(True)), "retry_limit_invalid"), (F.coalesce(s["retry_count"] < 0, F.lit(True)), "retry_count_invalid"),
        (~F.coalesce(s["ready_fingerprint"].rlike(HASH), F.lit(False)), "fingerprint_invalid"),
        (~F.coalesce(s["baseline"].isin("pass", "fail", "unavailable"), F.lit(False)), "baseline_invalid"),
        (~F.coalesce(s["delivery"].isin("attachment", "durable_deliverable", "none"), F.lit(False)), "delivery_invalid"),
        (ready & ((s["baseline"] != "pass") | (s["delivery"] == "none")), "ready_without_delivery"),
        ((s["status"] == "hard_fail") & (s["plan_path"].isNull() | ~F.coalesce(s["adapter_fingerprint"].rlike(HASH), F.lit(False))), "repair_plan_missing"))


def guard_reason(s: Column, tools: list[str]) -> Column:
    """Reason of the decision for a call under state ``s``; reasons that allow start with ``allow:``."""
    spent = s["retry_count"] >= s["max_retries"]
    same = F.coalesce(F.col("fingerprint") == s["ready_fingerprint"], F.lit(False))
    bound = F.col("plan_path").eqNullSafe(s["plan_path"]) & F.col("adapter_fingerprint").eqNullSafe(s["adapter_fingerprint"])
    ready, transient = s["status"] == "artifact_ready", s["status"] == "transient_retry"
    return F.coalesce(_state_error(s), first_reason(
        (~F.col("tool").isin(tools), "allow:non_production_tool"), (F.coalesce(F.col("mode").isin(VERIFY_MODES), F.lit(False)), "allow:verification"),
        (s["status"] == "review_only", "review_only"), (ready & same, "same_fingerprint"), (ready & ~F.coalesce(s["allow_new"], F.lit(False)), "new_fingerprint_not_admitted"),
        ((ready | transient) & spent, "retry_limit_exhausted"), (ready, "allow:new_fingerprint"), (transient, "allow:transient_retry"),
        (bound, "allow:bound_correction"), default="correction_not_bound"))


def _decided(df: DataFrame, reason: Column) -> DataFrame:
    r = df.withColumn("_r", reason)
    return r.select("task_id", "seq", F.when(F.startswith("_r", F.lit("allow:")), "allow").otherwise("block").alias("decision"),
                    F.regexp_replace("_r", "^allow:", "").alias("reason"))


def _alive(state_at: Column, at: Column, ttl: str | None) -> Column:
    """Whether a state of time ``state_at`` still counts at ``at``; a state without a time never ends."""
    return F.lit(True) if ttl is None else F.coalesce(at <= state_at + F.expr(f"INTERVAL {ttl}"), F.lit(True))


def retry_guard(events: DataFrame, tools: list[str], band: int = 65536, event_time: str | None = None, ttl: str | None = None) -> DataFrame:
    """Decide every production call from the last state record before it (``kind`` is ``state`` or ``call``).

    With ``event_time`` and ``ttl`` (an interval such as ``2 days``) a state record counts that long.
    """
    timed = [F.col(event_time).alias("at")] if event_time else []
    state = F.when(F.col("kind") == "state", F.struct("seq", *STATE_FIELDS, *timed))
    known = skew.running(events, ["task_id"], ["seq"], {"s": ("max", state)}, F.floor(F.col("seq") / band))
    s = F.when(_alive(F.col("s.at"), F.col(event_time), ttl), F.col("s")) if event_time and ttl else F.col("s")
    return _decided(known.where(F.col("kind") == "call"), guard_reason(s, tools))


class _LastOfKey(StatefulProcessor):
    """The last state of each key: of rows in ``seq`` order, those at or before the last one seen are late.

    ``step(row, held)`` returns the new held values, the output values of one row on time and whether its time to live starts
    anew; ``late(row, held)`` the output values of a late one (None: no row). ``ttl`` in milliseconds needs the event time column.
    """

    def __init__(self, held: str, out: str, step, late, event_time: str | None, ttl: int | None):
        self.schema, self.step, self.late, self.event_time, self.ttl = f"last_seq bigint, ends bigint, {held}", step, late, event_time, ttl
        self.names = [c.split()[0] for c in out.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        last, ends, *held = self.state.get() if self.state.exists() else (-1, None, *[None] * (self.schema.count(",") - 1))
        before = ends
        for row in sorted(rows, key=lambda r: r.seq):
            now = int(row[self.event_time].timestamp() * 1000) if self.ttl is not None else None
            if ends is not None and now > ends:
                last, ends, held = -1, None, [None] * len(held)
            if row.seq <= last:
                out = self.late(row, held)
            else:
                last = row.seq
                held, out, renewed = self.step(row, held)
                if self.ttl is not None and (renewed or ends is None):
                    ends = now + self.ttl
            if out is not None:
                yield Row(**dict(zip(self.names, out, strict=True)))
        self.state.update((int(last), ends, *held))
        if ends != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _follow(rows: DataFrame, key: str, held: str, out: str, step, late, event_time: str | None, ttl: str | None, delay: str) -> DataFrame:
    """Run ``_LastOfKey`` over a stream; the state lives in RocksDB, so it may be larger than memory."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if ttl is None:
        return rows.groupBy(key).transformWithState(_LastOfKey(held, out, step, late, None, None), out, "append", "None")
    span = spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {ttl}) AS BIGINT)").first()[0]
    timed = rows.withWatermark(event_time, delay)
    return timed.groupBy(key).transformWithState(_LastOfKey(held, out, step, late, event_time, span), out, "append", "EventTime")


def retry_guard_stream(events: DataFrame, tools: list[str], event_time: str | None = None, ttl: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The same decisions on a stream: the last state record of each task is kept as state.

    The stateful step only attaches the state; the decision itself stays a
    column expression shared with the batch form. With ``event_time`` and ``ttl``
    the state of a task ends; ``delay`` is how far its events may be apart from order.
    """
    names = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    carried = ", ".join(f"s_{c} {t}" for c, t in (x.split() for x in EVENT_SCHEMA.split(", ")) if c in STATE_FIELDS)

    def attached(row: Row, late: bool, held: list) -> list:
        return [*[row[c] for c in names], late, *held]

    def step(row: Row, held: list) -> tuple[list, list, bool]:
        state = row.kind == "state"
        held = [row[f] for f in STATE_FIELDS] if state else held
        return held, attached(row, False, held), state

    joined = _follow(events.select(*names, *([event_time] if event_time else [])), "task_id", carried, f"{EVENT_SCHEMA}, late boolean, {carried}",
                     step, lambda row, held: attached(row, True, held), event_time, ttl, delay)
    return _finish_stream(joined, tools)


def _finish_stream(joined: DataFrame, tools: list[str]) -> DataFrame:
    s = F.when(F.col("s_status").isNotNull(), F.struct(*[F.col("s_" + f).alias(f) for f in STATE_FIELDS]))
    calls = joined.where(F.col("kind") == "call")
    return _decided(calls, F.when(F.col("late"), "late_event").otherwise(guard_reason(s, tools)))


def ledger_stream(entries: DataFrame, event_time: str | None = None, ttl: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Chain and tamper findings of ledger entries as they arrive; state is the last hash and position.

    With ``event_time`` and ``ttl`` a workflow without entries for that long is forgotten: its next entry must start a chain.
    """
    def step(row: Row, held: list) -> tuple[list, list | None, bool]:
        expected = hashlib.sha256(f"{row.workflow_id}~{row.seq}~{row.payload}".encode()).hexdigest()
        found = [r for r, wrong in (("chain_mismatch", row.prev_hash != (held[0] or HEADER)), ("tampered", row.entry_hash != expected)) if wrong]
        return [row.entry_hash], [row.workflow_id, row.seq, found] if found else None, True

    slim = entries.select("workflow_id", "seq", "payload", "prev_hash", "entry_hash", *([event_time] if event_time else []))
    found = _follow(slim, "workflow_id", "last_hash string", "workflow_id bigint, seq bigint, reasons array<string>", step,
                    lambda row, held: [row.workflow_id, row.seq, ["late_entry"]], event_time, ttl, delay)
    return found.select("workflow_id", "seq", F.explode("reasons").alias("reason"))

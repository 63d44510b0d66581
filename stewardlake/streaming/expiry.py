"""T4: expiry timers of approvals, one for each approval and kind.

A key's approvals are a list state, and each has two event-time timers: its
warning and its end. A timer fires once the watermark has passed it; no approval
before it can then still arrive, so what a timer says is decided there and then
from the list: it is silent if a later approval of the key came up to its time,
because that approval restarted the clock. So the output depends on the data and
the final watermark only, not on the order of arrival inside the delay nor on
micro-batches. An approval leaves the list with its last timer, which bounds the
state by the approvals still running.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "actor_id bigint, target_id bigint, kind string, approved_ms bigint, fire_ms bigint"
KEYS = ["actor_id", "target_id"]


def fired(approvals: list[int], at: int, warn_before: int, valid: int) -> list[tuple[str, int]]:
    """(kind, approval) of the timers that stand at ``at`` and that no later approval has replaced."""
    times = sorted(set(approvals))
    out = []
    for t, later in zip(times, [*times[1:], None]):
        if later is None or at < later:
            out += [(kind, t) for kind, due in (("Expiring", t + valid - warn_before), ("Expired", t + valid)) if due == at]
    return out


class ExpiryTimers(StatefulProcessor):
    def __init__(self, warn_before: int, valid: int):
        self.warn_before, self.valid = warn_before, valid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.approvals = handle.getListState("approvals", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = {r[0] for r in self.approvals.get()}
        for t in sorted({r["event_ms"] for r in rows} - held):
            if t > passed:
                self.approvals.appendValue((t,))
                self.handle.registerTimer(t + self.valid - self.warn_before)
                self.handle.registerTimer(t + self.valid)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        held = [r[0] for r in self.approvals.get()]
        for kind, t in fired(held, at, self.warn_before, self.valid):
            yield Row(actor_id=key[0], target_id=key[1], kind=kind, approved_ms=t, fire_ms=at)
        running = [t for t in held if t + self.valid > at]
        if not running:
            self.approvals.clear()
        elif len(running) < len(held):
            self.approvals.put([(t,) for t in running])

    def close(self) -> None:
        pass


def expiry_events(approvals: DataFrame, warn_before_ms: int, valid_ms: int) -> DataFrame:
    """Warnings and ends of a watermarked stream (actor_id, target_id, event_ms, event_time) of approvals."""
    return approvals.groupBy(*KEYS).transformWithState(ExpiryTimers(warn_before_ms, valid_ms), OUT, "Append", "EventTime")

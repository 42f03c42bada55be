"""The life of each report as a stream: submitted, scored or failed and tried again, expired.

One state a report is kept by Spark, with a timer in event time for retention. Late or repeated events change nothing that
is newer. A result carries the number of its scoring; what was marked up for an earlier scoring is stale from then on.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: fixed values: attempts of a job, progress when it begins and before its results are stored
ATTEMPTS, BEGUN, SCORED = 3, 10, 80
#: days that a report is kept after its submission unless it is a sample
KEPT_DAYS = 30

CHANGES = "report long, at timestamp, status string, attempts int, progress int, scoring int, overlap double, stale_scoring int"
_STATE = "status string, attempts int, scoring int, at_ms long, expires_ms long"


def _ms(at: datetime) -> int:
    return round(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000)


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


class _Life(StatefulProcessor):
    def __init__(self, kept_days: int):
        self.kept_ms = kept_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("life", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get() if self.state.exists() else None
        status, attempts, scoring, last, expires = tuple(known) if known else (None, 0, 0, -1, 0)
        for x in sorted(rows, key=lambda r: (r.at, r.kind)):
            at = _ms(x.at)
            if at < last or (at == last and x.kind == "submitted"):
                continue  # something newer is known, or this came before
            stale, progress = None, None
            if x.kind == "submitted":
                status, attempts, progress = "waiting", 0, BEGUN
                if expires:
                    self.handle.deleteTimer(expires)
                expires = 0 if x.is_sample else at + self.kept_ms
                if expires:
                    self.handle.registerTimer(expires)
            elif status is None or status == "done" and at == last:
                continue  # no such report, or the same result again
            elif x.kind == "failed":
                attempts += 1
                status = "failed" if attempts >= ATTEMPTS else "waiting"
                progress = BEGUN
            elif x.kind == "scored":
                stale, scoring = scoring or None, scoring + 1
                status, attempts, progress = "done", 0, 100
            else:
                continue
            last = at
            yield Row(report=key[0], at=x.at, status=status, attempts=attempts, progress=progress, scoring=scoring, overlap=x.overlap if x.kind == "scored" else None, stale_scoring=stale)
        if status is not None:
            self.state.update((status, attempts, scoring, last, expires))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        status, attempts, scoring, last, expires = tuple(self.state.get())
        if expires == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield Row(report=key[0], at=_at(expires), status="expired", attempts=attempts, progress=None, scoring=scoring, overlap=None, stale_scoring=scoring or None)

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, kept_days: int = KEPT_DAYS, late: str = "1 hour") -> DataFrame:
    """Changes of state (``CHANGES``) of a stream of events: report, at, kind (submitted, scored, failed), is_sample, overlap.

    Defined results: events out of order within a batch are put in order; one older than what is known of its report, or a repeated
    one, gives no change; a result or failure of an unknown or expired report gives none; null reports and times are left out."""
    known = events.where("report IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return known.groupBy("report").transformWithState(statefulProcessor=_Life(kept_days), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")

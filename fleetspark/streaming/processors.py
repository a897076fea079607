"""Stateful processors of the change feed: what a key's state is, and when it goes.

State lies in the engine's store and belongs to one key.  A processor sees the
events of its key in any order.  What the watermark has passed can no longer
change and is folded to a value of fixed size; only events within the allowed
lateness are kept as they are.  Timers on event time do what is due and remove
the state of keys that are gone.

Times are microseconds since 1970; an event without a time sorts before all
others, as in the batch forms.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, ValueState

from fleetspark.operators.changes import READY_PHASE, RETRY_SECONDS, RETRY_TRIES

EVENTS = "at LONG, event_id LONG, phase INT"
LATEST = "kind STRING, at LONG, event_id LONG, phase INT, has_child BOOLEAN"


def _rows(rows: Iterator[Row], *names: str) -> list[tuple]:
    return [tuple(row[name] for name in names) for row in rows]


def _held(state: ValueState) -> tuple | None:
    value = state.get()
    return None if value is None else tuple(value)


def _placed(row: tuple) -> tuple:
    """Sort key of (at, event_id, ..)."""
    return (row[0] is not None, row[0] or 0, row[1])


class Phases(StatefulProcessor):
    """Transitions of a key's phase.

    ``folded`` is the stretch of events that the watermark has passed, ``open``
    the later ones.  Events without a time come before all others; they stay in
    ``open``, as one with a smaller number may still arrive.
    """

    FOLDED = "first_phase INT, first_at LONG, last_phase INT, changed_at LONG, changes LONG, last_at LONG, seen LONG"
    OUTPUT = "key LONG, phase INT, last_transition_at LONG, transitions LONG, last_seen_at LONG, seen LONG"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.folded = handle.getValueState("folded", self.FOLDED)
        self.open = handle.getListState("open", EVENTS)

    @staticmethod
    def _extended(stretch: tuple | None, events: list[tuple]) -> tuple | None:
        """A stretch (first phase, its time, last phase, last change after the first, changes, last time, events) with later events."""
        for at, _, phase in events:
            if stretch is None:
                stretch = (phase, at, phase, None, 0, at, 1)
                continue
            first, first_at, last, changed_at, changes, last_at, seen = stretch
            if phase != last:
                changed_at, changes = (at if at is not None else changed_at), changes + 1
            stretch = (first, first_at, phase, changed_at, changes, at if at is not None else last_at, seen + 1)
        return stretch

    @staticmethod
    def _joined(a: tuple | None, b: tuple | None) -> tuple | None:
        if a is None or b is None:
            return a or b
        opens = b[0] != a[2]
        changed_at = b[3] if b[3] is not None else b[1] if opens and b[1] is not None else a[3]
        return (a[0], a[1], b[2], changed_at, a[4] + b[4] + opens, b[5] if b[5] is not None else a[5], a[6] + b[6])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events = sorted([tuple(r) for r in self.open.get()] + _rows(rows, "at", "event_id", "phase"), key=_placed)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        folded = _held(self.folded)
        untimed = [e for e in events if e[0] is None]
        done = [e for e in events if e[0] is not None and e[0] <= passed]
        late = [e for e in events if e[0] is not None and e[0] > passed]
        if done:
            folded = self._extended(folded, done)
            self.folded.update(folded)
        self.open.put(untimed + late)
        before = self._joined(self._extended(None, untimed), folded)
        first, first_at, phase, changed_at, changes, last_at, seen = self._extended(before, late)
        moved_at = changed_at if changed_at is not None else first_at
        yield Row(key=key[0], phase=phase, last_transition_at=moved_at, transitions=changes + 1, last_seen_at=last_at, seen=seen)


class Latest(StatefulProcessor):
    """The last event of a key.

    A deleted key keeps a tombstone until the watermark has passed its
    deletion, since an event before that may still come back after it.  Then
    its state is removed, unless a child of it was left at its last event.
    """

    OUTPUT = "key LONG, kind STRING, at LONG, event_id LONG, phase INT, has_child BOOLEAN, purged BOOLEAN"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LATEST)

    def _row(self, key: Any, last: tuple, purged: bool) -> Row:
        kind, at, event_id, phase, has_child = last
        return Row(key=key[0], kind=kind, at=at, event_id=event_id, phase=phase, has_child=has_child, purged=purged)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = _held(self.last)
        events = _rows(rows, "kind", "at", "event_id", "phase", "has_child")
        last = max(([known] if known else []) + events, key=lambda e: _placed(e[1:]))
        if last == known:
            return
        self.last.update(last)
        if known and known[0] == "DELETED":
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if last[0] == "DELETED":
            passed = timerValues.getCurrentWatermarkInMs()
            self.handle.registerTimer(max((last[1] or 0) // 1000, passed) + 1)
        yield self._row(key, last, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last = _held(self.last)
        if last is None or last[0] != "DELETED" or last[4]:
            return
        self.last.clear()
        yield self._row(key, last, True)


class Retries(StatefulProcessor):
    """Keys that are not ready, tried again after 5, 10, 15 .. seconds, at most ten times.

    A try is made once the watermark has passed its time: no event before it
    can call it off any more.  A newer event starts anew.  Ready keys wait
    without a timer; a deleted key loses its state like its tombstone.
    """

    LAST = "at LONG, event_id LONG, phase INT, kind STRING, tries INT"
    OUTPUT = "key LONG, kind STRING, at LONG, event_id LONG, phase INT, tries INT, due_at LONG"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.LAST)

    @staticmethod
    def _due(last: tuple) -> int | None:
        """When the next try is made: the delays before it add up."""
        at, _, phase, kind, tries = last
        if kind == "DELETED" or phase == READY_PHASE or tries >= RETRY_TRIES:
            return None
        return (at or 0) + RETRY_SECONDS * 1_000_000 * (tries + 1) * (tries + 2) // 2

    def _advance(self, key: Any, known: tuple | None, last: tuple, timerValues: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        while (due := self._due(last)) is not None and due <= passed * 1000:
            last = (*last[:4], last[4] + 1)
        if last == known:
            return
        self.last.update(last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))
        elif last[3] == "DELETED":
            self.handle.registerTimer(max((last[0] or 0) // 1000, passed) + 1)
        at, event_id, phase, kind, tries = last
        yield Row(key=key[0], kind=kind, at=at, event_id=event_id, phase=phase, tries=tries, due_at=due)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = _held(self.last)
        events = [(*row, 0) for row in _rows(rows, "at", "event_id", "phase", "kind")]
        last = max(([known] if known else []) + events, key=lambda e: (*_placed(e), e[4]))
        yield from self._advance(key, known, last, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last = _held(self.last)
        if last is None:
            return
        if last[3] == "DELETED":
            self.last.clear()
        else:
            yield from self._advance(key, last, last, timerValues)

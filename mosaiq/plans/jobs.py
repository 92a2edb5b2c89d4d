"""Running plans in the background: one job a session, cancelled by the next, with events."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Event:
    """kind: progress (done of total tasks so far known), done, error (with message) or cancelled."""

    kind: str
    session: Hashable
    done: int = 0
    total: int = 0
    message: str = ""


@dataclass
class Handle:
    """A running action: its job group, its thread, and its result once it is done."""

    group: str
    cancelled: bool = False
    result: object = None
    ended: threading.Event = field(default_factory=threading.Event)


class Jobs:
    """Starts actions for sessions and hands events to listen, which is called on the actions' threads."""

    def __init__(self, spark: SparkSession, listen: Callable[[Event], None] = lambda e: None, every: float = 0.2) -> None:
        self.spark, self.listen, self.every = spark, listen, every
        self.running: dict[Hashable, Handle] = {}
        self._lock = threading.Lock()

    def start(self, session: Hashable, action: Callable[[], object]) -> Handle:
        """Run action, whose Spark jobs all count as one, after the session's earlier one is cancelled."""
        handle = Handle(f"mosaiq-{uuid.uuid4().hex}")
        with self._lock:
            before, self.running[session] = self.running.get(session), handle
        if before:
            self._stop(before)
        InheritableThread(target=self._run, args=(session, handle, action), daemon=True).start()
        threading.Thread(target=self._watch, args=(session, handle), daemon=True).start()
        return handle

    def cancel(self, session: Hashable) -> None:
        with self._lock:
            handle = self.running.pop(session, None)
        if handle:
            self._stop(handle)

    def is_running(self, session: Hashable) -> bool:
        handle = self.running.get(session)
        return handle is not None and not handle.ended.is_set()

    def _stop(self, handle: Handle) -> None:
        handle.cancelled = True
        self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(handle.group)

    def _run(self, session: Hashable, handle: Handle, action: Callable[[], object]) -> None:
        self.spark.sparkContext.setJobGroup(handle.group, f"session {session}", interruptOnCancel=True)
        try:
            if not handle.cancelled:
                handle.result = action()
            event = Event("cancelled" if handle.cancelled else "done", session)
        except Exception as e:  # noqa: BLE001, whatever ends an action is an event
            event = Event("cancelled", session) if handle.cancelled else Event("error", session, message=str(e))
        handle.ended.set()
        with self._lock:
            if self.running.get(session) is handle:
                del self.running[session]
        self.listen(event)

    def progress(self, handle: Handle) -> tuple[int, int]:
        """Tasks done, and of all stages known so far."""
        tracker, done, total = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(handle.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                state = tracker.getStageInfo(stage)
                if state:
                    done, total = done + state.numCompletedTasks, total + state.numTasks
        return done, total

    def _watch(self, session: Hashable, handle: Handle) -> None:
        last = (0, 0)
        while not handle.ended.wait(self.every):
            now = self.progress(handle)
            if now != last and not handle.ended.is_set():
                self.listen(Event("progress", session, *now))
            last = now

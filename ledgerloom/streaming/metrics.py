"""Figures of a run, taken while its rows are written, and alerts at milestones."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from ledgerloom import fixed
from ledgerloom.shared import children, delete, exists, get_text, put_text

Alert = Callable[[int, dict], None]


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, Observation]:
    """df, and the measures of its rows once an action has gone over all of them; no pass of its own."""
    seen = Observation()
    return df.observe(seen, *(c.alias(name) for name, c in measures.items())), seen


class Milestones:
    """Numbers that are told of once each: the mark of one that was reached stays in a folder, so a job that starts again is silent about it."""

    def __init__(self, spark: SparkSession, path: str, alert: Alert, steps: tuple[int, ...] = fixed.MILESTONES):
        self.spark, self.path, self.alert, self.steps = spark, path.rstrip("/"), alert, steps

    def at(self, number: int, figures: dict | None = None) -> list[int]:
        """The steps that number reaches for the first time, least first; the alert gets each with the figures."""
        new = [s for s in self.steps if s <= number and not exists(self.spark, f"{self.path}/{s}")]
        for step in new:
            put_text(self.spark, f"{self.path}/{step}", str(number))
            self.alert(step, figures or {})
        return new


class Progress(StreamingQueryListener):
    """Totals of the measures that a stream observes under a name, kept in a folder, with rate, time left and milestones.

    A batch counts once: the totals are kept with the last batch in them, by which batches that are
    told of again are known. Those that end while nobody listens are not in the totals. None of the
    measures may be other than a sum or a count.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, of: str, expected: int | None = None, milestones: Milestones | None = None):
        self.spark, self.path, self.name, self.of, self.expected, self.milestones = spark, path.rstrip("/"), name, of, expected, milestones
        self.batch, self.totals = self._held()
        self.began, self.since = time.monotonic(), self.totals.get(of, 0)

    def _held(self) -> tuple[int, dict]:
        kept = sorted((int(c) for c in children(self.spark, self.path) if c.isdigit()), reverse=True)
        for batch in kept:
            text = get_text(self.spark, f"{self.path}/{batch}")
            if text.endswith("}"):  # one that was cut off has no end
                return batch, json.loads(text)
        return -1, {}

    def add(self, batch: int, counts: dict) -> None:
        if batch <= self.batch:
            return
        last, self.batch = self.batch, batch
        self.totals = {k: self.totals.get(k, 0) + (v or 0) for k, v in counts.items()}
        put_text(self.spark, f"{self.path}/{batch}", json.dumps(self.totals))
        if last >= 0:
            delete(self.spark, f"{self.path}/{last}")
        if self.milestones:
            self.milestones.at(self.totals[self.of], self.figures())

    def figures(self) -> dict:
        """Totals, units a second since this listener began, and minutes that are left of what is expected (None if unknown)."""
        n = self.totals.get(self.of, 0)
        rate = (n - self.since) / max(time.monotonic() - self.began, 1e-9)
        left = None if self.expected is None or rate <= 0 else max(self.expected - n, 0) / rate / 60
        return {**self.totals, "rate": rate, "minutes_left": left}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.add(event.progress.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def report(figures: dict, seconds: float, of: str) -> dict:
    """Figures of a run that has ended, with its length and rate."""
    return {**figures, "seconds": round(seconds, 3), "rate": figures[of] / max(seconds, 1e-9)}

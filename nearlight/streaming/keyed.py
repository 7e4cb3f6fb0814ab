"""Streams whose state is kept by key, with timers: failure suspicion that needs no beat to arise, and rows
that wait for the end of a split."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from nearlight.functions import PHI_8
from nearlight.operators.health import FIRST_MEAN, SAMPLE, STD_FLOOR
from nearlight.session import ship

CHANGES = "peer_id long, ms double, cause string, available boolean, n long, mean double, std double"
WAITED = "cluster_id long, seq long, id long, released boolean"


@contextmanager
def stores(spark: SparkSession):
    """Keyed state with timers needs the store that has column families."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Detector(StatefulProcessor):
    """A peer's last ``SAMPLE`` gaps, its last beat, and whether it is held to be up.

    A beat sets a timer for the moment when its silence would mean a suspicion of 8; what arrives before
    deletes it. A beat that comes after that moment in the same batch reports the silence itself, so the
    changes do not depend on how a stream is cut into batches. A peer that was asked and has never answered is
    known, but neither up nor down."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("history", "last double, gaps array<double>, up boolean")

    @staticmethod
    def _stats(gaps: list) -> tuple[float, float]:
        return (float(np.mean(gaps)), float(np.std(gaps))) if gaps else (FIRST_MEAN, 0.0)

    def _deadline(self, last: float, gaps: list) -> float:
        mean, std = self._stats(gaps)
        return last + mean + PHI_8 * max(std, STD_FLOOR)

    def _row(self, key, ms, cause, available, gaps) -> tuple:
        mean, std = self._stats(gaps)
        return key[0], ms, cause, available, len(gaps), mean, std

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        beats = pd.concat(list(rows)).sort_values(["ms", "answered"], kind="stable")
        last, gaps, up = self.state.get() if self.state.exists() else (None, [], None)
        gaps, out = list(gaps), []
        if not self.state.exists() and not beats["answered"].iloc[0]:
            out.append(self._row(key, float(beats["ms"].iloc[0]), "added", None, gaps))
        for ms in beats["ms"][beats["answered"]].to_numpy(np.float64).tolist():
            if last is None:
                out.append(self._row(key, ms, "contact", True, gaps))
            else:
                due = self._deadline(last, gaps)
                if up and ms >= due:
                    out.append(self._row(key, due, "silence", False, gaps))
                    up = False
                gaps = (gaps + [ms - last])[-SAMPLE:]
                if not up:
                    out.append(self._row(key, ms, "return", True, gaps))
            last, up = ms, True
        self.state.update((last, gaps, up))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if up:
            self.handle.registerTimer(math.ceil(self._deadline(last, gaps)))
        if out:
            yield pd.DataFrame(out, columns=["peer_id", "ms", "cause", "available", "n", "mean", "std"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, gaps, up = self.state.get()
        if up:
            self.state.update((last, gaps, False))
            out = [self._row(key, self._deadline(last, list(gaps)), "silence", False, list(gaps))]
            yield pd.DataFrame(out, columns=["peer_id", "ms", "cause", "available", "n", "mean", "std"])

    def close(self) -> None:
        pass


def detected(beats: DataFrame, live: bool = False, late: str = "0 seconds") -> DataFrame:
    """Changes of each peer of a stream ``beats(peer_id, ms, answered)``: ``contact``, ``silence``, ``return``, or ``added``
    while it has not answered. ``live`` takes the clock of the machine; else time is what the beats say, and
    beats later than ``late`` are left out. Start the query inside :func:`stores`."""
    ship(beats.sparkSession)
    timed = beats.select("peer_id", "ms", "answered", F.timestamp_micros((F.col("ms") * 1000).cast("long")).alias("at"))
    timed = timed if live else timed.withWatermark("at", late)
    return timed.groupBy("peer_id").transformWithStateInPandas(Detector(), CHANGES, "Update", "ProcessingTime" if live else "EventTime")


class Waiting(StatefulProcessor):
    """Rows of a cluster go through, but wait in order while it is being split."""

    def init(self, handle) -> None:
        self.splitting = handle.getValueState("splitting", "on boolean")
        self.rows = handle.getListState("rows", "seq long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        on = self.splitting.get()[0] if self.splitting.exists() else False
        was, wait, out = on, [], []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            if r.kind == "begin":
                on = True
            elif r.kind == "end":
                held = [tuple(x) for x in self.rows.get()] if self.rows.exists() else []
                out += [(-1, int(s), int(i), True) for s, i in held + wait]
                self.rows.clear()
                on, wait = False, []
            elif on:
                wait.append((int(r.seq), int(r.id)))
            else:
                out.append((key[0], int(r.seq), int(r.id), False))
        if wait:
            self.rows.appendList(wait)
        if on != was:
            self.splitting.update((on,))
        if out:
            yield pd.DataFrame(out, columns=["cluster_id", "seq", "id", "released"])

    def close(self) -> None:
        pass


def diverted(rows: DataFrame) -> DataFrame:
    """``(cluster_id, seq, id, released)`` of a stream ``rows(cluster_id, seq, kind, id)``, ``kind`` being ``row``, or
    ``begin`` or ``end`` of a split of the cluster. Rows that waited come out at its end, in order, and without a cluster:
    theirs is gone. Start the query inside :func:`stores`."""
    ship(rows.sparkSession)
    return rows.groupBy("cluster_id").transformWithStateInPandas(Waiting(), WAITED, "Update", "None")

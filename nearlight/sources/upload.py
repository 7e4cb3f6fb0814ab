"""Upload of rows in slices to a store that takes batches.

Every task cuts its rows into slices and hands each to ``send``. A slice that fails is cut into smaller
ones and tried once more; if one of these fails too, so does the task, and Spark tries it again. ``send`` gets a
name for each slice that stays the same when a task is tried again, so a store that replaces by name or by id
never holds rows twice. What was sent is written by Spark's own commit protocol, a row for each task
that ended well: attempts that failed or were overtaken do not count."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.session import cut, ship

SLICE, RETRY = 256, 64
PAUSE = 2.0
REPORT = "task int, rows long, slices long, retried long"

#: ``send(name, rows)``: rows as dicts. An exception is a failure.
Send = Callable[[str, list[dict]], None]


def slices(rows: Iterable, size: int) -> Iterator[list]:
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield part


def deliver(rows: Iterable[dict], send: Send, name: str, size: int = SLICE, retry: int = RETRY, pause: float = PAUSE) -> tuple[int, int, int]:
    """Rows and slices that arrived, and slices that had to be cut smaller."""
    n = parts = again = 0
    for i, part in enumerate(slices(rows, size)):
        try:
            send(f"{name}-{i}", part)
            parts += 1
        except Exception:  # the store's own, whatever it is
            time.sleep(pause)
            again += 1
            for j, small in enumerate(slices(part, retry)):
                send(f"{name}-{i}-{j}", small)
                parts += 1
        n += len(part)
    return n, parts, again


def upload(rows: DataFrame, send: Send, label: str, size: int = SLICE, retry: int = RETRY, pause: float = PAUSE) -> DataFrame:
    """Send all ``rows`` as ``label``: ``(task, rows, slices, retried)`` of each task that had some. The rows' partitions
    should come out the same when they are computed again, as those of a table or a range do."""
    ship(rows.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        told = deliver((r for b in batches for r in b.to_pylist()), send, f"{label}-{task}", size, retry, pause)
        if told[0]:
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), **{c: pa.array([v], pa.int64()) for c, v in zip(("rows", "slices", "retried"), told)}})

    return cut(rows.mapInArrow(run, REPORT), "upload-report")


def upload_stream(stream: DataFrame, send: Send, label: str, checkpoint: str, size: int = SLICE, retry: int = RETRY, pause: float = PAUSE) -> int:
    """Drain a stream; how many rows were sent by this run. A micro-batch that is sent again has the names it had."""
    n = []

    def batch(rows: DataFrame, number: int) -> None:
        told = upload(rows, send, f"{label}-{number}", size, retry, pause)
        n.append(told.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sum(n)

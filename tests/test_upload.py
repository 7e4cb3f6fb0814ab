"""Uploads: slices, smaller ones after a failure, and counts that hold whatever was tried."""

import json
import os

import pytest
from pyspark.sql import functions as F

from nearlight.session import kept_dir
from nearlight.sources import upload


def test_slices_and_retries():
    got, calls = {}, []

    def send(name, rows):
        calls.append(len(rows))
        if len(rows) > 4 and any(r == 13 for r in rows):
            raise OSError("too large")
        got[name] = rows

    assert upload.deliver(range(25), send, "x", 10, 4, 0) == (25, 5, 1)
    assert calls == [10, 10, 4, 4, 2, 5]
    assert sorted(r for rows in got.values() for r in rows) == list(range(25))
    assert set(got) == {"x-0", "x-1-0", "x-1-1", "x-1-2", "x-2"}
    assert upload.deliver([], send, "x") == (0, 0, 0)
    with pytest.raises(OSError):
        upload.deliver([13] * 20, send, "x", 10, 6, 0)


def store(path):
    """A store below a folder: a file for each slice, replaced by name; large slices with a certain id fail."""

    def send(name, rows):
        if len(rows) > 8 and any(r["id"] % 50 == 7 for r in rows):
            raise OSError("refused")
        with open(f"{path}/{name}", "w") as f:
            json.dump([r["id"] for r in rows], f)

    return send


def held(path):
    return sorted(i for f in os.listdir(path) for i in json.load(open(f"{path}/{f}")))


def test_upload(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 3).withColumn("vec", F.array(F.lit(1.0)))
    for _ in range(2):  # sent again, everything replaces itself
        told = upload.upload(rows, store(tmp_path), "batch", 16, 8, 0)
        assert told.agg(F.sum("rows")).first()[0] == 1000 and told.agg(F.sum("retried")).first()[0] == 20
        assert held(tmp_path) == list(range(1000))
    assert upload.upload(rows.limit(0), store(tmp_path), "none").count() == 0


def test_upload_stream_goes_on_where_it_ended(spark, tmp_path):
    source, checkpoint = kept_dir(spark, "up-source"), kept_dir(spark, "up-checkpoint")
    schema = spark.range(1).schema
    spark.range(100).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    assert upload.upload_stream(stream(), store(tmp_path), "s", checkpoint, 16, 8, 0) == 100
    assert upload.upload_stream(stream(), store(tmp_path), "s", checkpoint, 16, 8, 0) == 0
    spark.range(100, 130).write.mode("append").parquet(source)
    assert upload.upload_stream(stream(), store(tmp_path), "s", checkpoint, 16, 8, 0) == 30
    assert held(tmp_path) == list(range(130))

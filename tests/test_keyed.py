"""Streams with keyed state: timers, waiting rows, tables of changes, restarts."""

import random

import numpy as np
import pytest

from nearlight.functions import PHI_8
from nearlight.session import kept_dir
from nearlight.streaming import ingest, keyed

BEATS = "peer_id long, ms double, answered boolean"


def brute_changes(beats, now):
    out = []
    for peer in {b[0] for b in beats}:
        own = sorted((ms, ok) for p, ms, ok in beats if p == peer)
        hits = [ms for ms, ok in own if ok]
        if not own[0][1]:
            out.append((peer, own[0][0], "added", None))
        gaps, last, up = [], None, None

        def due():
            mean, std = (np.mean(gaps), np.std(gaps)) if gaps else (3000.0, 0.0)
            return last + mean + PHI_8 * max(std, 100.0)

        for ms in hits:
            if last is None:
                out.append((peer, ms, "contact", True))
            else:
                if ms >= due():
                    out += [(peer, round(float(due()), 3), "silence", False), (peer, ms, "return", True)]
                gaps = (gaps + [ms - last])[-500:]
            last = ms
        if last is not None and now >= due():
            out.append((peer, round(float(due()), 3), "silence", False))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["peer_id"], round(r["ms"], 3), r["cause"], r["available"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("files", [1, 5])
def test_suspicions_do_not_depend_on_batches(spark, files):
    rng, beats = random.Random(6), []
    for peer in range(12):
        ms = 1_000_000.0 + rng.randrange(5000)
        for _ in range(40):
            beats.append((peer, ms, True))
            ms += 60_000.0 if rng.random() < 0.06 else 3000.0 + rng.randrange(-500, 500)
    beats += [(50, 1_000_100.0, False), (50, 1_090_000.0, False), (51, 1_000_050.0, False), (51, 1_020_000.0, True)]
    now = max(b[1] for b in beats)
    got = found(ingest.suspicions(spark, spark.createDataFrame(beats, BEATS).repartition(3), files))
    want = brute_changes(beats, now)
    assert (set(got) - set(want), set(want) - set(got), now) == (set(), set(), now)
    assert got == want
    assert {c for _, _, c, _ in got} == {"added", "contact", "silence", "return"}
    assert [x for x in got if x[0] == 50] == [(50, 1_000_100.0, "added", None)]


def test_timers_and_state_outlive_a_restart(spark):
    source, path, checkpoint = (kept_dir(spark, f"restart-{x}") for x in ("source", "path", "check"))

    def drain(rows):
        spark.createDataFrame(rows, BEATS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(BEATS).option("maxFilesPerTrigger", 1).parquet(source)
        with keyed.stores(spark):
            ingest._drain(keyed.detected(stream), lambda n, df: df.write.mode("overwrite").parquet(f"{path}/{n}"), checkpoint, "update")
        numbers = ingest.Snapshots(spark, path, keyed.CHANGES).numbers()
        return found(spark.read.schema(keyed.CHANGES).parquet(*[f"{path}/{n}" for n in numbers]))

    steady = [(1, 1_000_000.0 + 3000 * i, True) for i in range(10)] + [(2, 1_000_000.0 + 3000 * i, True) for i in range(10)]
    assert [x[2] for x in drain(steady)] == ["contact", "contact"]
    later = [(2, 1_027_000.0 + 3000 * i, True) for i in range(1, 30)]  # peer 1 says nothing more
    silence = (1, 1_027_000.0 + 3000 + round(PHI_8 * 100, 3), "silence", False)
    assert silence in drain(later)
    assert drain([(1, 1_200_000.0, True), (2, 1_117_000.0, True)])[-4:] == sorted(
        [(1, 1_200_000.0, "return", True), silence, (2, 1_000_000.0, "contact", True), (2, 1_117_000.0 + 3000 + round(PHI_8 * 100, 3), "silence", False)], key=str
    )


@pytest.mark.parametrize("files", [1, 4])
def test_rows_wait_for_the_end_of_a_split(spark, files):
    told = [(5, 10, "begin", None), (5, 30, "end", None), (5, 35, "begin", None), (6, 20, "begin", None)]
    at = {t[1] for t in told}
    rows = [(c, s, "row", s * 10 + c) for s in range(50) for c in (5, 6, 7) if s not in at] + told
    got = {(r["id"], r["cluster_id"], r["released"]) for r in ingest.divert(spark, spark.createDataFrame(rows, "cluster_id long, seq long, kind string, id long"), files).collect()}
    want = set()
    for c, s, kind, i in rows:
        if kind == "row":
            if c == 7 or s < 10 or c == 5 and 30 < s < 35 or c == 6 and s < 20:
                want.add((i, c, False))
            elif c == 5 and s < 30:
                want.add((i, -1, True))
    assert got == want


def test_changes_fold_and_a_batch_may_come_again(spark):
    schema = spark.createDataFrame([], "id long, x long").schema
    table = ingest.Changes(spark, kept_dir(spark, "changes"), schema)
    table.FOLD = 4
    rng, want = random.Random(2), {}
    for n in range(15):
        rows = [(i, 100 * n + i) for i in rng.sample(range(20), 6)]
        for _ in range(1 + n % 2):
            table.write(n, spark.createDataFrame(rows, schema))
        want |= dict(rows)
        assert {r["id"]: r["x"] for r in table.read().collect()} == want
    assert len(table.base.numbers()) == 2 and len(table.changes.numbers()) < 10


def test_a_batch_writes_its_own_ids_only(spark):
    source, path, checkpoint = (kept_dir(spark, f"own-{x}") for x in ("source", "path", "check"))
    schema = spark.createDataFrame([], "id long, ts double, node long").schema
    spark.range(1000).selectExpr("id", "1D as ts", "0L as node").write.parquet(source)
    assert ingest.upsert_stream(spark, source, schema, path, checkpoint).count() == 1000
    spark.createDataFrame([(5, 2.0, 0), (6, 0.5, 0), (2000, 1.0, 0)], schema).coalesce(1).write.mode("append").parquet(source)
    got = ingest.upsert_stream(spark, source, schema, path, checkpoint)
    assert got.count() == 1001 and {r["id"]: r["ts"] for r in got.filter("id in (5, 6, 2000)").collect()} == {5: 2.0, 6: 1.0, 2000: 1.0}
    last = max(ingest.Snapshots(spark, f"{path}/changes", schema).numbers())
    assert spark.read.parquet(f"{path}/changes/{last}").count() == 3

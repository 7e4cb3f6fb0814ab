"""Collections under versions, marks, races and broken batches."""

import random

import pytest

from nearlight.session import kept_dir
from nearlight.sources.collections import Collections

ROW = "id long, vec array<float>, payload string, cluster_id long, ts double, node long, seq long"


def rows(spark, *r):
    """``(id, x, payload, cluster_id, ts, node)`` in order."""
    return spark.createDataFrame([(i, [float(x), 0.0], p, c, t, n, k) for k, (i, x, p, c, t, n) in enumerate(r)], ROW)


def content(c, name="a", cluster=None):
    return sorted((r["id"], r["vec"][0], r["payload"], r["cluster_id"], r["ts"], r["node"]) for r in c.scan(name, cluster).collect())


@pytest.fixture
def c(spark):
    c = Collections(spark, kept_dir(spark, "c"))
    c.create("a", 2, "dot")
    return c


def test_newest_version_only(spark, c):
    assert c.insert("a", rows(spark, (1, 1, "x", 5, 1.0, 0), (2, 2, "y", 5, 1.0, 0)), "1") == 2
    assert c.insert("a", rows(spark, (1, 3, "older", 5, 0.5, 9), (2, 4, "equal", 5, 1.0, 0)), "2") == 0
    assert c.insert("a", rows(spark, (1, 5, "newer", 5, 1.0, 1), (3, 6, None, None, None, None)), "3") == 2
    assert content(c) == sorted([(1, 5.0, "newer", 5, 1.0, 1), (2, 2.0, "y", 5, 1.0, 0), (3, 6.0, None, None, None, None)], key=lambda r: r[0])
    assert c.count("a") == 3


def test_rows_of_a_batch_come_one_by_one(spark, c):
    batch = rows(spark, (1, 1, "a", 0, 2.0, 0), (1, 2, "b", 0, 1.0, 0), (1, 3, "c", 0, 3.0, 0), (1, 4, "d", 0, 3.0, 0), (None, 5, "e", 0, 1.0, 0))
    assert c.insert("a", batch, "1", order="seq") == 2
    assert content(c) == [(1, 3.0, "c", 0, 3.0, 0)]
    assert c.insert("a", batch, "2") == 0
    c.create("b", 2)
    assert c.insert("b", batch, "1") == 1  # without order only the newest comes
    assert c.scan("b").first()["ts"] == 3.0


def test_a_row_that_moves_leaves_its_cluster(spark, c):
    c.insert("a", rows(spark, (1, 1, "x", 5, 1.0, 0), (2, 1, "x", 5, 1.0, 0)), "1")
    assert c.insert("a", rows(spark, (1, 2, "y", 6, 2.0, 0)), "2") == 1
    assert [r[0] for r in content(c, cluster=5)] == [2] and [r[0] for r in content(c, cluster=6)] == [1]
    assert c.insert("a", rows(spark, (1, 3, "z", 5, 3.0, 0)), "3") == 1
    assert [r[0] for r in content(c, cluster=5)] == [1, 2] and content(c, cluster=6) == []
    q = spark.createDataFrame([(9, [1.0, 0.0], 6), (8, [1.0, 0.0], 5)], "qid long, qvec array<double>, cluster_id long")
    assert {(r["qid"], r["id"], r["payload"]) for r in c.query_by_cluster("a", q, 5).collect()} == {(8, 1, "z"), (8, 2, "x")}


def test_deleted_rows_may_come_back_with_any_version(spark, c):
    c.insert("a", rows(spark, (1, 1, "x", 5, 9.0, 0), (2, 1, "x", 6, 9.0, 0), (3, 1, "x", 6, 9.0, 0)), "1")
    ids = spark.createDataFrame([(1,), (1,), (77,)], "id long")
    assert c.delete("a", ids, "2") == 1 == c.delete("a", ids, "2")
    assert c.delete_cluster("a", 6, "3") == 2 and c.count("a") == 0
    assert c.insert("a", rows(spark, (1, 2, "old", 5, 1.0, 0)), "4") == 1
    assert content(c) == [(1, 2.0, "old", 5, 1.0, 0)]


def test_a_broken_batch_is_not_seen(spark, c):
    c.insert("a", rows(spark, (1, 1, "x", 5, 1.0, 0)), "1")
    bad = rows(spark, *[(i, 1, "x", 5, 1.0, 0) for i in range(10, 40)]).unionByName(
        spark.createDataFrame([(50, [1.0], "short", 5, 1.0, 0, 0)], ROW)
    )
    with pytest.raises(Exception, match="has 2 components"):
        c.insert("a", bad, "2")
    # files of a writer that died before its manifest
    spark.createDataFrame([(60, [1.0, 1.0], "x", 1.0, 0, False, 5)], "id long, vec array<float>, payload string, ts double, node long, gone boolean, cluster_id long").write.partitionBy("cluster_id").parquet(f"{c.base}/a/rows/seq=2/part=dead")
    assert c.count("a") == 1
    assert c.insert("a", rows(spark, (2, 1, "x", 5, 1.0, 0)), "2") == 1 and c.count("a") == 2
    # a manifest that broke off
    p, fs = c._path(f"{c.base}/a/manifest/3")
    fs.create(p, True).close()
    assert c.count("a") == 2


def test_the_slower_of_two_writers_starts_again(spark, c, monkeypatch):
    c.insert("a", rows(spark, (1, 1, "x", 5, 1.0, 0)), "1")
    commit, late = Collections._commit, []

    def raced(self, name, manifest):
        if not late:
            late.append(1)
            monkeypatch.setattr(Collections, "_commit", commit)
            assert self.insert("a", rows(spark, (1, 7, "first", 5, 5.0, 0)), "other") == 1
        return commit(self, name, manifest)

    monkeypatch.setattr(Collections, "_commit", raced)
    assert c.insert("a", rows(spark, (1, 2, "slow", 5, 4.0, 0), (2, 2, "slow", 5, 4.0, 0)), "2") == 1
    assert content(c) == [(1, 7.0, "first", 5, 5.0, 0), (2, 2.0, "slow", 5, 4.0, 0)]


def test_compaction_changes_nothing(spark, c, monkeypatch):
    from nearlight.sources import collections

    monkeypatch.setattr(collections, "FOLDERS", 5)
    rng, stored = random.Random(1), {}
    for b in range(9):
        batch = [(rng.randint(0, 12), rng.randint(0, 99), f"p{b}", rng.choice([None, 1, 2]), rng.choice([None, 1.0, 2.0, 3.0, 4.0]), rng.choice([None, 0, 1])) for _ in range(6)]
        taken = 0
        for i, x, p, cl, ts, node in batch:
            if i not in stored or (ts or 0.0, node or 0) > (stored[i][4] or 0.0, stored[i][5] or 0):
                stored[i] = (i, float(x), p, cl, ts, node)
                taken += 1
        assert c.insert("a", rows(spark, *batch), str(b), order="seq") == taken
        if b == 4:
            gone = rng.sample(sorted(stored), 2)
            c.delete("a", spark.createDataFrame([(i,) for i in gone], "id long"), "gone")
            for i in gone:
                del stored[i]
        assert content(c) == sorted(stored.values(), key=lambda r: r[0])
    c.compact("a")
    assert len(c._manifest("a")["folders"]) == 1 and not c.compact("a")
    assert content(c) == sorted(stored.values(), key=lambda r: r[0])
    assert c.insert("a", rows(spark, *batch), "8", order="seq") == taken  # known, and not applied again

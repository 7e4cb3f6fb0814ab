"""Sharding by Karmarkar-Karp differencing of indivisible groups.

Rows with equal texts form a group that stays in one shard. Differencing starts from single groups:
repeatedly the two partial partitions of largest spread are joined, their sums in opposite order,
until one is left. A partial partition keeps its sums less the least of them, and only those above
it, so that a join of two small ones costs their own entries and not one for each shard.

Differencing needs all its items in one place, so their number is bounded whatever the input: a
group above one ``SHARE``-th of a shard's mean is an item of its own (there are fewer than ``n_shards *
SHARE`` of them), and the others go to ``BUNDLES`` items by a hash of their text. Items' sums, some
70 000 rows at most, come to the driver, which differences them; the large items let no shard be
filled before its small ones are dealt. A group is one row whatever its count, and rows find their
shard by two broadcast tables of that bounded size, so a hot text moves no other row than its own
and no shuffle carries rows. Slots are numbered by task.

Defined cases: a null text has size 16 and crc 0 and groups with the empty text; repeated rows
are rows of one group; null keys stay null; ties go by group hash; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.llm.common import cut, key_column, null_key, scratch, small_batches

N_SHARDS = 40
SHARE = 1_000
BUNDLES = 1 << 15


def difference(partials: list[list[tuple[int, object]]], n: int) -> list[tuple[int, object]]:
    """Join partial partitions until one is left. Each lists ``(sum, members)`` of its parts in
    descending order, those above its least sum only, sums counted from there; members are leaves
    or linked pairs. Returns the last one's parts in the same form."""
    heap = [(-p[0][0], i, p) for i, p in enumerate(partials) if p]
    heapq.heapify(heap)
    serial = len(partials)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= n:  # the largest of one meet nothing of the other
            joined = a + b
        else:
            # Parts a[i] and b[j] meet where i + j = n - 1.
            joined = a[: n - len(b)]
            for i in range(n - len(b), len(a)):
                (x, p), (y, q) = a[i], b[n - 1 - i]
                joined.append((x + y, (p, q)))
            joined += b[: n - len(a)]
        joined.sort(key=lambda e: -e[0])
        if len(joined) == n:
            least = joined[-1][0]
            if least:
                joined = [(s - least, p) for s, p in joined]
            # A part at the least sum still has members: it stays, with nothing above the least.
        heapq.heappush(heap, (-joined[0][0], serial, joined))
        serial += 1
    return heap[0][2] if heap else []


def members(tree) -> list:
    """Leaves of the nested pairs that :func:`difference` builds, without recursion."""
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            out.append(x)
    return out


def split_groups(sizes: list[int], n: int) -> list[int]:
    """The part, from 0 in descending order of sums, that each group goes to."""
    out = [0] * len(sizes)
    for p, (_, tree) in enumerate(difference([[(s, i)] for i, s in enumerate(sizes)], n)):
        for i in members(tree):
            out[i] = p
    return out


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Row facts without the text: key, size, crc and the group's hash."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(
        key_column(key).alias("k"),
        (F.octet_length(t).cast("long") + 16).alias("size"),
        F.crc32(t.cast("binary")).alias("crc"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("g"),
    )


def shard(docs: DataFrame, n_shards: int = N_SHARDS, share: int = SHARE, bundles: int = BUNDLES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, crc, shard, slot)`` for every row of ``docs``."""
    spark = docs.sparkSession
    with scratch(spark):
        small_batches(spark, 10_000)
        bundle = F.pmod(F.xxhash64("g"), F.lit(bundles)).cast("int").alias("bundle")
        rows = cut(groups(docs, key, text), "shard-rows")
        totals = cut(rows.groupBy("g").agg(F.sum("size").alias("total")), "shard-sums")
        limit = (totals.agg(F.sum("total")).first()[0] or 0) // (n_shards * share)
        large = [(r["g"], r["total"]) for r in totals.filter(F.col("total") > limit).collect()]  # fewer than n_shards * share
        small = [(r["bundle"], r["total"]) for r in totals.filter(F.col("total") <= limit).groupBy(bundle).agg(F.sum("total").alias("total")).collect()]
        items = [(t, bytes(g), None) for g, t in large] + [(t, b"", b) for b, t in small]
        items.sort(key=lambda x: (-x[0], x[1], x[2] or 0))
        part = split_groups([x[0] for x in items], n_shards)
        of_group = spark.createDataFrame([(x[1], p) for x, p in zip(items, part) if x[2] is None], "g binary, own int")
        of_bundle = spark.createDataFrame([(x[2], p) for x, p in zip(items, part) if x[2] is not None], "bundle int, common int")
        placed = rows.withColumn("bundle", bundle).join(F.broadcast(of_group), "g", "left").join(F.broadcast(of_bundle), "bundle", "left")
        placed = cut(placed.select("k", "size", "crc", F.coalesce("own", "common").alias("shard")), "shard-placed")
        return cut(null_key(number(placed), key), "shard-result", keep=True)  # tasks are numbered as they read now


def number(placed: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard. Rows are counted by task and shard, the
    driver adds up 8 bytes for each task and shard, and each task numbers its own rows."""
    spark = placed.sparkSession
    tagged = placed.withColumn("task", F.spark_partition_id())
    counts = tagged.groupBy("task", "shard").agg(F.count("*").alias("n")).toPandas()
    n = np.zeros((int(counts["task"].max()) + 1, int(counts["shard"].max()) + 1) if len(counts) else (0, 0), np.int64)
    n[counts["task"], counts["shard"]] = counts["n"]
    base = spark.sparkContext.broadcast(np.cumsum(n, axis=0) - n)

    def slots(batches):
        at = None
        for pdf in batches:
            if len(pdf):
                at = base.value[int(pdf["task"].iloc[0])].copy() if at is None else at
                shard = pdf["shard"].to_numpy()
                slot = pdf.groupby("shard").cumcount().to_numpy() + at[shard]
                at += np.bincount(shard, minlength=len(at))
                yield pd.DataFrame({"k": pdf["k"], "size": pdf["size"], "crc": pdf["crc"], "shard": shard, "slot": slot})

    return tagged.mapInPandas(slots, "k long, size long, crc long, shard int, slot long")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents, law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Heartbeat suspicion and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearlight.functions import PHI_8, phi
from nearlight.operators.ranking import ranked

SAMPLE = 500
FIRST_MEAN, STD_FLOOR = 3000.0, 100.0


def intervals(beats: DataFrame) -> DataFrame:
    """Adds ``gap`` in milliseconds to ``beats(peer_id, ms)``."""
    return beats.withColumn("gap", F.col("ms") - F.lag("ms").over(Window.partitionBy("peer_id").orderBy("ms")))


def window_stats(beats: DataFrame) -> DataFrame:
    """Mean and population variance of each peer's last ``SAMPLE`` gaps at each beat."""
    w = Window.partitionBy("peer_id").orderBy("ms").rowsBetween(-(SAMPLE - 1), 0)
    g = intervals(beats)
    return g.withColumn("mean", F.coalesce(F.avg("gap").over(w), F.lit(FIRST_MEAN))).withColumn("var", F.coalesce(F.var_pop("gap").over(w), F.lit(0.0)))


def suspicion(beats: DataFrame, now_ms: float) -> DataFrame:
    """``(peer_id, y, available)`` at ``now_ms``; ``available`` is suspicion below 8."""
    last = window_stats(beats).groupBy("peer_id").agg(F.max_by(F.struct("ms", "mean", "var"), "ms").alias("s")).select("peer_id", "s.*")
    y = (F.lit(float(now_ms)) - F.col("ms") - F.col("mean")) / F.greatest(F.sqrt("var"), F.lit(STD_FLOOR))
    return last.withColumn("y", y).withColumn("available", F.col("y") < PHI_8)


def suspicion_value(beats: DataFrame, now_ms: float) -> DataFrame:
    return suspicion(beats, now_ms).withColumn("phi", phi("y"))


def latency(samples: DataFrame, *by: str) -> DataFrame:
    """Mean, median, exclusive p95 and p99 (the maximum where there are too few), deviation.

    Quantiles are picked by rank, so a group may hold any share of the rows; null ``ms`` do not count."""
    good = samples.select(*by, "ms").filter("ms is not null")
    # Equal values are counted first, so a very common one is one row.
    r = ranked(good.groupBy(*by, "ms").agg(F.count("*").alias("c")), list(by), ["ms"], "c")

    def place(p: float) -> Column:
        return F.greatest(F.lit(1), F.least(F.floor((F.col("total") + 1) * p), F.col("total") - 1))

    def at(where: Column) -> Column:
        return F.max(F.when((F.col("rank") >= where) & (F.col("rank") - F.col("c") < where), F.col("ms")))

    picks = [at(place(p) + i).alias(f"v{i}_{q}") for q, p in (("p95", 0.95), ("p99", 0.99)) for i in (0, 1)]
    middle = [at(F.floor((F.col("total") + i) / 2)).alias(f"m{i}") for i in (1, 2)]
    sums = good.groupBy(*by).agg(F.avg("ms").alias("mean"), F.stddev_samp("ms").alias("std"), F.max("ms").alias("most"))
    a = r.groupBy(*by).agg(F.max("total").alias("n"), *middle, *picks).withColumn("median", (F.col("m1") + F.col("m2")) / 2)
    same = F.lit(True)
    for c in by:
        same &= a[c].eqNullSafe(sums[c])
    a = a.join(sums, same).select(a["*"], "mean", "std", "most")

    def quantile(q: str, p: float, fewest: int) -> Column:
        n = F.col("n")
        part = (n + 1) * p - F.greatest(F.lit(1), F.least(F.floor((n + 1) * p), n - 1))
        return F.when(n < fewest, F.col("most")).otherwise(F.col(f"v0_{q}") + part * (F.col(f"v1_{q}") - F.col(f"v0_{q}"))).alias(q)

    return a.select(*by, "n", "mean", "median", "std", quantile("p95", 0.95, 20), quantile("p99", 0.99, 100))


def error_share(samples: DataFrame, *by: str) -> DataFrame:
    """Operations of ``samples(..., ok)``, failed ones among them, their share in percent."""
    failed = F.count_if(~F.coalesce("ok", F.lit(False)))
    return samples.groupBy(*by).agg(F.count("*").alias("n"), failed.alias("errors"), (100 * failed / F.count("*")).alias("percent"))


def tail_ratio(summary: DataFrame) -> DataFrame:
    """How far the slowest hundredth lies from the middle: p99 over the median, null where that is 0."""
    return summary.withColumn("tail", F.when(F.col("median") != 0, F.col("p99") / F.col("median")))


def first_contact(joined: DataFrame, now_ms: float) -> DataFrame:
    """A peer that answers when it joins has had its first beat: ``(peer_id, ms)``."""
    return joined.filter("answered").select("peer_id", F.lit(float(now_ms)).alias("ms"))


def jittered(seed: int, every: float = 3.0, by: float = 0.5, least: float = 0.1) -> Column:
    """Seconds to the next beat."""
    return F.greatest(F.lit(least), every + (2 * F.rand(seed) - 1) * by)


def server_report(samples: DataFrame) -> DataFrame:
    """Average by server against the global one: OK to 10 %, WARN to 30 %, else SLOW."""
    s = samples.groupBy("server").agg(F.count("*").alias("n"), F.avg("ms").alias("mean"))
    g = samples.agg(F.avg("ms").alias("overall"))
    diff = (F.col("mean") - F.col("overall")) / F.col("overall") * 100
    status = F.when(diff <= 10, "OK").when(diff <= 30, "WARN").otherwise("SLOW")
    return s.join(F.broadcast(g)).select("server", "n", "mean", diff.alias("diff"), status.alias("status"))


def throughput(samples: DataFrame, by: str) -> DataFrame:
    return samples.groupBy(by).agg((F.count("*") / ((F.max("end_ms") - F.min("end_ms")) / 1000.0)).alias("ops"))


def after_resets(beats: DataFrame) -> DataFrame:
    """``(peer_id, ms, epoch, gap)`` of ``beats(peer_id, ms, reset)``: a reset begins a new history, so the
    beat itself has no gap."""
    w = Window.partitionBy("peer_id").orderBy("ms")
    e = beats.withColumn("epoch", F.sum(F.col("reset").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.when(~F.col("reset"), F.col("ms") - F.lag("ms").over(w))
    return e.select("peer_id", "ms", "epoch", gap.alias("gap"))


def extremes(samples: DataFrame) -> DataFrame:
    """Fastest and slowest server by mean, how much slower in percent, and what to say about it:
    ``warning`` over 50, ``notice`` over 20, else ``balanced``; ties to the least server."""
    s = samples.groupBy("server").agg(F.avg("ms").alias("mean"))
    a = s.agg(
        F.min_by("server", F.struct("mean", "server")).alias("fastest"), F.max_by("server", F.struct("mean", -F.col("server"))).alias("slowest"),
        F.min("mean").alias("lo"), F.max("mean").alias("hi"),
    ).withColumn("diff", (F.col("hi") - F.col("lo")) / F.col("lo") * 100)
    level = F.when(F.col("diff") > 50, "warning").when(F.col("diff") > 20, "notice").otherwise("balanced")
    return a.select("fastest", "slowest", "diff", level.alias("level"))

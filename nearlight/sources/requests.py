"""Requests, answers and reports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_HITS = 100


def inserts(requests: DataFrame, body: str = "body") -> DataFrame:
    """``(request, status, ord, vec, payload)`` of ``{"vectors": [[vec, text], ...]}`` bodies: a row for each
    vector with status 200, one row with 400 where there are none or the body is no such JSON."""
    pairs = F.from_json(body, "vectors array<array<string>>")["vectors"]
    rows = requests.select("request", pairs.alias("pairs"))
    good = F.coalesce(F.size("pairs") > 0, F.lit(False)) & F.coalesce(F.forall("pairs", lambda p: F.size(p) == 2), F.lit(False))
    each = rows.filter(good).select("request", F.lit(200).alias("status"), F.posexplode("pairs").alias("ord", "p"))
    each = each.select("request", "status", F.col("ord").cast("long").alias("ord"), F.from_json(F.col("p")[0], "array<double>").alias("vec"), F.col("p")[1].alias("payload"))
    none = rows.filter(~good).select(
        "request", F.lit(400).alias("status"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("array<double>").alias("vec"), F.lit(None).cast("string").alias("payload")
    )
    return each.unionByName(none)


def clamped(k: Column) -> Column:
    """What a caller asked for, between 1 and ``MOST_HITS``."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_HITS), k))


def answers(hits: DataFrame, top_k: int = MOST_HITS) -> DataFrame:
    """``(qid, answer)`` of ``hits(qid, rank, id, score, vec, payload)``: each query's hits in rank order as
    ``{"results": [{"vector", "id", "payload", "distance"}, ...]}``; distance is the similarity."""
    hit = F.struct("rank", F.struct(F.col("vec").alias("vector"), "id", "payload", F.col("score").alias("distance")).alias("hit"))
    few = hits.filter(F.col("rank") <= clamped(F.lit(top_k)))
    got = few.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(hit)), lambda h: h["hit"]).alias("results"))
    return got.select("qid", F.to_json(F.struct("results")).alias("answer"))


def server_of(peer: Column) -> tuple[Column, Column]:
    """Host and port of ``host:port`` or a URL; a port that is no number is 6334."""
    bare = F.regexp_replace(peer, "^[a-zA-Z]+://", "")
    return F.split(bare, ":")[0], F.coalesce(F.element_at(F.split(bare, ":"), -1).try_cast("int"), F.lit(6334))


def escaped(text: Column) -> Column:
    """Text for a page."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def write_report(summary: DataFrame, path: str, scenario: str = "scenario") -> None:
    """A report as JSON lines, sanity checks left out."""
    summary.filter(F.col(scenario) != "sanity_check").coalesce(1).write.mode("overwrite").json(path)

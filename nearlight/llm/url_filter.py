"""URL filters: longest-rule lists, and gradient-boosted trees on lexical features for the rest.

Native throughout: features, statistics, training and scoring are DataFrame and SQL functions.
Labelled URLs are those that a rule judges (or any table with a label). Training is
histogram boosting: features are small integers, equal labelled feature vectors are first
summed, and each level of each tree is one aggregate of gradients and curvatures by node,
feature and bin (at most ``2**depth * features * BINS`` rows come to the driver, whatever the
input). Every labelled URL takes part; there is no sample.

The suffix statistic is a blocked share, drawn to the overall one, that a row never has a part in:
hosts fall into ``FOLDS`` folds, and a labelled row reads the statistic of the other folds. Suffixes with
few labels have the overall share. A split must gain more than chance would give it (``GAIN``, of a
chi-squared test over all candidate splits), so that without lexical evidence the model keeps
to the overall share and allows; :func:`held_out` measures it on hosts that it has not seen.

Defined cases: a null URL or one without ``://`` has empty host and path and meets no rule with
a path; it is judged by the model on the features of the empty text. Repeated rows get equal
verdicts. Without labelled rows the model allows. Other columns are carried and never read; those
named like one of the operator's own (``host path rule score verdict``) give way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.llm.common import cut, scratch

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BINS = 32
TREES, DEPTH, RATE, RIDGE, MIN_CURVATURE = 6, 3, 0.4, 1.0, 2.0
GAIN = 20.0  # of a split, about a chi-squared of one degree: passed by chance in 1 of 10**5
FOLDS, PULL, FEWEST, HOST = 4, 10, 30, 4
OWN = ("host", "path", "rule", "score", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path`` and ``tail`` (what follows the path) to ``pages``, whose other columns have
    none of these names."""
    u = f"coalesce(`{url}`, '')"
    rest = f"if(instr({u}, '://') > 0, substr({u}, instr({u}, '://') + 3), '')"
    out = pages.withColumn("rest", F.expr(rest))
    out = out.withColumn("raw", F.expr("regexp_extract(rest, '^[^/?#]*', 0)"))
    out = out.withColumn("after", F.expr("substr(rest, length(raw) + 1)"))
    out = out.withColumn("host", F.expr(f"translate(raw, '{UPPER}', '{LOWER}')"))
    out = out.withColumn("path", F.expr("regexp_extract(after, '^[^?#]*', 0)"))
    return out.withColumn("tail", F.expr("substr(after, length(path) + 1)")).drop("rest", "raw", "after")


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` by the longest rule that fits, null where none does."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = {_q(h)} or endswith(host, {_q('.' + h)})) and startswith(path, {_q(p)})" for _, h, p in order]
    name = "case " + " ".join(f"when {c} then {_q(h + p)}" for c, (_, h, p) in zip(fits, order)) + " end" if order else "cast(null as string)"
    said = "case rule " + " ".join(f"when {_q(h + p)} then {_q(v)}" for v, h, p in order) + " end" if order else "cast(null as string)"
    return pages.withColumn("rule", F.expr(name)).withColumn("rule_verdict", F.expr(said))


def _bin(x: str) -> str:
    return f"cast(greatest(0, least({BINS - 1}, coalesce({x}, 0))) as int)"


def features(url: str = "url") -> dict[str, str]:
    """SQL of each lexical feature as a small integer; needs ``host``, ``path`` and ``tail``."""
    u = f"coalesce(`{url}`, '')"
    count = lambda col, chars: f"(length({col}) - length(translate({col}, {_q(chars)}, '')))"
    entropy = (
        f"transform(array({u}), u -> aggregate(array_distinct(split(u, '')), 0D, (a, c) -> a - "
        f"if(c = '', 0D, ((length(u) - length(replace(u, c, ''))) / length(u)) * ln((length(u) - length(replace(u, c, ''))) / length(u)))))[0]"
    )
    return {
        "f_length": _bin(f"length({u}) div 6"),
        "f_host": _bin("length(host) div 2"),
        "f_depth": _bin(count("path", "/")),
        "f_labels": _bin(count("host", ".")),
        "f_path": _bin("length(path) div 3"),
        "f_digits": _bin(f"{BINS} * {count(u, '0123456789')} div greatest(1, length({u}))"),
        "f_entropy": _bin(f"cast(floor(6 * ({entropy})) as int)"),
        "f_params": _bin(count("tail", "=&")),
        "f_tail": _bin("length(tail) div 4"),
        "f_hyphens": _bin(count(u, "-_%~")),
        "f_suffix": _bin("suffix_bin"),
    }


SUFFIX = "substring_index(host, '.', -1)"
FOLD = f"cast(pmod(xxhash64(host), {FOLDS}) as int)"


def suffix_stats(labelled: DataFrame) -> DataFrame:
    """``(suffix, bins, rest)`` for suffixes with ``FEWEST`` labels and more: the blocked share as a
    bin, for each fold without its own rows, and last over all."""
    cells = labelled.groupBy(F.expr(SUFFIX).alias("suffix"), F.expr(FOLD).alias("fold")).agg(F.sum("y").alias("b"), F.count("*").alias("n"))
    whole = cells.agg(F.expr("(sum(b) + 1) / (sum(n) + 2)").alias("prior"))
    outer = [f"sum(if(fold <> {f}, {c}, 0))" for f in range(FOLDS) for c in "bn"] + ["sum(b)", "sum(n)"]
    per = cells.groupBy("suffix").agg(*[F.expr(e).alias(f"s{i}") for i, e in enumerate(outer)]).filter(f"s{2 * FOLDS + 1} >= {FEWEST}")
    share = ", ".join(f"cast(floor({BINS} * (s{2 * i} + {PULL} * prior) / (s{2 * i + 1} + {PULL})) as int)" for i in range(FOLDS + 1))
    return per.join(F.broadcast(whole)).select("suffix", F.expr(f"array({share})").alias("bins"))  # one row is broadcast


def overall_bin(labelled: DataFrame) -> int:
    r = labelled.agg(F.expr(f"cast(floor({BINS} * (sum(y) + 1) / (count(*) + 2)) as int)").alias("x")).first()
    return r["x"] or 0


def with_features(pages: DataFrame, stats: DataFrame, rest: int, url: str = "url") -> DataFrame:
    """Adds the feature columns; rows with a label ``y`` read the statistic of the other folds."""
    out = pages.withColumn("suffix", F.expr(SUFFIX)).join(stats, "suffix", "left")
    out = out.withColumn("suffix_bin", F.expr(f"coalesce(bins[if(y is null, {FOLDS}, {FOLD})], {rest})"))
    return out.selectExpr("*", *[f"{e} as {n}" for n, e in features(url).items()])


class Trees:
    """Additive trees of nested ``(feature, bin, low, high)`` tuples over leaf weights."""

    def __init__(self, base: float = -1e-9):
        self.base, self.trees = base, []

    def _sql(self, t) -> str:
        if not isinstance(t, tuple):
            return f"{t!r}D"
        f, b, lo, hi = t
        return f"if({f} <= {b}, {self._sql(lo)}, {self._sql(hi)})"

    def score(self) -> str:
        return " + ".join([f"{self.base!r}D", *[self._sql(t) for t in self.trees]])


def fit(labelled: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, gain_least: float = GAIN) -> Trees:
    """Boost logistic trees on ``labelled`` (feature columns, weight ``w`` and ``y`` 0 or 1)."""
    cells = cut(labelled.groupBy(*names).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s")), "url-cells")
    tot = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not tot["n"]:
        return Trees()
    p = (tot["s"] + 0.5) / (tot["n"] + 1)
    model = Trees(round(math.log(p / (1 - p)), 9))
    pairs = "array(" + ", ".join(f"named_struct('f', {i}, 'b', {n})" for i, n in enumerate(names)) + ")"
    for _ in range(trees):
        # Nodes are numbered as in a heap; paths[node] are its conditions.
        scored = cells.withColumn("p", F.expr(f"1D / (1D + exp(-({model.score()})))"))
        scored = scored.selectExpr("*", "n * p - s as g", "n * p * (1D - p) as h")
        splits: dict[int, tuple[int, int]] = {}
        weight: dict[int, float] = {}
        open_nodes = {1: "true"}
        for level in range(depth + 1):
            if not open_nodes:
                break
            node = "case " + " ".join(f"when {c} then {k}" for k, c in open_nodes.items()) + " end"
            hist = scored.selectExpr(f"{node} as node", "g", "h", f"inline({pairs})").filter("node is not null")
            rows = hist.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            table: dict[int, dict[int, list]] = {}
            for r in sorted(rows, key=lambda r: (r["node"], r["f"], r["b"])):
                table.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["b"], r["g"], r["h"]))
            following = {}
            for k, by in sorted(table.items()):
                g = sum(x[1] for x in by[0])
                h = sum(x[2] for x in by[0])
                weight[k] = round(-rate * g / (h + RIDGE), 9)
                best = (gain_least, None)
                for f, hist_f in by.items() if level < depth else ():
                    gl = hl = 0.0
                    for b, x, y in hist_f[:-1]:
                        gl, hl = gl + x, hl + y
                        if min(hl, h - hl) < MIN_CURVATURE:
                            continue
                        gain = round(gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE), 6)
                        if gain > best[0]:
                            best = (gain, (f, b))
                if best[1]:
                    splits[k] = best[1]
                    f, b = best[1]
                    following[2 * k] = f"({open_nodes[k]}) and {names[f]} <= {b}"
                    following[2 * k + 1] = f"({open_nodes[k]}) and {names[f]} > {b}"
            open_nodes = following

        def build(k):
            return (names[splits[k][0]], splits[k][1], build(2 * k), build(2 * k + 1)) if k in splits else weight.get(k, 0.0)

        model.trees.append(build(1))
    return model


def prepared(pages: DataFrame, rules, url: str, label: str | None) -> DataFrame:
    """``(row, u, host, path, tail, rule, rule_verdict, y)``, the page's own columns apart in ``row``.
    ``y`` is 1 where ``label`` (or, without one, a rule) blocks, 0 where it allows, else null."""
    given = F.col(f"`{label}`").cast("int") if label else F.lit(None).cast("int")
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{url}`").cast("string").alias("u"), given.alias("given"))
    said = "given" if label else "cast(rule_verdict = 'block' as int)"
    return ruled(parsed(base, "u"), rules).withColumn("y", F.expr(said))


def trained(rows: DataFrame) -> tuple[Trees, DataFrame, int]:
    """The model of labelled ``rows``, and the suffix statistics that it reads."""
    labelled = cut(rows.filter("y is not null").select("u", "host", "path", "tail", "y"), "url-labelled")
    stats, rest = cut(suffix_stats(labelled), "url-suffix"), overall_bin(labelled)
    names = list(features("u"))
    rows = cut(with_features(labelled, stats, rest, "u").select("host", *names, "y"), "url-features")
    # Pages of one host are alike, not so many witnesses: all of them together weigh HOST at most.
    weight = rows.groupBy("host").agg(F.expr(f"least(1D, {HOST}D / count(*))").alias("w"))
    return fit(rows.join(weight, "host"), names), stats, rest


def judge(pages: DataFrame, rules=RULES, url: str = "url", label: str | None = None) -> DataFrame:
    """Adds host, path, rule, score and verdict to ``pages``; labels are the column ``label`` or, without
    one, the rules' verdicts."""
    with scratch(pages.sparkSession):
        rows = prepared(pages, rules, url, label)
        model, stats, rest = trained(rows)
        stats = spark_rows(stats)
    out = with_features(rows.withColumn("y", F.lit(None).cast("int")), stats, rest, "u").withColumn("score", F.expr(model.score()))
    out = out.withColumn("verdict", F.expr("coalesce(rule_verdict, if(score > 0, 'block', 'allow'))"))
    return out.select(*[F.col(f"row.`{c}`") for c in pages.columns if c not in OWN], *OWN)


def spark_rows(stats: DataFrame) -> DataFrame:
    """The suffixes' statistics as a table that outlives the temporary ones: a row for each suffix of
    ``FEWEST`` labels and more."""
    return cut(stats, "url-statistics", keep=True)


def held_out(pages: DataFrame, rules=RULES, url: str = "url", label: str | None = None) -> DataFrame:
    """``(n, blocked, right, base)``: labelled pages of the first fold's hosts, how many are blocked, the
    share that a model of the other folds judges right, and the share that the commoner verdict would."""
    with scratch(pages.sparkSession):
        rows = prepared(pages, rules, url, label).filter("y is not null")
        model, stats, rest = trained(rows.filter(f"{FOLD} <> 0"))
        test = with_features(rows.filter(f"{FOLD} = 0"), stats, rest, "u")
        right = F.expr(f"avg(cast((({model.score()}) > 0) = (y = 1) as int))").alias("right")
        out = test.agg(F.count("*").alias("n"), F.sum("y").alias("blocked"), right, F.expr("greatest(avg(y), 1 - avg(y))").alias("base"))
        return cut(out, "url-held-out", keep=True)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))

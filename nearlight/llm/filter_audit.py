"""Audit of quality filters that interact, by inclusion and exclusion.

Every document gets one failure flag for each filter. Joint failures are counted for each of the
32 sets of filters as sums of products of flags, for each part of the corpus; everything else is
algebra on these 32 numbers. Their Möbius inversion gives the documents that no filter of a set
fails (what any prefix of any order keeps), those that one filter alone fails, and what an order
makes redundant. The number of documents that a set of filters removes is a game whose Harsanyi
dividends are the joint counts with alternating signs, so a filter's Shapley value is the sum
of its sets' dividends, each divided by the set's size. No order is ever replayed on documents.

Copies are found by SHA-256 of the text. Counts are combined before every shuffle: a hot source, a
hot text or repeated rows cost a row for each task. Labels are one row for each document.

Defined cases: a null text is empty; a null source is the part ``''``; a copy is a text that also
stands under a smaller ``doc_id``, so rows of the least one, rows that repeat it and rows without an
id are no copies, and rows without an id have no label. Contradicting labels of one document count if
any of them says so. An empty table gives no parts. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
N_ORDERS = 120
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_flags(text: Column) -> Column:
    """Bits of the filters A to D for a text that is not null."""
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    rest = F.struct(
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("caps"), F.length(text).cast("long").alias("chars"), text.rlike("[#$%&*|]").alias("signs"), sizes.alias("w")
    )

    def bits(m: Column) -> Column:
        tests = [m.w.n < 200, 100 * m.w.d < 50 * m.w.n, 100 * m.caps > 2 * m.chars, m.signs]
        return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))

    return F.transform(F.array(rest), bits)[0]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, bits, n, good, toxic)``: documents by part, failed filters and labels, combined."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sum"), text_flags(text).alias("bits"),
    )
    rows = rows.groupBy("id", "part", "sum", "bits").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # rows without an id meet no label, so they may go anywhere
    salt = F.when(F.col("id").isNull(), F.hash("sum") % 1009).otherwise(F.lit(0))
    rows = rows.withColumn("salt", salt).join(
        marks.withColumn("label_salt", F.lit(0)), (F.col("id") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")), "left"
    )
    rows = rows.select("id", "part", "sum", "bits", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # one row for each id now: the least id's count can be taken along with it
    has = F.col("id").isNotNull()
    groups = rows.groupBy("sum", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(has, F.lit(0)).otherwise(F.col("n"))).alias("bare"), F.min(F.when(has, F.struct("id", "n"))).alias("first")
    )
    least = groups.groupBy("sum").agg(F.min("first.id").alias("least"), F.sum("n").alias("all")).filter("all > 1")
    groups = groups.join(least.select(F.col("sum").alias("of"), "least"), F.col("sum") == F.col("of"), "left")
    firsts = F.when(F.col("of").isNull(), F.col("n")).otherwise(F.col("bare") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0))
    both = F.array(
        F.struct(F.col("bits"), firsts.alias("n")), F.struct((F.col("bits") + (1 << 4)).alias("bits"), (F.col("n") - firsts).alias("n"))
    )
    return groups.select("part", "good", "toxic", F.inline(both)).filter("n > 0").groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n"))


def joint_counts(fails: DataFrame) -> DataFrame:
    """``(part, n, good, toxic)``: arrays of joint failures, of all and of labelled documents, by set of filters."""
    flag = [F.expr(f"(bits >> {i}) & 1") for i in range(len(FILTERS))]

    def joint(weight: Column) -> Column:
        sums = []
        for s in SETS:
            product = F.col("n") * weight
            for i in range(len(FILTERS)):
                if s >> i & 1:
                    product = product * flag[i]
            sums.append(F.sum(product))
        return F.array(*sums)

    return fails.groupBy("part").agg(joint(F.lit(1)).alias("n"), joint(F.col("good")).alias("good"), joint(F.col("toxic")).alias("toxic"))


def _signed(joint: str, sets: dict[int, int]) -> str:
    return " + ".join(f"({c}) * {joint}[{s}]" for s, c in sets.items())


def _within(s: int):
    return [t for t in SETS if t & s == t]


def inverted(joint: DataFrame) -> DataFrame:
    """Möbius inversion: survivors by set of filters, and for each filter its failures, those that it
    alone fails, and its Shapley value times the number of orders."""

    def survivors(name: str) -> Column:
        return F.expr("array(" + ", ".join(_signed(name, {t: (-1) ** t.bit_count() for t in _within(s)}) for s in SETS) + ")")

    full = len(SETS) - 1
    alone, shapley = [], []
    for i in range(len(FILTERS)):
        alone.append(_signed("n", {t | 1 << i: (-1) ** t.bit_count() for t in _within(full ^ 1 << i)}))
        shapley.append(_signed("n", {t: (-1) ** (t.bit_count() + 1) * N_ORDERS // t.bit_count() for t in SETS if t >> i & 1}))
    return joint.select(
        "part", survivors("n").alias("left_n"), survivors("good").alias("left_good"), survivors("toxic").alias("left_toxic"),
        F.expr("array(" + ", ".join(f"n[{1 << i}]" for i in range(len(FILTERS))) + ")").alias("fails"),
        F.expr(f"array({', '.join(alone)})").alias("alone"), F.expr(f"array({', '.join(shapley)})").alias("values"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, done = "".join(FILTERS[i] for i in order), 0
        for k, i in enumerate(order):
            steps.append(f"struct('{name}', {k + 1}, {i}, {done}, {done | 1 << i})")
            done |= 1 << i
    rows = inverted(joint_counts(failures(docs, labels))).withColumn("s", F.explode(F.expr(f"array({', '.join(steps)})")))
    rows = rows.select("*", F.col("s.col1").alias("filter_order"), F.col("s.col2").alias("step"), F.col("s.col3").alias("f"), F.col("s.col4").alias("before"), F.col("s.col5").alias("after"))
    lost = "left_{0}[before] - left_{0}[after]"
    return rows.select(
        "part", "filter_order", "step", F.expr("left_n[after]").alias("kept"), F.expr(lost.format("n")).alias("removed"),
        F.expr(f"fails[f] - ({lost.format('n')})").alias("redundant"), F.expr("alone[f]").alias("unique_fails"),
        F.expr(lost.format("good")).alias("good_lost"), F.expr(lost.format("toxic")).alias("toxic_lost"), F.expr("values[f]").alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every order and step for every source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Replays every order on the documents' flags.
ORACLE = r"""
with recursive t as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
), w as (
  select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         coalesce(min(doc_id) over (partition by t) < doc_id, false) as e
  from t
), l as (
  select doc_id, max(coalesce((quality = 1)::int, 0)) as good, max(coalesce((toxic = 1)::int, 0)) as toxic from labels group by doc_id
), f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
          'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': e} as x
  from w left join l using (doc_id)
), m as (
  select part, good, toxic, (case when x.A then 'A' else '' end) || (case when x.B then 'B' else '' end) || (case when x.C then 'C' else '' end)
         || (case when x.D then 'D' else '' end) || (case when x.E then 'E' else '' end) as failed, count(*) as n
  from f group by all
), p as (
  select '' as filter_order
  union all
  select filter_order || c from p, (select unnest(['A', 'B', 'C', 'D', 'E']) as c) where not contains(filter_order, c)
), s as (
  select filter_order, unnest(range(1, 6)) as step from p where length(filter_order) = 5
), d as (
  select part, good, toxic, failed, n, filter_order, step, substr(filter_order, step::bigint, 1) as c,
         contains(failed, substr(filter_order, step::bigint, 1)) as hit, translate(substr(filter_order, 1, step::bigint - 1), failed, '') <> substr(filter_order, 1, step::bigint - 1) as gone
  from m, s
), r as (
  select part, filter_order, step::int as step, any_value(c) as c,
         coalesce(sum(n) filter (not hit and not gone), 0)::bigint as kept, coalesce(sum(n) filter (hit and not gone), 0)::bigint as removed,
         coalesce(sum(n) filter (hit and gone), 0)::bigint as redundant, coalesce(sum(n) filter (failed = c), 0)::bigint as unique_fails,
         coalesce(sum(n) filter (hit and not gone and good = 1), 0)::bigint as good_lost,
         coalesce(sum(n) filter (hit and not gone and toxic = 1), 0)::bigint as toxic_lost
  from d group by part, filter_order, step
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, c))::bigint as shapley
from r
"""

"""Quality rules as a bitmask ledger (native: DataFrame and SQL functions only).

Every rule is evaluated once for each document. The ledger keeps the measurements and one
failure bit for each rule; a policy is a versioned mask over those bits, so that changing a
policy, comparing two of them or asking what one rule costs never reads a text again.

Defined cases: a null text has no words, no lines and no symbols and fails ``few_words``; an
empty text likewise. Repeated rows are judged alone, each on its own. Extra columns are
carried by :func:`ledger` when asked for and never read; its own column names are taken from a
struct, so clashing names cannot shadow them. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "[\\\\x20\\\\x09-\\\\x0D]"
SYMBOLS = "#*$%&|<>"

#: Bit, rule and failing condition over the measurements. All arithmetic is on integers.
RULES = [
    ("few_words", "m.n_words < 50"),
    ("repeated_words", "100 * m.n_repeat_words > 50 * m.n_words"),
    ("repeated_lines", "m.n_lines >= 4 and 100 * m.n_dup_lines > 50 * m.n_lines"),
    ("symbols", "100 * m.n_symbols > 5 * m.word_chars"),
    ("short_words", "m.word_chars < 2 * m.n_words"),
    ("long_words", "m.word_chars > 25 * m.n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "strict-1": tuple(BITS),
    "prod-1": tuple(BITS),
}


def policy_mask(policy: str) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def _let(value: str, var: str, body: str) -> str:
    """``body`` with ``var`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {var} -> {body})[0]"


def _covered(runs: str) -> str:
    """Words covered by 3-word windows that begin at the ascending positions ``runs``."""
    return _let(
        runs, "q",
        "aggregate(transform(q, (x, i) -> if(i + 1 < size(q), least(3L, q[i + 1] - x), 3L)), 0L, (a, x) -> a + x)",
    )


def _repeat_words(words: str) -> str:
    """Count of words in 3-word windows that occur twice or more.

    Windows are hashed; hash and position share a long, and one primitive sort brings equal
    windows together. Neighbours are compared by their words. If two different windows share
    the 40 kept bits, the text goes the plain way, a sort of the words themselves.
    """
    same = (
        f"{words}[cast({{a}} & 16777215L as int)] = {words}[cast({{b}} & 16777215L as int)]"
        f" and {words}[cast({{a}} & 16777215L as int) + 1] = {words}[cast({{b}} & 16777215L as int) + 1]"
        f" and {words}[cast({{a}} & 16777215L as int) + 2] = {words}[cast({{b}} & 16777215L as int) + 2]"
    )
    near = "shiftright({a}, 24) = shiftright({b}, 24)"
    prev, nxt = {"a": "x", "b": "s[i - 1]"}, {"a": "x", "b": "s[i + 1]"}
    clash = (
        f"exists(sequence(1, size(s) - 1), i -> {near.format(a='s[i]', b='s[i - 1]')} and not ({same.format(a='s[i]', b='s[i - 1]')}))"
    )
    hits = (
        f"filter(s, (x, i) -> (i > 0 and {near.format(**prev)} and {same.format(**prev)})"
        f" or (i + 1 < size(s) and {near.format(**nxt)} and {same.format(**nxt)}))"
    )
    fast = _covered(f"array_sort(transform({hits}, x -> x & 16777215L))").replace("array_sort", "sort_array")
    grams = f"transform(sequence(0, size({words}) - 3), i -> struct({words}[i] as a, {words}[i + 1] as b, {words}[i + 2] as c, cast(i as bigint) as p))"
    eq = "{x}.a = {y}.a and {x}.b = {y}.b and {x}.c = {y}.c"
    slow = _let(
        f"sort_array({grams})", "g",
        _covered(
            f"sort_array(transform(filter(g, (x, i) -> (i > 0 and {eq.format(x='x', y='g[i - 1]')})"
            f" or (i + 1 < size(g) and {eq.format(x='x', y='g[i + 1]')})), x -> x.p))"
        ),
    )
    return (
        f"case when size({words}) < 4 then 0L else "
        + _let(
            f"transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))", "h",
            "case when size(array_distinct(h)) = size(h) then 0L else "
            + _let(
                "sort_array(transform(h, (x, i) -> (x & -16777216L) | cast(i as bigint)))", "s",
                f"case when size({words}) >= 16777216 or {clash} then {slow} else {fast} end",
            )
            + " end",
        )
        + " end"
    )


def measure_sql(text: str) -> str:
    """SQL of the struct of measurements of the column ``text``."""
    blanks = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    chars = f"cast(length(translate(t, {blanks}, '')) as bigint)"
    symbols = f"cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint)"
    lines = "filter(split(t, '\\\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    words = f"filter(split(t, '{SPACE}+', -1), w -> w <> '')"
    return _let(
        f"coalesce(cast({text} as string), '')", "t",
        _let(
            words, "w",
            _let(
                lines, "l",
                f"named_struct('n_words', cast(size(w) as bigint), 'word_chars', {chars}, 'n_symbols', {symbols},"
                f" 'n_lines', cast(size(l) as bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint),"
                f" 'n_repeat_words', {_repeat_words('w')})",
            ),
        ),
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: ``key``, measurements ``m`` and failure bits ``failed``; with
    ``carry`` also the document itself as the struct ``row``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    base = docs.select(F.col(key).alias("k"), F.expr(measure_sql(f"`{text}`")).alias("m"), *row)
    bits = " | ".join(f"if({cond}, {BITS[name]}L, 0L)" for name, cond in RULES)
    return base.select(F.col("k").alias(key), "m", F.expr(bits).alias("failed"), *["row"] * carry)


def judge(rows: DataFrame, policy: str = "prod-1") -> DataFrame:
    """Apply a policy to a ledger: adds ``policy`` and ``kept``."""
    mask = policy_mask(policy)
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", F.expr(f"(failed & {mask}L) = 0"))


def ablation(rows: DataFrame, policy: str = "prod-1") -> DataFrame:
    """For each rule of a policy: documents it fails, and documents that only it rejects.

    One aggregate over the ledger's bits; texts are not read again.
    """
    mask = policy_mask(policy)
    names = POLICIES[policy]
    aggs = []
    for n in names:
        aggs.append(F.sum(F.expr(f"cast((failed & {BITS[n]}L) <> 0 as bigint)")).alias(f"f_{n}"))
        aggs.append(F.sum(F.expr(f"cast((failed & {mask}L) = {BITS[n]}L as bigint)")).alias(f"o_{n}"))
    one = rows.agg(F.count("*").alias("n_docs"), F.sum(F.expr(f"cast((failed & {mask}L) <> 0 as bigint)")).alias("n_rejected"), *aggs)
    stack = ", ".join(f"'{n}', f_{n}, o_{n}" for n in names)
    return one.select("n_docs", "n_rejected", F.expr(f"stack({len(names)}, {stack}) as (rule, n_failed, n_only)"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the contract's columns for every document, with the ledger's bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(ledger(docs))
    return out.select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        F.expr(f"(failed & {policy_mask('base-1')}L) <> 0").alias("base_failed"),
        "kept", F.col("failed").alias("rule_bits"),
    )


ORACLE = r"""
with w as (
  select rowid_ as r, doc_id, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from (select row_number() over () as rowid_, doc_id, coalesce(text, '') as t from documents)
), g as (
  select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
  from (select r, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)
), d as (
  select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from g) where n > 1
), c as (
  select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from d) group by r
), m as (
  select doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines,
         len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
  from w left join c using (r)
), b as (
  select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines then 4 else 0 end)
    + (case when 100 * n_symbols > 5 * word_chars then 8 else 0 end)
    + (case when word_chars < 2 * n_words then 16 else 0 end) + (case when word_chars > 25 * n_words then 32 else 0 end) as bits
  from m
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       (bits & 3) <> 0 as base_failed, bits = 0 as kept, bits::bigint as rule_bits
from b
"""

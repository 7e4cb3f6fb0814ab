"""Language identification by character models with interpolated Kneser-Ney smoothing.

Texts become symbols: lower-case letters, and one space for any run of anything else. Four-grams are
counted over all training texts, by language, and shorter grams by the number of different longer ones that
they end (Kneser and Ney's continuation counts), all as distributed aggregates. Each order is discounted
by its own counts of counts, what a context loses goes to the next shorter order, and the
shortest is interpolated with the uniform distribution.

A gram is a 64-bit word of four 16-bit symbols, and its hash a bijection of it, so hashes cannot
collide. For each language and order the hashes are kept sorted beside their probabilities, and found by
binary search, once for each different gram of a batch. A text belongs to the language of least
cross-entropy a symbol. A part of the training documents is kept out of the counts and calibrates: the share of
right answers by the margin between the two best languages, made monotonous, is the score, and the
cross-entropies of right answers bound what may be accepted (``accepted``).

The model travels to every task while no order holds more than ``GRAMS`` grams over all languages (``MAX_LANGS``
languages at most; more raise). Beyond that :func:`spread` judges by the same, whole model: probabilities are
joined order by order for all grams that the texts hold, the frequent ones travel, and the rest are joined
with the texts that hold them. No gram is left out of a judgement. :func:`train` alone, which returns models that must
travel, leaves rare grams of an order that is too large to the shorter order. All counts are of all documents.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; so is every text where no
language was learned. Documents without id, language or text teach nothing; ``held_out`` is false for
a null id. Ties go to the first language by name. Repeated rows are judged alone and count
each. Long texts are read in pieces that overlap, and count as a whole. Extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.llm.common import cut, mix, scratch, small_batches

ORDER = 4
GRAMS = 1 << 19
MAX_LANGS = 4096
FOLDS = 5
HELD_OUT, CALIBRATION = 0, 1
#: Symbols of one piece; an array of this length takes some 100 bytes a symbol on the way.
PIECE = 1 << 20
#: Margins (nats of the whole text) are told apart by powers of this.
STEP, BINS = 1.25, 64
#: Share of right answers whose cross-entropy is accepted.
ACCEPT = 0.999


@lru_cache(maxsize=1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """By UTF-16 unit: its symbol, and whether it is a letter. Surrogates stand for themselves."""
    table = np.full(1 << 16, ord(" "), np.uint16)
    letter = np.zeros(1 << 16, bool)
    for i in range(1 << 16):
        kind = unicodedata.category(chr(i))
        if kind[0] in "LM" or kind == "Cs":
            low = chr(i).lower()
            table[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
            letter[i] = kind[0] == "L"
    return table, letter


def symbols(text: str) -> tuple[np.ndarray, bool]:
    """Symbols of a text, and whether it holds a letter."""
    table, letter = _symbols()
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    out = table[units]
    blank = out == ord(" ")
    again = blank[1:] & blank[:-1]
    if again.any():
        out = out[np.concatenate([[True], ~again])]
    has = bool(letter[units].any())
    if not has and len(units) and ((units >> 11) == 0x1B).any():
        has = any(c.isalpha() for c in text)
    return out, has


def codes(parts: list[np.ndarray]) -> np.ndarray:
    """The gram that ends at each symbol of some texts; a text begins with ``ORDER - 1`` zeros."""
    lengths = np.array([len(p) for p in parts])
    pad = ORDER - 1
    row = np.zeros(int(lengths.sum()) + pad * len(parts), np.uint64)
    at = np.cumsum(lengths + pad) - lengths
    keep = np.ones(len(row), bool)
    for i, p in zip(at, parts):
        row[i : i + len(p)] = p
        keep[i - pad : i] = False
    out = row.copy()
    for k in range(1, ORDER):
        out[k:] |= row[:-k] << np.uint64(16 * k)
    return out[keep]


def batches_of(texts: list, limit: int = PIECE):
    """Lists of (index of the text, grams, has a letter), about ``limit`` symbols each; pieces of a long text follow one another."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        s, has = symbols(t)
        for a in range(0, max(1, len(s)), limit):
            b = max(0, a - (ORDER - 1))
            grams = codes([s[b : a + limit]])[a - b :]
            held.append((i, grams, has))
            size += len(grams)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def fold(key: str) -> F.Column:
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % FOLDS


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        by: dict[str, list] = {}
        for x, t in zip(langs, texts):
            by.setdefault(x, []).append(t)
        for lang, own in by.items():
            for held in batches_of(own):
                grams, n = np.unique(np.concatenate([g for _, g, _ in held]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)


def counts(docs: DataFrame) -> DataFrame:
    """``(lang, k, gram, n)``: counts of the longest grams, continuation counts of the shorter."""
    rows = docs.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = cut(rows.select("lang", F.lit(ORDER).alias("k"), "gram", "n"), "language-grams")
    out = rows
    for k in range(ORDER - 1, 0, -1):
        rows = rows.groupBy("lang", F.col("gram").bitwiseAND((1 << 16 * k) - 1).alias("gram")).agg(F.count("*").alias("n"))
        rows = cut(rows.select("lang", F.lit(k).alias("k"), "gram", "n"), "language-grams")
        out = out.unionByName(rows)
    return out


class Model:
    """Sorted hash arrays of one language: probabilities of grams, and what contexts leave to the shorter order."""

    def __init__(self, lang: str, discount: list[float], kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_symbols: int):
        """``kept[k]``: grams of k + 1 symbols with their counts and their contexts' counts."""
        self.lang, self.floor = lang, 1 / (n_symbols + 1)
        self.grams, self.probability, self.contexts, self.left = [], [], [], []
        for k, (grams, n, total) in enumerate(kept):
            share = np.maximum(n - discount[k], 0) / total
            context, first = np.unique(grams >> np.uint64(16), return_inverse=True)
            left = 1 - np.bincount(first, share, len(context))
            # the part that the order below gives to the same symbol
            self._store(self.contexts, self.left, context, left)
            lower = self._below(grams, k)
            self._store(self.grams, self.probability, grams, share + left[first] * lower)

    @staticmethod
    def _store(keys: list, values: list, words: np.ndarray, v: np.ndarray) -> None:
        h = mix(words)
        order = np.argsort(h)
        keys.append(h[order])
        values.append(v[order])

    @staticmethod
    def _find(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(words)
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        return at, (keys[at] == h if len(keys) else np.zeros(len(h), bool))

    def _below(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Probability of the last symbol by the ``k`` symbols that end ``grams``."""
        if k == 0:
            return np.full(len(grams), self.floor)
        return self.probabilities(grams & np.uint64((1 << 16 * k) - 1), k)

    def probabilities(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Of the last symbol of each gram of ``k`` symbols, given those before it."""
        at, hit = self._find(self.grams[k - 1], grams)
        out = np.empty(len(grams))
        out[hit] = self.probability[k - 1][at[hit]]
        miss = grams[~hit]
        if len(miss):
            at, seen = self._find(self.contexts[k - 1], miss >> np.uint64(16))
            left = np.ones(len(miss))
            left[seen] = self.left[k - 1][at[seen]]
            out[~hit] = left * self._below(miss, k - 1)
        return out


def known_counts(all_: DataFrame) -> tuple[list[str], dict]:
    """Languages of :func:`counts`, and by language and order its totals, with the ``discount``."""
    facts = all_.groupBy("lang", "k").agg(
        F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.count("*").alias("grams")
    )
    facts = facts.limit(MAX_LANGS * ORDER + 1).toArrow().to_pylist()
    langs = sorted({r["lang"] for r in facts})
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: name a column that holds languages")
    for r in facts:
        r["discount"] = r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] and r["twice"] else 0.5
    return langs, {(r["lang"], r["k"]): r for r in facts}


def large(by: dict) -> set[int]:
    """Orders with more grams than may travel."""
    return {k for k in range(1, ORDER + 1) if sum(r["grams"] for (_, o), r in by.items() if o == k) > GRAMS}


def train(docs: DataFrame) -> list[Model]:
    """Models of ``docs(lang, text)``, by name; orders that are :func:`large` without their rare grams."""
    all_ = counts(docs)
    return models_of(all_, *known_counts(all_))


def models_of(all_: DataFrame, langs: list[str], by: dict) -> list[Model]:
    if not langs:
        return []
    spark, cut_at = all_.sparkSession, large(by)
    least = [(lang, k, -(-r["total"] * len(langs) // GRAMS) if k in cut_at else 1) for (lang, k), r in by.items()]
    least = spark.createDataFrame(least, "of string, o int, least long")
    kept = all_.join(F.broadcast(least), (F.col("lang") == F.col("of")) & (F.col("k") == F.col("o"))).filter("n >= least")
    contexts = all_.groupBy("lang", "k", F.shiftrightunsigned("gram", 16).alias("c")).agg(F.sum("n").alias("total"))
    contexts = contexts.select(F.col("lang").alias("c_lang"), F.col("k").alias("c_k"), "c", "total")
    kept = kept.join(contexts, (F.col("lang") == F.col("c_lang")) & (F.col("k") == F.col("c_k")) & (F.shiftrightunsigned("gram", 16) == F.col("c")))
    kept = kept.select("lang", "k", "gram", "n", "total").toPandas()  # at most ORDER * GRAMS rows
    groups = {key: g for key, g in kept.groupby(["lang", "k"])}
    models = []
    for lang in langs:
        arrays, discount = [], []
        for k in range(1, ORDER + 1):
            g = groups.get((lang, k))
            discount.append(by[lang, k]["discount"])
            if g is None:
                arrays.append((np.zeros(0, np.uint64), np.zeros(0), np.ones(0)))
            else:
                arrays.append((g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy(float), g["total"].to_numpy(float)))
        models.append(Model(lang, discount, arrays, by[lang, 1]["grams"]))
    return models


def entropies(models: list[Model], texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its cross-entropy in nats by model, its symbols, and whether it holds a letter."""
    sums, n, has = np.zeros((len(texts), len(models))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for held in batches_of(texts):
        at = np.array([i for i, _, _ in held])
        sizes = np.array([len(g) for _, g, _ in held])
        np.add.at(n, at, sizes)
        has[at] = [h for _, _, h in held]
        if not sizes.any() or not models:
            continue
        grams, back = np.unique(np.concatenate([g for _, g, _ in held]), return_inverse=True)
        full = np.flatnonzero(sizes)
        starts = np.cumsum(sizes[full]) - sizes[full]
        for m, model in enumerate(models):
            np.add.at(sums[:, m], at[full], np.add.reduceat(-np.log(model.probabilities(grams))[back], starts))
    return sums / np.maximum(n, 1)[:, None], n, has


_JUDGED = "lang_pred string, entropy double, margin double, n_symbols long"


def judged(docs: DataFrame, models: list[Model], text: str = "text") -> DataFrame:
    """``docs`` with the language of least cross-entropy (null without letter), that entropy, the margin of the
    whole text to the second language, and the number of symbols."""
    given = docs.sparkSession.sparkContext.broadcast(models)
    carried = [c for c in docs.columns if c != text]
    fields = [pa.field("lang_pred", pa.string()), pa.field("entropy", pa.float64()), pa.field("margin", pa.float64()), pa.field("n_symbols", pa.int64())]

    def run(batches):
        models = given.value
        names = np.array([m.lang for m in models] + [None], object)
        for batch in batches:
            h, n, has = entropies(models, batch.column(text).to_pylist())
            good = has & (len(models) > 0)
            best = np.argmin(h, axis=1) if models else np.zeros(len(n), int)
            two = np.partition(h, 1, axis=1)[:, :2] if len(models) > 1 else np.zeros((len(n), 2))
            first = h[np.arange(len(n)), best] if models else np.zeros(len(n))
            margin = (two[:, 1] - two[:, 0]) * n
            own = [
                pa.array(names[np.where(good, best, -1)].tolist(), pa.string()), pa.array(first, pa.float64(), mask=~good), pa.array(margin, pa.float64(), mask=~good), pa.array(n)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *own], schema=pa.schema([*(batch.schema.field(c) for c in carried), *fields]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInArrow(run, f"{kinds}, {_JUDGED}")


def _suffix(k: int) -> F.Column:
    return F.col("gram") if k == ORDER else F.col("gram").bitwiseAND((1 << 16 * k) - 1)


def log_probabilities(seen: DataFrame, all_: DataFrame, langs: list[str], by: dict) -> DataFrame:
    """``(gram, l, lp)``: the logarithm of each gram of ``seen(gram)`` in the language numbered ``l``, order by order."""
    spark, below = seen.sparkSession, None
    for k in range(1, ORDER + 1):
        named = [(lang, i, by[lang, k]["discount"], 1 / (by[lang, 1]["grams"] + 1)) for i, lang in enumerate(langs)]
        named = F.broadcast(spark.createDataFrame(named, "lang string, l int, d double, floor double"))
        own = all_.filter(F.col("k") == k).join(named, "lang").select("l", "gram", "n", (F.col("n") - F.col("d")).alias("held"), F.shiftrightunsigned("gram", 16).alias("c"))
        contexts = own.groupBy("l", "c").agg(F.sum("n").alias("total"), F.sum("held").alias("all_held"))
        need = seen.select(_suffix(k).alias("gram")).distinct().crossJoin(named.select("l", "floor"))
        need = need.withColumn("c", F.shiftrightunsigned("gram", 16)).join(own.select("l", "gram", "held"), ["l", "gram"], "left")
        need = need.join(F.broadcast(contexts) if k == 1 else contexts, ["l", "c"], "left")  # the empty context alone
        lower = F.col("floor")
        if below is not None:
            need = need.withColumn("s", F.col("gram").bitwiseAND((1 << 16 * (k - 1)) - 1)).join(below.select("l", F.col("gram").alias("s"), "p"), ["l", "s"])
            lower = F.col("p")
        p = F.coalesce(F.col("held") / F.col("total"), F.lit(0.0)) + F.coalesce(1 - F.col("all_held") / F.col("total"), F.lit(1.0)) * lower
        below = cut(need.select("l", "gram", p.alias("p")), "language-probabilities")
    return below.select("gram", "l", F.log("p").alias("lp"))


def spread(docs: DataFrame, all_: DataFrame, langs: list[str], by: dict, text: str = "text") -> DataFrame:
    """As :func:`judged` by the whole model of ``all_``, whatever its size."""
    spark, m = docs.sparkSession, len(langs)
    seen = docs.filter(F.col(text).isNotNull()).select(F.lit("").alias("lang"), F.col(text).alias("text"))
    seen = cut(seen.mapInArrow(_count, "lang string, gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "language-seen")
    least = -(-(seen.agg(F.sum("n")).first()[0] or 0) * m // GRAMS)
    found = log_probabilities(seen.select("gram"), all_, langs, by).join(seen, "gram")
    top = found.filter(F.col("n") >= least).groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("l", "lp"))).alias("lp"))
    top = top.select("gram", "lp.lp").toArrow()  # at most GRAMS logarithms
    keys, values = top.column("gram").to_numpy().view(np.uint64), np.array(top.column("lp").to_pylist(), float).reshape(-1, m)
    order = np.argsort(keys)
    given = spark.sparkContext.broadcast((keys[order], values[order]))
    carried = [c for c in docs.columns if c != text]
    rest_type = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))
    fields = [pa.field("n_symbols", pa.int64()), pa.field("has", pa.bool_()), pa.field("sums", pa.list_(pa.float64())), pa.field("rest", rest_type)]

    def run(batches):
        keys, values = given.value
        for batch in batches:
            rows = batch.num_rows
            n, has, sums = np.zeros(rows, np.int64), np.zeros(rows, bool), np.zeros((rows, m))
            rest: list[list] = [[] for _ in range(rows)]
            for held in batches_of(batch.column(text).to_pylist()):
                for i, grams, letter in held:
                    n[i] += len(grams)
                    has[i] = letter
                    own, times = np.unique(grams, return_counts=True)
                    at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                    hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                    sums[i] += times[hit] @ values[at[hit]]
                    rest[i] += [{"gram": g, "n": t} for g, t in zip(own[~hit].view(np.int64).tolist(), times[~hit].tolist())]
            own = [pa.array(n), pa.array(has), pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(rest, rest_type)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *own], schema=pa.schema([*(batch.schema.field(c) for c in carried), *fields]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    parts = docs.mapInArrow(run, f"{kinds}, n_symbols long, has boolean, sums array<double>, rest array<struct<gram:bigint,n:bigint>>")
    parts = cut(parts.withColumn("row", F.monotonically_increasing_id()), "language-parts")
    # Rare grams: no text or gram brings many rows.
    more = parts.select("row", F.explode("rest").alias("r")).select("row", "r.gram", F.col("r.n").alias("times"))
    more = more.join(found.filter(F.col("n") < least).select("gram", "l", "lp"), "gram").groupBy("row", "l").agg(F.sum(F.col("times") * F.col("lp")).alias("s"))
    more = more.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("l", "s"))).alias("more"))
    sums = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", F.col("more.s"), lambda a, b: a + b))
    out = parts.drop("rest").join(more, "row", "left").withColumn("h", F.transform(sums, lambda x: -x / F.greatest(F.col("n_symbols"), F.lit(1))))
    first, names = F.array_min("h"), F.array(*[F.lit(x) for x in langs])
    second = F.element_at(F.array_sort("h"), 2) if m > 1 else first
    judge = [F.element_at(names, F.array_position("h", first).cast("int")), first, (second - first) * F.col("n_symbols")]
    return out.select(*carried, *[F.when(F.col("has"), x).alias(a) for x, a in zip(judge, ("lang_pred", "entropy", "margin"))], "n_symbols")


def margin_bin(margin: str) -> F.Column:
    return F.least(F.greatest(F.ceil(F.log(STEP, F.greatest(F.col(margin), F.lit(1e-9)))), F.lit(0)), F.lit(BINS - 1)).cast("int")


def calibration(rows: DataFrame) -> tuple[list[float], float]:
    """From ``rows(lang, lang_pred, entropy, margin)``: the score of each margin, never falling, and the entropy that is accepted."""
    right = F.col("lang") == F.col("lang_pred")
    found = rows.groupBy(margin_bin("margin").alias("b")).agg(F.count("*").alias("n"), F.count_if(right).alias("r")).toArrow().to_pylist()
    n, r = [0] * BINS, [0] * BINS
    for x in found:
        n[x["b"]], r[x["b"]] = x["n"], x["r"]
    blocks: list[list[float]] = []  # right, all, bins; neighbours that fall are pooled
    for i in range(BINS):
        blocks.append([r[i] + 0.5 if n[i] else 0, n[i] + 1 if n[i] else 0, 1])
        while len(blocks) > 1 and (not blocks[-1][1] or blocks[-2][1] and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    score, before = [], 0.5
    for a, b, k in blocks:
        before = a / b if b else before
        score += [before] * int(k)
    limit = rows.filter(right).agg(F.percentile_approx("entropy", F.lit(ACCEPT), F.lit(10_000))).collect()[0][0]
    return score, float("inf") if limit is None else limit


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``lang_pred``, ``score``, and whether calibration accepts it."""
    spark = docs.sparkSession
    with scratch(spark):
        small_batches(spark, 500)
        part = fold(key)
        rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), part.alias("part"))
        known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        # a corpus that is too small for both is all counted, and calibrated on itself
        apart = known.filter(F.col("part") > CALIBRATION).select("lang").distinct()
        thin = known.filter(F.col("part") == CALIBRATION).select("lang").distinct().exceptAll(apart).withColumnRenamed("lang", "thin")
        taught = known.filter(F.col("part") > CALIBRATION).unionByName(
            known.filter(F.col("part") == CALIBRATION).join(F.broadcast(thin.limit(MAX_LANGS + 1)), F.col("lang") == F.col("thin"), "left_semi")
        )
        all_ = counts(taught.select("lang", "text"))
        langs, by = known_counts(all_)
        out = spread(rows, all_, langs, by) if large(by) else judged(rows, models_of(all_, langs, by))
        out = cut(out, "languages", keep=True)
        score, limit = calibration(out.filter((F.col("part") == CALIBRATION) & F.col("lang").isNotNull() & F.col("lang_pred").isNotNull()))
    scores = F.array(*[F.lit(s) for s in score])
    sure = F.when(F.col("lang_pred").isNull(), 0.0).otherwise(F.element_at(scores, margin_bin("margin") + 1))
    return out.select(
        F.col("k").alias(key), F.coalesce(F.col("part") == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"),
        sure.alias("score"), F.coalesce((F.col("entropy") <= limit) & (sure >= 0.5), F.lit(False)).alias("accepted"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))

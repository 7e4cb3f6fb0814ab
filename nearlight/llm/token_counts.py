"""Delta-maintained token counts by source, language and tokenizer version.

A batch is a set of signed changes: an insert adds a document's count, a delete takes it away,
a revision takes the old count and adds the new one. A commit aggregates the batch (partial
sums before the shuffle, so a hot source costs one row a task) and writes the aggregate under
the batch's id; the totals are the sum over committed batches. A batch id that is committed is
never applied again, and a commit that broke off leaves no marker and is written anew, so
batches may be sent any number of times.

Defined cases: null source, language and version are groups of their own; a null or empty text
counts 0 words; repeated rows count each; groups whose documents have all been deleted stay with
zeros unless dropped by ``totals(live=True)``; an empty batch commits as empty; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlight.llm.common import chunks, kept_dir, ship
from nearlight.llm.wavelet import encoder

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def words(text: Column) -> Column:
    """Whitespace-separated words: ``words@1``."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def utf8(text: Column) -> Column:
    """Ids of a byte-level vocabulary: ``bytes@1``."""
    return F.octet_length(F.coalesce(text.cast("string"), F.lit(""))).cast("long")


TOKENIZERS = {"words@1": words, "bytes@1": utf8, "bytes@2": lambda t: utf8(t) + 1}


def counted(docs: DataFrame, *versions: str, text: str = "text") -> DataFrame:
    """``(source, lang, tokenizer, n_tokens)``, a row for each document and version."""
    pairs = F.array(*[F.struct(F.lit(v).alias("tokenizer"), TOKENIZERS[v](F.col(text)).alias("n_tokens")) for v in versions])
    return docs.select("source", "lang", F.inline(pairs))


def encoded(docs: DataFrame, path: str, version: str, text: str = "text") -> DataFrame:
    """As :func:`counted` for a byte-level tokenizer of the tokenizers library, without end ids."""
    ship(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for pdf in batches:
            texts = pdf["t"].tolist()
            for i, j in chunks(texts, 1 << 20):
                yield pdf.iloc[i:j][["source", "lang"]].assign(n_tokens=enc.encode(texts[i:j])[1] - 1)

    rows = docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    out = rows.mapInPandas(run, "source string, lang string, n_tokens long")
    return out.select("source", "lang", F.lit(version).alias("tokenizer"), "n_tokens")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn("sign", F.lit(sign).cast("long"))


def revision(old: DataFrame, new: DataFrame) -> DataFrame:
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """Totals below one folder of any store that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        p, fs = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[0])]
        return sorted(n.removeprefix("batch-") for n in done)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes(source, lang, tokenizer, n_tokens, sign)`` once; False if it was."""
        p, fs = self._fs(f"{self.path}/batch-{batch}/_SUCCESS")
        if fs.exists(p):
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        return True

    def totals(self, live: bool = False) -> DataFrame:
        done = self.committed()
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/batch-{b}" for b in done]) if done else self.spark.createDataFrame([], SCHEMA)
        out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 or n_tokens <> 0") if live else out


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents inserted under two tokenizers, the byte counts then revised to the
    version with an end id, a tenth of the documents deleted, and all batches sent twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rollup = Rollup(spark, kept_dir(spark, "token-counts"))
    insert = signed(counted(docs, "words@1", "bytes@1"), 1)
    revise = revision(counted(docs, "bytes@1"), counted(docs, "bytes@2"))
    leave = signed(counted(docs.filter("doc_id % 10 = 3"), "words@1", "bytes@2"), -1)
    for batch, changes in 2 * (("1", insert), ("2", revise), ("3", leave)):
        rollup.commit(batch, changes)
    return rollup.totals(live=True)


ORACLE = r"""
select source, lang, tokenizer, count(*)::bigint as n_docs, sum(n)::bigint as n_tokens
from (
  select source, lang, unnest(['words@1', 'bytes@2']) as tokenizer,
         unnest([len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), strlen(coalesce(text, '')) + 1]) as n
  from documents where doc_id % 10 <> 3 or doc_id is null
)
group by source, lang, tokenizer
"""

"""The corpus pipeline: quality rules, near-duplicate join, repeated strings, packing.

Every stage takes ``(spark, docs, sf_dir)`` and all that its predecessor kept. All but the last
return the columns of ``documents``; ``n_chars`` follows the text. Documents of one id and
one text count once in the near-duplicate stage; those without id are never dropped there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlight.llm import ngram_join, packing, quality_rules, substring_dedup
from nearlight.llm.common import cut, scratch

#: A passage of over 50 words holds so many whole words, even where it is joined to other text at one end.
PASSAGE_WORDS = 50


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps."""
    return quality_rules.judge(quality_rules.ledger(docs, carry=True)).filter("kept").select("row.*")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of linked documents."""
    keep = ngram_join.join(docs).filter("doc_id = component_id").select("doc_id").distinct()
    stay = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes, and those of 50 words, that also start elsewhere."""
    out = substring_dedup.dedup(docs, keep_text=True, words=PASSAGE_WORDS).select("row.*", F.col("kept_text").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces, bins and offsets of what is left, by the ids of the byte-level tokenizer."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", stage_quality),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("suffix-array dedup", stage_substrings),
    ("best-fit packing", stage_packing),
]

#: The joins and the packing are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return STAGES[-1][1](spark, docs, sf_dir)  # reads its own tables only

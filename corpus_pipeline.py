"""The corpus pipeline: five stages over `documents`, each one operator of the llm subpackage.

Every stage works on all rows that its predecessor kept and returns the columns of `documents` (the last one: what the
encoding gives). Rows with nulls, empty or very long texts and repeated ids go through as the operators define it, an empty
table gives an empty one, and other columns of `documents`, whatever their names, are left behind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import written
from tracelake.llm.mixing import mix_sources
from tracelake.llm.neardup import near_duplicates
from tracelake.llm.passages import remove_passages
from tracelake.llm.rules import fit_rules, judge
from tracelake.llm.spm import encode_pieces

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    docs = docs.select(*COLUMNS)
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id (5-word shingles, 0.8).

    Rows of one id are one document: they stay or go together, and of those with one text one stays. Rows without an id, or
    without words, stay.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    many = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    if many.isEmpty():
        return left
    left, many = written(left, "left"), written(many, "repeated")
    return left.join(many, "doc_id", "left_anti").select(*COLUMNS).unionByName(left.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out of the texts; every document stays, n_chars follows."""
    cut = remove_passages(docs, texts=True, carry=["lang", "source"])
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the whole times its words are taken, and once more with the chance of the
    rest, drawn from a hash of the id. Documents without words stay once."""
    mixed = mix_sources(docs, keep=("text", "lang", "n_chars"))
    part = F.col("taken") / F.greatest("size", F.lit(1))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) / float(1 << 20)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(part + chance).cast("int"))
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces: ids, number of tokens, checksums of ids and of the text decoded from them."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("passages", passage_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL has no rolling of a decision list, MinHash or piece model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stage's rows written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs

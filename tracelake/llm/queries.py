"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.fingerprint import edited_fingerprints
from tracelake.llm.fm import classify, train
from tracelake.llm.lm import backoff_scores
from tracelake.llm.mixing import mix_sources
from tracelake.llm.neardup import near_duplicates
from tracelake.llm.passages import remove_passages
from tracelake.llm.records import token_records
from tracelake.llm.rules import fit_rules, judge
from tracelake.llm.spm import encode_pieces
from tracelake.llm.sql import LM_SQL, LM_TRIGRAMS_SQL, NEARDUP_SQL, WARC_SQL
from tracelake.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on 4-word shingles at 80 percent."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the index."""
    return archive_round_trip(_table(spark, sf_dir, "pages"), revisit_bytes=100)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 percent of their words, sources weighing 5, 2, 1 and so on."""
    mixed = mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a factorisation machine."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = train(docs, _table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return classify(docs, machine, threshold=0.3, metadata=("n_chars",))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to pieces and decoded again."""
    return encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token records, written in the order of ids and read back."""
    return token_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and a learned decision list over all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_rules(docs, _table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how near those and the next documents are."""
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that a document with a smaller id has, cut out of all documents."""
    return remove_passages(_table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents from all uni- and bigrams of the whole corpus, once-seen ones too."""
    scores = backoff_scores(_table(spark, sf_dir, "documents"), order=2, least=1)
    return scores.select("doc_id", "n_words", F.round("log10_score", 3).alias("log10_score"), F.round("mean_log10", 5).alias("mean_log10"))


def op10_lm_scores_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents from all uni-, bi- and trigrams of the whole corpus, once-seen ones too."""
    scores = backoff_scores(_table(spark, sf_dir, "documents"), order=3, least=1)
    return scores.select("doc_id", "n_words", F.round("log10_score", 3).alias("log10_score"), F.round("mean_log10", 5).alias("mean_log10"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_minhash_neardup, op2_warc, op3_mixing, op4_quality_classifier, op5_sentencepiece, op6_token_records, op7_quality_rules, op8_fingerprints, op9_suffix_dedup, op10_lm_scores, op10_lm_scores_trigrams)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; tests hold the others against brute force."""
    return {"op1_minhash_neardup": NEARDUP_SQL, "op2_warc": WARC_SQL, "op10_lm_scores": LM_SQL, "op10_lm_scores_trigrams": LM_TRIGRAMS_SQL}

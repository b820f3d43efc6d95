"""A training-data pipeline over ``documents``: each stage calls one operator of ``tickwise.llm``.

A stage is ``f(spark, docs, sf_dir) -> DataFrame`` and sees everything its predecessor kept, as a written
table. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm import decontam, sentencepiece_lattice, simhash_dedup, suffix_dedup, toxicity
from tickwise.llm.common import stored, table
from tickwise.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go.

    A null or empty text has no words and stays unless the intercept alone rejects it; repeated rows are judged
    alike; null ids, extra columns of any name and empty tables pass through; a text is read whole, one row at a time.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of SimHashes (three words, two bits): the smallest id.

    Texts without words share fingerprint zero and form a group like any other; of rows that repeat an id one stays;
    extra columns of any name are kept; an empty table stays empty.
    """
    return simhash_dedup.keep_one(docs, shingle=3, max_bits=2)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte in a string of 400 bytes that also starts elsewhere goes; no document does.

    A null text becomes empty; null ids, repeated rows and extra columns are kept; ``n_chars`` is counted anew.
    """
    return suffix_dedup.without_repeats(docs, length=400)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share template windows with the benchmark go.

    Null and empty texts are clean; repeated rows and null ids are judged by their texts; all columns are kept.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): what is left, as piece ids; null and empty texts have none, every row gets its row."""
    pieces = sentencepiece_lattice.model_pieces(tokenizer("piece_bpe_32k.model"))
    return sentencepiece_lattice.encode(docs, pieces, bucket=ENCODE_BUCKET).select("doc_id", F.size("ids").alias("n_tokens"), "ids")


ENCODE_BUCKET = 4_000_000  # bytes of text in one task of the last stage, whose executors still hold what the stages before took
STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", repeat_dedup),
          ("benchmark_decontamination", decontaminate), ("sentencepiece", encode)]
ORACLE_SQL = None  # fitted models, suffix order and lattices; tests/llm/test_pipeline.py recomputes each stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""A training corpus from documents: toxicity, line dedup, near-dedup, mixing and encoding, one after another.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import line_dedup, mixing, near_dedup, pieces, toxicity
from kindred.llm.queries import piece_model
from kindred.runtime import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go.

    Null and empty texts hold no evidence and are scored as such; texts of any length are read whole; rows repeated whole stay
    or go together, and there are no ties to break. Other columns are carried along, whatever their names. An empty table
    gives an empty one, and without labels to learn from every document stays.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier one stands for go, and documents of which no word is left by that.

    Null, empty and blank texts lose no line and stay; texts of any length are read whole. Earliest is by doc_id, then by line;
    rows repeated whole tie, lose the same lines and stay or go together. n_chars is counted again where a text changed; other
    columns are carried along, whatever their names. An empty table gives an empty one.
    """
    out = line_dedup.dedup(docs)
    emptied = (F.col(f"`{out.columns[-1]}`") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return out.where(~emptied).select(*(F.col(f"`{c}`") for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 0.8 of five-word shingles or more.

    The one that stays is that of the smallest doc_id; rows repeated whole share it and stay together. Null, empty and blank
    texts are near nothing and stay; texts of any length are read whole. Other columns are carried along, whatever their
    names. An empty table gives an empty one.
    """
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, up to three times.

    Null, empty and blank texts have no words and are taken no time; a null source is a source of its own. Texts of any length
    count whole. Rows repeated whole are rounded each for itself, and ties are broken by hashes, so reruns agree. Other columns
    are carried along, whatever their names. An empty table gives an empty one.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document that is taken, once for each time.

    Null and empty texts have the end id alone; texts of any length are encoded whole; rows repeated whole come out alike.
    Other columns play no part. An empty table gives an empty one.
    """
    return pieces.encode_table(docs, piece_model(), ids=True, digests=False)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mixing", mix_sources), ("sentencepiece", encode)]

#: Neither the compression model nor dependent rounding can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs

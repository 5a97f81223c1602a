"""Candidate generation: an inverted index of block keys, and pairs of records that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.groups import block_groups, first_block, meet, sliced, spread
from kindred.runtime import Scratch
from kindred.spec import Feature


def feature_tokens(records: DataFrame, features: list[Feature], strength: str, blocking: bool = False) -> DataFrame:
    """(record_id, token): ``name_value`` of every value of every feature of that strength, of those that block if asked."""

    def named(f: Feature) -> Column:
        return F.transform(f.column, lambda x: F.concat(F.lit(f.name + "_"), x.cast("string")))

    columns = [named(f) for f in features if f.strength == strength and (f.blocks or not blocking)]
    if not columns:
        return records.select("record_id", F.lit("").alias("token")).where("false")
    return records.select("record_id", F.explode(F.array_distinct(F.concat(*columns))).alias("token"))


def generate_blocks(records: DataFrame, features: list[Feature], strengths: tuple[str, ...] = ("strong", "weak")) -> DataFrame:
    """(kind, block_key, record_id)."""
    out = None
    for kind in strengths:
        part = feature_tokens(records, features, kind, blocking=True).select(F.lit(kind).alias("kind"), F.col("token").alias("block_key"), "record_id").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def clean_blocks(blocks: DataFrame, max_block_size: int | None) -> DataFrame:
    """Blocks of more than max_block_size records go. Only sizes are joined back, so a huge block never meets in one task."""
    if max_block_size is None:
        return blocks
    fit = blocks.groupBy("kind", "block_key").agg(F.count("*").alias("n")).where(F.col("n") <= max_block_size).drop("n")
    return blocks.join(fit, ["kind", "block_key"])


def complete_blocks(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Records without a block get a weak one of their own."""
    alone = records.select("record_id").join(blocks.select("record_id"), "record_id", "left_anti")
    key = F.concat(F.lit("singular_ad_"), F.col("record_id").cast("string"))
    return blocks.unionByName(alone.select(F.lit("weak").alias("kind"), key.alias("block_key"), "record_id"))


def blocking_scheme(records: DataFrame, features: list[Feature], max_block_size: int | None = None, single_block: bool = False) -> DataFrame:
    """Strong and weak blocks, cleaned, then completed; or all records in the weak block ``All``."""
    if single_block:
        return records.select(F.lit("weak").alias("kind"), F.lit("All").alias("block_key"), "record_id")
    return complete_blocks(clean_blocks(generate_blocks(records, features), max_block_size), records)


def number_of_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.countDistinct("kind", "block_key").alias("n_blocks"))


def candidate_pairs(blocks: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of records that share a block, each once. Blocks should be cleaned: pairs grow with the
    square of their size. Pairs are made in tiles, so a large block is no one task's work, and none is shuffled."""
    scratch = Scratch(blocks.sparkSession, "candidates")
    return spread(first_block(meet(sliced(block_groups(blocks), scratch))))

"""Entity resolution: components of matches, and match-and-merge to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.clustering import labels_of, merge_duplicated, with_singletons
from kindred.operators.components import connected_components
from kindred.runtime import Scratch
from kindred.spec import Feature


def weak_components(records: DataFrame, match, blocks: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(record_id, cluster_id): components of pairs that share a block and match."""
    scratch = scratch or Scratch(records.sparkSession, "matches")
    return with_singletons(connected_components(match.block_edges(blocks, records, scratch), scratch), records)


def match_and_merge(blocked: DataFrame, match, features: list[Feature], max_rounds: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """Merged records of each block: (block, record_id, members, features).

    blocked has a row for each record in each block. Each round scores all pairs within blocks (those that are alike as one), merges the components of
    matches, and goes on until none match. Merging by components reaches the same fixpoint as merging one by one if matching
    is idempotent, commutative, associative and keeps matching after merges, which is what ``icar`` claims. All blocks run
    together; a round is one plan and is written to the shared folder.
    """
    if not match.icar:
        raise ValueError("match-and-merge needs a match function whose merges keep matching (icar)")
    scratch = scratch or Scratch(blocked.sparkSession, "merge")
    columns = [f.column for f in features]
    now = scratch.keep(blocked.select("block", F.xxhash64("block", "record_id").alias("record_id"), "members", *columns))
    for _ in range(max_rounds):
        blocks = now.select(F.lit("").alias("kind"), F.col("block").alias("block_key"), "record_id")
        edges = scratch.keep(match.block_edges(blocks, now, scratch))
        if edges.isEmpty():
            return now
        groups = with_singletons(connected_components(edges, scratch), now)
        sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ["members", *columns]]
        merged = now.join(groups, "record_id").groupBy("block", "cluster_id").agg(*sets)
        step = scratch.keep(merged.select("block", F.col("cluster_id").alias("record_id"), "members", *columns))
        scratch.drop(now)
        now = step
    raise RuntimeError(f"records still merge after {max_rounds} rounds")


def resolve(records: DataFrame, match, blocks: DataFrame, features: list[Feature]) -> tuple[DataFrame, DataFrame]:
    """Entities and labels: match-and-merge within each block on unmerged records, then entities that share a record merged."""
    keyed = blocks.select("record_id", F.concat_ws(":", "kind", "block_key").alias("block")).distinct()
    blocked = keyed.join(records, "record_id")
    merged = match_and_merge(blocked, match, features)
    alone = merged.select(F.col("record_id"), "members", *[f.column for f in features])
    entities = merge_duplicated(alone, features).withColumn("record_id", F.array_min("members"))
    return entities, labels_of(entities)

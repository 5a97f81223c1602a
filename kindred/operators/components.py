"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.runtime import Scratch


#: Keys with more edges than this, and more than a thousandth of all, are joined by broadcast: at most a thousand are that hot.
HOT = 200_000


def _hot(edges: DataFrame, key: str, count: int) -> DataFrame | None:
    """Keys of so many edges that one task would sort them all; None where there can't be any."""
    limit = max(HOT, count // 1000)
    if count <= limit:
        return None
    found = [r[0] for r in edges.groupBy(key).count().where(F.col("count") > limit).select(key).collect()]
    return edges.sparkSession.createDataFrame([(x,) for x in found], f"{key} bigint") if found else None


def _to_least(edges: DataFrame, least, key: str, count: int) -> DataFrame:
    """Edges with m, the least neighbour of their key. ``least`` finds it for the keys of a table, or for all but those."""
    hot = _hot(edges, key, count)
    if hot is None:
        return edges.join(least(None, ""), key)
    hot = F.broadcast(hot)
    cold = edges.join(hot, key, "left_anti").join(least(hot, "left_anti"), key)
    return cold.unionByName(edges.join(F.broadcast(least(hot, "left_semi")), key))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour. Needs src > dst."""

    def least(keys: DataFrame | None, how: str) -> DataFrame:
        both = edges.select("dst", F.col("dst").alias("m")).union(edges.select("src", "dst"))
        both = both if keys is None else both.join(keys, "dst", how)
        return both.groupBy("dst").agg(F.min("m").alias("m"))

    return _to_least(edges, least, "dst", count).select("src", F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest. Needs src > dst."""

    def least(keys: DataFrame | None, how: str) -> DataFrame:
        return (edges if keys is None else edges.join(keys, "src", how)).groupBy("src").agg(F.min("dst").alias("m"))

    moved = _to_least(edges, least, "src", count).where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.union(least(None, "").select("src", F.col("m").alias("dst"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Stars are stable: no node is both a leaf and a centre."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(src, dst) edges of bigint ids to (id, component), component being the smallest reachable id.

    Alternates large-star and small-star until the edges are stars, which takes about log2 of the longest path rounds. Each
    half is an aggregation with map-side combining and a join, of hubs by broadcast, so no hub's edges are ever sorted by one
    task. Every round is written to the shared folder, which cuts lineage. Self-loops give
    their node its own component; nulls are dropped; nodes without an edge don't appear.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "components")
    edges = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).dropna()
    first = scratch.keep(
        edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    )
    now, before = first.where("src <> dst"), None
    state = _state(now)
    if state[0]:
        for _ in range(max_rounds):
            large = _large_star(now, state[0])
            large = scratch.keep(large) if state[0] > HOT else large
            step = scratch.keep(_small_star(large, state[0]))
            scratch.drop(large)
            after = _state(step)
            if before is not None:
                scratch.drop(before)
            now = before = step
            if after == state:
                break
            state = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    centres = first.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(stars, "id", "left_anti")
    return stars.union(centres.select("id", F.col("id").alias("component")))

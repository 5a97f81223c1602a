"""Clusters from links, and records merged by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.blocking import feature_tokens
from kindred.operators.components import connected_components
from kindred.runtime import Scratch
from kindred.spec import Feature


def with_singletons(components: DataFrame, ids: DataFrame) -> DataFrame:
    """(record_id, cluster_id) for all ids; without a component an id is its own cluster."""
    found = ids.select("record_id").join(components.toDF("record_id", "component"), "record_id", "left")
    return found.select("record_id", F.coalesce("component", "record_id").alias("cluster_id"))


def star_edges(tokens: DataFrame) -> DataFrame:
    """Every record that has a token, linked to the smallest that has it: as many edges as rows, however common a token."""
    least = tokens.groupBy("token").agg(F.min("record_id").alias("dst"))
    return tokens.join(least, "token").where("record_id <> dst").select(F.col("record_id").alias("src"), "dst").distinct()


def cluster_by_token(tokens: DataFrame, ids: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(record_id, cluster_id) where records that share a token, in any number of steps, are one cluster."""
    return with_singletons(connected_components(star_edges(tokens), scratch), ids)


def strong_cluster(records: DataFrame, features: list[Feature]) -> DataFrame:
    """(record_id, cluster_id) for every provenance id: records that share a strong value are one, and a record's own
    provenance ids are too."""
    tokens = feature_tokens(records, features, "strong")
    each = records.select("record_id", F.explode("members").alias("m"))
    edges = star_edges(tokens).join(each.toDF("src", "sm"), "src").join(each.toDF("dst", "dm"), "dst").select(F.col("sm").alias("src"), F.col("dm").alias("dst"))
    own = records.select(F.explode("members").alias("src"), F.array_min("members").alias("dst"))
    return with_singletons(connected_components(edges.union(own)), each.select(F.col("m").alias("record_id")))


def _sets(features: list[Feature]) -> list:
    return [F.array_sort(F.array_distinct(F.flatten(F.collect_list(f.column)))).alias(f.column) for f in features]


def merge_by(records: DataFrame, groups: DataFrame, features: list[Feature]) -> DataFrame:
    """Records of a group become one, with the union of each set and of provenance; its id is the smallest.

    groups: (record_id, cluster_id). Records without one stay; groups without a record are ignored.
    """
    own = records.join(groups.select("record_id", "cluster_id"), "record_id", "left")
    key = F.struct(F.col("cluster_id").isNull(), F.coalesce("cluster_id", "record_id")).alias("key")
    members = F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members")
    return own.groupBy(key).agg(F.min("record_id").alias("record_id"), members, *_sets(features)).drop("key")


def merge_duplicated(entities: DataFrame, features: list[Feature]) -> DataFrame:
    """Entities that share a provenance id, in any number of steps, merged."""
    links = entities.select("record_id", F.explode("members").alias("token"))
    groups = cluster_by_token(links.select("record_id", F.col("token").cast("string").alias("token")), entities)
    return merge_by(entities, groups, features)


def labels_of(entities: DataFrame) -> DataFrame:
    """(record_id, cluster_id) of every provenance id; the cluster is the smallest of them."""
    return entities.select(F.explode("members").alias("record_id"), F.array_min("members").alias("cluster_id"))


def bipartite_clusters(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Components of a two-sided mapping (a, b) of names, as (record_id, cluster_id) by ids (pid, record_id)."""
    left, right = ids.toDF("a", "src"), ids.toDF("b", "dst")
    edges = pairs.join(left, "a").join(right, "b").select("src", "dst")
    return with_singletons(connected_components(edges), ids)


def cluster_table(records: DataFrame, clusters: DataFrame, poster: str) -> DataFrame:
    """(record_id, poster_id, cluster_id): the first value of a feature beside the cluster, in order of id."""
    found = records.select("record_id", F.get(F.col(poster), F.lit(0)).alias("poster_id")).join(clusters, "record_id")
    return found.orderBy("record_id")

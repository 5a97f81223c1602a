"""Samples, synthetic records and their corruption. Everything is drawn by hashes of ids, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.spec import Feature


def hash_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that SQL engines with md5 share."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample_and_remove(df: DataFrame, n: int, key: str = "record_id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Exactly n rows, and the others. The n are a top-n, which is taken within partitions first."""
    ids = df.select(F.col(key).alias("__k"), hash_order(F.col(key), seed).alias("__h")).orderBy("__h", "__k").limit(n).select("__k")
    return df.join(ids, F.col(key) == F.col("__k"), "left_semi"), df.join(ids, F.col(key) == F.col("__k"), "left_anti")


def sample_labelled(records: DataFrame, labels: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sampled records and their labels, then the rest and theirs."""
    taken, rest = sample_and_remove(records, n, seed=seed)
    return taken, labels.join(taken.select("record_id"), "record_id", "left_semi"), rest, labels.join(rest.select("record_id"), "record_id", "left_semi")


def synthetic_features(n: int) -> list[Feature]:
    return [Feature(f"Name_{k}", "float", "weak", "", "numerical_difference") for k in range(n)]


def uniform(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def synthetic(spark: SparkSession, entities: int, copies: int, features: int = 2, seed: int = 0, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """entities x copies records, alike within an entity, of features uniform in [0, 1); and labels record -> entity."""
    rows = spark.range(entities * copies).select((F.col("id") + first).alias("record_id"), (F.floor(F.col("id") / copies) + first).alias("cluster_id"))
    values = [F.array(uniform(F.col("cluster_id"), F.lit(k), F.lit(seed))).alias(f"f_Name_{k}") for k in range(features)]
    records = rows.select("record_id", F.array("record_id").alias("members"), *values)
    return records, rows.select("record_id", "cluster_id")


def add_entities(records: DataFrame, labels: DataFrame, entities: int, copies: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """More synthetic records, with ids from the largest on."""
    top = records.agg(F.max("record_id")).first()[0]
    count = len([c for c in records.columns if c.startswith("f_")])
    more, own = synthetic(records.sparkSession, entities, copies, count, seed, 0 if top is None else top + 1)
    return records.unionByName(more), labels.unionByName(own)


def corrupt(records: DataFrame, sigma: float, most: int | None = None, seed: int = 2) -> DataFrame:
    """Normal noise on every value of the first ``most`` records, or of all."""

    def noise(name: str) -> Column:
        u, v = uniform(F.col("record_id"), F.lit(name), F.lit(seed)), uniform(F.col("record_id"), F.lit(name), F.lit(seed + 7919))
        normal = F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-300)))) * F.cos(6.283185307179586 * v)
        shifted = F.transform(name, lambda x: x + sigma * normal)
        return shifted if most is None else F.when(F.col("record_id") < most, shifted).otherwise(F.col(name))

    return records.withColumns({c: noise(c) for c in records.columns if c.startswith("f_")})


def corrupted_tokens(spark: SparkSession, records: int, per_cluster: int, p: float, features: int = 100, seed: int = 0) -> DataFrame:
    """(doc_id, cluster_id, tokens): ``f<i>_<cluster>``, each with probability p ``f<i>_corrupt`` instead."""
    rows = spark.range(records).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / per_cluster).alias("cluster_id"))
    one = lambda i: F.concat(F.lit("f"), i.cast("string"), F.lit("_"), F.when(uniform(F.col("doc_id"), i, F.lit(seed)) < p, F.lit("corrupt")).otherwise(F.col("cluster_id").cast("string")))
    return rows.select("doc_id", "cluster_id", F.transform(F.sequence(F.lit(0), F.lit(features - 1)), one).alias("tokens"))


def sample_clusters(labels: DataFrame, n: int, seed: int = 0, most: int = 10_000, share: float = 0.2) -> DataFrame:
    """Records of whole clusters, in hashed order until n ids are there; clusters of more than most ids, or of more than a
    share of n, are passed over. The running sum is over clusters, not records."""
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") <= min(most, max(1, int(share * n))))
    order = Window.orderBy(hash_order(F.col("cluster_id"), seed), "cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = sizes.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < n)
    return labels.join(chosen.select("cluster_id"), "cluster_id", "left_semi")


def triplets(labels: DataFrame, most: int = 10_000, seed: int = 0) -> DataFrame:
    """(a, b, c): two ids of one cluster and one of the next in hashed order, for pairs of clusters of which the first has two
    ids or more."""
    inner = Window.partitionBy("cluster_id").orderBy(hash_order(F.col("record_id"), seed), "record_id")
    few = labels.withColumn("r", F.row_number().over(inner)).where("r <= 2")
    heads = few.groupBy("cluster_id").agg(F.min_by("record_id", "r").alias("a"), F.max(F.when(F.col("r") == 2, F.col("record_id"))).alias("b"))
    # The first clusters are a top-n; the window then runs over at most that many rows.
    heads = heads.orderBy(hash_order(F.col("cluster_id"), seed), "cluster_id").limit(most)
    order = Window.orderBy(hash_order(F.col("cluster_id"), seed), "cluster_id")
    ranked = heads.withColumn("k", F.row_number().over(order) - 1).withColumn("c", F.lead("a").over(order))
    return ranked.where("k % 2 = 0 and b is not null and c is not null").select("a", "b", "c")

"""How well one clustering agrees with another, all from one table of cells: records in true cluster i and predicted j."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.runtime import Scratch


def cells(true: DataFrame, pred: DataFrame, check: bool = False) -> DataFrame:
    """(t, p, n, n_t, n_p): sizes of non-empty cells and of their clusters. Records without a true cluster are left out;
    with check a record without a predicted one is an error."""
    t = true.select("record_id", F.col("cluster_id").alias("t"))
    p = pred.select("record_id", F.col("cluster_id").alias("p"))
    if check and not t.join(p, "record_id", "left_anti").isEmpty():
        raise KeyError("records without a predicted cluster")
    found = t.join(p, "record_id").groupBy("t", "p").agg(F.count("*").alias("n"))
    n_t = found.groupBy("t").agg(F.sum("n").alias("n_t"))
    n_p = found.groupBy("p").agg(F.sum("n").alias("n_p"))
    return found.join(n_t, "t").join(n_p, "p").select("t", "p", "n", "n_t", "n_p")


def _pairs(n: str) -> Column:
    return F.col(n) * (F.col(n) - 1) / 2


def _f1(p: str, r: str) -> Column:
    return F.when(F.col(p) + F.col(r) > 0, 2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r))).otherwise(0.0)


def _sides(c: DataFrame) -> DataFrame:
    """One row: pairs in predicted and in true clusters, and numbers of clusters."""
    p = c.select("p", "n_p").distinct().agg(F.coalesce(F.sum(_pairs("n_p")), F.lit(0.0)).alias("pp"), F.count("*").alias("np"))
    t = c.select("t", "n_t").distinct().agg(F.coalesce(F.sum(_pairs("n_t")), F.lit(0.0)).alias("tp"), F.count("*").alias("nt"))
    return p.crossJoin(t)  # one row each


def pairwise(c: DataFrame) -> DataFrame:
    """Share of predicted pairs that are true (1 if there are none), of true pairs that are predicted (0 if none), and F1."""
    both = c.agg(F.coalesce(F.sum(_pairs("n")), F.lit(0.0)).alias("both")).crossJoin(_sides(c))
    out = both.select(
        F.when(F.col("pp") > 0, F.col("both") / F.col("pp")).otherwise(1.0).alias("precision"),
        F.when(F.col("tp") > 0, F.col("both") / F.col("tp")).otherwise(0.0).alias("recall"),
        F.col("both").alias("intersection"), F.col("pp").alias("pred_pairs"), F.col("tp").alias("true_pairs"),
    )
    return out.withColumn("f1", _f1("precision", "recall"))


def exact_clusters(c: DataFrame) -> DataFrame:
    """Share of clusters found exactly."""
    same = (F.col("n") == F.col("n_t")) & (F.col("n") == F.col("n_p"))
    out = c.agg(F.count_if(same).alias("same")).crossJoin(_sides(c))
    out = out.select((F.col("same") / F.col("np")).alias("precision"), (F.col("same") / F.col("nt")).alias("recall"))
    return out.withColumn("f1", _f1("precision", "recall"))


def closest_clusters(c: DataFrame) -> DataFrame:
    """Mean over clusters of the best Jaccard similarity with one of the other side."""
    j = c.withColumn("j", F.col("n") / (F.col("n_t") + F.col("n_p") - F.col("n")))
    p = j.groupBy("p").agg(F.max("j").alias("j")).agg(F.avg("j").alias("precision"))
    r = j.groupBy("t").agg(F.max("j").alias("j")).agg(F.avg("j").alias("recall"))
    return p.crossJoin(r).withColumn("f1", _f1("precision", "recall"))


def purities(c: DataFrame) -> DataFrame:
    """Average author purity, average cluster purity, their geometric mean, and purity."""
    n = F.sum("n")
    a = c.agg((F.sum(F.col("n") * F.col("n") / F.col("n_t")) / n).alias("aap"), (F.sum(F.col("n") * F.col("n") / F.col("n_p")) / n).alias("acp"))
    best = c.groupBy("p").agg(F.max("n").alias("m"), F.sum("n").alias("s")).agg((F.sum("m") / F.sum("s")).alias("purity"))
    return a.withColumn("k", F.sqrt(F.col("aap") * F.col("acp"))).crossJoin(best)


def information(c: DataFrame) -> DataFrame:
    """Entropies, mutual information, variation of information, homogeneity, completeness and V, in natural logarithms."""
    total = c.agg(F.sum("n").alias("total"))

    def entropy(side: str, size: str, name: str) -> DataFrame:
        x = c.select(side, size).distinct().crossJoin(total)
        share = F.col(size) / F.col("total")
        return x.agg(F.coalesce(-F.sum(share * F.log(share)), F.lit(0.0)).alias(name))

    mi = c.crossJoin(total).agg(F.coalesce(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("n_t") * F.col("n_p")))), F.lit(0.0)).alias("mutual_information"))
    out = mi.crossJoin(entropy("t", "n_t", "entropy_true")).crossJoin(entropy("p", "n_p", "entropy_pred"))
    out = out.withColumn("variation", F.col("entropy_true") + F.col("entropy_pred") - 2 * F.col("mutual_information"))
    out = out.withColumn("homogeneity", F.when(F.col("entropy_true") > 0, F.col("mutual_information") / F.col("entropy_true")).otherwise(1.0))
    out = out.withColumn("completeness", F.when(F.col("entropy_pred") > 0, F.col("mutual_information") / F.col("entropy_pred")).otherwise(1.0))
    return out.withColumn("v_measure", _f1("homogeneity", "completeness"))


def entity_sizes(labels: DataFrame) -> DataFrame:
    """(size, occurrences) of clusters, ascending."""
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("occurrences")).orderBy("size")


def class_balance(labels: DataFrame) -> DataFrame:
    """Share of all pairs that are within a cluster."""
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg((F.sum(_pairs("n")) / (F.sum("n") * (F.sum("n") - 1) / 2)).alias("class_balance"))


def clusters(labels: DataFrame) -> DataFrame:
    """(cluster_id, members) with sorted members; the partition as sets."""
    return labels.groupBy("cluster_id").agg(F.array_sort(F.collect_set("record_id")).alias("members"))


Cost = Callable[[Column, Column], Column]


def product(x: Column, y: Column) -> Column:
    return (x * y).cast("double")


def nothing(x: Column, y: Column) -> Column:
    return F.lit(0.0)


def entropy_cost(n: float) -> Cost:
    """h(x + y) - h(x) - h(y) with h(z) = z/n ln(z/n); merging and splitting by it costs the variation of information."""

    def h(z: Column) -> Column:
        return F.when(z > 0, z / n * F.log(z / n)).otherwise(0.0)

    return lambda x, y: h(x + y) - h(x) - h(y)


def merge_distance(c: DataFrame, split: Cost, merge: Cost) -> DataFrame:
    """Generalised merge distance from the predicted to the true clustering: predicted clusters are split into their cells, one
    after another in order of true cluster, and cells are merged into true clusters likewise.

    Costs take numbers of records and must not depend on the order for the distance to be defined. Running sums over a
    cluster's cells are aggregations of an array, one for each cluster.
    """

    def total(side: str, order: str, cost: Cost, name: str) -> DataFrame:
        xs = F.transform(F.array_sort(F.collect_list(F.struct(order, "n"))), lambda s: s["n"])
        arrays = c.groupBy(side).agg(xs.alias("xs"))
        start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(0.0).alias("cost"))
        step = lambda acc, x: F.struct((acc["before"] + x).alias("before"), (acc["cost"] + F.when(acc["before"] > 0, cost(x, acc["before"])).otherwise(0.0)).alias("cost"))
        return arrays.select(F.aggregate("xs", start, step)["cost"].alias("cost")).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias(name))

    out = total("p", "t", split, "split_cost").crossJoin(total("t", "p", merge, "merge_cost"))
    return out.withColumn("distance", F.col("split_cost") + F.col("merge_cost"))


def report(true: DataFrame, pred: DataFrame) -> DataFrame:
    """All metrics in one row."""
    c = Scratch(true.sparkSession, "cells").keep(cells(true, pred))
    names = {"precision": "pairwise_precision", "recall": "pairwise_recall", "f1": "pairwise_f1"}
    out = pairwise(c).withColumnsRenamed(names)
    for part, prefix in ((exact_clusters(c), "cluster"), (closest_clusters(c), "closest")):
        out = out.crossJoin(part.withColumnsRenamed({k: f"{prefix}_{k}" for k in names}))
    return out.crossJoin(purities(c)).crossJoin(information(c))

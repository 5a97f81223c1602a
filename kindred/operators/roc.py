"""Curves of precision and recall over decision thresholds, and bounds on them that need no truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z = 1.96


def wilson(p: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a share p of n."""
    z2 = Z * Z
    mid = p + z2 / (2 * n)
    spread = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - spread) / (1 + z2 / n), (mid + spread) / (1 + z2 / n)


def roc_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row for each distinct score, as a threshold: tp, fp, precision, recall (tpr), fpr, f1 and their intervals; and the
    end point at score 1 with recall 0 and precision 1. Ties are one step, so no order within them matters.

    Scores are aggregated before the running sums, so the one window runs over distinct scores, not rows.
    """
    steps = scored.groupBy(F.col(score).alias("prob")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    down = Window.orderBy(F.col("prob").desc()).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(F.lit(1))
    run = steps.select("prob", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("picked"), F.sum("pos").over(all_).alias("positives"), F.sum("n").over(all_).alias("total"))
    run = run.withColumn("fp", F.col("picked") - F.col("tp")).withColumn("precision", F.col("tp") / F.col("picked"))
    run = run.withColumn("recall", F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0))
    run = run.withColumn("fpr", F.when(F.col("total") > F.col("positives"), F.col("fp") / (F.col("total") - F.col("positives"))).otherwise(0.0))
    end = run.groupBy("positives", "total").agg(F.count("*").alias("k")).select(
        F.lit(1.0).alias("prob"), F.lit(0).cast("bigint").alias("tp"), F.lit(1).cast("bigint").alias("picked"), "positives", "total",
        F.lit(0).cast("bigint").alias("fp"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("fpr"),
    )
    out = run.withColumn("end", F.lit(False)).unionByName(end.withColumn("end", F.lit(True)))
    total = F.col("precision") + F.col("recall")
    p_lo, p_hi = wilson(F.col("precision"), F.col("picked"))
    r_lo, r_hi = wilson(F.col("recall"), F.greatest("positives", F.lit(1)))
    return out.select(
        "prob", "end", "tp", "fp", "precision", "recall", "fpr", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0).alias("f1"),
        p_lo.alias("precision_lo"), p_hi.alias("precision_hi"), r_lo.alias("recall_lo"), r_hi.alias("recall_hi"),
    )


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the curve of recall over the false positive rate, by trapezoids; null if either class is missing."""
    curve = roc_curve(scored, score, label).where("not end").select("prob", "tp", "fp")
    order = Window.orderBy(F.col("prob").desc())
    area = (F.col("fp") - F.coalesce(F.lag("fp").over(order), F.lit(0))) * (F.col("tp") + F.coalesce(F.lag("tp").over(order), F.lit(0))) / 2
    return curve.select("tp", "fp", area.alias("area")).agg((F.sum("area") / F.nullif(F.max("tp") * F.max("fp"), F.lit(0))).alias("auc"))


def class_share(scored: DataFrame, label: str = "label") -> DataFrame:
    return scored.agg(F.avg(F.col(label).cast("double")).alias("class_balance"))


def recall_at(curve: DataFrame, t: float) -> DataFrame:
    """Recall and its interval at the first score of at least t; nothing is found above 1, everything below 0."""
    names = ["recall", "recall_lo", "recall_hi"]
    if t > 1 or t < 0:
        return curve.sparkSession.range(1).select(*[F.lit(0.0 if t > 1 else 1.0).alias(n) for n in names])
    at = F.struct(F.col("prob"), F.col("end").cast("int"))
    found = curve.where(F.col("prob") >= t).agg(F.min_by(F.struct(*names), at).alias("r"))
    return found.select(*[F.col(f"r.{n}").alias(n) for n in names])


def precision_at(curve: DataFrame, t: float) -> DataFrame:
    """Precision and its interval at the last score of at most t; below all scores that of the least; 1 above 1, 0 below 0."""
    names = ["precision", "precision_lo", "precision_hi"]
    if t > 1 or t < 0:
        return curve.sparkSession.range(1).select(*[F.lit(1.0 if t > 1 else 0.0).alias(n) for n in names])
    at = F.struct(F.col("prob"), F.col("end").cast("int"))
    whole = F.struct(*names)
    found = curve.agg(F.max_by(whole, F.when(F.col("prob") <= t, at)).alias("x"), F.min_by(whole, at).alias("y"))
    return found.select(F.coalesce("x", "y").alias("r")).select(*[F.col(f"r.{n}").alias(n) for n in names])


def rebalance_precision(p: Column, from_: Column, to: Column) -> Column:
    """Precision measured at one share of positives, as it would be at another."""
    return (1 - from_) * to * p / (from_ - from_ * to - from_ * p + to * p)


def rebalance_recall(r: Column, from_: Column, to: Column) -> Column:
    return r


def precision_bound(pairs: DataFrame, match_precision: DataFrame, from_: float, to: float) -> DataFrame:
    """Lower bound of a clustering's precision: (id_a, id_b, direct) of all pairs within clusters, and the match function's
    precision on validation pairs, rebalanced, times the share of pairs that match directly. All 1 without pairs."""
    share = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("direct")).alias("d"))
    names = match_precision.columns
    out = share.crossJoin(match_precision)
    return out.select(*[F.when(F.col("n") == 0, 1.0).otherwise(rebalance_precision(F.col(c), F.lit(from_), F.lit(to)) * F.col("d") / F.col("n")).alias(c) for c in names])


def f1_bound(precision: DataFrame, recall: DataFrame) -> DataFrame:
    """Harmonic mean of two bounds, 0 if either is 0."""
    both = precision.select(F.col(precision.columns[0]).alias("p")).crossJoin(recall.select(F.col(recall.columns[0]).alias("r")))  # one row each
    return both.select(F.when((F.col("p") > 0) & (F.col("r") > 0), 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0).alias("f1"))


def write_rates(curve: DataFrame, path: str) -> None:
    names = ["prob", "recall", "fpr", "precision", "f1", "precision_lo", "precision_hi", "recall_lo", "recall_hi"]
    curve.orderBy("prob", "end").select(*names).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_scores(scored: DataFrame, path: str, score: str = "score", label: str = "label") -> None:
    scored.select(F.col(score).alias("score"), F.col(label).alias("true_label")).write.mode("overwrite").csv(path, header=True)


def write_labels(scored: DataFrame, path: str, score: str = "score", label: str = "label") -> None:
    """What a curve can be drawn from again: label,probability."""
    scored.select(F.col(label).alias("label"), F.col(score).alias("probability")).write.mode("overwrite").csv(path, header=True)


def bounds(found: DataFrame, scored: DataFrame, curve: DataFrame, threshold: float, balance_validation: float, balance_within: float) -> DataFrame:
    """One row of bounds that need no truth: of recall from the curve, of precision from the share of direct matches among pairs
    of a found cluster, and of F1; each with its interval where there is one; and the numbers of direct matches and of pairs.

    found: (record_id, cluster_id). scored: (id_a, id_b, score) of candidates; pairs that weren't candidates are no match.
    """
    from kindred.operators.pairs import cluster_pairs

    pairs = cluster_pairs(found).join(scored.select("id_a", "id_b", "score"), ["id_a", "id_b"], "left").select(F.coalesce(F.col("score") > threshold, F.lit(False)).alias("direct"))
    recall = recall_at(curve, threshold)
    recall = recall.select(*[F.col(c).alias(c.replace("recall", "recall_bound")) for c in recall.columns if c.startswith("recall")])
    precision = precision_bound(pairs, precision_at(curve, threshold), balance_validation, balance_within)
    precision = precision.select(*[F.col(c).alias(c.replace("precision", "precision_bound")) for c in precision.columns if c.startswith("precision")])
    f1 = f1_bound(precision.select("precision_bound"), recall.select("recall_bound")).select(F.col("f1").alias("f1_bound"))
    counts = pairs.agg(F.coalesce(F.sum(F.col("direct").cast("bigint")), F.lit(0)).alias("n_direct"), F.count("*").alias("n_pairs"))
    return precision.crossJoin(recall).crossJoin(f1).crossJoin(counts)  # one row each

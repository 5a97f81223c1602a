"""The supervised pipeline and its sweep over thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import metrics
from kindred.operators.blocking import blocking_scheme
from kindred.operators.clustering import merge_by, strong_cluster, with_singletons
from kindred.operators.components import connected_components
from kindred.operators.matching import ForestMatch
from kindred.operators.pairs import pair_seed
from kindred.operators.resolve import weak_components
from kindred.operators.roc import bounds
from kindred.runtime import Scratch
from kindred.spec import Feature


def run_pipeline(train: DataFrame, test: DataFrame, features: list[Feature], threshold: float = 0.7, max_block_size: int = 1000, train_labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, labels, metrics): strong clusters stand in for truth, a forest learns from pairs of the training records, and
    the test records are resolved by components of matches within blocks."""
    scratch = Scratch(train.sparkSession, "pipeline")
    truth = scratch.keep(train_labels or strong_cluster(train, features))
    seed = scratch.keep(pair_seed(train, truth, features, 0.5))
    match = ForestMatch(train, truth, seed, features, threshold)
    found = scratch.keep(weak_components(test, match, blocking_scheme(test, features, max_block_size), scratch))
    real = scratch.keep(strong_cluster(test, features))
    return merge_by(test, found, features), found, metrics.report(real, found)


def threshold_sweep(records: DataFrame, truth: DataFrame, match, blocks: DataFrame, curve: DataFrame, thresholds: list[float], balance_validation: float) -> DataFrame:
    """One row for each threshold: metrics against truth, and the bounds that need none.

    Candidate pairs are scored once; each threshold only filters them.
    """
    scratch = Scratch(records.sparkSession, "sweep")
    scored = scratch.keep(match.score_blocks(blocks, records, scratch))
    within = scratch.keep(metrics.class_balance(truth)).first()["class_balance"] or 0.0
    out = None
    for t in thresholds:
        edges = scored.where(F.col("score") > t).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
        found = scratch.keep(with_singletons(connected_components(edges, scratch), records))
        row = metrics.report(truth, found).crossJoin(bounds(found, scored, curve, t, balance_validation, within)).select(F.lit(float(t)).alias("threshold"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def synthetic_experiment(spark, entities: int = 100, copies: int = 10, features: int = 10, sigma: float = 0.001, thresholds: list[float] | None = None) -> DataFrame:
    """The sweep on synthetic records with noise: one part to learn from, one to validate on, the rest to resolve."""
    from kindred.operators.sampling import corrupt, sample_labelled, synthetic, synthetic_features

    spec = synthetic_features(features)
    records, labels = synthetic(spark, entities, copies, features)
    records = corrupt(records, sigma)
    fifth = entities * copies // 5
    train, train_y, rest, rest_y = sample_labelled(records, labels, fifth)
    valid, valid_y, test, test_y = sample_labelled(rest, rest_y, fifth, seed=1)
    match = ForestMatch(train, train_y, pair_seed(train, train_y, spec, 0.5, direct=False), spec)
    seed = pair_seed(valid, valid_y, spec, 0.5, direct=False)
    curve = match.test(valid, valid_y, seed)
    share = seed.agg(F.avg("y")).first()[0] or 0.5
    return threshold_sweep(test, test_y, match, blocking_scheme(test, spec, single_block=True), curve, thresholds or [0.1, 0.3, 0.5, 0.7, 0.9], share)


SWEEP_COLUMNS = {
    "threshold": "threshold", "pairwise_precision": "precision", "precision_bound": "precision_bound", "precision_bound_lo": "precision_bound_lo", "precision_bound_hi": "precision_bound_hi",
    "pairwise_recall": "recall", "recall_bound": "recall_bound", "recall_bound_lo": "recall_bound_lo", "recall_bound_hi": "recall_bound_hi", "pairwise_f1": "f1", "f1_bound": "f1_bound",
    "n_direct": "direct_matches", "n_pairs": "pairs",
}


def sweep_table(swept: DataFrame) -> DataFrame:
    """The thirteen columns of a sweep that are kept as a table."""
    return swept.select(*[F.col(c).alias(name) for c, name in SWEEP_COLUMNS.items()])


def write_sweep(swept: DataFrame, path: str) -> None:
    sweep_table(swept).orderBy("threshold").coalesce(1).write.mode("overwrite").csv(path, header=True)

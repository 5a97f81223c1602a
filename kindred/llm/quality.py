"""Quality by a sparse rule ensemble.

Statistics of a text are Spark columns. Shallow trees are grown on a bounded sample of labelled rows; every path from a root
is a conjunction of thresholds; lasso logistic regression keeps few of those rules, and these are compiled back into one
Spark expression, so that scoring runs without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the fitting sample: labelled documents of each class, the first by hash of key.
FIT_EACH = 4000
STATS = ["chars", "words", "word_chars", "distinct", "marks", "digits", "upper", "odd", "lines", "line_repeat", "shouts", "pipes", "ends"]


def statistics(text: Column, keep: list[str]) -> list[Column]:
    """Statistics of whole texts; null counts as empty. Shares of nothing are 0.

    Words are runs between white space. distinct and line_repeat are shares of different words and lines.
    """
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t).cast("double")
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    lines = F.array_remove(F.split(t, "\n"), "")
    n = F.size("__w").cast("double")
    m = F.size("__l").cast("double")

    def of(chars_: str) -> Column:
        return (F.length("__r") - F.length(F.translate("__r", chars_, ""))).cast("double")

    made = {
        "__w": words,
        "__l": lines,
        # What is neither a small letter nor white space: one pass over the text leaves little to count in.
        "__r": F.regexp_replace(t, r"[\x20\x09-\x0Da-z\x{00DF}-\x{00FF}]+", ""),
        "chars": chars,
        "words": n,
        "word_chars": F.col("chars") / F.greatest(n, F.lit(1.0)),
        "distinct": F.size(F.array_distinct("__w")) / F.greatest(n, F.lit(1.0)),
        "marks": of("#$%&*!|") / F.greatest("chars", F.lit(1.0)),
        "digits": of("0123456789") / F.greatest("chars", F.lit(1.0)),
        "upper": of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / F.greatest("chars", F.lit(1.0)),
        "odd": of("<>{}[]()_=/\\@~^+") / F.greatest("chars", F.lit(1.0)),
        "lines": m,
        "line_repeat": F.size(F.array_distinct("__l")) / F.greatest(m, F.lit(1.0)),
        "shouts": of("!") / F.greatest(n, F.lit(1.0)),
        "pipes": of("|") / F.greatest(n, F.lit(1.0)),
        "ends": of(".") / F.greatest(n, F.lit(1.0)),
    }
    return [made[k].alias(k) for k in keep]


def with_statistics(documents: DataFrame, text: str) -> DataFrame:
    """documents with STATS; columns of these names must be renamed before."""
    base = documents.select("*", *statistics(F.col(text), ["__w", "__l", "__r", "chars"]))
    return base.select("*", *statistics(F.col(text), STATS[1:])).drop("__w", "__l", "__r")


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, above, threshold), all of which must hold."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.bounds:
            out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
        return out

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, at in self.bounds:
            v = x[:, STATS.index(name)]
            out &= (v > at) if above else (v <= at)
        return out


@dataclass
class Model:
    base: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score, as an expression over STATS."""
        z = F.lit(self.base)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, tried: np.ndarray, path: tuple, out: set) -> None:
    """Gini splits at sample quantiles; every node below the root becomes a rule."""
    if path:
        out.add(Rule(tuple(sorted(path))))
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    best = (1e-9, None, None)
    total, pos = w.sum(), (w * y).sum()
    whole = pos * (total - pos) / total
    for j in tried:
        for at in np.unique(np.quantile(x[:, j], [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98])):
            left = x[:, j] <= at
            lw, lp = w[left].sum(), (w * y)[left].sum()
            if min(left.sum(), len(y) - left.sum()) < 5:
                continue
            gain = whole - lp * (lw - lp) / lw - (pos - lp) * (total - lw - pos + lp) / (total - lw)
            if gain > best[0]:
                best = (gain, j, float(at))
    if best[1] is None:
        return
    _, j, at = best
    left = x[:, j] <= at
    for side, above in ((left, False), (~left, True)):
        _grow(x[side], y[side], w[side], depth - 1, tried, path + ((STATS[j], above, at),), out)


def rules_from_trees(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, seed: int = 5) -> list[Rule]:
    """Paths of trees grown on resampled rows and on half of the statistics each."""
    rng, out = np.random.default_rng(seed), set()
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        tried = rng.permutation(len(STATS))[: len(STATS) // 2]
        _grow(x[rows], y[rows], balance[rows], depth, tried, (), out)
    return sorted(out, key=lambda r: repr(r.bounds))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 1500) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for mean log loss plus penalty times the sum of absolute weights; classes weigh alike."""
    c = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a1 = np.hstack([np.ones((len(a), 1)), a])
    step = 4 / np.linalg.norm(a1 * np.sqrt(c)[:, None], 2) ** 2
    w = v = np.zeros(a1.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a1 @ v, -30, 30)))
        new = v - step * (a1.T @ (c * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - step * penalty)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, t = new + (t - 1) / t2 * (new - w), t2
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w = new
    return float(w[0]), w[1:]


def held_out(key: Column, mod: int = 3, rest: int = 1) -> Column:
    return F.crc32(key.cast("string")) % mod == rest


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", penalty: float = 0.001) -> Model:
    """Learns from at most FIT_EACH labelled documents of each class. Only statistics reach the driver, no text. Without
    labels of both classes the score is that of the class there is, or one half."""
    y = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__k")).agg(F.max(label).alias("__y"))
    chosen = None
    for value in (1, 0):
        part = y.where(F.col("__y") == value).orderBy(F.xxhash64("__k"), "__k").limit(FIT_EACH)
        chosen = part if chosen is None else chosen.union(part)
    some = documents.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(chosen), "__k")
    rows = with_statistics(some, "__t").select("__k", "__y", *STATS).collect()
    rows.sort(key=lambda r: tuple(r))
    y_ = np.array([float(r["__y"]) for r in rows])
    if len(set(y_)) < 2:
        return Model(0.0 if not len(y_) else 10.0 * (2 * y_[0] - 1), [])
    x = np.array([[r[s] for s in STATS] for r in rows], float)
    rules = rules_from_trees(x, y_)
    base, weights = lasso_logistic(np.stack([r.holds(x) for r in rules], 1).astype(float), y_, penalty)
    return Model(base, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """key and the score of each whole text, 0 to 1, empty ones too; null is an empty text. Rows stand alone, other columns
    play no part, an empty table gives an empty one. No shuffle, no Python."""
    out = with_statistics(documents.select(F.col(key).alias("__k"), F.col(text).alias("__t")), "__t")
    return out.select(F.col("__k").alias(key), model.column().alias(name))

"""Match functions: classifiers of pairs on Spark ML, with one interface."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.similarity import strong_match
from kindred.operators.groups import block_groups, first_block, meet, sliced, spread
from kindred.operators.pairs import impute, pair_matrix, weak_columns, weak_features, weak_names
from kindred.operators.roc import precision_at, recall_at, roc_curve
from kindred.runtime import Scratch
from kindred.spec import Feature


class BlockScores:
    """Scores of all pairs within blocks, by groups of records that are alike in what a score reads."""

    def reads(self, records: DataFrame) -> set[str]:
        """Names of the columns that a score depends on, of x_<name>, strong, id_a and id_b."""
        raise NotImplementedError

    def group_scores(self, blocks: DataFrame, records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """(key, ids_a, ids_b, own, score, match) of groups that meet in a block, and the groups themselves: a score is that of
        all their pairs. Pairs that share several blocks are met once."""
        used = self.reads(records)
        weak = [f for f in self.features if f"x_{f.name}" in used]
        # Where the order of a pair matters, each record is a group of its own and the smaller id comes first.
        ordered = bool(used & {"id_a", "id_b"}) or any(f.use == "special_date_difference" for f in weak)
        columns = list(dict.fromkeys([f.column for f in weak] + [f.column for f in self.features if f.strength == "strong" and "strong" in used] + ["record_id"] * ordered))
        slices = sliced(block_groups(blocks, records, columns), scratch)
        met = first_block(meet(slices))
        if ordered:
            swap = F.col("ids_a")[0] > F.col("ids_b")[0]
            met = met.withColumns({x: F.when(swap, F.col(y)).otherwise(F.col(x)) for x, y in (("a", "b"), ("b", "a"), ("ids_a", "ids_b"), ("ids_b", "ids_a"))})
        keep = ["key", "ids_a", "ids_b", "own"]
        table = met.select(*keep, F.col("ids_a")[0].alias("id_a"), F.col("ids_b")[0].alias("id_b"), *weak_columns(self.features, used), *([strong_match(self.features).alias("strong")] if "strong" in used else []))
        return self.score_features(table).select(*keep, "score", self.matches().alias("match")), slices

    def score_blocks(self, blocks: DataFrame, records: DataFrame, scratch: Scratch | None = None) -> DataFrame:
        """(id_a, id_b, score, match) of all pairs of records that share a block, as score has them for candidate_pairs."""
        found, _ = self.group_scores(blocks, records, scratch or Scratch(records.sparkSession, "scores"))
        return spread(found, "score", "match")

    def block_edges(self, blocks: DataFrame, records: DataFrame, scratch: Scratch) -> DataFrame:
        """(src, dst) with the components of all matches within blocks: groups that match by their first records, and the records
        of each such group by its first one."""
        found, slices = self.group_scores(blocks, records, scratch)
        hits = scratch.keep(found.where("match").select("key", F.col("ids_a")[0].alias("src"), F.col("ids_b")[0].alias("dst")))
        met = hits.select("key", F.explode(F.array("src", "dst")).alias("dst")).distinct()
        stars = slices.where("size(ids) > 1").withColumn("dst", F.col("ids")[0]).join(met, ["key", "dst"]).select(F.explode("ids").alias("src"), "dst")
        return hits.select("src", "dst").union(stars).where("src <> dst")


class MatchFunction(BlockScores):
    """Learns from labelled pairs; scores any pairs with the training set's means for what is unknown.

    icar: whether merging can only help a match, which match-and-merge needs. strict: whether a score at the threshold is no
    match.
    """

    icar = False
    strict = True

    def __init__(self, records: DataFrame, labels: DataFrame, pairs: DataFrame, features: list[Feature], threshold: float = 0.5, seed: int = 0) -> None:
        self.features, self.threshold, self.seed = features, threshold, seed
        self.names = weak_names(features)
        matrix, self.means = pair_matrix(records, labels, pairs, features)
        table = self._assemble(matrix).select("v", F.col("y").cast("double").alias("y"))
        self.model = self.classifier(table.count(), len(self.names)).fit(table)

    def classifier(self, rows: int, width: int):
        raise NotImplementedError

    def _assemble(self, table: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.names, outputCol="v").transform(table)

    def matches(self, score: str = "score") -> Column:
        return F.col(score) > self.threshold if self.strict else F.col(score) >= self.threshold

    def reads(self, records: DataFrame) -> set[str]:
        return set(self.names)

    def score_features(self, table: DataFrame) -> DataFrame:
        """Adds score to a table with the feature columns."""
        scored = self.model.transform(self._assemble(impute(table, self.means)))
        return scored.withColumn("score", vector_to_array("probability")[1]).select(*table.columns, "score")

    def score(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        """(id_a, id_b, score, match) of all pairs, scored in one pass."""
        scored = self.score_features(weak_features(pairs.select("id_a", "id_b"), records, self.features))
        return scored.select("id_a", "id_b", "score", (self.matches() | (F.col("id_a") == F.col("id_b"))).alias("match"))

    def test(self, records: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """The ROC curve on labelled pairs."""
        matrix, _ = pair_matrix(records, labels, pairs, self.features, self.means)
        return roc_curve(self.score_features(matrix).select("score", F.col("y").alias("label")))

    def recall(self, curve: DataFrame) -> DataFrame:
        return recall_at(curve, self.threshold)

    def precision(self, curve: DataFrame) -> DataFrame:
        return precision_at(curve, self.threshold)


class LogisticMatch(MatchFunction):
    """Logistic regression with weights of at most 0: what is less alike is never more likely a match."""

    icar = True

    def __init__(self, *args, c: float = 1.0, **kwargs) -> None:
        self.c = c
        super().__init__(*args, **kwargs)

    def classifier(self, rows: int, width: int):
        bound = Matrices.dense(1, width, [0.0] * width)
        return LogisticRegression(featuresCol="v", labelCol="y", regParam=1 / (self.c * max(1, rows)), elasticNetParam=0.0, standardization=False, upperBoundsOnCoefficients=bound, maxIter=200)


class TreeMatch(MatchFunction):
    def classifier(self, rows: int, width: int):
        return DecisionTreeClassifier(featuresCol="v", labelCol="y", impurity="gini", maxDepth=30, maxBins=128, seed=self.seed)


class ForestMatch(MatchFunction):
    strict = False

    def classifier(self, rows: int, width: int):
        return RandomForestClassifier(featuresCol="v", labelCol="y", impurity="gini", numTrees=10, featureSubsetStrategy="sqrt", maxDepth=30, maxBins=128, seed=self.seed)


class RuleMatch(BlockScores):
    """A match function given as an expression over x_<name> columns, such as a fixed threshold on a sum."""

    def __init__(self, features: list[Feature], expression: Column, threshold: float = 0.5, icar: bool = False) -> None:
        self.features, self.expression, self.threshold, self.icar = features, expression, threshold, icar

    def reads(self, records: DataFrame) -> set[str]:
        schema = ", ".join(f"`{n}` double" for n in weak_names(self.features))
        empty = records.sparkSession.createDataFrame([], f"id_a bigint, id_b bigint, strong boolean{', ' if schema else ''}{schema}")
        found, names = empty.select(self.expression)._jdf.queryExecution().analyzed().references().iterator(), set()
        while found.hasNext():
            names.add(found.next().name())
        return names

    def matches(self, score: str = "score") -> Column:
        return F.col(score) >= self.threshold

    def score_features(self, table: DataFrame) -> DataFrame:
        return table.withColumn("score", self.expression)

    def score(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        table = self.score_features(weak_features(pairs.select("id_a", "id_b"), records, self.features))
        return table.select("id_a", "id_b", "score", self.matches().alias("match"))

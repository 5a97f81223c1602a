"""Features of pairs of records, imputation, and samples of pairs to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.similarity import strong_match, weak_feature
from kindred.operators.groups import meet, sliced, spread
from kindred.operators.sampling import uniform
from kindred.runtime import Scratch
from kindred.spec import Feature

#: Up to so many direct pairs are listed and the sample taken from the list; beyond, pairs are drawn.
LISTED = 4_000_000
#: Records with more strong values than this have their direct pairs listed, since counts go through subsets of values.
MOST_VALUES = 8


def with_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b, ...) with both records as structs a and b."""
    whole = F.struct(*records.columns)
    left = records.select(F.col("record_id").alias("id_a"), whole.alias("a"))
    right = records.select(F.col("record_id").alias("id_b"), whole.alias("b"))
    return pairs.join(left, "id_a").join(right, "id_b")


def weak_names(features: list[Feature]) -> list[str]:
    return [f"x_{f.name}" for f in features if f.strength == "weak"]


def weak_columns(features: list[Feature], names: list[str] | None = None) -> list[Column]:
    """x_<name> of structs a and b, for each weak feature in header order, or for those named."""
    return [weak_feature(f, F.col(f"a.{f.column}"), F.col(f"b.{f.column}")).alias(f"x_{f.name}") for f in features if f.strength == "weak" and (names is None or f"x_{f.name}" in names)]


def weak_features(pairs: DataFrame, records: DataFrame, features: list[Feature]) -> DataFrame:
    """Pairs with x_<name> for each weak feature, in header order, and strong (see strong_match)."""
    for f in features:
        f.check()
    carry = [c for c in pairs.columns if c not in ("id_a", "id_b")]
    return with_records(pairs, records).select("id_a", "id_b", *carry, *weak_columns(features), strong_match(features).alias("strong"))


def column_means(table: DataFrame, columns: list[str]) -> dict[str, float]:
    """Means over what is known; 0 for a column of which nothing is."""
    row = table.agg(*[F.coalesce(F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))), F.lit(0.0)).alias(c) for c in columns]).first()
    return row.asDict()


def impute(table: DataFrame, means: dict[str, float]) -> DataFrame:
    return table.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) for c, m in means.items()})


def pair_matrix(records: DataFrame, labels: DataFrame, pairs: DataFrame, features: list[Feature], means: dict[str, float] | None = None, fill: bool = True) -> tuple[DataFrame, dict[str, float]]:
    """(id_a, id_b, y, x_...) and the means that fill what is unknown. y is 1 for pairs of one cluster; a record's cluster is
    that of its smallest provenance id. Given means (of a training set) are used, else the pairs' own."""
    own = records.select("record_id", F.array_min("members").alias("m")).join(labels.select(F.col("record_id").alias("m"), "cluster_id"), "m").select("record_id", "cluster_id")
    a, b = own.toDF("id_a", "ca"), own.toDF("id_b", "cb")
    found = weak_features(pairs.select("id_a", "id_b"), records, features).join(a, "id_a").join(b, "id_b")
    found = found.withColumn("y", (F.col("ca") == F.col("cb")).cast("int")).select("id_a", "id_b", "y", *weak_names(features))
    if not fill:
        return found, {}
    means = means or column_means(found, weak_names(features))
    return impute(found, means), means


def merge_precomputed(pairs: DataFrame, records: DataFrame, precomputed: DataFrame) -> DataFrame:
    """Pairs with the least value of each precomputed feature over the two records' provenance ids.

    precomputed: (id_a, id_b, x...) in either order of ids.
    """
    names = [c for c in precomputed.columns if c not in ("id_a", "id_b")]
    ids = records.select("record_id", F.explode("members").alias("m"))
    each = pairs.join(ids.toDF("id_a", "ma"), "id_a").join(ids.toDF("id_b", "mb"), "id_b")
    each = each.withColumn("lo", F.least("ma", "mb")).withColumn("hi", F.greatest("ma", "mb"))
    known = precomputed.select(F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi"), *names)
    return each.join(known, ["lo", "hi"], "left").groupBy("id_a", "id_b").agg(*[F.min(n).alias(n) for n in names])


def cluster_pairs(labels: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of each two records of one cluster; large clusters are spread over tasks."""
    scratch = Scratch(labels.sparkSession, "clusters")
    groups = labels.where("cluster_id is not null").groupBy(F.col("cluster_id").alias("key")).agg(F.lit(True).alias("v"), F.collect_list("record_id").alias("ids"))
    return spread(meet(sliced(groups, scratch)))


def seed_counts(positives: float, negatives: float, balance: float | None, most: int = 5000) -> tuple[int, int]:
    """How many positive and negative pairs to take for a share ``balance`` of positives, the rarer kind at most ``most``."""
    total = positives + negatives
    if not positives:
        raise ValueError("every cluster has one record only")
    natural = positives / total
    balance = natural if balance is None else balance
    if natural < balance:
        p, n = positives, positives * (1 - balance) / balance
    else:
        p, n = balance * negatives / (1 - balance), negatives
    scale = min(1.0, most / min(p, n)) if min(p, n) > 0 else 1.0
    return int(p * scale), int(n * scale)


def _named_values(f: Feature, number: int) -> Column:
    zero = F.lit(0.0) if f.sql_type == "double" else None  # one name for both zeros
    return F.transform(F.coalesce(f.column, F.array().cast(f"array<{f.sql_type}>")), lambda x: F.concat(F.lit(f"{number}:"), (x if zero is None else x + zero).cast("string")))


def _urns(own: DataFrame, records: DataFrame, features: list[Feature], direct: bool, unknown: bool) -> tuple[DataFrame, DataFrame]:
    """Members (cluster_id, k, record_id) and urns (cluster_id, ka, kb, na, nb): pairs of a cluster that may be drawn are those of
    two members of ka and kb. Pairs with several strong values in common are in as many urns; v has these in order."""
    if not direct:
        members = own.select("cluster_id", F.lit("").alias("k"), "record_id", F.array(F.lit("")).alias("v"))
    else:
        strong = [f for f in features if f.strength == "strong"]
        for f in strong:
            f.check()
        values = [_named_values(f, i) for i, f in enumerate(strong)]
        known = F.concat(F.lit("?"), *[F.when(F.coalesce(F.size(f.column), F.lit(0)) > 0, "1").otherwise("0") for f in strong])
        v = F.array_sort(F.array_distinct(F.filter(F.concat(*values), lambda x: x.isNotNull()))) if strong else F.array().cast("array<string>")
        found = own.join(records.select("record_id", v.alias("v"), known.alias("known")), "record_id")
        part = F.array("known") if unknown else F.array().cast("array<string>")
        members = found.select("cluster_id", F.explode(F.concat("v", part)).alias("k"), "record_id", "v")
    sizes = members.groupBy("cluster_id", "k").agg(F.count("*").alias("n"))
    urns = sizes.where("n > 1 and k not like '?%'").select("cluster_id", F.col("k").alias("ka"), F.col("k").alias("kb"), F.col("n").alias("na"), F.col("n").alias("nb"))
    if direct and unknown:
        # Two records of which no strong feature is known on both sides; how many kinds of them there are goes with the features.
        masks = sizes.where("k like '?%'")
        both = F.exists(F.zip_with(F.split("ka", ""), F.split("kb", ""), lambda x, y: (x == "1") & (y == "1")), lambda x: x)
        met = masks.toDF("cluster_id", "ka", "na").join(masks.toDF("cluster_id", "kb", "nb"), "cluster_id").where("ka < kb or (ka = kb and na > 1)").where(~both)
        urns = urns.unionByName(met.select("cluster_id", "ka", "kb", "na", "nb"))
    return members, urns


def _urn_pairs() -> Column:
    return F.when(F.col("ka") == F.col("kb"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))


def _listed(members: DataFrame, urns: DataFrame) -> DataFrame:
    a = members.select("cluster_id", F.col("k").alias("ka"), F.col("record_id").alias("x"))
    b = members.select("cluster_id", F.col("k").alias("kb"), F.col("record_id").alias("y"))
    met = urns.select("cluster_id", "ka", "kb").join(a, ["cluster_id", "ka"]).join(b, ["cluster_id", "kb"]).where("(ka = kb and x < y) or ka < kb")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _drawn(members: DataFrame, urns: DataFrame, want: int, of: int, seed: int, scratch: Scratch) -> DataFrame:
    """want or more distinct pairs, each of the ``of`` pairs as likely as any other.

    Members of an urn lie in hashed slots, as many as members; a draw takes two slots and the pairs between them, the smaller id
    from the first, so each pair is met by a draw at the same rate. Of a pair's urns only the first counts.
    """
    wanted = 2 * want + 200
    while True:
        urn = [F.col(c).cast("string") for c in ("cluster_id", "ka", "kb")]
        expected = F.lit(wanted / of) * F.col("na") * F.col("nb")
        times = urns.withColumn("times", (F.floor(expected) + (uniform(*urn, F.lit(seed + wanted)) < expected - F.floor(expected)).cast("int")).cast("int")).where("times > 0")
        each = times.select("cluster_id", "ka", "kb", "na", "nb", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("t"))
        slot = lambda side, n: F.floor(uniform(*urn, F.col("t"), F.lit(side), F.lit(seed + wanted)) * F.col(n))
        draws = scratch.keep(each.select("*", slot("a", "na").alias("slot_a"), slot("b", "nb").alias("slot_b")))
        sides = []
        for side in "ab":
            # Draws, and so the urns that have some, are few whatever the number of members.
            active = F.broadcast(draws.select("cluster_id", F.col(f"k{side}").alias("k"), F.col(f"n{side}").alias("n")).distinct())
            placed = members.join(active, ["cluster_id", "k"]).withColumn("slot", F.pmod(F.xxhash64("record_id", F.lit(seed)), F.col("n")))
            taken = F.broadcast(draws.select("cluster_id", F.col(f"k{side}").alias("k"), F.col(f"slot_{side}").alias("slot"), "ka", "kb", "t"))
            sides.append(placed.join(taken, ["cluster_id", "k", "slot"]).select("cluster_id", "ka", "kb", "t", F.col("record_id").alias(f"r{side}"), F.col("v").alias(f"v{side}")))
        met = sides[0].join(sides[1], ["cluster_id", "ka", "kb", "t"]).where("ka <> kb or ra < rb")
        first = (F.col("ka") != F.col("kb")) | F.col("ka").startswith("?") | (F.get(F.array_intersect("va", "vb"), F.lit(0)) == F.col("ka"))
        found = scratch.keep(met.where(first).select(F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b")).distinct())
        if found.count() >= want:
            return found
        wanted *= 2


def _positives(own: DataFrame, records: DataFrame, features: list[Feature], direct: bool, unknown: bool, scratch: Scratch) -> tuple[int, object]:
    """How many pairs of a cluster there are to draw from, and a function from a number to that many or more of them."""
    members, urns = _urns(own, records, features, direct, unknown)
    members, urns = scratch.keep(members), scratch.keep(urns)
    row = urns.agg(F.sum(_urn_pairs()).alias("w"), F.sum(F.when(F.col("ka").startswith("?"), _urn_pairs())).alias("u")).first()
    most = members.agg(F.max(F.size("v"))).first()[0] or 0
    if (row["w"] or 0) <= LISTED or most > MOST_VALUES:
        pairs = scratch.keep(_listed(members, urns))
        return pairs.count(), lambda want, seed: pairs
    count = row["w"]
    if most > 1:
        # Pairs with a value in common: those of each value, less those of each two, and so on.
        whole = members.where("k = get(v, 0)").select("cluster_id", F.explode(F.transform(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("v")) - 1), lambda m: F.filter("v", lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))).alias("s"))
        kinds = whole.groupBy("cluster_id", "s").agg(F.count("*").alias("n"))
        sign = F.when(F.size("s") % 2 == 1, 1).otherwise(-1)
        count = (kinds.agg(F.sum(sign * F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0) + (row["u"] or 0)

    def draw(want: int, seed: int) -> DataFrame:
        return _listed(members, urns) if want * 8 > count else _drawn(members, urns, want, int(count), seed, scratch)

    return int(count), draw


def pair_seed(records: DataFrame, labels: DataFrame, features: list[Feature], balance: float | None = 0.5, most: int = 5000, direct: bool = True, unknown_is_direct: bool = True, seed: int = 0) -> DataFrame:
    """(id_a, id_b, y): a sample of pairs, the same for the same seed.

    Positives are drawn from pairs of one cluster, with ``direct`` only from those that strong features don't deny (pairs of
    which nothing is known count as direct if so asked). The wanted numbers follow from the pairs that are there after that,
    so sampling always ends. Beyond LISTED pairs they are counted and drawn without listing them. Negatives are drawn by joining
    records in two hashed orders and leaving out pairs of a cluster.
    """
    scratch = Scratch(records.sparkSession, "positives")
    own = scratch.keep(records.select("record_id").join(labels.select("record_id", "cluster_id"), "record_id"))
    n_positives, draw = _positives(own.where("cluster_id is not null"), records, features, direct, unknown_is_direct, scratch)
    sizes = own.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p")).first()
    n = sizes["n"] or 0
    negatives = n * (n - 1) / 2 - (sizes["p"] or 0)
    want_p, want_n = seed_counts(float(n_positives), negatives, balance, most)
    chosen = draw(want_p, seed).orderBy(F.xxhash64("id_a", "id_b", F.lit(seed)), "id_a", "id_b").limit(want_p).withColumn("y", F.lit(1))
    rounds = max(1, min(64, int(4 * want_n / max(1, n)) + 1))
    tries = own.select(F.col("record_id").alias("r"), F.col("cluster_id").alias("c"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("k"))
    tries = tries.withColumn("slot", F.pmod(F.xxhash64("r", "k", F.lit(seed)), F.lit(max(1, n))))
    other = own.select(F.pmod(F.xxhash64("record_id", F.lit(seed + 1)), F.lit(max(1, n))).alias("slot"), F.col("record_id").alias("s"), F.col("cluster_id").alias("d"))
    apart = tries.join(other, "slot").where("c <> d").select(F.least("r", "s").alias("id_a"), F.greatest("r", "s").alias("id_b")).distinct()
    apart = apart.orderBy(F.xxhash64("id_a", "id_b", F.lit(seed)), "id_a", "id_b").limit(want_n).withColumn("y", F.lit(0))
    return chosen.unionByName(apart)

"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each source gets a target in words and each of its documents the same fractional number of copies. Whole copies are taken as
they are; the fractions are paired, and mass in words moves at random from one document of a pair to the other until one of
the two is integral, which keeps both every document's expectation and the source's total. Pairing runs through groups of
about ``GROUP`` documents; the one fraction that each leaves goes on to a group of the next level, a tree of depth log N.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.runtime import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
GROUP = 64
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space; null counts 0."""
    rest = F.regexp_replace(text, WORDS, "x")
    return F.coalesce(F.length(F.translate(rest, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(skey, n words of each source) to skey, source_size, target.

    Sources in code point order, null last, weigh 1, 2, 3 and again; they share all words by weight. A target stops at most
    times its source's size, and what is over is shared again by weight: with sources ordered by size / weight, the share of
    a unit of weight is the largest of (words - the caps before) / (weights from here on). The windows run over one row for
    each source, not over documents.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("skey") == "", "skey")) - 1) % 3 + 1)
    ranked = ranked.withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everyone = Window.partitionBy(F.lit(1))
    unit = F.max(F.greatest(F.lit(0.0), F.col("share"))).over(everyone)
    ranked = ranked.withColumn("share", (F.sum("source_size").over(everyone) - before) / left)
    return ranked.select("skey", "source_size", F.least("cap", F.col("weight") * unit).alias("target"))


def _uniform(*cols: Column) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _pivot(items: Column, level: int, seed: int) -> Column:
    """Struct of done (items whose fraction p became 0 or 1) and left (the one that didn't; null if none)."""
    item = "struct<h:bigint,id:bigint,w:bigint,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("left"), F.array().cast(f"array<{item}>").alias("done"))

    def with_p(x: Column, p: Column) -> Column:
        p = F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)
        return F.struct(x["h"].alias("h"), x["id"].alias("id"), x["w"].alias("w"), p.alias("p"))

    def merge(state: Column, b: Column) -> Column:
        a = state["left"]
        up = F.least(a["w"] * (1 - a["p"]), b["w"] * b["p"])
        down = F.least(a["w"] * a["p"], b["w"] * (1 - b["p"]))
        rises = _uniform(a["h"], b["h"], F.lit(level), F.lit(seed)) * (up + down) < down
        move = F.when(rises, up).otherwise(-down)
        pair = F.array(with_p(a, a["p"] + move / a["w"]), with_p(b, b["p"] - move / b["w"]))
        left = F.get(F.filter(pair, lambda x: (x["p"] > 0) & (x["p"] < 1)), F.lit(0))
        done = F.filter(pair, lambda x: (x["p"] <= 0) | (x["p"] >= 1))
        both = F.struct(left.alias("left"), F.concat(state["done"], done).alias("done"))
        return F.when(a.isNull(), F.struct(b.alias("left"), state["done"].alias("done"))).otherwise(both)

    return F.aggregate(items, start, merge)


def plan(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """One row for each distinct (key, source, size): key, skey, size, source_size, target, rows, copies, extra.

    Of ``rows`` equal rows each is taken copies times, and extra of them once more. skey is the source after ``=``, or empty
    for null, which is a source of its own. Rows repeated any number of times are one item with their joint fraction, so no
    group can grow with them. Documents without words are taken 0 times. Nulls in key are a value like others. An empty
    table gives an empty plan; reruns give the same, whatever the partitions.
    """
    scratch = scratch or Scratch(documents.sparkSession, "mixing")
    skey = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    items = documents.select(F.col(key).cast("bigint").alias("id"), skey.alias("skey"), word_count(F.col(text)).alias("size"))
    items = scratch.keep(items.groupBy("id", "skey", "size").agg(F.count("*").alias("rows")))
    sizes = items.groupBy("skey").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goal = scratch.keep(targets(sizes, most).coalesce(1))
    count = items.count()
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    whole = F.when(F.col("ratio") >= most, most).otherwise(F.floor(F.col("ratio") + EPS))
    shared = items.join(goal, "skey").withColumn("ratio", ratio).withColumn("copies", F.when(F.col("size") > 0, whole).otherwise(0).cast("bigint"))
    part = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("ratio") - F.col("copies"))).otherwise(0.0) * F.col("rows")
    shared = shared.withColumn("sure", F.floor(part + EPS).cast("bigint")).withColumn("p", F.greatest(F.lit(0.0), part - F.col("sure")))
    base = shared.select("id", "skey", "size", "source_size", "target", "rows", "copies", "sure", "p", F.xxhash64("id", "skey", "size", F.lit(seed)).alias("h"))

    def fractional() -> DataFrame:
        return base.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS)).select("skey", F.struct("h", "id", F.col("size").alias("w"), "p").alias("x"))

    now, level, decided = fractional(), 0, []
    while True:
        groups = max(1, math.ceil(count / GROUP ** (level + 1)))
        node = F.pmod(F.xxhash64(F.col("x.h"), F.lit(level)), F.lit(groups))
        step = now.groupBy("skey", node.alias("node")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
        step = scratch.keep(step.select("skey", _pivot(F.col("xs"), level, seed).alias("s")))
        decided.append(step.select("skey", F.explode("s.done").alias("x")))
        now, level = step.where("s.left is not null").select("skey", F.col("s.left").alias("x")), level + 1
        if groups == 1:
            break
    last = now.select("skey", "x.*").withColumn("p", (_uniform(F.col("h"), F.lit(-1), F.lit(seed)) < F.col("p")).cast("double"))
    drawn = last.select("skey", "h", "id", "w", "p")
    for d in decided:
        drawn = drawn.union(d.select("skey", "x.h", "x.id", "x.w", "x.p"))
    drawn = drawn.where("p = 1").select(F.col("skey").alias("k"), F.col("id").alias("i"), F.col("w").alias("s"))
    same = (F.col("k") == F.col("skey")) & F.col("i").eqNullSafe(F.col("id")) & (F.col("s") == F.col("size"))
    extra = F.col("sure") + F.when(F.col("p") > 1 - EPS, 1).when(F.col("k").isNotNull(), 1).otherwise(0)
    out = base.join(drawn, same, "left").withColumn("extra", extra)
    return out.select(F.col("id").alias(key), "skey", "size", "source_size", "target", "rows", "copies", F.col("extra").cast("bigint").alias("extra"))


def copies_of_rows(planned: DataFrame) -> DataFrame:
    """A row for each document again, with its own number of copies."""
    each = planned.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("nth"))
    return each.withColumn("times", F.col("copies") + (F.col("nth") <= F.col("extra")).cast("bigint")).drop("nth", "rows", "copies", "extra")


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, seed: int = 7) -> DataFrame:
    """The mixed documents: documents' own columns, each row as many times as the plan takes it.

    Whole texts are shuffled once, to meet their plan. Rows that share key, source and size share its extra copies by their
    order within equal keys; that order is by content, so reruns agree.
    """
    planned = plan(documents, key, text, source, most, seed).where("copies + extra > 0")
    cols = [f"__c{i}" for i in range(len(documents.columns))]
    at = dict(zip(documents.columns, cols))
    body = documents.toDF(*cols).withColumn("__s", F.coalesce(F.concat(F.lit("="), F.col(at[source]).cast("string")), F.lit("")))
    body = body.withColumn("__n", word_count(F.col(at[text])))
    same = F.col(at[key]).cast("bigint").eqNullSafe(F.col(key)) & (F.col("__s") == F.col("skey")) & (F.col("__n") == F.col("size"))
    met = body.join(planned, same)
    single = met.where("rows = 1").select(*cols, (F.col("copies") + F.col("extra")).alias("times"))
    # Equal rows collapse before they are shuffled; rows that differ under one key share its extra copies in turn.
    many = met.where("rows > 1").groupBy(*cols, "__s", "__n", "copies", "extra").agg(F.count("*").alias("alike"))
    order = Window.partitionBy(at[key], "__s", "__n").orderBy(F.xxhash64(*cols))
    before = F.coalesce(F.sum("alike").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("alike"), F.col("extra") - before))
    many = many.select(*cols, (F.col("alike") * F.col("copies") + more).alias("times"))
    out = single.union(many).where("times > 0").select(*cols, F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("__z"))
    return out.select(*cols).toDF(*documents.columns)

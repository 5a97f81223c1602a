"""MinHash near-dedup with odd sketches.

Each distinct shingle set gets MinHash samples. Bands of samples give candidates; all samples folded into a parity bitmap
(an odd sketch) tell from the population count of an XOR which candidates can be similar enough; those are confirmed on
full sets. Copies collapse first, and hot buckets are linked through their smallest member.

Whatever is still apart within a bucket then gets a finer odd sketch. Members of a bucket of up to HOT are compared with one
another. Those of a larger one, which are many only because they share much that is below the limit, are banded again, by
longer bands and as many of them as a pair at the limit needs, so work grows with members, not with their square. A bucket
that is hot even so is compared in blocks, none of its members left out. Of members that may link, only the best for each
member and component is carried on; all pairs of two components follow only where those fail.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.names import free
from kindred.llm.shingles import mix, shingle_sets
from kindred.operators.components import connected_components
from kindred.runtime import Scratch

HOT = BLOCK = 1024
CHUNK = 256
LONGS = 8
BINS = 4096


@dataclass(frozen=True)
class Settings:
    """Links are pairs with 100 * intersection >= percent * union of k-word shingles. At the limit a pair is missed by all
    bands with probability (1 - J^rows)^bands: 8e-7 for 0.85, 7e-7 for 0.8 with four rows."""

    k: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_odd(self) -> int:
        """Bits in which sketches of a pair at the limit can differ: the mean and five deviations of their number."""
        n, j, k = 64 * LONGS, self.percent / 100, self.samples
        differ = k * (1 - j)
        mean = n / 2 * (1 - (1 - 2 / n) ** (2 * differ))
        spread = math.sqrt(4 * k * j * (1 - j) + mean * (1 - mean / n))
        return min(n, math.ceil(mean + 5 * spread))


    @property
    def fine_rows(self) -> int:
        """Of a longer band: 15 at 0.85, 11 at 0.8. What fills a bucket by sharing 0.8 or 0.7 of its shingles shares few of these."""
        return int(math.log(0.075) / math.log(self.percent / 100))

    @property
    def fine_bands(self) -> int:
        """As few as miss a pair at the limit with a probability below 1e-6: about 150."""
        return math.ceil(math.log(1e-6) / math.log(1 - (self.percent / 100) ** self.fine_rows))


CONTRACT = Settings(k=3, percent=85, bands=24, rows=5)


def _features(sets: Iterator[np.ndarray], s: Settings) -> Iterator[tuple]:
    """(size, digest, digest, band keys, sketch) of each set."""
    rng = np.random.default_rng(7)
    odd = rng.integers(1, 1 << 62, s.samples, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    salt = mix(np.arange(1, s.samples + 1, dtype=np.uint64))
    band_salt = mix(np.arange(1001, 1001 + s.bands, dtype=np.uint64))
    for x in sets:
        if not len(x):
            yield 0, 0, 0, [], [0] * LONGS
            continue
        y = mix(x)
        least = np.empty(s.samples, np.uint64)
        for at in range(0, len(y), 8192):
            part = y[at : at + 8192]
            for i in range(s.samples):
                low = (part * odd[i]).min()
                if at == 0 or low < least[i]:
                    least[i] = low
        h = mix(least + salt)
        rows = h.reshape(s.bands, s.rows)
        key = band_salt
        for r in range(s.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
        bits = np.bincount((h >> np.uint64(40)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) & 1
        sketch = np.packbits(bits.astype(np.uint8)).view(np.int64)
        yield len(x), int(y.sum().view(np.int64)), int(mix(y + np.uint64(1)).sum().view(np.int64)), key.view(np.int64), sketch


def features(documents: DataFrame, s: Settings, key: str, text: str) -> DataFrame:
    """(id, n, d1, d2, bands, s0..s7) of each row; d1 and d2 stand for the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_features(shingle_sets(batch.column(1), s.k), s))
            columns = list(zip(*found)) or [()] * 5
            sketch = np.array(columns[4], np.int64).reshape(-1, LONGS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(columns[i], pa.int64()) for i in range(3)], pa.array(columns[3], pa.list_(pa.int64())), *[pa.array(sketch[:, i]) for i in range(LONGS)]],
                names=["id", "n", "d1", "d2", "bands", *[f"s{i}" for i in range(LONGS)]],
            )

    schema = "id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, " + ", ".join(f"s{i} bigint" for i in range(LONGS))
    return documents.select(F.col(key).cast("bigint").alias("id"), F.col(text)).mapInArrow(run, schema)


def _may_link(s: Settings) -> Column:
    """The odd sketches' verdict, and what the sizes allow."""
    odd = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(LONGS)), F.lit(0))
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * s.percent
    return sizes & (odd <= s.most_odd)


def _confirm(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Of (x, y) pairs those linked on full sets, as (src, dst).

    Pairs of one y are split into chunks; y's text goes to each chunk once and is read first, so a task holds one set of
    shingles at a time, however many documents are near one.
    """
    chunks = pairs.groupBy("y").agg(F.count("*").alias("c"))
    pairs = pairs.join(chunks, "y").withColumn("chunk", F.pmod(F.xxhash64("x"), F.floor(F.col("c") / CHUNK) + 1)).drop("c")
    rows = pairs.select("y", "chunk", F.lit(1).alias("role"), F.col("x").alias("id"))
    rows = rows.union(pairs.select("y", "chunk").distinct().select("y", "chunk", F.lit(0), F.col("y")))
    wanted = rows.join(texts, "id").repartition("y", "chunk").sortWithinPartitions("y", "chunk", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = None, None
        for batch in batches:
            ys, chunk, role, ids = (batch.column(i).to_pylist() for i in range(4))
            src, dst = [], []
            for i, own in enumerate(shingle_sets(batch.column(4), s.k)):
                if role[i] == 0:
                    at, base = (ys[i], chunk[i]), own
                elif at == (ys[i], chunk[i]):
                    both = len(np.intersect1d(own, base, assume_unique=True))
                    if 100 * both >= s.percent * (len(own) + len(base) - both) and both:
                        src.append(ids[i])
                        dst.append(ys[i])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return wanted.select("y", "chunk", "role", "id", "t").mapInArrow(run, "src bigint, dst bigint").distinct()


def _precise(texts: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """(id, n, size, odd): a finer odd sketch of wanted documents. Its sample is the least shingle of each of BINS bins, nearly
    the whole set for all but long texts; size is the sample's, n the set's."""
    wanted = texts.join(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - BINS.bit_length() + 1)
        for batch in batches:
            n, size, odd = [], [], []
            for x in shingle_sets(batch.column(1), s.k):
                y = np.sort(mix(x))
                sample = y[np.append(True, np.diff(y >> shift) != 0)] if len(y) else y
                bits = np.bincount((mix(sample + np.uint64(5)) % np.uint64(BINS)).astype(np.int64), minlength=BINS) & 1
                n.append(len(x))
                size.append(len(sample))
                odd.append(np.packbits(bits.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(odd, pa.binary())], names=["id", "n", "size", "odd"])

    return wanted.select("id", "t").mapInArrow(run, "id bigint, n bigint, size bigint, odd binary").dropDuplicates(["id"])


def _fine(texts: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """(rep, key): longer bands of other MinHash samples of wanted documents."""
    n = s.fine_bands * s.fine_rows
    odd = np.random.default_rng(11).integers(1, 1 << 62, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    band_salt = mix(np.arange(5001, 5001 + s.fine_bands, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(shingle_sets(batch.column(1), s.k)):
                if not len(x):
                    continue
                y, least = mix(x ^ np.uint64(0x5DEECE66D)), np.full(n, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(y), 256):
                    least = np.minimum(least, (y[at : at + 256, None] * odd).min(axis=0))
                rows, key = mix(least).reshape(s.fine_bands, s.fine_rows), band_salt
                for r in range(s.fine_rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], s.fine_bands), pa.array(key.view(np.int64))], names=["rep", "key"])

    return texts.join(ids, "id").select("id", "t").mapInArrow(run, "rep bigint, key bigint").distinct()


def most_odd(n: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Bits in which precise sketches can differ for pairs at the limit, from sums of their set and sample sizes: the most that
    can be expected, with five deviations for sampling and five for folding. A bin's least shingle is in one set only with
    probability 1 - J, and then the other's sample holds another one, unless the other's bin is empty: size * (1 - J) differ
    where bins are full, and fewer where they aren't."""
    j = percent / 100
    sampling = 2 * np.sqrt(size / (1 + j) * j * (1 - j) * np.maximum(0, 1 - size / np.maximum(1, n)))
    differ = size * (1 - j) + 5 * sampling + 2
    p = np.power(1 - 2 / BINS, differ)
    variance = BINS / 4 * (1 - p * p) + BINS * (BINS - 1) / 4 * (np.power(1 - 4 / BINS, differ) - p * p)
    return BINS / 2 * (1 - p) + 5 * np.sqrt(np.maximum(0, variance)) + 1


def _open(members: DataFrame) -> DataFrame:
    """(key, c) of buckets with more than one component, c being the number of members."""
    return members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("key", "c")


def _apart(members: DataFrame, s: Settings, every: bool = False) -> DataFrame:
    """(x, y, cx, cy) of a bucket's members in different components cx < cy whose precise sketches allow a link: in each cell, for
    each member and component the one that differs least, or every one.

    Buckets are cut into blocks of about BLOCK members and every two blocks meet in one cell, which is compared row by row.
    """
    counts = members.groupBy("key").agg(F.count("*").alias("c"))
    split = members.join(counts, "key").withColumn("blocks", F.floor(F.col("c") / BLOCK) + 1)
    split = split.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    cells = split.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    cells = cells.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    names = ["key", "i", "j", "rep", "component", "n", "size", "odd"]
    rows = cells.select(*names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def compare(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        table, bits = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        rep, component, n, size = table.T
        xs, ys, cx, cy = [rep[:0]], [rep[:0]], [rep[:0]], [rep[:0]]
        for i in range(len(rep) - 1):
            at = np.flatnonzero(component[i + 1 :] != component[i]) + i + 1
            at = at[np.minimum(n[at], n[i]) * 100 >= np.maximum(n[at], n[i]) * s.percent]
            odd = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1)
            fits = odd <= most_odd(n[at] + n[i], size[at] + size[i], s.percent)
            hit = at[fits]
            if not every and len(hit) > 1:
                order = np.lexsort((rep[hit], odd[fits], component[hit]))
                hit = hit[order]
                hit = hit[np.append(True, np.diff(component[hit]) != 0)]
            xs.append(rep[hit])
            ys.append(np.full(len(hit), rep[i]))
            cx.append(np.minimum(component[hit], component[i]))
            cy.append(np.maximum(component[hit], component[i]))
        return tuple(map(np.concatenate, (xs, ys, cx, cy)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out() -> pa.RecordBatch:
            found = compare(held) if held else (np.zeros(0, np.int64),) * 4
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], names=["x", "y", "cx", "cy"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(i).to_numpy() for i in range(7)], 1)
            bits = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(len(table), -1)
            change = np.flatnonzero((table[1:, :3] != table[:-1, :3]).any(axis=1)) + 1
            for part, own in zip(np.split(table, change), np.split(bits, change)):
                if now is not None and tuple(part[0, :3]) != now:
                    yield out()
                    held = []
                now = tuple(part[0, :3])
                held.append((part[:, 3:], own))
        yield out()

    return rows.mapInArrow(run, "x bigint, y bigint, cx bigint, cy bigint").where("x <> y").distinct()


def groups(documents: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row for each row: key, n_shingles, component_id (smallest key reachable over links), kept (key = component_id).

    Null, empty and blank texts have no shingles and link with nothing. Equal sets are one class from the start, with its
    smallest key, so copies cost no pairs. key should be unique; rows repeated whole come out alike, and rows that share a
    key but not a text are linked as one document. Other columns play no part. An empty table gives an empty one.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "near")
    wide = [f"s{i}" for i in range(LONGS)]
    feat = scratch.keep(features(documents, s, key, text))
    firsts = [F.first(c).alias(c) for c in ["bands", *wide]]
    classes = scratch.keep(feat.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *firsts))
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = scratch.keep(banded.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").drop("last"))
    in_bucket = scratch.keep(banded.join(shared, "key"))
    sketches = classes.select("rep", "n", *wide)
    pairs = in_bucket.where("rep <> lead").select(F.col("rep").alias("x"), F.col("lead").alias("y")).distinct()

    def allowed(pairs: DataFrame) -> DataFrame:
        a, b = sketches.alias("a"), sketches.alias("b")
        return pairs.join(a, F.col("x") == F.col("a.rep")).join(b, F.col("y") == F.col("b.rep")).where(_may_link(s)).select("x", "y").distinct()

    first = scratch.keep(allowed(pairs))
    # The one shuffle of texts. At scale the ids are never few, so the plan is made the same for every size.
    ids = in_bucket.select(F.col("rep").alias("id")).distinct().hint("merge")
    texts = scratch.keep(documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).join(ids, "id", "left_semi"))
    edges = scratch.keep(_confirm(first, texts, s))
    part = scratch.keep(connected_components(edges, scratch))

    def placed(rows: DataFrame, part: DataFrame) -> DataFrame:
        return rows.select("key", "rep").join(part, F.col("rep") == F.col("id"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))

    # Only buckets with more than one component still need looking into.
    members = placed(in_bucket, part)
    members = scratch.keep(members.join(_open(members), "key"))
    cold, hot = members.where(F.col("c") <= HOT).drop("c"), members.where(F.col("c") > HOT)
    if not hot.isEmpty():
        fine = scratch.keep(placed(_fine(texts, hot.select(F.col("rep").alias("id")).distinct(), s), part))
        cold = scratch.keep(cold.union(fine.join(_open(fine).drop("c"), "key")))
    precise = scratch.keep(_precise(texts, cold.select(F.col("rep").alias("id")).distinct(), s)).withColumnRenamed("id", "rep")
    tested, final = first.select("x", "y"), part
    for every in (False, True):
        left = placed(cold, final)
        left = left.join(_open(left).drop("c"), "key")
        second = _apart(left.join(precise, "rep"), s, every)
        # Ends of pairs stand as they were made; a pair that was tested either way round isn't tested again.
        both = tested.union(tested.select(F.col("y").alias("x"), F.col("x").alias("y")))
        second = scratch.keep(second.join(both, ["x", "y"], "left_anti"))
        if second.isEmpty():
            break
        # One pair settles two components where it is confirmed; the others are tried where it isn't.
        one = scratch.keep(second.groupBy("cx", "cy").agg(F.min(F.struct("x", "y")).alias("p")).select("p.x", "p.y"))
        for rest in (False, True):
            if rest:
                now = [final.select(F.col("id").alias(v), F.col("component").alias(f"n{v}")) for v in "xy"]
                pairs = second.select("x", "y").join(one, ["x", "y"], "left_anti").join(now[0], "x", "left").join(now[1], "y", "left")
                pairs = scratch.keep(pairs.where(F.coalesce("nx", "x") != F.coalesce("ny", "y")).select("x", "y"))
                if pairs.isEmpty():
                    break
            more = scratch.keep(_confirm(pairs if rest else one, texts, s))
            if not more.isEmpty():
                edges = scratch.keep(edges.union(more))
                final = scratch.keep(connected_components(edges, scratch))
        tested = scratch.keep(tested.union(second.select("x", "y")).distinct())
    named = classes.join(final, F.col("rep") == F.col("id"), "left").where("copies > 1 or component is not null")
    named = named.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("m"), F.coalesce("component", "rep").alias("component"))
    found = feat.select("id", "n", "d1", "d2").join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("m")), "left")
    component = F.coalesce("component", "id")
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def keep_one(documents: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents without those that another of their group stands for, columns as they are, whatever their names.

    Nulls, empty and very long texts, ties, repeated rows and empty tables are as in groups.
    """
    name = free("__k", documents.columns)
    extra = groups(documents.select(key, text), s, key, text).where(~F.col("kept")).select(F.col(key).alias(name)).distinct().hint("merge")
    return documents.join(extra, F.col(key).cast("bigint") == F.col(name), "left_anti")

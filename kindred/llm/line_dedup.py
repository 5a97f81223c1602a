"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words, A-Z taken as a-z. A line goes if an earlier one that stays is within the edit bound:
one edited word (changed, left out or put in) for lines of five words or more, none for shorter ones, where a word is too much
of the line. A line's neighbourhood is itself and itself without any one of its words, as hashed keys:

* lines that agree without their i-th word differ at most there, so all that share the key (variant, i, length) are within the
  bound of one another: a group in which the first line that stays settles all after it;
* a line that equals another's variant is that other with a word left out: a group of one whole line and longer ones, which
  the whole line settles, or is settled by.

Groups list their members, not pairs, and what a key claims is verified on the words themselves. Which lines stay follows from
the groups in rounds: each keeps the lines that have no undecided earlier neighbour and drops what those reach.

Only lines that can have a neighbour emit variants: cut a line in half, and one half of any neighbour is the same, so two
hashed halves (for its own and for the next greater length) are counted first, and only positions in the other half emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kindred.llm.names import free
from kindred.llm.shingles import mix, texts_of, word_hashes
from kindred.runtime import Scratch

MIN_WORDS = 5
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


class Ranges:
    """Hashes of any range of a sequence of words, from prefix sums."""

    def __init__(self, words: np.ndarray, base: int = _BASES[0]) -> None:
        self.power = np.full(len(words) + 1, base, np.uint64)
        self.back = np.full(len(words) + 1, pow(base, -1, 1 << 64), np.uint64)
        self.power[0] = self.back[0] = 1
        self.power, self.back = np.cumprod(self.power), np.cumprod(self.back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self.power[:-1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.of(start, at) + self.of(at + 1, end) * self.power[at - start]


def _tagged(h: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(tag.astype(np.uint64) + np.uint64(77)))


def _lines(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each line, line number, first word, end word) and the words of runs of rows."""
    for row, _end, data, offsets in texts_of(column):
        # A line break between rows keeps their words apart.
        n = len(offsets) - 1
        where = np.arange(n) + offsets[:-1]
        spaced = np.full(len(data) + n, 10, np.uint8)
        hole = np.zeros(len(data) + n, bool)
        hole[where] = True
        spaced[~hole] = data
        starts, words = word_hashes(spaced)
        breaks = np.flatnonzero(spaced == 10)
        first = np.searchsorted(starts, breaks)
        end = np.append(first[1:], len(starts))
        own = np.searchsorted(where, breaks, side="right") - 1
        number = np.arange(len(breaks)) - np.searchsorted(breaks, where)[own]
        yield row + own, number, first, end, words


def line_table(documents: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(doc, line, f, g, halves) of every line with a word; f and g stand for its words; only lines of ``least`` have halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0)
            for row, number, start, end, words in _lines(batch.column(1)):
                keep = np.flatnonzero(end > start)
                row, number, start, end = row[keep], number[keep], start[keep], end[keep]
                a, b, n = Ranges(words), Ranges(words, _BASES[1]), end - start
                f, g = _tagged(a.of(start, end), n), _tagged(b.of(start, end), n)
                large = n >= least
                places = pa.array(np.append(0, np.cumsum(4 * large)).astype(np.int32))
                start, end, n = start[large], end[large], n[large]
                p, q = n // 2, (n + 1) // 2
                halves = [
                    _tagged(a.of(start, start + p), 4 * n), _tagged(a.of(start + p, end), 4 * n + 1),
                    _tagged(a.of(start, start + q), 4 * (n + 1)), _tagged(a.of(end - (n + 1 - q), end), 4 * (n + 1) + 1),
                ]
                flat = pa.array(np.stack(halves, 1).astype(np.uint64).view(np.int64).ravel() if len(n) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.take(pa.array(row)), pa.array(number.astype(np.int32)),
                        pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), pa.ListArray.from_arrays(places, flat),
                    ],
                    names=["doc", "line", "f", "g", "halves"],
                )

    return documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text)).mapInArrow(run, "doc bigint, line int, f bigint, g bigint, halves array<bigint>")


def _pick(documents: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, line, mask, t): the texts of wanted lines, whose numbers and masks come as one list for each document."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("line", "mask")).alias("ls"))
    met = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t")).join(lists, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, t, ls in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = (t or "").split("\n")
                out += [(doc, x["line"], x["mask"], lines[x["line"]]) for x in ls if x["line"] < len(lines)]
            cols = list(zip(*out)) or [()] * 4
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc", "line", "mask", "t"])

    return met.select("doc", "t", "ls").mapInArrow(run, "doc bigint, line int, mask int, t string")


def _variants(lines: DataFrame) -> DataFrame:
    """(key, i, n, doc, line): the words but the i-th for positions the mask allows, and with i = -1 all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, numbers = batch.column(0), batch.column(1)
            masks = batch.column(2).to_numpy()
            for row, _, first, end, words in _lines(batch.column(3)):
                ranges, n = Ranges(words), end - first
                mask, half = masks[row], n // 2
                lo = np.where(mask & 2, 0, half)
                hi = np.where(mask & 1, n, half)
                count = np.maximum(0, hi - lo)
                who = np.repeat(np.arange(len(row)), count)
                i = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + lo[who]
                whole = np.flatnonzero(mask & 4)
                keys = np.concatenate((_tagged(ranges.without(first[who], end[who], first[who] + i), n[who] - 1), _tagged(ranges.of(first[whole], end[whole]), n[whole])))
                at = np.concatenate((who, whole))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.view(np.int64)), pa.array(np.concatenate((i, np.full(len(whole), -1))).astype(np.int32)), pa.array(n[at].astype(np.int32)),
                        docs.take(pa.array(row[at])), numbers.take(pa.array(row[at])),
                    ],
                    names=["key", "i", "n", "doc", "line"],
                )

    return lines.mapInArrow(run, "key bigint, i int, n int, doc bigint, line int")


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACE = str.maketrans("\t\x0b\x0c\r", "    ")
#: Members of a group by role: any of those that differ in one word; the whole line; the longer ones. What each is settled by.
_SAME, _WHOLE, _LONGER = 0, 1, 2
_AGAINST = {_SAME: _SAME, _WHOLE: _LONGER, _LONGER: _WHOLE}


def _words(line: str) -> list[str]:
    return [w for w in line.translate(_LOWER).translate(_SPACE).split(" ") if w]


def near(a: str, b: str) -> bool:
    """Whether two lines are at most one edited word apart."""
    x, y = _words(a), _words(b)
    if abs(len(x) - len(y)) > 1:
        return False
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    return x[k + 1 :] == y[k + 1 :] or x[k + 1 :] == y[k:] or x[k:] == y[k + 1 :]


def _groups(keys: DataFrame) -> DataFrame:
    """(gid, role, i, doc, line, lead) of groups with something to settle; lead is the line that stands for the group's text."""
    place = F.struct("doc", "line")
    same = keys.where("i >= 0").groupBy("key", "i", "n").agg(F.min(place).alias("lead"), F.max(place).alias("last")).where("lead <> last").drop("last")
    some = keys.where("i >= 0").join(same, ["key", "i", "n"]).select(F.xxhash64("key", "i", "n").alias("gid"), F.lit(_SAME).alias("role"), "i", "doc", "line", "lead")
    whole = F.min(F.when(F.col("i") < 0, place))
    ends = keys.groupBy("key").agg(whole.alias("lead"), F.max("i").alias("most")).where("lead is not null and most >= 0").drop("most")
    role = F.when(F.col("i") < 0, _WHOLE).otherwise(_LONGER)
    return some.union(keys.join(ends, "key").select(F.xxhash64("key").alias("gid"), role, "i", "doc", "line", "lead"))


def _verified(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(gid, role, doc, line) of members whose words are what the group's lead says."""
    texts = lines.select("doc", "line", "t")
    met = members.join(texts, ["doc", "line"]).join(texts.select(F.struct("doc", "line").alias("lead"), F.col("t").alias("u")), "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for role, i, t, u in zip(*(batch.column(k).to_pylist() for k in (1, 4, 5, 6))):
                own, lead = _words(t), _words(u)
                if role == _SAME:
                    hit.append(len(own) == len(lead) and own[:i] == lead[:i] and own[i + 1 :] == lead[i + 1 :])
                else:
                    hit.append(own == lead if role == _WHOLE else own[:i] + own[i + 1 :] == lead)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(hit, pa.bool_()))

    return met.select("gid", "role", "doc", "line", "i", "t", "u").mapInArrow(run, "gid bigint, role int, doc bigint, line int")


def settle(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, line) of the lines that go, from (gid, role, doc, line) members of groups.

    A round takes two joins over the members of groups that are still open, whatever the size of a group, and is written to
    the shared folder. The first undecided line is decided in every round; of lines in random order a few rounds decide all.
    """
    place = F.struct("doc", "line")
    now = scratch.keep(members.select("gid", "role", "doc", "line", F.lit(False).alias("stays")).distinct())
    gone = []
    while True:
        least = [F.min(F.when((F.col("role") == r) & (F.col("stays") == stays), place)).alias(f"{name}{r}") for r in _AGAINST for name, stays in (("kept", True), ("open", False))]
        seen = now.join(now.groupBy("gid").agg(*least), "gid")

        def before(name: str) -> Column:
            hit = F.lit(False)
            for role, other in _AGAINST.items():
                hit = F.when(F.col("role") == role, F.coalesce(F.col(f"{name}{other}") < place, F.lit(False))).otherwise(hit)
            return F.max(hit)

        found = seen.where(~F.col("stays")).groupBy("doc", "line").agg(before("kept").alias("goes"), before("open").alias("waits"))
        found = scratch.keep(found.where("goes or not waits"))
        if found.isEmpty():
            break
        gone.append(found.where("goes").select("doc", "line"))
        after = now.join(found, ["doc", "line"], "left").where("goes is null or not goes").select("gid", "role", "doc", "line", F.expr("stays or goes is not null").alias("stays"))
        still = after.where(~F.col("stays")).select("gid").distinct()
        step = scratch.keep(after.join(still, "gid", "left_semi"))
        scratch.drop(now)
        now = step
    out = members.select("doc", "line").limit(0)
    for part in gone:
        out = out.union(part)
    return out


def dropped_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc, lines): the numbers, from 0, of the lines that go, for each document that loses any.

    Earliest is by key, then line number; ties are the same line of rows repeated whole, which lose the same lines. Keys are
    taken as numbers and should be unique but for that; a null key never comes first. Null and empty texts and lines without
    a word lose nothing; texts of any length are read whole; an empty table gives an empty one.
    """
    scratch = scratch or Scratch(documents.sparkSession, "lines")
    table = scratch.keep(line_table(documents, key, text, least))
    place = F.struct("doc", "line")
    once = scratch.keep(table.groupBy("f", "g").agg(F.min(place).alias("at"), F.count("*").alias("times"), F.first("halves").alias("halves")))
    halves = once.select("f", "at", F.posexplode("halves").alias("side", "half"))
    shared = halves.groupBy("half").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo <> hi").select("half")
    bit = F.when(F.col("side") == 0, 1).when(F.col("side") == 1, 2).otherwise(4)
    wanted = halves.join(shared, "half").groupBy("at").agg(F.bit_or(bit).cast("int").alias("mask")).select("at.doc", "at.line", "mask")
    lines = scratch.keep(_pick(documents, wanted, key, text))
    keys = scratch.keep(_variants(lines))
    gone = settle(_verified(_groups(keys), lines), scratch).withColumn("gone", F.lit(True))
    heads = once.select("f", "g", "times", "at", F.col("at.doc").alias("doc"), F.col("at.line").alias("line")).join(gone, ["doc", "line"], "left")
    heads = heads.where("times > 1 or gone").select("f", "g", "at", F.coalesce("gone", F.lit(False)).alias("gone"))
    out = table.select("doc", "line", "f", "g").join(heads, ["f", "g"]).where(F.col("gone") | (place != F.col("at")))
    return out.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines"))


@F.arrow_udf(StringType())
def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines of the given numbers."""
    out = []
    for text, numbers in zip(texts.to_pylist(), gone.to_pylist()):
        if text is not None and numbers:
            drop = set(numbers)
            text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)
        out.append(text)
    return pa.array(out, pa.string())


#: A filter on the text that is left isn't pushed below it: that would run it twice, in two Python workers of each task, and
#: workers stay, with what they hold.
_without = _without.asNondeterministic()


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", least: int = MIN_WORDS) -> DataFrame:
    """documents with the text that is left, and behind them the numbers of lines before and dropped, __lines and __gone.

    What goes is said by dropped_lines. Null and empty texts stay as they are. A text without all of its lines is empty, not
    null. length, if there is such a column, is counted again where a text changed. Other columns are carried along, whatever
    their names; a number whose name is taken gets underscores behind it. An empty table gives an empty one.
    """
    doc, drop, before, gone = (free(name, documents.columns) for name in ("__doc", "__drop", "__lines", "__gone"))
    out = documents.join(dropped_lines(documents, key, text, least).toDF(doc, drop), F.col(key).cast("bigint") == F.col(doc), "left")
    cols = [_without(F.col(text), F.col(drop)).alias(text) if c == text else F.col(f"`{c}`") for c in documents.columns]
    lines = F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1)
    out = out.select(*cols, lines.alias(before), F.coalesce(F.size(drop), F.lit(0)).alias(gone))
    if length and length in documents.columns:
        size = F.when(F.col(gone) > 0, F.length(text)).otherwise(F.col(length)).cast(documents.schema[length].dataType)
        out = out.withColumn(length, size)
    return out

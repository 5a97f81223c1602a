"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, both on whole labelled texts. A text is cut into
windows of a few words; where the toxic dictionary compresses a window better than the ordinary one by more than a margin,
that is evidence, and evidence is calibrated against labels.

Before training and compressing alike, words are recoded: a word of any length becomes CODE bytes that stand for it and for how
often the text has had it so far. Two codes are incompressible against each other, so a dictionary helps with words it holds
and lengths don't hang on shared letters. Characters of scripts without spaces between words are words of their own.

Inputs of a score are texts alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.runtime import Scratch

_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{_UNSPACED}]+|\w")
CODE = 16
WINDOW = 2 * CODE
MARGIN = 5
#: A word's code changes with the second, third and fifth time that a text has it.
_STEPS = ("", "", " 2", " 3", " 3", " 5")
#: Bounds of the fitting sample: documents of each class, the first by hash of key.
FIT_TOXIC, FIT_ORDINARY = 2500, 5000
#: A dictionary is trained on codes in so large a share of its documents, and in so many of them, or more. The ordinary one goes
#: further down, so that what chance put above the toxic one's line is mostly known to it.
TOXIC_SHARE, TOXIC_LEAST, ORDINARY_SHARE, ORDINARY_LEAST = 0.01, 6, 0.002, 2
FOLDS = 4
_HEADER = 64


class Codes(dict):
    """Codes of words with their step; emptied when it has many."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 200_000:
            self.clear()
        code = self[word] = xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass"))
        return code


def recode(text: str | None, codes: Codes) -> list[bytes]:
    """The code of every word of the whole text, in lower case."""
    counts: dict[str, int] = {}
    out = []
    for word in WORD.findall((text or "").lower()):
        n = counts[word] = counts.get(word, 0) + 1
        out.append(codes[word] if n == 1 else codes[word + _STEPS[n if n < 5 else 5]])
    return out


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: list[float]
    rate: float = 0.0

    def __post_init__(self) -> None:
        self.ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ready": None}

    def gains(self, text: str | None) -> list[int]:
        """Bytes that the toxic dictionary saves over the ordinary one on each window; none without dictionaries."""
        if not self.toxic:
            return []
        if self.ready is None:
            self.ready = _compressor(self.toxic).compress, _compressor(self.ordinary).compress, Codes()
        toxic, ordinary, codes = self.ready
        stream = b"".join(recode(text, codes))
        windows = [stream[k : k + WINDOW] for k in range(0, len(stream), WINDOW)]
        return [len(ordinary(w)) - len(toxic(w)) for w in windows]

    def sums(self, text: str | None) -> list[float]:
        """Largest gain over the margin, sum of gains over the margin, and number of windows."""
        gains = self.gains(text)
        over = [g for g in gains if g > MARGIN]
        return [max(over, default=0) / 16, (sum(over) - MARGIN * len(over)) / 16, len(gains)]

    def evidence(self, text: str | None) -> list[float]:
        return measures(self.sums(text), self.rate)

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.evidence(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def measures(sums: list[float], rate: float) -> list[float]:
    """Largest gain, and what the sum exceeds that of so many windows of ordinary text by, as a logarithm and in deviations."""
    most, total, windows = sums
    beyond = total - rate * windows
    return [most, math.log1p(max(0.0, beyond)), beyond / math.sqrt(max(1, windows))]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """A strategy with two hash tables, with room for every position of the dictionary: codes lost to collisions would look like
    codes that it lacks. Nothing is written around the compressed bytes."""
    own, wide = zstandard.ZstdCompressionDict(dictionary), len(dictionary).bit_length() + 1
    settings = zstandard.ZstdCompressionParameters.from_level(
        1, source_size=2 * WINDOW, dict_size=len(dictionary), strategy=zstandard.STRATEGY_DFAST, min_match=7, hash_log=wide, chain_log=wide,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    own.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=settings)


def train(joined: bytes | pa.Buffer, documents: int, share: float, least: int) -> bytes:
    """A zstandard dictionary of documents, given as the joined codes that each has, one document after another.

    Codes in fewer documents than both bounds ask for are left out, and there is room for all others. Every code is a sample of
    its own, so no piece of the dictionary straddles two. The trainer lets its header overwrite the pieces that it takes first,
    from the first samples; filling in front of them takes that loss. Equal codes are one object, so millions take little room.
    """
    codes = np.frombuffer(joined, np.uint64).reshape(-1, 2) if len(joined) else np.zeros((0, 2), np.uint64)
    _, first, which, counts = np.unique(codes[:, 0], return_index=True, return_inverse=True, return_counts=True)
    fine = counts >= max(least, share * documents)
    names = [codes[k].tobytes() if ok else None for k, ok in zip(first, fine)]
    which = which[fine[which]].astype(np.int32)
    del joined, codes
    room = int(fine.sum()) + _HEADER
    samples = [xxhash.xxh3_128_digest(b"filling %d" % i) for i in range(_HEADER) for _ in range(len(which) // room + 2)]
    samples += map(names.__getitem__, which)
    del which
    return zstandard.train_dictionary(room * CODE, samples, k=CODE, d=8, f=23, accel=1).as_bytes()


def sketch(text: str | None, n: int = 3) -> list[int]:
    """Three min-hashes of word trigrams."""
    words = WORD.findall((text or "").lower()) or [""]
    grams = {zlib.crc32(" ".join(words[i : i + n]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - n + 1))}
    h = np.fromiter(grams, np.uint64, len(grams))
    return [int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in (2654435761, 2246822519, 3266489917)]


def unlike(sketches: list[list[int]]) -> list[int]:
    """Positions of those that share no min-hash with one before. Copies would make every rare word in them look telling; losing
    some that merely share a phrase does no harm to a sample."""
    seen, kept = set(), []
    for k, keys in enumerate(set(enumerate(s)) for s in sketches):
        if seen.isdisjoint(keys):
            kept.append(k)
        seen |= keys
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 60) -> list[float]:
    """Newton's method; the rarer class weighs more, by the square root of the odds."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, weight = np.zeros(a.shape[1]), np.where(y == 1, math.sqrt((len(y) - y.sum() + 1) / (y.sum() + 1)), 1.0)
    reg = np.diag([1e-6, *[ridge * len(y) / 100] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + reg, a.T @ (weight * (y - p)) - reg @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def held_out(key: Column, mod: int = 5, rest: int = 0) -> Column:
    return F.crc32(key.cast("string")) % mod == rest


def _traits(texts: DataFrame) -> DataFrame:
    """(key, y, sketch, codes) of (key, y, text) rows; codes joins the distinct codes of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            found = [v.as_py() for v in batch.column(2)]
            joined = [b"".join(dict.fromkeys(recode(t, codes))) for t in found]
            columns = [batch.column(0), batch.column(1), pa.array(map(sketch, found), pa.list_(pa.int64())), pa.array(joined, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "y", "sketch", "codes"])

    return texts.mapInArrow(run, f"key {df_type(texts, 'key')}, y int, sketch array<bigint>, codes binary")


def _order(row: dict) -> bytes:
    return xxhash.xxh3_64_digest(str(row["key"]))


def _models(traits: DataFrame, folds: dict) -> list[Model]:
    """Without weights: for each fold, a model of the others, and at the end one of all. The sample is bounded, and training takes
    memory, so one task reads it once, without a shuffle, and makes them one after another; no executor holds two at a time."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()) if r[0] in folds]
        rows.sort(key=lambda r: _order({"key": r[0]}))
        for part in range(FOLDS + 1):
            pair = []
            for y, share, least in ((1, TOXIC_SHARE, TOXIC_LEAST), (0, ORDINARY_SHARE, ORDINARY_LEAST)):
                own = [codes for k, of, codes in rows if of == y and folds[k] != part]
                pair.append(train(b"".join(own), len(own), share, least))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([d], pa.binary()) for d in pair)], names=["part", "toxic", "ordinary"])

    rows = traits.select("key", "y", "codes").coalesce(1).mapInArrow(build, "part int, toxic binary, ordinary binary").collect()
    return [Model(bytes(r["toxic"]), bytes(r["ordinary"]), []) for r in sorted(rows, key=lambda r: r["part"])]


def _evidence(texts: DataFrame, folds: dict, models: list[Model]) -> DataFrame:
    """(y, x) of (key, y, text) rows in a fold: sums by the model that was trained without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(y, models[folds[k]].sums(t)) for k, y, t in zip(*(batch.column(i).to_pylist() for i in range(3))) if k in folds]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], names=["y", "x"])

    return texts.mapInArrow(run, "y int, x array<double>")


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", scratch: Scratch | None = None) -> Model:
    """Learns from at most FIT_TOXIC and FIT_ORDINARY labelled documents, whole texts, the first by hash of key. Of copies among
    them one counts. Calibration is by FOLDS parts, each measured with dictionaries trained on the others. Null labels are
    none, of several for a key the largest counts, of several texts for a key the least. Where labels of a class are missing
    or too few to train on, every score is 0.
    """
    y = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    chosen = None
    for value, most in ((1, FIT_TOXIC), (0, FIT_ORDINARY)):
        part = y.where(F.col("y") == value).orderBy(F.xxhash64("key"), "key").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    scratch = scratch or Scratch(documents.sparkSession, "toxicity")
    # The chosen side has at most FIT_TOXIC + FIT_ORDINARY rows of two numbers.
    met = documents.select(F.col(key).alias("key"), F.col(text).alias("t")).join(F.broadcast(chosen), "key")
    texts = scratch.keep(met.groupBy("key", "y").agg(F.min("t").alias("t")))
    traits = scratch.keep(_traits(texts.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, "key")))
    rows = sorted(traits.where(F.length("codes") > 0).select("key", "y", "sketch").collect(), key=_order)
    toxic, ordinary = ([r for r in rows if r["y"] == value] for value in (1, 0))
    toxic, ordinary = ([some[k] for k in unlike([r["sketch"] for r in some])] for some in (toxic, ordinary))
    folds = {r["key"]: k % FOLDS for some in (toxic, ordinary) for k, r in enumerate(some)}
    if min(len(toxic), len(ordinary)) < 2 * FOLDS:
        return Model(b"", b"", [-500.0, 0.0, 0.0, 0.0])
    models = _models(traits, folds)
    x = _evidence(texts, folds, models).collect()
    plain = [r["x"] for r in x if not r["y"]]
    rate = sum(v[1] for v in plain) / max(1, sum(v[2] for v in plain))
    weights = _logistic(np.array([measures(r["x"], rate) for r in x]), np.array([r["y"] for r in x], float))
    return Model(models[FOLDS].toxic, models[FOLDS].ordinary, weights, rate)


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """key and the score of each whole text, 0 to 1; null and empty texts have no window and the score of no evidence.

    Rows stand alone: repeated rows score alike, other columns play no part, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["key", "score"])

    schema = f"key {df_type(documents, key)}, score double"
    return documents.select(key, text).mapInArrow(run, schema).toDF(key, name)


def keep_clean(documents: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """documents whose score is below the limit, columns and rows as they are; one pass, without a shuffle.

    Null and empty texts have the score of no evidence, like any text without words; texts of any length are read whole; rows
    repeated whole stay or go together; other columns are carried along, whatever their names; an empty table gives an empty
    one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.filter(pa.array([model.score(v.as_py()) < limit for v in batch.column(at)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def df_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()

"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules are packed side by side into Shift-And masks of as many 64-bit words as they need; one pass over a URL's bytes
simulates all of them at once, and one numpy operation advances a whole batch of URLs by one byte.

Globs: ``*`` is any run without a slash, ``**`` any run, ``?`` any one character; everything else stands for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.names import free

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` fits itself and all subdomains, ``path`` is a prefix; both may hold wildcards."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


class Automaton:
    """Shift-And masks of several globs. Bit k of a glob's field: its first k tokens have matched."""

    def __init__(self, globs: list[str]) -> None:
        steps: dict[int, list[int]] = {}
        loops: dict[int, list[int]] = {}
        start, final, at = [], [], 0
        every, tail = list(range(256)), list(range(0x80, 0xC0))
        for glob in globs:
            start.append(at)
            raw, k = glob.encode(), 0
            while k < len(raw):
                if raw[k : k + 2] == b"**":
                    loops[at] = every
                    k += 2
                elif raw[k : k + 1] == b"*":
                    loops.setdefault(at, [b for b in every if b != 0x2F])
                    k += 1
                else:
                    at += 1
                    if raw[k : k + 1] == b"?":
                        steps[at] = [b for b in every if b not in tail]
                        loops[at] = tail
                    else:
                        steps[at] = [raw[k]]
                    k += 1
            final.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        for masks, found in ((self.step, steps), (self.loop, loops)):
            for bit, values in found.items():
                masks[values, bit // 64] |= np.uint64(1 << (bit % 64))
        self.start = np.zeros(self.words, np.uint64)
        for bit in start:
            self.start[bit // 64] |= np.uint64(1 << (bit % 64))
        self.final = [(bit // 64, np.uint64(1 << (bit % 64))) for bit in final]
        ends = np.zeros(self.words, np.uint64)
        for word, bit in self.final:
            ends[word] |= bit
        self.settled = ends & np.bitwise_and.reduce(self.loop, axis=0)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """[text, glob] booleans."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if n else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        state = np.repeat(self.start[None, :], n, axis=0)
        ends = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        for k, active in enumerate(ends):
            now = state[:active]
            if k % 16 == 0 and not np.any(now & ~self.settled):
                break
            byte = data[offsets[:active] + k]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.step[byte]) | (now & self.loop[byte])
        out = np.empty((n, len(self.final)), bool)
        for g, (word, bit) in enumerate(self.final):
            out[order, g] = (state[:, word] & bit) != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path, both empty for a url that is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def longest_rule(rules: list[Rule]):
    """A pandas UDF from the canonical text ``.host/path`` to the position in rules of the one that wins, or -1.

    The longest rule wins; of equally long ones a block wins, then the earlier one.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), rules[i].verdict != "block", i))
    globs = [rules[i].glob for i in order]

    @F.pandas_udf("int")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(globs)
        ranked = np.array([*order, -1], np.int32)
        for texts in batches:
            hit = automaton.matches([t.encode() for t in texts])
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), len(globs)) if globs else np.zeros(len(texts), int)
            yield pd.Series(ranked[first])

    return find


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (the winning rule's ``host/path``, else null) and verdict (the rule's, else default).

    Columns of these names in pages are replaced. Null, empty and malformed urls have an empty host and path, fit no rule
    and get the default. Equal urls get equal verdicts; an empty table gives an empty one.
    """
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    out = pages.select(*kept, host.alias("host"), path.alias("path"))
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    k = longest_rule(rules)(F.concat(F.lit("."), "host", "path"))
    place = free("__k", [*out.columns, "rule", "verdict"])
    out = out.withColumn(place, k)
    return out.select(
        *kept,
        "host",
        "path",
        F.when(F.col(place) >= 0, F.get(names, F.col(place))).alias("rule"),
        F.when(F.col(place) >= 0, F.get(verdicts, F.col(place))).otherwise(default).alias("verdict"),
    )

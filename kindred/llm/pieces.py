"""SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a piece of text the table holds the one token its encoding ends with. The automaton lists the tokens
that end at a position, longest first; a token is the one if the last token of the prefix before it and it are compatible,
that is, if encoding their joined text gives just the two. Ids are then recovered backwards.

Nothing merges across a place where a space symbol follows another character (no piece holds such a place, which is checked
when a model is loaded), or across a character without a piece, so texts are cut there and the parts' ids kept in a bounded
table. Runs of space symbols, whose pieces tie in score, and any part that the table can't settle go through merging itself.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
PART = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, raw[i : i + n]
            i += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", raw[i : i + n])[0]
            i += n


class Memo(dict):
    """A function's values, kept for between half of and all of the last ``size`` distinct arguments."""

    def __init__(self, make: Callable, size: int) -> None:
        super().__init__()
        self.make, self.half, self.old = make, size // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Pieces:
    """A BPE model with byte fallback; encode and decode agree with the sentencepiece library."""

    def __init__(self, path: str, memo: int = 500_000) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix = True
        with open(path, "rb") as f:
            raw = f.read()
        for number, value in _fields(raw):
            if number == 1:
                one = dict(_fields(value))
                self.pieces.append(one[1].decode())
                self.scores.append(one.get(2, 0.0))
                self.kinds.append(one.get(3, NORMAL))
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("only BPE models are read")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only the identity normalizer that keeps white space is read")
                self.dummy_prefix = bool(spec.get(3, 1))
        if USER in self.kinds:
            raise ValueError("user-defined pieces are not read")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte_ids = [0] * 256
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        self.end = self.pieces.index("</s>")
        self.cuts_hold = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        #: Whether the joined text of two tokens, as first << 20 | second, is encoded as just the two.
        self.compatible = Memo(self._compatible, memo)
        #: Ids of a part, as text, and the decoded text of such ids.
        self.ids_of, self.text_of = Memo(self._ids_of, memo), Memo(self._text_of, memo)
        self.plain = {str(i): p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.alone = [False] * len(self.pieces)
        for piece, i in self.ids.items():
            self.alone[i] = self.merge(piece) == [i]

    def merge(self, text: str) -> list[int]:
        """Encoding by merging the best-scored adjacent pair again and again, the leftmost first of equals."""
        n = len(text)
        parts: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else n
            if a >= 0 and b < n and (i := self.ids.get(joined := parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (-self.scores[i], a, b, joined))

        for a in range(n - 1):
            offer(a)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        out: list[int] = []
        for part in parts:
            if part is not None:
                i = self.ids.get(part)
                out += [i] if i is not None else [self.byte_ids[x] for x in part.encode()]
        return out

    def _compatible(self, pair: int) -> bool:
        a, b = pair >> 20, pair & 0xFFFFF
        return self.merge(self.pieces[a] + self.pieces[b]) == [a, b]

    def by_table(self, text: str) -> list[int] | None:
        """Encoding by the prefix table; None if some prefix has no token, as before a character without a piece."""
        table, sizes, compatible, alone = [-1] * (len(text) + 1), [0] * (len(text) + 1), self.compatible, self.alone
        for last, (i, n) in self.automaton.iter(text):
            k = last + 1
            if table[k] < 0 and alone[i]:
                back = table[k - n]
                if k == n or back >= 0 and compatible[back << 20 | i]:
                    table[k], sizes[k] = i, n
        out, k = [], len(text)
        while k:
            if table[k] < 0:
                return None
            out.append(table[k])
            k -= sizes[k]
        return out[::-1]

    def encode_part(self, text: str) -> list[int]:
        found = None if SPACE * 2 in text or not self.cuts_hold else self.by_table(text)
        return self.merge(text) if found is None else found

    def _ids_of(self, part: str) -> str:
        return " ".join(map(str, self.encode_part(part)))

    def _text_of(self, part: str) -> str:
        ids = self.ids_of[part].split()
        try:
            return "".join([self.plain[i] for i in ids])
        except KeyError:
            return self.surface([int(i) for i in ids])

    def prepared(self, text: str) -> str:
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def parts(self, text: str) -> list[str]:
        """Where the text can be cut so that nothing merges across."""
        ready = self.prepared(text)
        return PART.findall(ready) if self.cuts_hold else [ready] if ready else []

    def encode(self, text: str) -> list[int]:
        """Ids with the end id last."""
        return [i for part in self.parts(text) for i in self.encode_part(part)] + [self.end]

    def surface(self, ids: list[int]) -> str:
        """Text of ids: space symbols as spaces, runs of byte pieces as UTF-8, each bad byte as U+FFFD, controls as nothing."""
        out, run = [], bytearray()

        def flush() -> None:
            k = 0
            while k < len(run):
                lead = run[k]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                try:
                    out.append(run[k : k + n].decode())
                except UnicodeDecodeError:
                    out.append("�")
                    n = 1
                k += n
            run.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run.append(int(self.pieces[i][1:-1], 16))
                continue
            if run:
                flush()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """As the library's decode: the space symbol that was put before the text is taken away again."""
        text = self.surface(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if self.dummy_prefix and first is not None and self.pieces[first].startswith(SPACE) else text


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model, once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_table(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", ids: bool = False, digests: bool = True) -> DataFrame:
    """key, n_tokens and, as asked, ids (array<int>) and ids_sha256 and decoded_sha256 of each whole text.

    Null and empty texts have the end id only. Rows stand alone: repeated rows come out alike, other columns are ignored,
    an empty table gives an empty one. Memory beside the batch is two tables of bounded size in each Python worker. Texts go
    through part by part, so a very long one needs a few times its own size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(model)
        end = str(coder.end)
        for batch in batches:
            counts, listed, one, two = [], [], [], []
            for value in batch.column(1):
                parts = coder.parts(value.as_py() or "")
                joined = " ".join([*map(coder.ids_of.__getitem__, parts), end])
                counts.append(joined.count(" ") + 1)
                if ids:
                    listed.append(np.fromstring(joined, np.int32, sep=" "))
                if digests:
                    decoded = "".join(map(coder.text_of.__getitem__, parts))
                    if coder.dummy_prefix and parts and coder.pieces[int(coder.ids_of[parts[0]].split(" ", 1)[0])].startswith(SPACE):
                        decoded = decoded[1:]
                    one.append(hashlib.sha256(joined.encode()).hexdigest())
                    two.append(hashlib.sha256(decoded.encode()).hexdigest())
            cols, names = [batch.column(0), pa.array(counts, pa.int64())], ["key", "n_tokens"]
            if ids:
                cols, names = [*cols, pa.array(listed, pa.list_(pa.int32()))], [*names, "ids"]
            if digests:
                cols, names = [*cols, pa.array(one, pa.string()), pa.array(two, pa.string())], [*names, "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"key {df.schema[key].dataType.simpleString()}, n_tokens bigint" + ", ids array<int>" * ids
    schema += ", ids_sha256 string, decoded_sha256 string" * digests
    return df.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)

"""Problem 8: encoding a corpus with a public byte-level BPE tokenizer as a streaming transducer, and decoding it again.

The transducer reads a piece byte by byte. For every prefix it keeps only the last token of that prefix's encoding; this is
unique: the token is a suffix of the prefix, and the pair made of it and of the last token before it re-encodes to itself. A
token is emitted once it is stable, that is once all prefixes which a later byte can still extend share it. How far back such
a prefix can lie is the merge list's sufficient lookahead: the longest token but one byte. Memory is bounded by a small multiple of it.

Between two characters that no token of the vocabulary can join, the needed lookahead is zero: both sides are encoded alone.
"""

from __future__ import annotations

import base64
import codecs
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import code_points, map_batches

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces and pairs remembered by one worker before the memory is emptied.
MEMO = 150_000
#: White space as the pattern has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(kinds: str) -> str:
    """A character class of all code points whose general category starts with one of `kinds`."""
    out, begin = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in kinds
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return "".join(out)


def piece_pattern() -> re.Pattern[str]:
    """The public pre-tokenizer of this vocabulary family: contractions, letters, numbers, other signs, white space."""
    letters, numbers = _ranges("L"), _ranges("N")
    space = r"\t-\r\x85 \xa0  -     　"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """A rank table and what follows from it: tries, valid pairs, the lookahead."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.lookahead = self.longest - 1
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._prefixes: set[bytes] | None = None
        #: Endings by last byte: the lengths of tokens that end so, longest first.
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            lengths.setdefault(t[-2:], set()).add(len(t))
        self._lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        #: Splits of tokens at a boundary with a non-ASCII side, by the two bytes at the boundary.
        self._splits: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
        for t in ranks:
            for k in range(1, len(t)):
                if t[k - 1] >= 0x80 or t[k] >= 0x80:
                    self._splits.setdefault((t[k - 1], t[k]), []).append((t[:k], t[k:]))

    def extends(self, tail: bytes) -> bool:
        """Whether some longer token begins with tail."""
        if self._prefixes is None:
            self._prefixes = {t[:k] for t in self.ranks for k in range(1, len(t))}
        return tail in self._prefixes

    def merge(self, data: bytes) -> list[bytes]:
        """The encoding by its definition: again and again the pair of lowest rank, leftmost first. For short inputs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def valid(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are when they stand side by side."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > MEMO:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def endings(self, data: bytes, end: int, begin: int) -> Iterator[bytes]:
        """Tokens that end at `end` and start at `begin` or later, longest first."""
        for n in self._lengths.get(data[max(begin, end - 2) : end], ()):
            if end - n >= begin and data[end - n : end] in self.ranks:
                yield data[end - n : end]
        if end - begin >= 2:
            yield data[end - 1 : end]


class Transducer:
    """Reads bytes, emits token ids as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.data, self.last, self.before = vocabulary, bytearray(), [], b""
        #: The last token emitted; only pairs with it bind what follows.

    def feed(self, more: bytes) -> Iterator[int]:
        for byte in more:
            self.data.append(byte)
            end = len(self.data)
            tail = bytes(self.data[-self.v.longest :])
            for token in self.v.endings(tail, len(tail), 0):
                start = end - len(token)
                previous = self.last[start - 1] if start else self.before
                if not previous or self.v.valid(previous, token):
                    self.last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            if end >= 4 * self.v.longest:
                yield from self._stable()

    def _chain(self, end: int) -> list[int]:
        ends = []
        while end:
            ends.append(end)
            end -= len(self.last[end - 1])
        return ends

    def _stable(self) -> Iterator[int]:
        n, data = len(self.data), bytes(self.data)
        alive = [p for p in range(max(1, n - self.v.lookahead), n) if self.v.extends(data[p:])]
        common = set(self._chain(n))
        for p in alive:
            common &= set(self._chain(p))
        if common:
            yield from self._emit(max(common))

    def _emit(self, end: int) -> Iterator[int]:
        ends = self._chain(end)
        for p in reversed(ends):
            yield self.v.ranks[self.last[p - 1]]
        if ends:
            self.before = self.last[end - 1]
            del self.data[:end], self.last[:end]

    def finish(self) -> Iterator[int]:
        yield from self._emit(len(self.data))
        self.data, self.last, self.before = bytearray(), [], b""


class Encoder:
    """Encodes texts; equal pieces are looked up in a bounded memory, characters that nothing can join in a flat table."""

    def __init__(self, path: str = DEFAULT_RANKS):
        self.v = Vocabulary(read_ranks(path))
        self.pieces = piece_pattern().findall
        #: Splits in a list; which of them a character can be part of, on its left and on its right.
        self._splits = [s for group in self.v._splits.values() for s in group]
        self._by_u: dict[int, list[int]] = {}
        self._by_v: dict[int, list[int]] = {}
        for i, (u, v) in enumerate(self._splits):
            self._by_u.setdefault(u[-1], []).append(i)
            self._by_v.setdefault(v[0], []).append(i)
        self._left_kinds: dict[frozenset, int] = {frozenset(): 0}
        self._right_kinds: dict[frozenset, int] = {frozenset(): 0}
        self._left, self._right = np.full(0x110000, -1, np.int32), np.full(0x110000, -1, np.int32)
        self._joins = np.zeros((1, 1), bool)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._flat, self._starts, self._lengths = array("i"), array("q"), array("q")
        self._single = np.full(0x110000, -1, np.int32)

    def _learn(self, codes: np.ndarray) -> None:
        """Kinds of characters not met before: two characters can be joined if their kinds share a split."""
        for c in codes.tolist():
            data = chr(c).encode(errors="replace")
            fits = lambda whole, part, cut: cut(whole, min(len(whole), len(part))) == cut(part, min(len(whole), len(part)))
            left = frozenset(i for i in self._by_u.get(data[-1], ()) if fits(data, self._splits[i][0], lambda x, n: x[-n:]))
            right = frozenset(i for i in self._by_v.get(data[0], ()) if fits(data, self._splits[i][1], lambda x, n: x[:n]))
            self._left[c] = self._left_kinds.setdefault(left, len(self._left_kinds))
            self._right[c] = self._right_kinds.setdefault(right, len(self._right_kinds))
        if self._joins.shape != (len(self._left_kinds), len(self._right_kinds)):
            self._joins = np.array([[not x.isdisjoint(y) for y in self._right_kinds] for x in self._left_kinds], bool)

    def _transduce(self, data: bytes) -> array:
        run = Transducer(self.v)
        ids = array("i", run.feed(data))
        ids.extend(run.finish())
        return ids

    def _entry(self, piece: str) -> int:
        """Where the ids of a piece are in the table."""
        at = self._known.get(piece)
        if at is None:
            ids = self._transduce(piece.encode(errors="replace"))
            at = len(self._starts)
            self._starts.append(len(self._flat))
            self._lengths.append(len(ids))
            self._flat.extend(ids)
            self._known[piece] = at
        return at

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's end; null and empty texts have none."""
        texts = [t or "" for t in texts]
        if len(self._known) > MEMO or len(self._flat) > 20 * MEMO:
            self._forget()
        codes, offsets = code_points(texts)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        new = np.unique(codes)
        new = new[self._left[new] < 0]
        if len(new):
            self._learn(new)
        a, b = codes[:-1], codes[1:]
        blank = self._blank[codes]
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = ~self._joins[self._left[a], self._right[b]] & ((a >= 128) | (b >= 128)) & ~blank[:-1] & ~blank[1:] & (b != 39)
        cut[offsets] = True
        begin = np.flatnonzero(cut)
        sizes = np.diff(begin)
        begin = begin[:-1]
        first = codes[begin]
        alone = sizes == 1
        fresh = np.unique(first[alone])
        for c in fresh[self._single[fresh] < 0].tolist():
            self._single[c] = self._entry(chr(c))
        rest = np.flatnonzero(~alone)
        joined, entry, many, found, ends = "".join(texts), self._entry, array("q"), self.pieces, (begin[rest] + sizes[rest]).tolist()
        counts = np.ones(len(begin), np.int64)
        known, n = self._known.get, 0
        held = array("q")
        for s, e in zip(begin[rest].tolist(), ends, strict=True):
            for piece in found(joined[s:e]):
                at = known(piece)
                held.append(entry(piece) if at is None else at)
            many.append(len(held) - n)
            n = len(held)
        if len(rest):
            counts[rest] = np.frombuffer(many, np.int64)
        place = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(counts, out=place[1:])
        entries = np.zeros(place[-1], np.int64)
        entries[place[:-1][alone]] = self._single[first[alone]]
        if len(rest):
            mask = np.ones(len(entries), bool)
            mask[place[:-1][alone]] = False
            entries[mask] = np.frombuffer(held, np.int64)
        starts, lengths = np.frombuffer(self._starts, np.int64)[entries], np.frombuffer(self._lengths, np.int64)[entries]
        out = np.zeros(len(entries) + 1, np.int64)
        np.cumsum(lengths, out=out[1:])
        flat = np.frombuffer(self._flat, np.int32)[np.repeat(starts - out[:-1], lengths) + np.arange(out[-1])]
        return flat.copy(), out[place[np.searchsorted(begin, offsets)]]

    @property
    def _blank(self) -> np.ndarray:
        if not hasattr(self, "_blanks"):
            self._blanks = np.zeros(0x110000, bool)
            self._blanks[[c for c in range(0x3001) if re.match(f"[{SPACE}]", chr(c))]] = True
        return self._blanks

    def encode(self, text: str | None) -> list[int]:
        return self.batch([text])[0].tolist()


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """The text of ids: bytes run through an incremental machine that keeps at most one unfinished character."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    return "".join(machine.decode(vocabulary.tokens[i]) for i in ids) + machine.decode(b"", final=True)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, ids) of every row of df, once each.

    Null and empty texts get an empty list, blank ones are encoded like any other; repeated rows come out as often as they
    come in; an empty table gives an empty one; other columns are left out. Text of any length needs memory for its ids only.
    """

    def make():
        encoder = Encoder(ranks_path)

        def work(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, ends = encoder.batch(part.column(1).to_pylist())
                yield {key: part.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}

        return work

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df, [key, text], f"{key} {kind}, ids array<int>", make)


def token_counts(df: DataFrame, key: str, text: str = "text", ranks_path: str = DEFAULT_RANKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns key and keep, and tokens: how many ids the text has."""

    def make():
        encoder = Encoder(ranks_path)

        def work(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield {c: part.column(c) for c in (key, *keep)} | {"tokens": np.diff(encoder.batch(part.column(text).to_pylist())[1])}

        return work

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return map_batches(df, list(dict.fromkeys([key, *keep, text])), f"{fields}, tokens bigint", make)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, tokens, same): whether decoding the ids gives the text again, character by character."""

    def make():
        encoder = Encoder(ranks_path)

        def work(batch: pa.RecordBatch):
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            same = [decode(i, encoder.v) == (t or "") for i, t in zip(ids, batch.column(1).to_pylist(), strict=True)]
            yield {key: batch.column(0), "tokens": pa.array(map(len, ids), pa.int64()), "same": same}

        return work

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df, [key, text], f"{key} {kind}, tokens bigint, same boolean", make)

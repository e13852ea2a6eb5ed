"""Problem 6: texts over a limit in ordered pieces, cut where speech or writing pauses, with overlaps.

Recursive bisection: cut at the strongest boundary near the midpoint, recurse on halves that still exceed the limit minus the
overlap, then give each piece but the first the end of the piece before.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import code_points, map_batches

LIMIT, OVERLAP_LEAST, OVERLAP_MOST = 600, 90, 150
#: How strong a boundary after each character is; a full stop between digits or letters is none.
STRENGTH = {"\n": 6, **dict.fromkeys("。！？!?…", 5), **dict.fromkeys("；;", 4), **dict.fromkeys("：:，,、", 2), **dict.fromkeys(" \t　", 1.5)}
CLOSING = "」』）》】”’)]\"'"


class Boundaries:
    """How strong a cut before each character of a text is, worked out for the whole text at once."""

    def __init__(self) -> None:
        self.after = np.zeros(0x110000, np.float32)
        for c, v in STRENGTH.items():
            self.after[ord(c)] = v
        self.closing = np.zeros(0x110000, bool)
        self.closing[[ord(c) for c in CLOSING]] = True
        #: Characters that stay with the one before them: marks, joiners, variation selectors.
        self.bound = np.zeros(0x110000, bool)
        self.bound[[c for c in range(0x3100) if unicodedata.combining(chr(c))] + [0x200D, *range(0xFE00, 0xFE10)]] = True

    def __call__(self, text: str) -> np.ndarray:
        """At position i the strength of a cut between text[i-1] and text[i]; position 0 is the strongest."""
        codes, _ = code_points([text])
        before, after, here = codes[:-1], codes[1:], self.after
        s = here[before]
        behind = np.concatenate([[0], here[before[:-1]]]) if len(before) else s
        s = np.where(self.closing[before], behind, s)
        dot = np.concatenate([[False], before[:-1] == 46]) if len(before) else s > 0
        s = np.where((before == 46) & ((after == 32) | (after == 10) | (after > 127)), 5, s)
        s = np.where((before == 32) & (dot | (behind == 5)), 5, s)
        word = lambda x: ((x >= 48) & (x <= 57)) | ((x | 32) >= 97) & ((x | 32) <= 122)
        s = np.where((s == 0) & word(before) & word(after), -1, s)
        stuck = self.bound[after] | self.closing[after] | (before == 0x200D) | (here[after] > 0) & (after != 10) & (before != 10)
        return np.concatenate([[9], np.where(stuck, -9, s)]).astype(np.float32)


def bisect(strengths: np.ndarray, most: int) -> list[int]:
    """Cuts such that no part is longer than most."""
    todo, cuts = [(0, len(strengths))], []
    while todo:
        lo, hi = todo.pop()
        n = hi - lo
        if n <= most:
            continue
        middle, reach = (lo + hi) / 2, max(1.0, min(0.3 * n, most))
        first = max(lo + 1, int(middle - reach))
        around = np.arange(first, min(hi - 1, int(middle + reach)) + 1)
        best = first + int(np.argmax(strengths[around] - 4 * np.abs(around - middle) / reach))
        cuts.append(best)
        todo += [(lo, best), (best, hi)]
    return sorted(cuts)


def spans(text: str, boundaries: Boundaries, limit: int = LIMIT, least: int = OVERLAP_LEAST, most: int = OVERLAP_MOST) -> list[tuple[int, int]]:
    """(begin, end) of each piece in the text, overlaps included; one span if the text is within the limit."""
    if len(text) <= limit:
        return [(0, len(text))]
    strengths = boundaries(text)
    cuts = [0, *bisect(strengths, limit - most), len(text)]
    out = [(0, cuts[1])]
    for begin, end in zip(cuts[1:-1], cuts[2:], strict=True):
        low = max(out[-1][0], begin - most)
        high = max(low, begin - least)
        out.append((low + int(np.argmax(strengths[low : high + 1])), end))
    return out


def pieces(df: DataFrame, key: str = "row", text: str = "text", start: str = "start", end: str = "end", limit: int = LIMIT) -> DataFrame:
    """(key, piece, begin, text, chars, start, end) of every row whose text is longer than limit characters, whatever other columns say.

    Times are interpolated over the characters where the row has both, the earlier first; else they are null. Null, empty and
    short texts give no piece; a text without any boundary is cut at the midpoint; repeated rows give their pieces again.
    """
    long = df.where(F.length(text) > limit).select(F.col(key).alias("k"), F.col(text).alias("t"), F.least(start, end).alias("s"), F.greatest(start, end).alias("e"), (F.col(start).isNotNull() & F.col(end).isNotNull()).alias("timed"))

    def make():
        boundaries = Boundaries()

        def work(batch: pa.RecordBatch):
            out: dict[str, list] = {c: [] for c in (key, "piece", "begin", "text", "chars", "start", "end")}
            for k, t, s, e, timed in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "s", "e", "timed")), strict=True):
                for n, (a, b) in enumerate(spans(t, boundaries, limit)):
                    times = [round(s + (e - s) * x / len(t), 2) if timed else None for x in (a, b)]
                    for c, v in zip(out, (k, n + 1, a, t[a:b], b - a, *times), strict=True):
                        out[c].append(v)
            yield out

        return work

    return map_batches(long, ["k", "t", "s", "e", "timed"], f"{key} {df.schema[key].dataType.simpleString()}, piece int, begin int, text string, chars int, start double, end double", make)


def oversized(df: DataFrame, key: str = "row", text: str = "text") -> DataFrame:
    """The keys of rows that come out in more than one piece."""
    return pieces(df, key, text).where("piece = 2").select(key)

"""Problem 1: the share of a text that repeats itself.

A hashed word and character n-gram logistic regression, trained on rows labelled by the exact measure and calibrated, scores
every row in Arrow batches. Rows whose probability reaches a fixed threshold are measured exactly.

The model sees which hashed n-grams a text says again, and what part of the text they are; it is fitted on a bounded sample
of labelled rows (TRAIN_ROWS) and on the same rows with passages said again, so that both labels are there at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_sample, code_points, map_batches, mix64, owners, window_hashes
from quillspark.llm.logistic import Model, Sparse, calibrated, fit, halves

#: Successive letters and digits that count as a repeat, and the share that counts as repetitive.
RUN, SHARE = 12, 0.30
#: The bounds of the labelled sample in rows and in characters of one, the number of hashed features, and the fixed threshold on the probability.
TRAIN_ROWS, TRAIN_CHARS, BUCKETS, THRESHOLD = 2000, 8000, 4096, 0.01
WORD_GRAM, CHAR_GRAM = 3, 8


class Letters:
    """Tables: which code points are letters or digits, their lower case, and which stand for a word alone."""

    def __init__(self) -> None:
        self.kept, self.lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in [*range(0xD800), *range(0xE000, 0x32400)]:
            ch = chr(c)
            if ch.isalnum():
                self.kept[c] = True
                low = ch.lower()
                if low != ch and len(low) == 1:
                    self.lower[c] = ord(low)
        self.single = np.zeros(0x110000, bool)
        self.single[0x3040:0xA000] = self.single[0xF900:0xFB00] = self.single[0x20000:0x32400] = True


def _again(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether the same hash occurs earlier with the same owner."""
    keys = hashes ^ mix64(own.astype(np.uint64) + np.uint64(0x51ED2701))
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def _grams(codes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and owners of the windows of n that lie within one text."""
    own = owners(offsets)
    h = window_hashes(codes, n)
    inside = own[: len(h)] == own[n - 1 :] if len(h) else np.zeros(0, bool)
    return h[inside], own[: len(h)][inside]


def _plain(texts: list[str | None], letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits in lower case, text after text."""
    codes, offsets = code_points([t or "" for t in texts])
    kept = letters.kept[codes]
    before = np.concatenate([[0], np.cumsum(kept)])
    return letters.lower[codes[kept]], before[offsets]


def exact_shares(texts: list[str | None], letters: Letters) -> np.ndarray:
    """The share of letters and digits inside a run of RUN that occurs earlier in the same text; 0 for texts without any."""
    codes, offsets = _plain(texts, letters)
    own = owners(offsets)
    h = window_hashes(codes, RUN)
    marks = np.zeros(len(codes) + 1, np.int64)
    if len(h):
        inside = np.flatnonzero(own[: len(h)] == own[RUN - 1 :])
        starts = inside[_again(h[inside], own[inside])]
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + RUN, -1)
    covered = np.cumsum(marks[:-1]) > 0
    total = np.diff(offsets)
    return np.bincount(own[covered], minlength=len(total)) / np.maximum(1, total)


def features(texts: list[str | None], letters: Letters) -> Sparse:
    """Hashed n-grams that a text says again, weighted by their part of it."""
    n = len(texts)
    codes, offsets = _plain(texts, letters)
    own = owners(offsets)
    start = np.ones(len(codes), bool)
    if len(codes):
        single = letters.single[codes]
        start[1:] = single[1:] | single[:-1] | (own[1:] != own[:-1])
    at = np.flatnonzero(start)
    place = np.arange(len(codes)) - np.repeat(at, np.diff(np.append(at, len(codes))))
    words = np.add.reduceat(mix64(codes.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21))), at) if len(at) else np.zeros(0, np.uint64)
    word_offsets = np.searchsorted(at, offsets)
    rows, kinds, values = [], [], []
    for k, (seq, ends, size) in enumerate(((words, word_offsets, WORD_GRAM), (codes, offsets, CHAR_GRAM))):
        h, of = _grams(seq, ends, size)
        again = _again(h, of)
        part = 1 / np.maximum(1, np.diff(ends))
        half = BUCKETS // 2
        rows.append(of[again])
        kinds.append((h[again] % np.uint64(half)).astype(np.int64) + k * half)
        values.append(8 * part[of[again]])
    row, kind, value = np.concatenate(rows), np.concatenate(kinds), np.concatenate(values)
    order = np.argsort(row, kind="stable")
    return Sparse(kind[order], value[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]))


def train(texts: list[str], letters: Letters) -> Model:
    """The calibrated model of labelled texts: the sample's own, and the same with a passage said once or more again."""
    rng = np.random.default_rng(11)
    made = []
    for t in texts:
        size = max(1, int(len(t) * rng.uniform(0.05, 0.5)))
        at = int(rng.integers(0, max(1, len(t) - size)))
        made.append(t + "".join(t[at : at + size] for _ in range(int(rng.integers(1, 4)))))
    texts = texts + made or ["", "ab" * 40]
    y = (exact_shares(texts, letters) >= SHARE).astype(float)
    x = features(texts, letters)
    one, two = halves(len(texts), 5)
    return calibrated(fit(x.take(one), y[one], BUCKETS, steps=200), x.take(two), y[two])


def _model(df: DataFrame, text: str) -> Model:
    sample = bounded_sample(df.select(F.col(text).alias("value")), "value", TRAIN_ROWS, f"length(value) between {2 * RUN} and {TRAIN_CHARS}")
    return train([r.value for r in sample], Letters())


def repeated_shares(df: DataFrame, key: str = "row", text: str = "raw_text") -> DataFrame:
    """(key, probability, share) of every row of df: the model's probability of being repetitive, and the share as measured.

    Null, empty and blank texts, and texts without letters or digits, have share 0; a text of any length is
    measured whole; repeated rows come out as often as they come in; an empty table gives an empty one.
    """
    model = _model(df, text)

    def make():
        letters = Letters()

        def work(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                yield {key: part.column(0), "probability": model.probability(features(texts, letters)), "share": exact_shares(texts, letters)}

        return work

    return map_batches(df, [key, text], f"{key} {df.schema[key].dataType.simpleString()}, probability double, share double", make)


def repetitive(df: DataFrame, key: str = "row", text: str = "raw_text", share: float = SHARE, threshold: float = THRESHOLD) -> DataFrame:
    """The keys of the rows with at least `share`: those whose probability reaches the threshold are measured."""
    model = _model(df, text)

    def make():
        letters = Letters()

        def work(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                kept = np.flatnonzero(model.probability(features(texts, letters)) >= threshold)
                good = kept[exact_shares([texts[i] for i in kept], letters) >= share]
                yield {key: part.column(0).take(pa.array(good, pa.int64()))}

        return work

    return map_batches(df.where(F.length(text) >= RUN), [key, text], f"{key} {df.schema[key].dataType.simpleString()}", make)

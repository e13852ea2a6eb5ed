"""Problem 3: records that share most of their content but for small edits, insertions or another order.

Deletion-variant signatures. Each distinct text gets a signature of minhash positions, one byte each, over its 3-character
sequences. The signature is cut into few segments, so few that of two texts at the threshold some segment almost surely differs in
at most one position. For each segment the variants with one position left out (a wildcard) are indexed; texts that meet in
one are candidates if sketches of their whole signatures are alike too, and these are verified on the texts themselves.

The unit that may differ is a minhash position, not a single bit: at a similarity of 0.70 one-bit positions differ so often
that segments selective enough would need about 480 variants a text; see the README.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import code_points, expanded, map_batches, mix64, owners, written
from quillspark.llm.forms import Prototypes, composed

GRAM, SIMILARITY = 3, 0.70
#: Segments and positions a segment. At 0.70 a pair is found with probability 0.99, at 0.75 with 0.999.
SEGMENTS, POSITIONS = 12, 7
#: Candidates whose signatures agree in fewer positions than this are no pair at 0.70 (four standard deviations below).
AGREE = 42
#: Fewest positions whose two-bit sketches agree in a candidate (four standard deviations below what a pair at 0.70 has).
SKETCHED = 49
#: Texts of one variant that are paired in one task. Records, half a segment of a text each, that a task is to hold.
HOT, RECORDS = 4096, 400_000
#: Positions of a segment that are its first half.
HALF = (POSITIONS + 1) // 2
#: Positions in a word of a sketch, and words. Bytes of a record: of the segment and its half, of the id, of each word.
THIRD, WORDS = SEGMENTS * POSITIONS // 3, 3
_BYTES = [8, 8, *[7] * WORDS]
_SEEDS = mix64(np.arange(1, 2 * SEGMENTS * POSITIONS + 1)).reshape(2, -1) | np.uint64(1)


def normal(text: str, table: Prototypes) -> str:
    """The one form of problem 5 without white space."""
    return "".join(composed(text, table).split())


class Normals:
    """`normal` of many texts, characters replaced in one array. That is the same as long as no character acts on another: texts with marks,
    with parts of syllables, or with a character whose one form isn't a single other one go one by one."""

    GONE, APART = 0xFFFFFFFE, 0xFFFFFFFF

    def __init__(self) -> None:
        self.table = Prototypes()
        self.known, self.to = np.zeros(0x110000, bool), np.zeros(0x110000, np.uint32)

    def replaced(self, code: int) -> int:
        out = composed(chr(code), self.table)
        for c in chr(code) + out:
            if unicodedata.category(c)[0] == "M" or 0x1100 <= ord(c) < 0x1200 or 0x16D63 <= ord(c) <= 0x16D6A:
                return self.APART
        out = "".join(out.split())
        return ord(out) if len(out) == 1 else self.APART if out else self.GONE

    def __call__(self, texts: list[str]) -> list[str]:
        codes, offsets = code_points(texts)
        for code in np.unique(codes[~self.known[codes]]).tolist():
            self.to[code], self.known[code] = self.replaced(code), True
        made = self.to[codes]
        apart = set(np.searchsorted(offsets, np.flatnonzero(made == self.APART), "right").tolist())
        kept = made < self.GONE
        at = np.concatenate([[0], np.cumsum(kept)])[offsets].tolist()
        every = made[kept].tobytes().decode("utf-32-le", "surrogatepass")
        return [normal(t, self.table) if i + 1 in apart else every[at[i] : at[i + 1]] for i, t in enumerate(texts)]


def _keys(texts: list[str]) -> tuple[np.ndarray, int, np.ndarray] | None:
    """(keys, bits, used): the distinct 3-character sequences of each text, in order: the text's number above three ranks of `bits` bits in
    `used`, the code points that occur. One word each, so they are sorted by value; None where a word is too short for it."""
    codes, offsets = code_points([t if len(t) >= GRAM else t + "\x00" * (GRAM - len(t)) for t in texts])
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    used = np.flatnonzero(seen).astype(np.uint64)
    bits = max(1, (len(used) - 1).bit_length())
    if GRAM * bits + len(texts).bit_length() > 64:
        return None
    c = (np.cumsum(seen) - 1).astype(np.uint64)[codes]
    own = owners(offsets).astype(np.uint64)
    keys = (own << np.uint64(3 * bits))[:-2] | (c[:-2] << np.uint64(2 * bits)) | (c[1:-1] << np.uint64(bits)) | c[2:]
    keys = np.sort(keys[own[:-2] == own[2:]])
    return _once(keys), bits, used


def _once(keys: np.ndarray) -> np.ndarray:
    """Sorted keys, each once."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 3-character sequences of each text, packed into 63 bits, in order; a shorter text is one sequence."""
    made = _keys(texts)
    if made is None:  # never a single text
        (a, ao), (b, bo) = grams(texts[: len(texts) // 2]), grams(texts[len(texts) // 2 :])
        return np.concatenate([a, b]), np.concatenate([ao, ao[-1] + bo[1:]])
    keys, bits, used = made
    one, two, three = (used[keys >> np.uint64(k * bits) & np.uint64((1 << bits) - 1)] for k in (2, 1, 0))
    counts = np.bincount((keys >> np.uint64(3 * bits)).astype(np.int64), minlength=len(texts))
    return (one << np.uint64(42)) | (two << np.uint64(21)) | three, np.concatenate([[0], np.cumsum(counts)])


def signatures(packed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of SEGMENTS x POSITIONS bytes for each text; as many sequences at a time as the caches of a core hold."""
    h = mix64(packed)
    least = np.empty((SEGMENTS * POSITIONS, len(offsets) - 1), np.uint64)
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + 8192, "right")) - 1)
        part, starts = h[offsets[begin] : offsets[end]], offsets[begin:end] - offsets[begin]
        x, y = np.empty_like(part), np.empty_like(part)
        for k in range(len(least)):
            np.multiply(part, _SEEDS[0, k], out=x)
            np.right_shift(x, np.uint64(29), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _SEEDS[1, k], out=x)
            np.minimum.reduceat(x, starts, out=least[k, begin:end])
        begin = end
    return np.ascontiguousarray((mix64(least) & np.uint64(0xFF)).astype(np.uint8).T)


def variants(sig: np.ndarray) -> np.ndarray:
    """64-bit keys, one row a text: every segment with every single position left out."""
    parts = sig.reshape(len(sig), SEGMENTS, POSITIONS).astype(np.uint64)
    keys = np.empty((len(sig), SEGMENTS, POSITIONS), np.uint64)
    segment = np.arange(SEGMENTS, dtype=np.uint64)
    for gone in range(POSITIONS):
        word = np.zeros((len(sig), SEGMENTS), np.uint64)
        for p in range(POSITIONS):
            if p != gone:
                word = (word << np.uint64(8)) | parts[:, :, p]
        keys[:, :, gone] = mix64(word ^ ((segment * np.uint64(POSITIONS) + np.uint64(gone)) << np.uint64(48)) ^ mix64(segment * np.uint64(97) + np.uint64(gone)))
    return keys.reshape(len(sig), -1)


def halves(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments, places), two columns for each segment of each text. A segment is its positions, a byte each from the lowest, below its
    number and half; a place is the same for equal halves.

    Two segments that differ in at most one position have the other half in common, so a variant needs no row of its own: where a half
    meets its like, the variants that leave out a position of the other half are made.
    """
    parts = sig.reshape(len(sig), SEGMENTS, POSITIONS).astype(np.uint64)
    word = np.zeros((len(sig), SEGMENTS), np.uint64)
    for p in range(POSITIONS):
        word |= parts[:, :, p] << np.uint64(8 * p)
    tags = np.arange(2 * SEGMENTS, dtype=np.uint64).reshape(SEGMENTS, 2) << np.uint64(56)
    segments = word[:, :, None] | tags
    low, high = np.uint64((1 << 8 * HALF) - 1), np.uint64((1 << 56) - (1 << 8 * HALF))
    places = mix64((word[:, :, None] & np.array([low, high])) | tags)
    return segments.reshape(len(sig), -1), places.reshape(len(sig), -1)


def sketches(sig: np.ndarray) -> np.ndarray:
    """The two lowest bits of every position: WORDS words a text, each with the low bits of THIRD positions and then their high bits."""
    out = np.zeros((len(sig), WORDS), np.uint64)
    for k in range(sig.shape[1]):
        word, at = divmod(k, THIRD)
        bits = sig[:, k].astype(np.uint64)
        out[:, word] |= ((bits & np.uint64(1)) << np.uint64(at)) | ((bits >> np.uint64(1) & np.uint64(1)) << np.uint64(at + THIRD))
    return out


def alike(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Whether sketches side by side, given by words, agree in SKETCHED positions."""
    differ = np.zeros(len(one[0]), np.uint8)
    for x, y in zip(one, two, strict=True):
        x = x ^ y
        differ += np.bitwise_count((x | (x >> np.uint64(THIRD))) & np.uint64((1 << THIRD) - 1))
    return differ <= SEGMENTS * POSITIONS - SKETCHED


def packed_records(columns: list[np.ndarray]) -> bytes:
    """Records as planes of bytes, so that what repeats is compressed."""
    return b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes() for c, n in zip(columns, _BYTES, strict=True))


def unpacked_records(blobs: list[bytes]) -> list[np.ndarray]:
    """The columns of all records in the blobs."""
    counts = [len(b) // sum(_BYTES) for b in blobs]
    out = [np.zeros((sum(counts), 8), np.uint8) for _ in _BYTES]
    at = 0
    for blob, rows in zip(blobs, counts, strict=True):
        planes, plane = np.frombuffer(blob, np.uint8).reshape(-1, rows), 0
        for column, n in zip(out, _BYTES, strict=True):
            column[at : at + rows, :n] = planes[plane : plane + n].T
            plane += n
        at += rows
    return [c.view("<u8").ravel() for c in out]


def met(ends: np.ndarray, ids: np.ndarray, words: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids, smaller first, of records in one group whose sketches are alike. ends: for each record, where its group ends."""
    at = np.arange(len(ids))
    for step in range(1, len(ids)):
        at = at[at + step < ends[at]]
        if not len(at):
            return
        for part in np.array_split(at, -(-len(at) // 500_000)):
            i = part[alike([w[part] for w in words], [w[part + step] for w in words])]
            x, y = ids[i], ids[i + step]
            yield np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]


def jaccard(one: list[str], two: list[str]) -> np.ndarray:
    """The exact similarity of texts side by side."""
    n = len(one)
    made = _keys([*one, *two])
    if made is None and n > 1:
        return np.concatenate([jaccard(one[: n // 2], two[: n // 2]), jaccard(one[n // 2 :], two[n // 2 :])])
    if made is None:  # one pair of nearly every character
        a, b = (grams(side)[0] for side in (one, two))
        common = np.array([len(np.intersect1d(a, b, assume_unique=True))])
        return common / (len(a) + len(b) - common)
    keys, bits, _ = made
    text = (keys >> np.uint64(3 * bits)).astype(np.int64)
    sizes = np.bincount(text, minlength=2 * n)
    half = int(sizes[:n].sum())
    keys[half:] -= np.uint64(n << 3 * bits)
    keys = np.sort(keys)
    both = keys[1:][keys[1:] == keys[:-1]]
    common = np.bincount((both >> np.uint64(3 * bits)).astype(np.int64), minlength=n)
    return common / np.maximum(1, sizes[:n] + sizes[n:] - common)


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, plain): every row with a text, its normal form and 16 bytes of that form's digest. Null texts and blank ones are in no
    group."""

    def make():
        normals = Normals()

        def work(batch: pa.RecordBatch):
            plain = [p for at in range(0, batch.num_rows, 1000) for p in normals(batch.column(1).slice(at, 1000).to_pylist())]
            kept = [i for i, p in enumerate(plain) if p]
            digests = [hashlib.blake2b(plain[i].encode("utf-8", "surrogatepass"), digest_size=16).digest() for i in kept]
            yield {key: batch.column(0).take(pa.array(kept, pa.int64())), "digest": digests, "plain": [plain[i] for i in kept]}

        return work

    return map_batches(df.where(F.length(text) > 0), [key, text], f"{key} {df.schema[key].dataType.simpleString()}, digest binary, plain string", make)


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in larger parts, each pair once a part."""
    held, rows = [], 0

    def once() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return a[first], b[first]

    for pair in pairs:
        held.append(pair)
        rows += len(pair[0])
        if rows >= least:
            yield once()
            held, rows = [], 0
    if rows:
        yield once()


def candidates(signed: DataFrame) -> DataFrame:
    """(a, b) with a < b for texts (id, sig) that have a variant in common and whose sketches are alike.

    The number of pairs that only have a variant in common grows with the square of the table, so they are never written: every record
    of the index carries its text's sketch, and each task compares what meets in it. A variant of more than HOT texts is cut into blocks;
    every two blocks are compared in a task of their own.
    """
    spark, hot = signed.sparkSession, HOT
    parts = max(1, -(-signed.count() * 2 * SEGMENTS // RECORDS))

    def index():
        def work(batch: pa.RecordBatch):
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SEGMENTS * POSITIONS)
            segments, places = halves(sig)
            to = (places.ravel() % np.uint64(parts)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            text = order // (2 * SEGMENTS)
            columns = [segments.ravel()[order], batch.column(0).to_numpy()[text], *sketches(sig)[text].T]
            some, starts = np.unique(to[order], return_index=True)
            ends = np.append(starts[1:], len(order))
            yield {"part": some, "records": [packed_records([c[i:j] for c in columns]) for i, j in zip(starts, ends, strict=True)]}

        return work

    schema = T._parse_datatype_string("a bigint, b bigint, cell binary")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.binary())], schema=arrow)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, ids, *words = unpacked_records([blob for batch in batches for blob in batch.column(0).to_pylist()])
        second = (segments >> np.uint64(56) & np.uint64(1)).astype(bool)
        for gone in range(POSITIONS):
            order = np.flatnonzero(second == (gone < HALF))
            key = segments[order] & ~np.uint64(0xFF << 8 * gone)
            by = np.argsort(key)
            order, key = order[by], key[by]
            starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            for start, n in zip(starts[sizes > hot], sizes[sizes > hot], strict=True):
                blocks = np.array_split(order[start : start + n], -(-n // hot))
                packed = [packed_records([segments[b], ids[b], *[w[b] for w in words]]) for b in blocks]
                for i, one in enumerate(packed):
                    for two in packed[i:]:
                        cell = len(one).to_bytes(8, "little") + one + (two if two is not one else b"")
                        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([cell], pa.binary())], schema=arrow)
            few = (sizes > 1) & (sizes <= hot)
            order, sizes = order[np.repeat(few, sizes)], sizes[few]
            ends = np.repeat(np.cumsum(sizes), sizes)
            for a, b in gathered(met(ends, ids[order].view(np.int64), [w[order] for w in words])):
                yield rows(a, b)

    def across(one: list[np.ndarray], two: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        many = max(1, 500_000 // len(two[0]))
        for at in range(0, len(one[0]), many):
            x, y = ([np.repeat(c[at : at + many], len(two[0])) for c in one], [np.tile(c, len(one[0][at : at + many])) for c in two])
            kept = alike(x[1:], y[1:]) & (x[0] != y[0])
            yield np.minimum(x[0], y[0])[kept], np.maximum(x[0], y[0])[kept]

    def compare():
        def work(batch: pa.RecordBatch):
            for cell in batch.column(0).to_pylist():
                n = int.from_bytes(cell[:8], "little")
                one = [c.view(np.int64) if k == 0 else c for k, c in enumerate(unpacked_records([cell[8 : 8 + n]])[1:])]
                two = [c.view(np.int64) if k == 0 else c for k, c in enumerate(unpacked_records([cell[8 + n :] or cell[8:]])[1:])]
                for a, b in gathered(across(one, two)):
                    yield {"a": a, "b": b}

        return work

    keyed = map_batches(signed, ["id", "sig"], "part int, records binary", index)
    found = written(keyed.repartitionById(parts, F.col("part")).select("records").mapInArrow(meet, schema))
    cells = found.where("cell is not null").select("cell").repartition(spark.sparkContext.defaultParallelism * 4)
    return found.where("cell is null").select("a", "b").union(map_batches(cells, ["cell"], "a bigint, b bigint", compare)).distinct()


def links(texts: DataFrame) -> DataFrame:
    """(a, b, similarity) with a < b for distinct texts (id, plain) that are at least SIMILARITY alike."""

    def sign():
        def work(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed, offsets = grams(part.column(1).to_pylist())
                sig = signatures(packed, offsets)
                yield {"id": part.column(0), "sig": pa.array([s.tobytes() for s in sig], pa.binary()), "grams": np.diff(offsets).astype(np.int32)}

        return work

    signed = written(map_batches(texts, ["id", "plain"], "id bigint, sig binary, grams int", sign))
    pairs = candidates(signed)
    one, two = (signed.select(F.col("id").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("grams").alias(f"grams_{k}")) for k in "ab")
    near = pairs.join(one, "a").join(two, "b").where(F.least("grams_a", "grams_b") >= SIMILARITY * F.greatest("grams_a", "grams_b"))

    def agree():
        def work(batch: pa.RecordBatch):
            s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SEGMENTS * POSITIONS) for c in (2, 3))
            kept = pa.array(np.flatnonzero((s == t).sum(1) >= AGREE))
            yield {"a": batch.column(0).take(kept), "b": batch.column(1).take(kept)}

        return work

    likely = written(map_batches(near, ["a", "b", "sig_a", "sig_b"], "a bigint, b bigint", agree))
    first, second = (texts.select(F.col("id").alias(k), F.col("plain").alias(f"plain_{k}")) for k in "ab")

    def verify():
        def work(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield {"a": part.column(0), "b": part.column(1), "similarity": jaccard(part.column(2).to_pylist(), part.column(3).to_pylist())}

        return work

    both = likely.join(first, "a").join(second, "b")
    return map_batches(both, ["a", "b", "plain_a", "plain_b"], "a bigint, b bigint, similarity double", verify).where(F.col("similarity") >= SIMILARITY)


def representatives(df: DataFrame, key: str = "row", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (k, id), a row of df each, and distinct texts (id, plain), written once. The ids are numbers given to the distinct digests as
    they are written, so no two texts have the same; what comes out doesn't depend on them."""
    keyed = written(distinct_texts(df, key, text))
    texts = written(keyed.groupBy("digest").agg(F.min("plain").alias("plain")).withColumn("id", F.monotonically_increasing_id()))
    members = keyed.select(F.col(key).alias("k"), "digest").join(texts.select("digest", "id"), "digest").select("k", "id")
    return written(members), texts.select("id", "plain")


def near_pairs(df: DataFrame, key: str = "row", text: str = "text") -> DataFrame:
    """Pairs (key_a < key_b) of rows at least SIMILARITY alike, copies included: every row of one text with every row of the other.

    Null, empty and blank texts are in no pair. Rows repeated with the same key and text pair once. Other columns are not read.
    """
    members, texts = representatives(df, key, text)
    found = links(texts).select("a", "b")
    copied = members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    rows = expanded(found.unionByName(copied), members.distinct()).where("x <> y and (a <> b or x < y)")
    return rows.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def components(links: DataFrame) -> DataFrame:
    """(id, group) for every id in a link: the smallest id that links lead to. Labels are lowered along the links and along the
    labels' own labels until nothing changes; each round is written, so no round depends on an earlier one's executors."""
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("group")))
    while True:
        heard = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("group").alias("heard"))
        lower = labels.join(heard, labels["id"] == heard["a"]).select("id", F.col("group").alias("old"), F.least("group", "heard").alias("group"))
        jump = lower.select(F.col("id").alias("at"), F.col("group").alias("further"))
        after = written(lower.join(jump, lower["group"] == jump["at"], "left").select("id", "old", F.least("group", F.coalesce("further", "group")).alias("group")))
        labels = after.select("id", "group")
        if not after.where("old <> group").limit(1).count():
            return labels


def groups(df: DataFrame, key: str = "row", text: str = "text") -> DataFrame:
    """One row for each row of df with a text: (key, group, copies, links): its group (the smallest key in it), how many rows
    hold the same text, and how many other texts are linked to it. Rows alone are their own group. Copies aren't expanded."""
    members, texts = representatives(df, key, text)
    found = written(links(texts).select("a", "b"))
    labels = components(found)
    degree = found.select(F.col("a").alias("id")).union(found.select("b")).groupBy("id").agg(F.count("*").alias("links"))
    texts_of = members.groupBy("id").agg(F.min("k").alias("least"), F.count("*").alias("copies")).join(labels, "id", "left").join(degree, "id", "left").withColumn("label", F.coalesce("group", "id"))
    named = texts_of.groupBy("label").agg(F.min("least").alias("group"))
    per_text = texts_of.drop("group").join(named, "label").select("id", "group", "copies", F.coalesce("links", F.lit(0)).cast(T.LongType()).alias("links"))
    return members.join(per_text, "id").select(F.col("k").alias(key), "group", "copies", "links")

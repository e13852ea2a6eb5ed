"""Problem 2: the most similar vectors for every vector, by NN-descent.

The graph starts from blocks: in each of several rounds every vector goes to the nearest of many pivots, which are drawn from the
vectors, until no block is larger than BLOCK, and takes the best of its block. NN-descent then improves it by Spark joins of
neighbours of neighbours: at every node the vectors that list it or are listed by it are compared with one another, and what beats
a list's last entry goes into that list. Queries walk the graph greedily. Shuffles carry vectors as 8-bit codes, and lists as
arrays; similarities that are reported come from the vectors.

Equal vectors are one node of the graph, however many keys hold them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import map_batches, map_groups, map_led, mix64, written

#: Neighbours reported and kept, and those that a block gives; rounds of blocks, a block's most rows, and the pivots that part a larger one.
REPORT, KEPT, GIVEN, ROUNDS, BLOCK, PIVOTS = 10, 16, 12, 10, 4096, 512
#: Of NN-descent: fresh members of a local join in each direction, and the part of the entries that may be new when it ends.
SAMPLE, SETTLED = 12, 0.01
#: Rows of a table of cells up to which it is broadcast.
FEW = 20_000
#: Entries kept where only those above a similarity are of interest.
WIDE = 48
#: Of the greedy search: the beam's width, its steps, the nodes from which queries can start, and from how many of them one does.
BEAM, STEPS, ENTRIES, STARTS = 192, 6, 4096, 96
#: The least cosine of a pair, and how far codes can be off.
COSINE, SLACK = 0.90, 0.01


def usable(df: DataFrame, key: str = "key", vec: str = "vec") -> DataFrame:
    """(key, digest, dims, unit): keys, null ones left out, with a vector that isn't null, empty, all zero or not finite; `unit` has length one, as 4-byte
    floats; `digest` has 16 bytes and is equal for equal vectors."""

    def make():
        def work(batch: pa.RecordBatch):
            vecs = batch.column(1)
            dims = pc.list_value_length(vecs).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(dims):
                return
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)
            x = flat.astype(np.float64)
            ends = np.cumsum(dims)
            norms = np.sqrt(np.add.reduceat(x * x, ends - dims))
            good = np.flatnonzero(np.isfinite(norms) & (norms > 0))
            with np.errstate(all="ignore"):
                units = (x / np.repeat(norms, dims)).astype(np.float32).tobytes()
            raw, ends = flat.tobytes(), 4 * ends
            spans = [(int(ends[i] - 4 * dims[i]), int(ends[i])) for i in good]
            yield {
                key: batch.column(0).take(pa.array(good)),
                "digest": pa.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in spans], pa.binary()),
                "dims": dims[good].astype(np.int32),
                "unit": pa.array([units[a:b] for a, b in spans], pa.binary()),
            }

        return work

    return map_batches(df.where((F.size(vec) > 0) & F.col(key).isNotNull()), [key, vec], f"{key} {df.schema[key].dataType.simpleString()}, digest binary, dims int, unit binary", make)


def nodes(keyed: DataFrame) -> DataFrame:
    """(id, digest, dims, unit, code): one row for each distinct vector; the code has one signed byte a dimension.

    The id is made of seven bytes of the digest and a number among those that share them, so no two vectors have the same.
    """
    one = keyed.groupBy("digest").agg(F.min("dims").alias("dims"), F.min("unit").alias("unit"))
    part = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint")
    numbered = one.withColumn("part", part).withColumn("id", F.shiftleft("part", 8) + F.row_number().over(Window.partitionBy("part").orderBy("digest")) - 1)

    def make():
        def work(batch: pa.RecordBatch):
            codes: list[bytes] = [b""] * batch.num_rows
            dims = batch.column(2).to_numpy()
            units = batch.column(3).to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(units[i] for i in at), np.float32).reshape(len(at), -1)
                made = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)
                for i, row in zip(at, made, strict=True):
                    codes[i] = row.tobytes()
            yield {"id": batch.column(0), "digest": batch.column(1), "dims": batch.column(2), "unit": batch.column(3), "code": pa.array(codes, pa.binary())}

        return work

    return written(map_batches(numbered, ["id", "digest", "dims", "unit"], "id bigint, digest binary, dims int, unit binary, code binary", make))


def _matrix(codes: pa.Array | list) -> np.ndarray:
    """Rows of length one; shorter codes are filled up with zeros, which change no product of vectors of one length."""
    raw = codes.to_pylist() if isinstance(codes, (pa.Array, pa.ChunkedArray)) else codes
    most = max(map(len, raw), default=1)
    if any(len(r) != most for r in raw):
        raw = [r.ljust(most, b"\0") for r in raw]
    x = np.frombuffer(b"".join(raw), np.int8).reshape(len(raw), -1).astype(np.float32)
    return x / np.maximum(1e-9, np.sqrt((x * x).sum(1, keepdims=True)))


def _lists(ids: np.ndarray, s: np.ndarray) -> tuple[pa.Array, pa.Array]:
    ends = pa.array(np.arange(len(ids) + 1) * ids.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(ids.ravel())), pa.ListArray.from_arrays(ends, pa.array(s.ravel()))


def _nearest(x: np.ndarray, pivots: np.ndarray, ids: np.ndarray, salt: int) -> np.ndarray:
    """The nearest pivot of each row; what is equally near to several goes to any of them."""
    out = np.empty(len(x), np.int64)
    for lo in range(0, len(x), 2048):
        near = x[lo : lo + 2048] @ pivots.T
        chance = mix64(ids[lo : lo + 2048, None].astype(np.uint64) + np.arange(len(pivots), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
        out[lo : lo + 2048] = (near + 2e-6 * (chance >> np.uint64(40)).astype(np.float32) / 2**24).argmax(1)
    return out


def _drawn(rows: DataFrame, level: int) -> DataFrame:
    """The pivots of each (round, cell) of rows (id, code, n, round, cell): the smallest by a hash."""
    w = Window.partitionBy("round", "cell").orderBy(F.xxhash64("id", "round", F.lit(level)), "id")
    return rows.withColumn("k", F.row_number().over(w)).where((F.col("k") <= PIVOTS) & (F.col("k") <= F.ceil(2 * F.col("n") / BLOCK)))


def _first_cells(vectors: DataFrame) -> DataFrame:
    """(id, code, round, cell): every node's nearest of at most PIVOTS pivots, in every round. The pivots are broadcast; there are no more
    than ROUNDS * PIVOTS for each length of vectors."""
    sizes = {r.dims: r.n for r in vectors.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    n = F.element_at(F.create_map(*[F.lit(x) for d, c in (sizes or {0: 0}).items() for x in (d, c)]), F.col("dims"))
    turns = F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1)))
    large = vectors.select("id", "code", n.alias("n"), F.col("dims").alias("cell")).where(F.col("n") > BLOCK).select("*", turns.alias("round"))
    pivots: dict[tuple[int, int], list[bytes]] = {}
    for r in _drawn(large, 0).select("round", "cell", "id", "code").orderBy("round", "cell", "id").collect():
        pivots.setdefault((r.cell, r.round), []).append(bytes(r.code))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def make():
        known = {k: _matrix(p) for k, p in shared.value.items()}

        def work(batch: pa.RecordBatch):
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                take = pa.array(at)
                ids, codes = batch.column(0).to_numpy()[at], batch.column(2).take(take)
                x = _matrix(codes)
                for r in range(ROUNDS):
                    near = _nearest(x, known[d, r], ids, r) if (d, r) in known else np.zeros(len(at), np.int64)
                    yield {"id": ids, "code": codes, "round": np.full(len(at), r, np.int32), "cell": (np.int64(d) << np.int64(32)) + near}

        return work

    return map_batches(vectors, ["id", "dims", "code"], "id bigint, code binary, round int, cell bigint", make)


def blocks(vectors: DataFrame) -> DataFrame:
    """(id, code, block): every node in ROUNDS blocks of at most BLOCK nodes, each of which holds what is nearest to one pivot.

    A cell larger than that is parted by pivots of its own, again and again. It is read in parts of bounded size, each of which gets
    the cell's pivots first, so no task holds a cell. Nodes with equal codes, which no pivot parts, are parted by chance.
    """
    done, cells, level = [], written(_first_cells(vectors)), 1
    while True:
        sizes = written(cells.groupBy("round", "cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
        many = sizes.count()
        some = F.broadcast(sizes) if many <= FEW else sizes
        done.append((cells.join(some, ["round", "cell"], "left_anti") if many else cells).select("id", "code", F.xxhash64("round", "cell").alias("block")))
        if not many:
            break
        large = cells.join(some, ["round", "cell"])
        parts = F.ceil(F.col("n") / (64 * BLOCK)).cast("int")
        led = _drawn(large, level).select("round", "cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"), "id", "code")
        rows = large.select("round", "cell", F.pmod(F.xxhash64("id", F.lit(level)), parts).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "code")
        both = led.union(rows).select(F.xxhash64("round", "cell", "part").alias("group"), "kind", "id", "round", "cell", "code")

        def parted(salt: int = level):
            def work(pivots: pa.Table, rows: pa.Table):
                ids = rows.column("id").to_numpy()
                near = _nearest(_matrix(rows.column("code")), _matrix(pivots.column("code")), ids, salt)
                yield {"id": ids, "code": rows.column("code").combine_chunks(), "round": rows.column("round").combine_chunks(), "own": rows.column("cell").combine_chunks(), "pivot": near}

            return work

        made = map_led(both, "group", "kind", ["id", "round", "cell", "code"], "id bigint, code binary, round int, own bigint, pivot bigint", parted)
        cells = written(made.select("id", "code", "round", F.xxhash64("own", "pivot", F.lit(level)).alias("cell")))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _merged(lists: DataFrame, kept: int) -> DataFrame:
    """(id, others, s) of lists (id, others, s): of each node the best, every other once; ties by id."""

    def best():
        def work(t: pa.Table, starts: np.ndarray):
            sizes = pc.list_value_length(t.column("others")).to_numpy()
            ids = t.column("id").to_numpy()
            own = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows))), sizes)
            other, s = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("others", "s"))
            o, e, v = _best(own, other, s, kept)
            ends = np.searchsorted(o, np.arange(len(starts) + 1))
            cut = pa.array(ends, pa.int32())
            yield {"id": ids[starts], "others": pa.ListArray.from_arrays(cut, pa.array(e)), "s": pa.ListArray.from_arrays(cut, pa.array(v))}

        return work

    return map_groups(lists, "id", ["others", "s"], "id bigint, others array<bigint>, s array<smallint>", best)


def _best(own: np.ndarray, other: np.ndarray, s: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, other, s) in order of own and falling s: the `kept` best of each own, every other once."""
    order = np.lexsort((-s.astype(np.int32), other, own))
    own, other, s = own[order], other[order], s[order]
    once = np.ones(len(own), bool)
    once[1:] = (own[1:] != own[:-1]) | (other[1:] != other[:-1])
    own, other, s = own[once], other[once], s[once]
    order = np.lexsort((other, -s.astype(np.int32), own))
    own, other, s = own[order], other[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return own[rank < kept], other[rank < kept], s[rank < kept]


#: Similarities in lists are whole numbers of this part.
UNIT = 32000


def first_graph(vectors: DataFrame) -> DataFrame:
    """(id, others, s): for each node the best of its blocks."""

    def best():
        def work(t: pa.Table, starts: np.ndarray):
            ids, ends = t.column("id").to_numpy(), np.append(starts[1:], t.num_rows)
            for a, b in zip(starts, ends, strict=True):
                if b - a < 2:
                    continue
                x, k = _matrix(t.column("code").slice(a, b - a)), min(GIVEN, b - a - 1)
                for lo in range(0, b - a, 512):
                    s = x[lo : lo + 512] @ x.T
                    s[np.arange(len(s)), lo + np.arange(len(s))] = -2
                    top = np.argpartition(s, -k, axis=1)[:, -k:]
                    others, values = _lists(ids[a:b][top], np.rint(UNIT * np.take_along_axis(s, top, 1)).astype(np.int16))
                    yield {"id": ids[a + lo : a + lo + len(s)], "others": others, "s": values}

        return work

    return _merged(map_groups(blocks(vectors), "block", ["id", "code"], "id bigint, others array<bigint>, s array<smallint>", best), KEPT)


def edges(lists: DataFrame, *more: str) -> DataFrame:
    """(id, other, s, rank, more) of lists; s is near the cosine."""
    zipped = F.posexplode(F.arrays_zip("others", "s", *more)).alias("rank", "o")
    return lists.select("id", zipped).select("id", F.col("o.others").alias("other"), (F.col("o.s") / UNIT).cast("float").alias("s"), (F.col("rank") + 1).alias("rank"), *[F.col("o")[m].alias(m) for m in more])


def _chosen(own: np.ndarray, here: np.ndarray, other: np.ndarray, fresh: np.ndarray, turn: int, most: int) -> np.ndarray:
    """Which of the entries (here, other), in order of own, take part in a turn: those that aren't fresh, and of the fresh ones the smallest by a hash."""
    chance = mix64(here.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix64(other.astype(np.uint64) + np.uint64(turn)))
    place = np.flatnonzero(fresh)
    order = place[np.lexsort((chance[place], own[place]))]
    of = own[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    out = ~fresh
    out[order[rank < most]] = True
    return out


def descend(vectors: DataFrame, lists: DataFrame, turn: int, kept: int = KEPT, least: float = -1.5, sample: int = SAMPLE) -> DataFrame:
    """One round of NN-descent on lists (id, others, s, state) over entries of at least `least`; of the result's entries those of state 2 are
    new. Two members of a node are compared once, while one of them is fresh there; of those at most `sample` a
    direction take part in a round, and the others stay fresh."""

    def offers():
        def work(batch: pa.RecordBatch):
            ids, sizes = batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy()
            other, state = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            own = np.repeat(np.arange(len(ids)), sizes)
            here = np.repeat(ids, sizes)
            take = _chosen(own, here, other, state > 0, turn, sample)
            kind = (state[take] > 0).astype(np.int8)
            yield {"at": np.concatenate([here[take], other[take]]), "id": np.concatenate([other[take], here[take]]), "kind": np.concatenate([kind, kind + np.int8(2)])}

        return work

    def members():
        def work(t: pa.Table, starts: np.ndarray):
            at, ids, kind = (t.column(c).to_numpy() for c in ("at", "id", "kind"))
            own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
            back = np.flatnonzero(kind >= 2)
            take = kind < 2
            for fresh in (0, 1):
                some = back[(kind[back] & 1) == fresh]
                take[some[_chosen(own[some], at[some], ids[some], np.ones(len(some), bool), turn, sample)]] = True
            own, ids, fresh, at = own[take], ids[take], (kind[take] & 1), at[take]
            order = np.lexsort((-fresh, ids, own))
            own, ids, fresh, at = own[order], ids[order], fresh[order], at[order]
            once = np.ones(len(own), bool)
            once[1:] = (own[1:] != own[:-1]) | (ids[1:] != ids[:-1])
            some = np.bincount(own, fresh, len(starts))[own] > 0
            once &= some
            yield {"at": at[once], "id": ids[once], "fresh": fresh[once].astype(bool)}

        return work

    met = map_groups(map_batches(lists, ["id", "others", "state"], "at bigint, id bigint, kind byte", offers), "at", ["id", "kind"], "at bigint, id bigint, fresh boolean", members)
    full = F.when(F.size("s") >= kept, F.element_at("s", -1)).otherwise(F.lit(-32768)).cast("smallint")
    known = vectors.select("id", "code").join(lists.select("id", full.alias("worst")), "id", "left").fillna({"worst": -32768})
    floor = np.int16(max(-32768, round(UNIT * least))) if least > -1 else np.int16(-32768)

    def meet():
        def work(t: pa.Table, starts: np.ndarray):
            ids, worst, fresh = t.column("id").to_numpy(), np.maximum(t.column("worst").to_numpy(), floor).astype(np.float32), t.column("fresh").to_numpy(zero_copy_only=False)
            x = _matrix(t.column("code"))
            sizes = np.diff(np.append(starts, t.num_rows))
            for lo in range(0, len(starts), 512):
                n, begin = sizes[lo : lo + 512], starts[lo : lo + 512]
                at = begin[:, None] + np.arange(n.max())
                there = np.arange(n.max()) < n[:, None]
                at = np.where(there, at, begin[:, None])
                y, new = x[at], fresh[at]
                s = np.rint(UNIT * (y @ y.transpose(0, 2, 1)))
                fits = (s > worst[at][:, :, None]) & there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :])
                fits[:, np.arange(n.max()), np.arange(n.max())] = False
                g, i, j = np.nonzero(fits)
                if len(g):
                    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])]))
                    cut = pa.array(np.append(first, len(g)), pa.int32())
                    yield {"id": ids[at[g[first], i[first]]], "others": pa.ListArray.from_arrays(cut, pa.array(ids[at[g, j]])), "s": pa.ListArray.from_arrays(cut, pa.array(s[g, i, j].astype(np.int16)))}

        return work

    found = map_groups(met.join(known, "id"), "at", ["id", "code", "worst", "fresh"], "id bigint, others array<bigint>, s array<smallint>", meet)

    def renewed():
        def work(t: pa.Table, starts: np.ndarray):
            ids, sizes = t.column("id").to_numpy(), pc.list_value_length(t.column("others")).to_numpy()
            own = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids)))), sizes)
            other, s = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("others", "s"))
            lengths = pc.list_value_length(t.column("state")).fill_null(0).to_numpy()
            state = np.full(len(other), 2, np.int8)  # found now
            old = np.repeat(lengths > 0, sizes)
            before = t.column("state").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int8)
            here = np.repeat(ids, sizes)
            took = _chosen(own[old], here[old], other[old], before > 0, turn, sample)
            state[old] = (before > 0) & ~took
            # a pair that is found again was known: it stays as fresh as it was
            order = np.lexsort((state, other, own))
            own, other, s, state = own[order], other[order], s[order], state[order]
            once = np.ones(len(own), bool)
            once[1:] = (own[1:] != own[:-1]) | (other[1:] != other[:-1])
            own, other, s, state = own[once], other[once], s[once], state[once]
            order = np.lexsort((other, -s.astype(np.int32), own))
            own, other, s, state = own[order], other[order], s[order], state[order]
            begin = np.searchsorted(own, np.arange(len(starts)))
            rank = np.arange(len(own)) - begin[own]
            good = rank < kept
            own, other, s, state = own[good], other[good], s[good], state[good]
            cut = pa.array(np.searchsorted(own, np.arange(len(starts) + 1)), pa.int32())
            yield {"id": ids[starts], **{c: pa.ListArray.from_arrays(cut, pa.array(v)) for c, v in (("others", other), ("s", s), ("state", state))}}

        return work

    both = lists.select("id", "others", "s", "state").union(found.withColumn("state", F.lit(None).cast("array<tinyint>")))
    return map_groups(both, "id", ["others", "s", "state"], "id bigint, others array<bigint>, s array<smallint>, state array<tinyint>", renewed)


def settled(vectors: DataFrame, lists: DataFrame, kept: int = KEPT, least: float = -1.5, sample: int = SAMPLE) -> DataFrame:
    """Rounds of descent from (id, others, s) until at most SETTLED of the entries have still to be compared. Lists only ever improve, so
    they end."""
    out, turn = written(lists.withColumn("state", F.transform("others", lambda _: F.lit(1).cast("tinyint")))), 0
    while True:
        n = out.agg(F.coalesce(F.sum(F.size("others")), F.lit(0)).alias("all"), F.coalesce(F.sum(F.size(F.filter("state", lambda x: x > 0))), F.lit(0)).alias("fresh")).first()
        if n.fresh <= SETTLED * n.all:
            return out.drop("state")
        out = written(descend(vectors, out, turn, kept, least, sample))
        turn += 1


def graph(vectors: DataFrame) -> DataFrame:
    """(id, others, s) of every node that has another one of its length."""
    return settled(vectors, first_graph(vectors))


def near_graph(vectors: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """(id, others, s): the greedy search of every node at once, among entries of at least `least` and with WIDE of them kept.
    Every step compares what a node's entries list or are listed by; it costs as much as there are such entries."""
    near = edges(lists).where(F.col("s") >= least).select("id", "other", F.rint(F.col("s") * UNIT).cast("smallint").alias("s"))
    both = near.union(near.select(F.col("other"), F.col("id"), "s")).select("id", F.array("other").alias("others"), F.array("s").alias("s"))
    return settled(vectors, _merged(both, WIDE), WIDE, least, WIDE // 2)


def exact(pairs: DataFrame, vectors: DataFrame, left: str = "id", right: str = "other") -> DataFrame:
    """pairs with their cosine, from the vectors themselves."""
    one, two = (vectors.select(F.col("id").alias(c), F.col("unit").alias(f"unit_{c}")) for c in (left, right))
    rows = pairs.join(one, left).join(two, right)
    kept = [c for c in pairs.columns if c != "cosine"]

    def make():
        def work(batch: pa.RecordBatch):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32) for c in (f"unit_{left}", f"unit_{right}"))
            ends = np.cumsum([0, *(len(u) // 4 for u in batch.column(f"unit_{left}").to_pylist())])
            if len(ends) > 1:
                yield {c: batch.column(c) for c in kept} | {"cosine": np.add.reduceat(x.astype(np.float64) * y, ends[:-1])}

        return work

    fields = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(rows, [*kept, f"unit_{left}", f"unit_{right}"], f"{fields}, cosine double", make)


def similar_pairs(df: DataFrame, key: str = "key", vec: str = "vec", cosine: float = COSINE) -> DataFrame:
    """Pairs (key_a < key_b) with at least this cosine, at least one being among the other's REPORT nearest; ties by key.

    Null, empty, all-zero and non-finite vectors have no neighbours; vectors of different length are never compared; keys with
    the same vector are neighbours with cosine 1, each of its REPORT smallest others.
    """
    keyed = written(usable(df, key, vec))
    vectors = nodes(keyed)
    near = exact(edges(near_graph(vectors, graph(vectors), cosine - SLACK)).select("id", "other"), vectors).where(F.col("cosine") >= cosine)
    members = keyed.join(vectors.select("digest", "id"), "digest").select("id", F.col(key).alias("k")).distinct()
    # of a vector's keys only the smallest can be among the nearest of another key
    firsts = written(members.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("k"))).where(F.col("n") <= REPORT + 1).select("id", F.col("k").alias("other_key")))
    same = firsts.select("id", "other_key", F.lit(1.0).alias("cosine"))
    others = near.join(firsts.withColumnRenamed("id", "other"), "other").select("id", "other_key", "cosine")
    short = same.union(others).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other_key"))).where(F.col("n") <= REPORT + 1)
    rows = members.join(short, "id")
    own = F.max(F.when(F.col("k") == F.col("other_key"), F.col("n"))).over(Window.partitionBy("id", "k"))
    ranked = rows.withColumn("own", F.coalesce(own, F.lit(REPORT + 2))).withColumn("n", F.col("n") - (F.col("own") < F.col("n")).cast("int")).where((F.col("k") != F.col("other_key")) & (F.col("n") <= REPORT))
    return ranked.select(F.least("k", "other_key").alias(f"{key}_a"), F.greatest("k", "other_key").alias(f"{key}_b")).distinct()


def search(queries: DataFrame, vectors: DataFrame, lists: DataFrame, report: int = REPORT, beam: int = BEAM, steps: int = STEPS) -> DataFrame:
    """(query, other, cosine, rank) of nodes near each query (query, unit), which may be a vector that isn't in the graph.

    Greedy graph search in blocks: a query starts from the nearest of ENTRIES fixed nodes; every step joins each query's beam with
    the lists of its nodes and of those that list them, scores what is new and keeps the best `beam`. The beams are written after
    each step. Queries of a length that no node has find nothing.
    """
    both = edges(lists).select("id", "other")
    both = both.union(both.select(F.col("other"), F.col("id"))).distinct()
    capped = written(both.toDF("id", "other").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("other")))).where(F.col("n") <= 3 * KEPT).select("id", "other"))
    first = Window.partitionBy("dims").orderBy(F.xxhash64("id"), "id")
    starts: dict[int, list] = {}
    for r in vectors.select("id", "dims", "unit").withColumn("n", F.row_number().over(first)).where(F.col("n") <= ENTRIES).orderBy("dims", "n").collect():
        starts.setdefault(4 * r.dims, []).append((r.id, bytes(r.unit)))
    shared = vectors.sparkSession.sparkContext.broadcast(starts)

    def enter():
        known = {size: (np.array([i for i, _ in some]), np.frombuffer(b"".join(u for _, u in some), np.float32).reshape(len(some), -1)) for size, some in shared.value.items()}

        def work(batch: pa.RecordBatch):
            for q, u in zip(batch.column(0).to_numpy(), batch.column(1).to_pylist(), strict=True):
                if len(u) in known:
                    ids, units = known[len(u)]
                    s = units @ np.frombuffer(u, np.float32)
                    top = np.argsort(-s, kind="stable")[:STARTS]
                    yield {"query": np.full(len(top), q), "other": ids[top], "s": s[top]}

        return work

    def score():
        def work(batch: pa.RecordBatch):
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float32) for i in (1, 3))
                sizes = np.array([len(u) // 4 for u in batch.column(1).to_pylist()])
                yield {"query": batch.column(0), "other": batch.column(2), "s": np.add.reduceat(x * y, np.cumsum(sizes) - sizes)}

        return work

    asked = queries.select("query", F.col("unit").alias("asked"))
    units = vectors.select(F.col("id").alias("other"), "unit")
    beams = written(map_batches(queries, ["query", "unit"], "query bigint, other bigint, s float", enter))
    for _ in range(steps):
        reached = beams.select("query", F.col("other").alias("id")).join(capped, "id").select("query", "other").distinct().join(beams.select("query", "other"), ["query", "other"], "left_anti")
        scored = map_batches(reached.join(asked, "query").join(units, "other"), ["query", "asked", "other", "unit"], "query bigint, other bigint, s float", score)
        every = beams.union(scored).withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "other")))
        beams = written(every.where(F.col("n") <= beam).drop("n"))
    ends = beams.join(asked, "query").join(units, "other")

    def cosines():
        def work(batch: pa.RecordBatch):
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float32) for i in (1, 3))
                sizes = np.array([len(u) // 4 for u in batch.column(1).to_pylist()])
                yield {"query": batch.column(0), "other": batch.column(2), "cosine": np.add.reduceat(x.astype(np.float64) * y, np.cumsum(sizes) - sizes)}

        return work

    near = map_batches(ends, ["query", "asked", "other", "unit"], "query bigint, other bigint, cosine double", cosines)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= report)


def nearest(df: DataFrame, key: str = "key", vec: str = "vec", every: int = 100) -> DataFrame:
    """(key, other_key, cosine, rank): the REPORT nearest entries of each query key, the keys whose hash is divisible by `every`, against all.

    A neighbouring vector stands for its smallest keys; ties by key. A query's own vector, and others equal to it, come from its
    keys, the rest from the greedy search.
    """
    keyed = written(usable(df, key, vec))
    vectors = nodes(keyed)
    known = keyed.join(vectors.select("digest", "id"), "digest").select("id", F.col(key).alias("k")).distinct()
    asked = written(known.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).select("k", F.col("id").alias("query")))
    queries = vectors.join(asked.select(F.col("query").alias("id")).distinct(), "id").select(F.col("id").alias("query"), "unit")
    others = search(queries, vectors, graph(vectors), REPORT + 1).where("query <> other").select("query", "other", "cosine")
    found = others.union(asked.select("query", F.col("query").alias("other"), F.lit(1.0).alias("cosine")).distinct())
    members = known.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("k"))).where(F.col("n") <= REPORT + 1)
    rows = asked.join(found, "query").join(members.select(F.col("id").alias("other"), F.col("k").alias("other_key")), "other").where("k <> other_key")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("cosine"), "other_key"))).where(F.col("rank") <= REPORT).select(F.col("k").alias(key), "other_key", "cosine", "rank")


def nearest_of_all(df: DataFrame, key: str = "key", vec: str = "vec") -> DataFrame:
    """(key, other_key, cosine, rank): the REPORT nearest entries of every usable key, read off the graph; ties by key.

    Null, empty, all-zero and non-finite vectors have no neighbours. Of the keys of a neighbouring vector the smallest count.
    """
    keyed = written(usable(df, key, vec))
    vectors = nodes(keyed)
    near = exact(edges(graph(vectors)).select("id", "other"), vectors)
    known = keyed.join(vectors.select("digest", "id"), "digest").select("id", F.col(key).alias("k")).distinct()
    firsts = written(known.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("k"))).where(F.col("n") <= REPORT + 1).select("id", F.col("k").alias("other_key")))
    others = near.join(firsts.withColumnRenamed("id", "other"), "other").select("id", "other_key", "cosine")
    short = firsts.select("id", "other_key", F.lit(1.0).alias("cosine")).union(others).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other_key"))).where(F.col("n") <= REPORT + 1)
    rows = known.join(short, "id").where("k <> other_key")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("cosine"), "other_key"))).where(F.col("rank") <= REPORT).select(F.col("k").alias(key), "other_key", "cosine", "rank")

"""What the operators of this package share: batches of columns, flat arrays of code points, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspark.sources.shared import written as written

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def map_batches(df: DataFrame, columns: list[str], schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]]) -> DataFrame:
    """Runs `make()` once per task and its result on every Arrow batch of `columns`; each dict it yields is a batch of output columns.

    Only `columns` are read, so other columns of the input, whatever their names, never reach the workers.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Batches) -> Batches:
        work = make()
        for batch in batches:
            for out in work(batch):
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, type=f.type) for f, a in ((f, out[f.name]) for f in arrow)]
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for f, a in zip(arrow, arrays, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, kind)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the offsets of the texts (one more than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n values; position i stands for codes[i:i+n]. Windows may cross texts: mask them."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    mixed = mix64(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(len(codes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x100000001B3) + mixed[i : i + len(out)]
    return mix64(out)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text's number at each position of a flat array."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def map_groups(df: DataFrame, group: str, columns: list[str], schema: str, make: Callable[[], Callable[[pa.Table, np.ndarray], Iterable[dict]]], least: int = 4096) -> DataFrame:
    """Runs on runs of whole groups: work(table, starts) gets rows sorted by `group` and where each group starts.

    For groups of bounded size only: a task holds one group and at most a batch more. `group` is a bigint and comes first in
    the table, then `columns`.
    """
    kind = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Batches) -> Batches:
        work, held, rows = make(), [], 0

        def done(t: pa.Table, keys: np.ndarray) -> Batches:
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for out in work(t, starts):
                yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, type=f.type) for f, a in ((f, out[f.name]) for f in arrow)], schema=arrow)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= least:
                t = pa.Table.from_batches(held).combine_chunks()
                keys = t.column(0).to_numpy()
                last = int(np.searchsorted(keys, keys[-1]))
                if last:
                    yield from done(t.slice(0, last).combine_chunks(), keys[:last])
                    t = t.slice(last)
                held, rows = t.to_batches(), t.num_rows
        if rows:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from done(t, t.column(0).to_numpy())

    return df.select(group, *columns).repartition(group).sortWithinPartitions(group).mapInArrow(run, kind)


def map_led(df: DataFrame, group: str, kind: str, columns: list[str], schema: str, make: Callable[[], Callable[[pa.Table, pa.Table], Iterable[dict]]]) -> DataFrame:
    """Runs on groups whose first rows, those of `kind` 0, lead: work(leaders, rows) gets all leaders of the group and some of its rows.

    A group's leaders are of bounded number; its rows stream by, so a group of any size needs memory for its leaders and a batch.
    """
    to = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(to)

    def run(batches: Batches) -> Batches:
        work, current, leaders = make(), None, []
        for batch in batches:
            keys, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(keys)) if len(keys) else []
            begin = 0
            for end in map(int, ends):
                if keys[begin] != current:
                    current, leaders = keys[begin], []
                part = pa.Table.from_batches([batch.slice(begin, end - begin)])
                if kinds[begin] == 0:
                    leaders.append(part)
                else:
                    for out in work(pa.concat_tables(leaders).combine_chunks() if leaders else part.slice(0, 1), part):
                        yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, type=f.type) for f, a in ((f, out[f.name]) for f in arrow)], schema=arrow)
                begin = end

    return df.select(group, kind, *columns).repartition(group).sortWithinPartitions(group, kind).mapInArrow(run, to)


#: Rows of one id that a join takes at once, and ids up to which their table is broadcast.
PART, FEW = 2000, 20_000


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(x, y) for each pair (a, b) of ids: every member (id, k) of the one with every member of the other.

    An id of many members is parted: its members by a hash into parts of about PART, the pairs it is in into as many rows, so no task
    holds more than PART members of either side.
    """
    from pyspark.sql import functions as F

    hot = members.groupBy("id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    known = written(hot)
    hot = F.broadcast(known) if known.count() <= FEW else known
    parts = F.coalesce("parts", F.lit(1))
    salted = members.join(hot, "id", "left").select("id", "k", F.pmod(F.xxhash64("k"), parts).cast("int").alias("salt"))
    out = pairs.select("a", "b")
    for side, name in (("a", "x"), ("b", "y")):
        out = out.join(hot.withColumnRenamed("id", side), side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        out = out.join(salted.withColumnRenamed("id", side).withColumnRenamed("k", name), [side, "salt"]).drop("salt")
    return out.select("a", "b", "x", "y")


def bounded_sample(df: DataFrame, by: str, rows: int, where: str, *more: str) -> list:
    """At most `rows` rows (by, more) with different values of `by`, those whose values are smallest by a hash, so the same at every
    partitioning; copies of a value count once. A condition on the same hash leaves about a quarter more before anything is sorted
    or sent, so what reaches the driver doesn't grow with the table."""
    from pyspark.sql import functions as F

    some = df.where(where).select(by, *more, F.pmod(F.xxhash64(by), F.lit(1 << 30)).alias("h_"))
    n = df.where(where).count()
    few = some.where(F.col("h_") < int((1 << 30) * min(1.0, 1.25 * rows / max(1, n)))).dropDuplicates(["h_", by])
    return few.orderBy("h_", by).limit(rows).drop("h_").collect()

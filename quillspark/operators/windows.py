"""Window-shaped operators: runs, carries, sessions, cut-offs, as-of and range joins, greedy folds over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import written


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """rows with `run` (its number within the keys) and `run_length`: successive rows of equal value; nulls equal one another."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    numbered = rows.withColumn("new_", new).withColumn("run", F.sum(F.col("new_").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")
    return numbered.withColumn("run_length", F.count("*").over(Window.partitionBy(*keys, "run")))


def ends_from_next(rows: DataFrame, keys: list[str], order: list[str], start: str, last: Column) -> DataFrame:
    """rows with `end`: the next row's start, for the last row `last`."""
    return rows.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(*order)), last))


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the last value so far that isn't null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def totals_before(rows: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """rows with the total of `amount` over the rows before them in their key, in two passes: no task holds a key.

    Rows are put into ranges of keys and order and written; every range is summed on its own, and the totals of a key's ranges
    before it, of which there are few, are added. `order` is total within a key. The null amount counts as 0.
    """
    ranged = written(rows.withColumn("amount_", F.coalesce(amount.cast("double"), F.lit(0.0))).repartitionByRange(*keys, *order).withColumn("range_", F.spark_partition_id()))
    parts = ranged.groupBy("range_", *keys).agg(F.sum("amount_").alias("part_"))
    carried_in = parts.withColumn("carry_", F.coalesce(F.sum("part_").over(Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("part_")
    inside = F.coalesce(F.sum("amount_").over(Window.partitionBy("range_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    same = [F.col(f"k_{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    renamed = carried_in.select(F.col("range_").alias("r_"), "carry_", *[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)])
    joined = ranged.withColumn("inside_", inside).join(renamed, [F.col("r_") == F.col("range_"), *same])
    return joined.withColumn(name, F.col("inside_") + F.col("carry_")).select(*rows.columns, name)


def until_total(rows: DataFrame, keys: list[str], order: list[str], amount: str, limit: float) -> DataFrame:
    """rows in order until the total before them reaches the limit; the row that crosses it is in."""
    return totals_before(rows, keys, order, F.col(amount), "before_").where(F.col("before_") < limit).drop("before_")


def sessions(rows: DataFrame, keys: list[str], ts: str, order: list[str], gap_seconds: int) -> DataFrame:
    """rows with `session`: a new one where more than the gap has passed; exactly the gap stays in."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    new = micros(ts) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_seconds * 1_000_000
    return rows.withColumn("session", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def first_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """rows with `allowed`: the first n of each key."""
    return rows.withColumn("allowed", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= n)


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, tie: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row not later than it (of equal times the largest `tie`), null if there is none.

    Both sides go through one sort within the keys and one running window: each row is read once, whatever the match rate.
    """
    a = left.select(F.struct("*").alias("l"), *[F.col(k).alias(f"k_{k}") for k in keys], F.col(left_on).alias("t_"), F.lit(1).alias("side_"), F.lit(None).cast(right.schema[tie].dataType).alias("tie_"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("v_"))
    b = right.select(F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("l"), *[F.col(k).alias(f"k_{k}") for k in keys], F.col(right_on).alias("t_"), F.lit(0).alias("side_"), F.col(tie).alias("tie_"), F.struct(*values).alias("v_"))
    w = Window.partitionBy(*[f"k_{k}" for k in keys]).orderBy("t_", "side_", "tie_").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("v_", F.last("v_", ignorenulls=True).over(w)).where("side_ = 1")
    return both.select("l.*", *[F.col("v_")[v].alias(v) for v in values])


def within(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, seconds: int) -> DataFrame:
    """Pairs of rows whose times differ by at most `seconds`: an equality join on time buckets, so that no row meets rows far away.

    left keeps its columns; right's are prefixed with other_ except the keys.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000)).cast("bigint")
    a = left.withColumn("bucket_", F.explode(F.array(bucket(left_on) - 1, bucket(left_on), bucket(left_on) + 1)))
    b = right.select(*keys, *[F.col(c).alias(f"other_{c}") for c in right.columns if c not in keys]).withColumn("bucket_", bucket(f"other_{right_on}"))
    gap = F.abs(F.unix_micros(F.col(f"other_{right_on}").cast("timestamp")) - F.unix_micros(F.col(left_on).cast("timestamp")))
    return a.join(b, [*keys, "bucket_"]).where(gap <= seconds * 1_000_000).drop("bucket_")


def folded(rows: DataFrame, keys: list[str], order: list[str], schema: str, begin: Callable[[], Any]) -> DataFrame:
    """A sequential fold over the rows of each key in order: `begin()` gives an object with step(row) and end(), both yielding
    dicts of output columns. Rows stream through: a task holds an Arrow batch and the object's own state, however large a key is."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, out = None, None, []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(columns, values, strict=True))
                key = tuple(row[k] for k in keys)
                if state is None or key != current:
                    if state is not None:
                        out.extend(state.end())
                    state, current = begin(), key
                out.extend(state.step(row))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if state is not None:
            out.extend(state.end())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    return rows.select(*columns).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)

"""Duplicates of files and paragraphs, and a few relations between what is there and what is known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.windows import totals_before
from quillspark.sources.shared import written

LEAST_KEY, COVER = 8, 0.8


def first_of(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row of each key, the first in order; rows without a key are all kept."""
    w = Window.partitionBy("key_").orderBy(*order)
    keyed = rows.withColumn("key_", key)
    numbered = keyed.where("key_ is not null").withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
    return numbered.unionByName(keyed.where("key_ is null")).drop("key_")


def with_twins(excluded: DataFrame, kept: DataFrame, digest: str, key: str) -> DataFrame:
    """excluded with `twin`: the smallest kept key of the same digest, null if there is none."""
    twins = kept.groupBy(digest).agg(F.min(key).alias("twin"))
    return excluded.join(twins, digest, "left")


def paragraphs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, paragraph): lines that aren't blank, numbered as they stand."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?|\u2028|\u2029", "\n"), "\n"), lambda x: X.trimmed(F.regexp_replace(x, "[ \\t\u3000\u00a0]+", " ")))
    return documents.select(key, F.posexplode(lines).alias("at", "paragraph")).where("paragraph <> ''")


def repeated_exactly(paras: DataFrame, order: list[str], text: str = "paragraph") -> DataFrame:
    """paras with `first`: whether no earlier paragraph has the same key; keys under eight characters never count as repeats.

    Only keys that come again are joined, with the place of their first, so a key of any number of rows is no task's alone.
    """
    keyed = paras.withColumn("dedupe_key", X.dedupe_key(F.col(text)))
    again = keyed.where(F.length("dedupe_key") >= LEAST_KEY).groupBy("dedupe_key").agg(F.min(F.struct(*order)).alias("first_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    marked = keyed.join(again, "dedupe_key", "left").withColumn("first", F.col("first_").isNull() | (F.struct(*order) == F.col("first_")))
    return marked.select(*paras.columns, "dedupe_key", "first")


def kept_paragraphs(paras: DataFrame, order: list[str], text: str = "paragraph", cover: float = COVER, most: int = 200) -> DataFrame:
    """paras that a reader in order would keep: the key is new, and less than `cover` of it is sentences of kept paragraphs before.

    The rule depends on its own earlier decisions, so it is solved as a fix-point: bounds on which sentences are kept close in from both
    sides, and at least the earliest open paragraph of each set that shares sentences is decided in every round, so sets go on side by
    side. A round reads what is open and the sentences in it, and appends what it decides; only digests move. More rounds than
    `most` are an error.
    """
    place = F.struct(*order)
    base = written(paras.withColumn("place", place).withColumn("k", X.dedupe_key(F.col(text))).withColumn("size", F.length("k")))
    long = base.where(F.col("size") >= LEAST_KEY)
    every = long.select("place", F.explode(F.transform(F.split(F.col(text), "[。！？；!?;\\n]+"), lambda s: X.dedupe_key(s))).alias("s")).where(F.length("s") >= LEAST_KEY)
    parts = written(every.select("place", F.unhex(F.md5("s")).alias("sd"), F.length("s").alias("n")))
    # of equal keys only the first can be kept: it is so whatever is decided, unless it is covered itself
    open_ = written(long.select("place", "size", F.unhex(F.md5("k")).alias("kd")))
    empty = long.select("place").limit(0)
    kept, kept_parts, kept_keys = [], [], []
    for _ in range(most):
        if open_.isEmpty():
            break
        union = lambda some, like: reduce(DataFrame.unionByName, some) if some else like
        sure_parts = union(kept_parts, parts.select("sd", "place").limit(0)).join(parts.select("sd").distinct(), "sd", "left_semi")
        seen = parts.select("sd", F.col("place").alias("maybe")).groupBy("sd").agg(F.min("maybe").alias("maybe")).join(sure_parts.groupBy("sd").agg(F.min("place").alias("sure")), "sd", "left")
        first = open_.groupBy("kd").agg(F.min("place").alias("open")).join(union(kept_keys, open_.select("kd", "place").limit(0)).groupBy("kd").agg(F.min("place").alias("twin")), "kd", "left")
        sure, maybe = F.col("sure") < F.col("place"), F.least("maybe", "sure") < F.col("place")
        covered = parts.join(seen, "sd").groupBy("place").agg(F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(maybe, F.col("n")).otherwise(0)).alias("high"))
        judged = open_.join(covered, "place", "left").fillna({"low": 0, "high": 0}).join(first, "kd")
        drop = F.coalesce(F.col("twin") < F.col("place"), F.lit(False)) | ((F.col("low") > 0) & (F.col("low") >= F.col("size") * F.lit(cover)))
        keep = ~(F.col("open") < F.col("place")) & ~((F.col("high") > 0) & (F.col("high") >= F.col("size") * F.lit(cover)))
        now = written(judged.select("place", "size", "kd", F.when(drop, False).when(keep, True).alias("kept")))
        chosen = now.where("kept")
        kept.append(chosen.select("place"))
        kept_keys.append(chosen.select("kd", "place"))
        kept_parts.append(written(parts.join(chosen.select("place"), "place", "left_semi").select("sd", "place")))
        open_ = now.where("kept is null").select("place", "size", "kd")
        parts = written(parts.join(open_.select("place"), "place", "left_semi"))
    else:
        raise RuntimeError(f"paragraphs are not decided after {most} rounds")
    short = base.where(F.col("size") < LEAST_KEY)
    return short.unionByName(base.join(reduce(DataFrame.unionByName, kept, empty), "place", "left_semi")).drop("place", "k", "size")


def with_suffixes(rows: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """Ids made unique: the second of the same id gets -2, the third -3, in order. Only ids that come again are numbered, over ranges, so
    an id of any number of rows is no task's alone."""
    again = rows.groupBy(id_column).agg(F.count("*").alias("n_")).where("n_ > 1").select(F.col(id_column).alias("again_"))
    same = F.col("again_").eqNullSafe(F.col(id_column))
    numbered = totals_before(rows.join(again, same, "left_semi"), [id_column], order, F.lit(1), "n_")
    made = F.when(F.col("n_") > 0, F.concat(F.col(id_column), F.lit("-"), (F.col("n_") + 1).cast("bigint"))).otherwise(F.col(id_column))
    return rows.join(again, same, "left_anti").unionByName(numbered.withColumn(id_column, made).drop("n_"))


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert: of the rows with the same keys the last one in order."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def differences(one: DataFrame, two: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, reason): missing on a side, extra, or the first column that differs; equal rows don't come out."""
    a = one.select(*keys, F.struct(*columns).alias("a"))
    b = two.select(*keys, F.struct(*columns).alias("b"))
    first = reduce(lambda rest, c: F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)).otherwise(rest), reversed(columns), F.lit(None).cast("string"))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise(first).alias("reason")).where("reason is not null")

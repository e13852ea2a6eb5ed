"""Links between corpora: containment joins over pairs of characters, chains in reading order, prefixes, coverage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from quillspark.functions import text as X
from quillspark.functions.fixed import NUMBERED
from quillspark.functions.numerals import number_of
from quillspark.sources.shared import written
from quillspark.sources.tables import spread


#: Pairs of characters of the left side, all texts together, up to which they are broadcast.
LEFT_GRAMS = 20_000_000


def _packed(text: str) -> Column:
    """The distinct pairs of characters as numbers."""
    return F.transform(X.bigrams(F.col(text)), lambda g: F.ascii(g).cast("bigint") * 2097152 + F.ascii(F.substring(g, 2, 1)))


def containment_join(left: DataFrame, right: DataFrame, threshold: float, left_key: str = "id", right_key: str = "id", left_text: str = "text", right_text: str = "text", most: int = LEFT_GRAMS) -> DataFrame:
    """(a, b, score): pairs where at least `threshold` of the left text's distinct pairs of characters are in the right's. Exact.

    The left side is a stated set of queries against all of the right. While it has at most `most` pairs of characters, it is broadcast as
    posting lists, and every right text counts its hits in them where it is read: nothing is shuffled. Beyond that, by prefix
    filtering: whoever holds `need` of a set of n holds at least k of any n - need + k of its members; the rarest such
    members are joined on and counted, k being half the need, and the few pairs that reach k are verified. Texts without pairs
    match nothing.
    """
    a = left.select(F.col(left_key).alias("a"), _packed(left_text).alias("sa")).where("size(sa) > 0")
    texts = spread(right.select(F.col(right_key).alias("b"), F.col(right_text).alias("text_")))
    if (a.agg(F.sum(F.size("sa").cast("bigint")).alias("n")).first().n or 0) <= most:
        return _counted(a, texts.select("b", X.compact(F.col("text_")).alias("key")).where("length(key) > 1"), threshold)
    b = texts.select("b", _packed("text_").alias("sb")).where("size(sb) > 0")
    held = b.select("b", F.explode("sb").alias("g"))
    common = held.groupBy("g").agg(F.count("*").alias("df"))
    wanted = a.select("a", F.size("sa").alias("n"), F.explode("sa").alias("g")).join(common, "g", "left").fillna({"df": 0})
    need = F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    k = F.greatest(F.lit(1), F.floor(need / 2))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("df", "g"))
    rarest = wanted.withColumn("rank", rank).withColumn("k", k).where(F.col("rank") <= F.col("n") - need + F.col("k")).where("df > 0")
    pairs = rarest.select("a", "g", "k").join(held, "g").groupBy("a", "b", "k").agg(F.count("*").alias("hits")).where("hits >= k").select("a", "b")
    scored = pairs.join(a, "a").join(b, "b").withColumn("score", X.containment(F.col("sa"), F.col("sb")))
    return scored.where(F.col("score") >= threshold - 1e-9).select("a", "b", "score")


def _counted(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """The pairs of containment_join with the left side (a, sa) broadcast; the right one is (b, key), its pairs are made where they are counted."""
    rows = a.collect()
    sizes = np.array([len(r.sa) for r in rows], np.int64)
    grams = np.fromiter((g for r in rows for g in r.sa), np.int64, int(sizes.sum()))
    own = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    order = np.argsort(grams, kind="stable")
    known, starts = np.unique(grams[order], return_index=True)
    need = np.ceil(threshold * sizes - 1e-9)
    kind = a.schema["a"].dataType
    shared = a.sparkSession.sparkContext.broadcast((known, np.append(starts, len(grams)), own[order], sizes, need, pa.array([r.a for r in rows], to_arrow_type(kind))))
    schema = StructType([StructField("a", kind), StructField("b", b.schema["b"].dataType), StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, starts, lists, sizes, need, keys = shared.value
        for batch in batches:
            out_a, out_b, scores = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                grams = np.unique(codes[:-1] * 2097152 + codes[1:])
                where = np.searchsorted(known, grams)
                near = where < len(known)
                at = where[near][known[where[near]] == grams[near]]
                if not len(at):
                    continue
                hits = np.bincount(np.concatenate([lists[starts[j] : starts[j + 1]] for j in at.tolist()]), minlength=len(sizes))
                good = np.flatnonzero((hits >= need) & (hits > 0))
                out_a.append(good)
                out_b.append(np.full(len(good), i))
                scores.append(hits[good] / sizes[good])
            if out_a:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(out_a))), batch.column(0).take(pa.array(np.concatenate(out_b))), pa.array(np.concatenate(scores))], schema=arrow)

    return b.select("b", "key").mapInArrow(run, schema)


def best_per_left(links: DataFrame, n: int) -> DataFrame:
    """The n best of each left key; ties by the right key. For one left text the order by score is that by shared pairs."""
    return links.withColumn("n_", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("n_") <= n).drop("n_")


def heaviest_chain(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the chain of greatest total weight in which both coordinates grow strictly; a tree of prefix maxima over y."""
    if not len(x):
        return np.zeros(0, np.int64)
    place = np.unique(y, return_inverse=True)[1] + 1
    size = int(place.max())
    best, at = np.zeros(size + 1), np.full(size + 1, -1, np.int64)
    total, before = np.zeros(len(x)), np.full(len(x), -1, np.int64)
    order = np.lexsort((y, x))
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and x[order[j]] == x[order[i]]:
            j += 1
        for k in order[i:j]:  # equal x: all ask before any is entered
            p, top = int(place[k]) - 1, 0.0
            while p > 0:
                if best[p] > top:
                    top, before[k] = best[p], at[p]
                p -= p & -p
            total[k] = top + w[k]
        for k in order[i:j]:
            p = int(place[k])
            while p <= size:
                if total[k] > best[p]:
                    best[p], at[p] = total[k], k
                p += p & -p
        i = j
    out, k = [], int(np.argmax(total))
    while k >= 0:
        out.append(k)
        k = int(before[k])
    return np.array(out[::-1], np.int64)


def ordered_best(candidates: DataFrame, group: str) -> DataFrame:
    """Of candidates (group, x, y, score, ...) the chain of greatest score, strictly increasing in x and y, for each group. A group
    is one book's candidates, already cut to the best few of each unit."""

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        return f.iloc[heaviest_chain(f["x"].to_numpy(), f["y"].to_numpy(), f["score"].to_numpy(float))]

    return candidates.groupBy(group).applyInPandas(pick, candidates.schema)


def longest_prefix(rows: DataFrame, prefixes: DataFrame, column: str, prefix: str, values: list[str]) -> DataFrame:
    """Distinct values of `column` with those of the longest prefix they begin with, null for none.

    An equality join on each value's own prefixes, so neither side is compared with all of the other.
    """
    distinct = rows.select(column).distinct()
    every = distinct.select(column, F.explode(F.sequence(F.lit(0), F.length(column))).alias("n_"))
    met = every.withColumn("p_", F.substring(F.col(column), F.lit(1), F.col("n_"))).join(prefixes.select(F.col(prefix).alias("p_"), *values), "p_")
    best = met.groupBy(column).agg(F.max_by(F.struct(*values), "n_").alias("v_"))
    return distinct.join(best, column, "left").select(column, *[F.col("v_")[v].alias(v) for v in values])


def upserted(links: DataFrame, order: str | None = None) -> DataFrame:
    """One link of each classic and target: of links made again the one that comes last by `order`. A table without an order has no last
    one; then the one with the higher score stays."""
    by = F.struct(*([order] if order else []), "score", "target_kind", "method", "lecture_number")
    return links.groupBy("classic_id", "target_id").agg(F.max(by).alias("v")).select("classic_id", "target_id", "v.target_kind", "v.score", "v.method", "v.lecture_number")


def commentary(links: DataFrame, chunks: DataFrame, n: int = 6) -> DataFrame:
    """(classic_id, rank, row, id, score): the best n linked passages of each classic; ties by row. Of ids delivered again the first row."""
    first = chunks.groupBy("id").agg(F.min("row").alias("row"))
    both = upserted(links).join(first.withColumnRenamed("id", "target_id"), "target_id")
    rank = F.row_number().over(Window.partitionBy("classic_id").orderBy(F.desc("score"), "row"))
    return both.withColumn("rank", rank).where(F.col("rank") <= n).select("classic_id", "rank", "row", F.col("target_id").alias("id"), "score")


def coverage(links: DataFrame, classics: DataFrame) -> DataFrame:
    """(target_kind, linked, rate): classics with a link of the kind, and their part of all."""
    ids = classics.select("id").distinct()
    total = ids.agg(F.count("*").alias("total"))
    met = links.join(ids.withColumnRenamed("id", "classic_id"), "classic_id", "left_semi").groupBy("target_kind").agg(F.countDistinct("classic_id").alias("linked"))
    return met.join(F.broadcast(total)).select("target_kind", "linked", (F.col("linked") / F.col("total")).alias("rate"))


#: Terms that are looked for in one pass over the passages, passages of a term that are compared in one task, units of those that are compared
#: at once, and cells of a table of pairs.
TERMS, TOGETHER, UNITS, CELLS = 200_000, 4096, 1000, 4_000_000
_FLAGS = ("heading", "nearby", "early", "holds")


def _named(rows: DataFrame, terms: DataFrame, numbered: str, strict: bool) -> DataFrame:
    """Of rows (row, id, kind, key, text, last, earlier) those that name a term so that it may qualify: (row, id, kind, key, found), found
    being the terms, each with _FLAGS over its aliases. Only the first 80 characters are looked through if only they can decide."""
    aliases: dict[str, list[str]] = {}
    of: dict[str, list[str]] = {}
    for r in terms.where("alias is not null and term is not null").select("term", "alias").distinct().orderBy("term", "alias").collect():
        aliases.setdefault(r.term, []).append(r.alias)
        of.setdefault(r.alias, []).append(r.term)
    shared = rows.sparkSession.sparkContext.broadcast((aliases, of, sorted({len(x) for x in of if x})))
    schema = StructType([*(rows.schema[c] for c in ("row", "id", "kind", "key")), StructField("found", ArrayType(StructType([StructField("term", StringType()), *(StructField(c, BooleanType()) for c in _FLAGS)])))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aliases, of, sizes = shared.value
        heads = re.compile(numbered, re.ASCII)
        heading: dict[str, re.Pattern] = {}

        def headed(text: str, alias: str) -> bool:
            if alias not in heading:
                heading[alias] = re.compile(f"(?:{numbered}){re.escape(alias)}", re.ASCII)
            return heading[alias].search(text) is not None

        def held(text: str) -> set[str]:
            return {x for n in sizes for x in {text[i : i + n] for i in range(len(text) - n + 1)} if x in of}

        for batch in batches:
            at, out = [], []
            for i, (text, last, earlier) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "last", "earlier")), strict=True)):
                if text is None:
                    continue
                known = held(text if strict else text[:80]) | (held(earlier) if strict else set()) | ({last} if last in of else set())
                if not known:
                    continue
                numbers, before = heads.search(text) is not None, strict and heads.search(earlier) is not None
                found = []
                for term in sorted({t for x in known for t in of[x]}):
                    # an empty alias is named only by an empty section
                    names = [x for x in aliases[term] if x or last == ""]
                    head, near = numbers and any(headed(text, x) for x in names), before and any(headed(earlier, x) for x in names)
                    early, holds = any(x in text[:80] or x == last for x in names), any(x in text for x in names)
                    if (early or head or near) and (holds or near):
                        found.append({"term": term, "heading": head, "nearby": near, "early": early, "holds": holds})
                if found:
                    at.append(i)
                    out.append(found)
            kept = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept).cast(arrow.field(c).type) for c in ("row", "id", "kind", "key")), pa.array(out, arrow.field("found").type)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _text_pairs(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(own, pair): the distinct pairs of characters of each key, as numbers, and the key's place."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(keys), dtype=np.uint64), sizes)
    both = ((own << np.uint64(42))[:-1] | (codes[:-1] << np.uint64(21)) | codes[1:])[own[:-1] == own[1:]]
    both = np.sort(both)
    both = both[np.concatenate([np.ones(min(1, len(both)), bool), both[1:] != both[:-1]])]
    return (both >> np.uint64(42)).astype(np.int64), both & np.uint64((1 << 42) - 1)


def _thousandths(x: np.ndarray) -> np.ndarray:
    """x rounded to three places as `round` does it: what is written as half a place goes up."""
    y = x * 1000
    out = np.floor(y + 0.5).astype(np.int32)
    close = np.abs(y - np.floor(y) - 0.5) < 1e-6
    if close.any():
        values, at = np.unique(x[close], return_inverse=True)
        exact = [int(Decimal(repr(v)).scaleb(3).quantize(Decimal(1), ROUND_HALF_UP)) for v in values.tolist()]
        out[close] = np.array(exact, np.int32)[at.ravel()]
    return out


def _scored(units: pa.Table, rows: pa.Table, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(unit, row, thousandths): places of units (key, by) and their best n of rows (row, key, _FLAGS), ties by row. Shared pairs of characters
    are counted by a product of two tables, as many rows at a time as CELLS allow, so a unit may have more than n in all."""
    own, pair = _text_pairs(units["key"].to_pylist())
    sizes = np.bincount(own, minlength=len(units))
    known, place = np.unique(pair, return_inverse=True)
    has = np.zeros((len(units), len(known)), np.float32)
    has[own, place] = 1
    by = units["by"].to_numpy(zero_copy_only=False)[:, None].astype(bool)
    order = pc.sort_indices(rows["row"]).to_numpy()
    keys, flags = rows["key"].to_pylist(), {c: rows[c].to_numpy(zero_copy_only=False).astype(bool) for c in _FLAGS}
    for part in np.array_split(order, max(1, -(-len(order) * (len(known) + len(units)) // CELLS))):
        if not len(part):
            continue
        own, pair = _text_pairs([keys[i] for i in part])
        at = np.searchsorted(known, pair)
        met = at < len(known)
        met[met] = known[at[met]] == pair[met]
        holding = np.zeros((len(part), len(known)), np.float32)
        holding[own[met], at[met]] = 1
        share = (has @ holding.T).astype(float) / np.maximum(1, sizes)[:, None]
        heading, nearby, early, holds = (flags[c][part][None, :] for c in _FLAGS)
        near = nearby & by
        score = _thousandths(0.35 + 0.25 * heading + 0.15 * early + 0.1 * near + 0.15 * share)
        score[~(np.where(by, heading | near, early) & (holds | near))] = -1
        unit = np.arange(len(units))
        for _ in range(min(n, len(part))):
            best = score.argmax(1)
            value = score[unit, best]
            good = value >= 0
            yield unit[good], part[best[good]], value[good]
            score[unit, best] = -1


def term_links(classics: DataFrame, targets: DataFrame, terms: DataFrame, n: int = 3, numbered: str = "[一二三四五六七八九十百千〇零\\d]{1,5}[、：]\\s*", strict: Column | None = None) -> DataFrame:
    """(classic_id, target_id, kind, score): passages that name a classic's term, the best n of each classic and kind; ties by row.

    `terms` (term, alias) is a dimension, `numbered` a pattern that means the same in Java and Python. A passage qualifies by naming the term
    early (in its first 80 characters or at its section's end); where `strict` holds (of the columns `book`, the classic's title, and
    kind) by a numbered heading of the term in it or in the passage before, even if it doesn't name the term itself. The score adds a
    heading, an early mention, the passage before, and how much of the classic is in the passage.

    Every passage that names a term is compared with every classic of the term. The passages of a term and kind are parted into at most
    about TOGETHER, each part meets all the term's classics in one task, and only its best n of each classic go on.
    """
    # the passage before is asked for only where a heading in it can decide
    before = F.lit("") if strict is None else F.coalesce(F.lag("text").over(Window.partitionBy("kind", "source").orderBy("row")), F.lit(""))
    rows = targets.select("row", "id", "kind", "text", F.element_at(F.split(F.coalesce("section", F.lit("")), r"\s+"), -1).alias("last"), before.alias("earlier"))
    rows = spread(rows).withColumn("key", X.compact(F.col("text")))
    passes = max(1, -(-terms.select("term").distinct().count() // TERMS))
    some = [terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == i) if passes > 1 else terms for i in range(passes)]
    named = written(reduce(DataFrame.unionByName, [_named(rows, t, numbered, strict is not None) for t in some]))
    hits = named.select("row", "id", "kind", "key", F.explode("found").alias("v")).select("row", "id", "kind", "key", "v.*")
    counts = hits.groupBy("term", "kind").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    groups = written(counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("g", F.monotonically_increasing_id()))
    last = F.element_at(F.split(X.trimmed(F.col("section")), r"\s+|、"), -1)
    of = classics.where("section is not null").select(F.col("id").alias("classic_id"), F.col("title").alias("book"), last.alias("term"), X.compact(F.substring("text", 1, 100)).alias("key")).distinct()
    by_heading = F.lit(False) if strict is None else F.coalesce(strict, F.lit(False))
    units = of.join(groups, "term").withColumn("by", by_heading).select("g", "classic_id", F.coalesce("key", F.lit("")).alias("key"), "by").distinct()
    to = groups.select(F.col("term").alias("term_"), F.col("kind").alias("kind_"), "parts", "part", F.col("g").alias("to"))
    salt = F.pmod(F.xxhash64("row"), F.col("parts")) == F.col("part")
    passages = hits.join(to, (F.col("term") == F.col("term_")) & F.col("kind").eqNullSafe(F.col("kind_")) & salt).select("to", "row", "id", "kind", "key", *_FLAGS)
    schema = StructType([units.schema["classic_id"], passages.schema["id"], passages.schema["kind"], passages.schema["row"], StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        parts = range(0, len(one), UNITS) if len(two) else ()
        found = [(unit + i, row, value) for i in parts for unit, row, value in _scored(one.slice(i, UNITS), two, n)]
        if not found:
            return arrow.empty_table()
        unit, row, value = (np.concatenate(c) for c in zip(*found, strict=True))
        unit, row = pa.array(unit), pa.array(row)
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip([one["classic_id"].take(unit), two["id"].take(row), two["kind"].take(row), two["row"].take(row), pa.chunked_array([value / 1000])], arrow, strict=True)], schema=arrow)

    scored = units.groupBy("g").cogroup(passages.groupBy("to")).applyInArrow(meet, schema)
    best = scored.groupBy("classic_id", "kind", "row", "id").agg(F.max("score").alias("score"))
    return best.withColumn("n_", F.row_number().over(Window.partitionBy("classic_id", "kind").orderBy(F.desc("score"), "row"))).where(F.col("n_") <= n).select("classic_id", F.col("id").alias("target_id"), "kind", "score")


def lecture_entries(lectures: DataFrame) -> DataFrame:
    """(row, id, at, number, body): the numbered lines of lecture passages, whose text has a key of at least eight characters."""
    found = lambda g: F.regexp_extract_all("text", F.lit(NUMBERED), F.lit(g))
    lines = lectures.select("row", "id", F.posexplode(F.arrays_zip(found(1).alias("n"), found(2).alias("body"))).alias("at", "x"))
    entries = lines.select("row", "id", "at", number_of(F.col("x.n")).alias("number"), F.regexp_replace(F.col("x.body"), r"^[」\"” ]+|[」\"” ]+$", "").alias("body"))
    return entries.where((F.col("number") > 0) & (F.length(X.compact(F.col("body"))) >= 8))


def course_links(classics: DataFrame, transcripts: DataFrame, threshold: float = 0.38, most: int = 7, needle: int = 160, chained: Callable[[DataFrame, str], DataFrame] = ordered_best) -> DataFrame:
    """(book, classic_id, target_id, score): passages that hold a classic unit, in one order for each book."""
    units = classics.select("source", F.col("row").alias("x"), F.col("id").alias("classic_id"), F.substring("text", 1, needle).alias("text")).where(F.length(X.compact(F.col("text"))) >= 12)
    found = best_per_left(containment_join(units, transcripts, threshold, "x", "row"), most)
    books = units.select(F.col("x").alias("a"), F.col("source").alias("book"), "classic_id")
    targets = transcripts.select(F.col("row").alias("b"), F.col("id").alias("target_id"))
    candidates = found.join(books, "a").join(targets, "b").select("book", F.col("a").alias("x"), F.col("b").alias("y"), "score", "classic_id", "target_id")
    return chained(candidates, "book").select("book", "classic_id", "target_id", F.round("score", 3).alias("score"))


def numbered_links(classics: DataFrame, lectures: DataFrame, threshold: float = 0.64, most: int = 8) -> DataFrame:
    """(classic_id, target_id, target_kind, score, method, lecture_number): the numbered lines of lectures with the classic unit that holds
    them, in one order for the whole table. An entry keeps its best `most` units before the order is looked for."""
    entries = lecture_entries(lectures).withColumn("x", F.col("row") * 10_000 + F.col("at"))
    found = best_per_left(containment_join(entries.select("x", F.col("body").alias("text")), classics.select("row", "text"), threshold, "x", "row"), most)
    candidates = found.select(F.lit(0).alias("book"), F.col("a").alias("x"), F.col("b").alias("y"), "score")
    best = ordered_best(candidates, "book")
    return best.join(entries.select("x", F.col("id").alias("target_id"), "number"), "x").join(classics.select(F.col("row").alias("y"), F.col("id").alias("classic_id")), "y").select(
        "classic_id", "target_id", F.lit("document").alias("target_kind"), F.round("score", 3).alias("score"), F.lit("numbered").alias("method"), F.col("number").cast("string").alias("lecture_number")
    )


def book_links(classics: DataFrame, lectures: DataFrame, transcripts: DataFrame, few: int = 20) -> DataFrame:
    """The links of one book from three matchers: numbered lines of its lectures (0.64); where there are fewer than `few` of those,
    units in passages of lectures (the first 180 characters, 0.53); units in transcripts (the first 160, 0.38)."""
    shape = lambda d, kind, method: d.select("classic_id", "target_id", F.lit(kind).alias("target_kind"), "score", F.lit(method).alias("method"), F.lit(None).cast("string").alias("lecture_number"))
    out = numbered_links(classics, lectures)
    if lecture_entries(lectures).limit(few).count() < few:
        out = out.unionByName(shape(course_links(classics, lectures, 0.53, 6, 180), "document", "direct"))
    return out.unionByName(shape(course_links(classics, transcripts), "transcript", "transcript"))


def named_sections(classics: DataFrame, targets: DataFrame, book: str, gap: int = 8, score: float = 0.9) -> DataFrame:
    """(classic_id, target_id, target_kind, score): passages that name the book and, at most `gap` characters other than numerals
    on, a unit's section. Passages are matched to sections by an equality join on what follows the book's name."""
    sections = classics.where("section is not null").select(F.col("id").alias("classic_id"), "section")
    sizes = [r.n for r in sections.select(F.length("section").alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    after = F.regexp_extract_all("text", F.lit(f"(?={re.escape(book)}([^一二三四五六七八九十百千〇零\\d]{{0,{gap}}}.{{0,{max(sizes, default=1) + 1}}}))"), F.lit(1))
    places = targets.select("id", "kind", F.explode(after).alias("rest"))
    starts = places.select("id", "kind", "rest", F.explode(F.sequence(F.lit(1), F.lit(gap + 2))).alias("i"))
    said = starts.select("id", "kind", "rest", "i", F.explode(F.array(*[F.lit(n) for n in sizes or [1]])).alias("n")).select("id", "kind", F.substring("rest", 1, F.col("i") - 1).alias("before"), F.substring("rest", F.col("i"), F.col("n")).alias("section"), "n")
    fits = said.where((F.length("section") == F.col("n")) & F.regexp_like("before", F.lit(f"^[^一二三四五六七八九十百千〇零\\d]{{0,{gap}}}第?$")))
    return fits.join(sections, "section").select("classic_id", F.col("id").alias("target_id"), F.col("kind").alias("target_kind"), F.lit(score).alias("score")).distinct()


def unique_numbers(units: DataFrame, entries: DataFrame, unit: str = "unit", order: str = "unit") -> DataFrame:
    """(unit, number): units (unit, text) that get the number of an entry (number, text) of equal key, where just one is left.

    Of the units with one key each takes a number only if exactly one entry has the key, and then the first of them; so every number is
    given once. The rest is found by anti joins on either side.
    """
    keyed = lambda d: d.withColumn("key", X.compact(F.col("text"))).where("key <> ''")
    one = keyed(entries).groupBy("key").agg(F.count("*").alias("n"), F.min("number").alias("number")).where("n = 1")
    first = keyed(units).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(order))).where("k = 1")
    return first.join(one, "key").select(unit, "number")


def link_report(links: DataFrame, classics: DataFrame) -> DataFrame:
    """(book, units, kind, linked, rate, unlinked): of each book and kind of target the linked units, their part, and the unit numbers
    (unit_ids, JSON) of classics that nothing is linked to. A book is bounded."""
    books = classics.groupBy(F.col("title").alias("book")).agg(F.countDistinct("id").alias("units"))
    of = links.join(classics.select(F.col("id").alias("classic_id"), F.col("title").alias("book")).distinct(), "classic_id")
    linked = of.groupBy("book", F.col("target_kind").alias("kind")).agg(F.countDistinct("classic_id").alias("linked"))
    alone = classics.join(links.select(F.col("classic_id").alias("id")).distinct(), "id", "left_anti")
    missing = alone.select(F.col("title").alias("book"), F.explode_outer(F.from_json("unit_ids", "array<string>")).alias("u")).groupBy("book").agg(F.sort_array(F.collect_set("u")).alias("unlinked"))
    both = books.join(linked, "book", "left").join(missing, "book", "left")
    return both.select("book", "units", "kind", F.coalesce("linked", F.lit(0)).alias("linked"), F.round(F.coalesce("linked", F.lit(0)) / F.col("units"), 4).alias("rate"), F.coalesce("unlinked", F.array().cast("array<string>")).alias("unlinked"))

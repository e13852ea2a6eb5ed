"""Keyword search (BM25 over pairs of characters) on an index, vector search, rank fusion, neighbours, short ids, citations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vectors as V
from quillspark.operators.layout import case_title, short_section
from quillspark.sources.shared import written
from quillspark.sources.tables import spread

K1, B, FUSION = 1.2, 0.75, 60
KINDS = ("transcript", "document", "classic")


#: Parts of the index by a term's first character, and rows of one of its files.
PARTS, FILE_ROWS = 64, 4_000_000


def postings(rows: DataFrame, key: str = "row", text: str = "text") -> DataFrame:
    """(term, key, tf): how often each term stands in each row."""
    return spread(rows.select(key, text)).select(key, F.explode(X.tokens(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def lengths(rows: DataFrame, key: str = "row", text: str = "text") -> DataFrame:
    """(key, size): tokens of every row, also of rows without any."""
    return rows.select(key, F.size(X.tokens(F.col(text))).alias("size"))


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 1)), F.lit(parts)).cast("int")


def _parts_of(spark: SparkSession, terms: list[str], parts: int) -> list[int]:
    """_part of a few terms, without a job where the hash is at hand."""
    try:
        import xxhash
    except ImportError:
        return [r.part for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_part(F.col("term"), parts).alias("part")).distinct().collect()]
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    return sorted({signed(xxhash.xxh64(t[:1].encode(), seed=42).intdigest()) % parts for t in terms})


def write_index(rows: DataFrame, folder: str, key: str = "row", text: str = "text", kind: str | None = "kind", parts: int = PARTS) -> None:
    """The inverted index of rows below a folder: postings (term, key, tf, size, kind) and one row of figures.

    A posting holds its row's size and kind, so a search joins nothing. Postings are put into parts by their term's first character and
    sorted by term over all files of a part: what a search reads is pruned by the part's folder, then by the files' statistics. A
    frequent term is spread over as many files as it fills.
    """
    of_kind = F.col(kind) if kind and kind in rows.columns else F.lit(None).cast("string")
    # tokens are dear to make, so they are made once
    some = spread(rows.select(F.col(key).alias("key"), of_kind.alias("kind"), F.col(text).alias("text")))
    tokens = written(some.select("key", "kind", X.tokens(F.col("text")).alias("tokens")).withColumn("size", F.size("tokens")))
    terms = tokens.select("key", "kind", "size", F.explode("tokens").alias("term")).groupBy("term", "key", "kind", "size").agg(F.count("*").cast("int").alias("tf"))
    placed = terms.withColumn("part", _part(F.col("term"), parts)).repartitionByRange("part", "term", "key").sortWithinPartitions("part", "term", "key")
    placed.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("part").parquet(f"{folder}/postings")
    tokens.agg(F.count("*").alias("count"), F.avg("size").alias("mean"), F.bit_xor(F.xxhash64("key", "size")).alias("digest")).withColumn("parts", F.lit(parts)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


@dataclass
class Index:
    """An index that write_index() wrote."""

    postings: DataFrame
    count: int
    mean: float
    digest: int
    parts: int


def open_index(spark: SparkSession, folder: str) -> Index:
    figures = spark.read.parquet(f"{folder}/meta").first()
    return Index(spark.read.parquet(f"{folder}/postings"), figures["count"], figures.mean or 0.0, figures.digest, figures.parts)


def _checked(question: str, kind: str | None) -> list[tuple[str, bool]]:
    if kind is not None and kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    return X.query_terms(question)


def _scored(counted: DataFrame, terms: list[tuple[str, bool]], count: Column, mean: Column, kind: str | None, key: str, limit: int | None) -> DataFrame:
    """(key, score) from rows with their size and the terms' counts f0, f1, ...; the statistics are one row."""
    stats = counted.agg(count.alias("n"), mean.alias("mean"), *[F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(terms))])

    def part(i: int) -> Column:
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.log((F.col("n") - n + 0.5) / (n + 0.5))
        return F.when(idf > 0, idf).otherwise(1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))

    scored = counted.join(F.broadcast(stats)).where(" or ".join(f"f{i} > 0" for i in range(len(terms))))
    out = scored.where(F.col("kind") == kind) if kind else scored
    out = out.select(key, sum((part(i) for i in range(1, len(terms))), part(0)).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(limit) if limit else out


def bm25_indexed(index: Index, question: str, kind: str | None = None, limit: int | None = 50, key: str = "row") -> DataFrame:
    """(key, score) of the best rows for an OR of the question's terms; ties by key.

    Only the postings of the terms are read. A prefix term counts all tokens that begin so. Statistics are the whole corpus's,
    also with a kind, which filters afterwards. No terms, no rows.
    """
    terms = _checked(question, kind)
    p = index.postings
    if not terms:
        return p.select(F.col("key").alias(key), F.lit(0.0).alias("score")).limit(0)
    whole, begins = [t for t, prefix in terms if not prefix], [t for t, prefix in terms if prefix]
    wanted = [F.col("term").isin(whole)] if whole else []
    wanted += [F.col("term").startswith(t) for t in begins]
    some = wanted[0]
    for w in wanted[1:]:
        some = some | w
    parts = _parts_of(p.sparkSession, [t for t, _ in terms], index.parts)
    hits = p.where(F.col("part").isin(parts)).where(some)
    is_term = lambda t, prefix: F.col("term").startswith(t) if prefix else F.col("term") == t
    counted = hits.groupBy("key", "kind", "size").agg(*[F.coalesce(F.sum(F.when(is_term(*t), F.col("tf"))), F.lit(0)).alias(f"f{i}") for i, t in enumerate(terms)])
    return _scored(counted.withColumnRenamed("key", key), terms, F.lit(index.count), F.lit(index.mean), kind, key, limit)


def bm25(rows: DataFrame, question: str, key: str = "row", text: str = "text", kind: str | None = None, limit: int | None = 50) -> DataFrame:
    """bm25_indexed() without an index, for small frames: every row is reduced to its size and its terms' counts in the scan, by regular
    expressions over the folded text; a pair of Han characters is a token wherever it stands."""
    terms = _checked(question, kind)
    if not terms:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    of_kind = [F.col("kind")] if kind else []
    folded = rows.select(key, *of_kind, F.coalesce(X.fold(F.col(text)), F.lit("")).alias("folded"))
    size = F.length(F.regexp_replace("folded", f"[^{X.HAN}]", "")) + F.regexp_count("folded", F.lit("[0-9a-z]+"))

    def hits(term: str, prefix: bool) -> Column:
        pattern = f"(?={term})" if not term.isascii() else rf"(?<![0-9a-z]){term}{'' if prefix else '(?![0-9a-z])'}"
        return F.regexp_count("folded", F.lit(pattern))

    counted = folded.select(key, *of_kind, size.alias("size"), *[hits(*t).alias(f"f{i}") for i, t in enumerate(terms)])
    return _scored(counted, terms, F.count("*"), F.avg("size"), kind, key, limit)


def vector_top(rows: DataFrame, query: list[float], key: str = "vec_id", vec: str = "embedding", where: Column | None = None, limit: int = 50) -> DataFrame:
    """(key, score): largest dot products with the normalised query; the filter comes before the top."""
    n = sum(v * v for v in query) ** 0.5
    if not n:
        raise ValueError("the query is the zero vector")
    some = rows if where is None else rows.where(where)
    return some.select(key, V.dot(F.col(vec), V.literal([v / n for v in query])).alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(limit)


def fused(rankings: dict[str, DataFrame], key: str = "row", k: int | None = None) -> DataFrame:
    """(key, score, one rank column a ranking): sums of 1 / (60 + rank), best first. The rankings are tops of bounded length."""
    parts = []
    for name, r in rankings.items():
        ranked = r.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), key)))
        parts.append(ranked.select(key, F.lit(name).alias("by"), "rank"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    out = both.groupBy(key).agg(F.sum(1 / (F.lit(float(FUSION)) + F.col("rank"))).alias("score"), *[F.max(F.when(F.col("by") == n, F.col("rank"))).alias(f"{n}_rank") for n in rankings])
    out = out.orderBy(F.desc("score"), key)
    return out.limit(k) if k else out


def hybrid(rows: DataFrame, question: str, vectors: DataFrame | None, embed, key: str = "row", k: int = 10, kind: str | None = None, index: Index | None = None) -> tuple[DataFrame, str, str | None]:
    """(rows of the best k with score, 'hybrid' or 'bm25', what went wrong): any failure of the vector side leaves keyword search. With an
    index of the rows its postings are read, without one the rows."""
    ranks = {"bm25": bm25(rows, question, key, kind=kind) if index is None else bm25_indexed(index, question, kind, key=key)}
    mode, wrong = "bm25", None
    try:
        if vectors is None:
            raise ValueError("no vectors")
        ranks["vector"] = vector_top(vectors, embed(question), key)
        mode = "hybrid"
    except Exception as e:  # noqa: BLE001
        wrong = f"{type(e).__name__}: {e}"
    best = fused(ranks, key, k)
    # the best k rows are fetched last; k is a parameter
    return rows.join(F.broadcast(best), key).orderBy(F.desc("score"), key), mode, wrong


#: Rows of one bucket in which runs are looked for at once.
BUCKET = 100_000


def islands(rows: DataFrame, key: str = "row", source: str = "source") -> DataFrame:
    """rows with `island`: the first key of the run they are in, of successive whole keys of one source. Null sources are one.

    Keys are cut into buckets of equal span; a run that enters a bucket from before is completed from the buckets' ends, so
    no task holds more than a bucket, however many rows a source has.
    """
    bucket = F.floor(F.col(key) / BUCKET)
    w = Window.partitionBy("bucket_").orderBy(key)
    follows = (F.lag(key).over(w) == F.col(key) - 1) & F.lag(source).over(w).eqNullSafe(F.col(source))
    marked = rows.withColumn("bucket_", bucket).withColumn("begin_", F.when(~F.coalesce(follows, F.lit(False)), F.col(key)))
    inside = marked.withColumn("first_", F.max("begin_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # of each bucket its ends: whether its first row goes on from the bucket before, and where the run at its end begins
    ends = inside.groupBy("bucket_").agg(
        F.min(key).alias("lo"), F.min_by(F.struct(F.col(source).alias("s")), key).alias("lo_source"), F.max(key).alias("hi"), F.max_by(F.struct(F.col(source).alias("s")), key).alias("hi_source"), F.max("first_").alias("last")
    )
    over = Window.partitionBy(F.lit(1)).orderBy("bucket_")  # one row for each bucket
    joined = (F.lag("hi").over(over) == F.col("lo") - 1) & F.lag("hi_source").over(over).eqNullSafe(F.col("lo_source"))
    linked = ends.withColumn("joined", F.coalesce(joined, F.lit(False)))
    # a run that goes on begins where the last run begins that a bucket before it starts anew
    fresh = F.when(~(F.col("joined") & (F.col("last") == F.col("lo"))), F.col("last"))
    carried = linked.withColumn("fresh", fresh).withColumn("carry_", F.last("fresh", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    carries = carried.where("joined").select("bucket_", F.col("lo").alias("first_"), "carry_")
    return inside.join(carries, ["bucket_", "first_"], "left").withColumn("island", F.coalesce("carry_", "first_")).select(*rows.columns, "island")


def neighbours(rows: DataFrame, wanted: DataFrame, before: int, after: int, key: str = "row", source: str = "source") -> DataFrame:
    """(center, key): each wanted key's neighbours in its run of one source: its keys around it that exist and are in the same run."""
    run = islands(rows, key, source).select(key, "island")
    asked = wanted.select(F.col(key).alias("center")).distinct().join(run.select(F.col(key).alias("center"), F.col("island").alias("at")), "center")
    near = asked.select("center", "at", F.explode(F.sequence(F.col("center") - before, F.col("center") + after)).alias(key))
    return near.join(run, key).where(F.col("island") == F.col("at")).select("center", key)


def short_ids(rows: DataFrame, id_column: str = "id", least: int = 6) -> DataFrame:
    """(id, short): the shortest prefix of at least `least` characters that no other id has. Ids are compared within equal first
    `least` characters only: no sort of all ids in one task."""
    ids = rows.select(F.col(id_column).alias("id")).where("id is not null").distinct()
    w = Window.partitionBy(F.substring("id", 1, least)).orderBy("id")

    def common(other: Column) -> Column:
        same = F.filter(F.sequence(F.lit(1), F.length("id")), lambda i: F.substring(F.col("id"), F.lit(1), i) == F.substring(other, F.lit(1), i))
        return F.when(other.isNull(), 0).otherwise(F.coalesce(F.array_max(same), F.lit(0)))

    near = ids.withColumns({"p": F.lag("id").over(w), "n": F.lead("id").over(w)})
    return near.select("id", F.substring(F.col("id"), F.lit(1), F.least(F.greatest(F.lit(least), common(F.col("p")) + 1, common(F.col("n")) + 1), F.length("id"))).alias("short"))


def find_prefix(rows: DataFrame, prefix: str, limit: int, id_column: str = "id") -> DataFrame:
    """Ids with the prefix, smallest first; the range form reaches the scan's statistics."""
    c = F.col(id_column)
    return rows.where((c >= prefix) & c.startswith(prefix)).select(id_column).distinct().orderBy(id_column).limit(limit)


def citation(rows: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """rows with `cited`: where a passage is from, by kind, with its code: the shortest id that no other row has, from `short`
    (id, short), else the first six characters. A case (name, date and complaint in a document's title) is cited without its name."""
    known = rows.join(short.select("id", F.col("short").alias("code_")), "id", "left") if short is not None else rows.withColumn("code_", F.lit(None).cast("string"))
    section = short_section(F.col("section"))
    code = F.concat(F.lit("（編號 "), F.coalesce("code_", F.substring("id", 1, 6)), F.lit("）"))
    pages = F.when(F.col("page_start").isNull(), None).when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("第 "), F.col("page_start"), F.lit(" 頁"))).otherwise(F.concat(F.lit("第 "), F.col("page_start"), F.lit("–"), F.col("page_end"), F.lit(" 頁")))
    none = lambda c: F.when(c != "", c)
    classic = F.concat(F.lit("《"), F.coalesce("title", F.lit("")), F.lit("》"), section, F.coalesce(F.concat(F.lit(" "), none(F.col("episode"))), F.lit("")))
    transcript = F.concat(F.concat_ws(" ", none(F.col("title")), none(F.col("episode"))), F.lit(" "), X.clock(F.col("start")), F.lit("–"), X.clock(F.col("end")))
    document = F.concat_ws(" ", F.col("title"), none(section), none(F.col("date")), pages)
    title = case_title(F.coalesce("title", F.lit("")))
    case = F.concat_ws(" ", F.lit("醫案"), none(title["date"]), none(X.clip(F.regexp_replace(title["complaint"], r"\s+", " "), 20)))
    shown = F.when(F.col("kind") == "classic", classic).when(F.col("kind") == "transcript", transcript).when(title.isNotNull(), case).otherwise(document)
    return known.withColumn("cited", F.concat(shown, code)).drop("code_")

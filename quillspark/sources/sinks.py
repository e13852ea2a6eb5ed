"""Writers: JSON lines with unique ids, index tables, caches that only grow, manifests, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import search
from quillspark.operators.dedupe import with_suffixes


def json_lines(rows: DataFrame, path: str, order: list[str], id_column: str = "id") -> None:
    """Chunks as JSON lines, ids made unique in emission order; the commit of the job is all or nothing."""
    with_suffixes(rows, id_column, order).write.mode("overwrite").json(path)


def index(chunks: DataFrame, folder: str, parts: int = search.PARTS) -> None:
    """chunks, and their inverted index with a row of figures, for search.open_index()."""
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    search.write_index(chunks.sparkSession.read.parquet(f"{folder}/chunks"), folder, parts=parts)


def fits(spark: SparkSession, folder: str, vectors_meta: DataFrame) -> bool:
    """Whether vectors (count, digest) were made for the index in the folder; search falls back to keywords if not."""
    return spark.read.parquet(f"{folder}/meta").join(vectors_meta, ["count", "digest"], "left_semi").limit(1).count() == 1


def grow(cache: str, fresh: DataFrame, key: str = "key") -> None:
    """Appends the rows whose key the cache hasn't; what is there stays."""
    spark = fresh.sparkSession
    new = fresh.dropDuplicates([key])
    try:
        new = new.join(spark.read.parquet(cache).select(key), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(cache)


def missing(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that has no output yet."""
    return rows.join(done.select(*keys), keys, "left_anti")


def manifest(rows: DataFrame, path: str) -> None:
    """A CSV with a header; durations with one decimal."""
    out = rows.withColumn("duration", F.format_string("%.1f", "duration")) if "duration" in rows.columns else rows
    out.write.mode("overwrite").option("header", "true").csv(path)


def report(rows: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A Markdown table of a small, aggregated frame; more than `most` rows are an error."""
    lines = rows.select(*columns).limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"a report has at most {most} rows")
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in lines]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *body])


def checked_documents(documents: DataFrame, path: str, problems) -> None:
    """Writes documents (value: JSON) if `problems` (a function that adds the column problems) finds nothing in any of them; else nothing is
    written. The commit of the job is all or nothing."""
    wrong = problems(documents).where(F.size("problems") > 0).limit(1).collect()
    if wrong:
        raise ValueError(f"a document is not valid: {wrong[0].problems[:3]}")
    documents.select("value").write.mode("overwrite").text(path)

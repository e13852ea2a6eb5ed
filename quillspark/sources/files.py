"""Readers of files: listings, texts in unknown encodings, subtitles, transcripts, marked-up classics, recognised pages, logs."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import trimmed
from quillspark.operators.inventory import category, suffix

SEGMENT = "struct<start: double, end: double, text_raw: string, text: string, speaker: string, confidence: struct<avg_logprob: double, no_speech_prob: double, compression_ratio: double>, low_confidence: boolean, filtered: boolean>"
TRANSCRIPT = f"schema string, source string, clip struct<start: double, duration: double>, duration_sec double, created_at string, segments array<{SEGMENT}>, dropped array<struct<start: double, end: double, text_raw: string, reason: string>>"
CHUNK = "`row` bigint, id string, kind string, source string, title string, episode string, section string, page_start int, page_end int, start double, `end` double, date string, text string, chars int, quality int, raw_text string, unit_ids string"


def listing(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(path, name, top, category, suffix, size, md5): every file but hidden ones. The content is read for its digest alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/")
    path = F.regexp_replace(F.col("path"), rf"^(?:file:)?/*{re.escape(root.lstrip('/'))}/", "")
    rows = files.select(path.alias("path"), F.col("length").alias("size"), F.md5("content").alias("md5"), *(["content"] if content else []))
    rows = rows.where(~F.col("path").rlike(r"(^|/)(\._|\.)"))
    return rows.withColumns({"name": F.regexp_extract("path", "([^/]+)$", 1), "top": F.split("path", "/")[0], "category": category(F.col("path")), "suffix": suffix(F.col("path"))})


def decoded(data: bytes) -> str:
    """UTF-8 with or without mark, UTF-16 with a mark, GB 18030, Big5; else GB 18030 with marks of loss."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for name in ("utf-8-sig", "gb18030", "big5"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("gb18030", "replace")


@F.pandas_udf(T.StringType())
def decode(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else decoded(bytes(b)))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every file of a folder, decoded."""
    return listing(spark, folder, content=True).select("path", decode("content").alias("text"))


_STAMP = re.compile(r"\[(\d+):(\d{1,2}(?:\.\d+)?)\]")


def subtitles(rows: DataFrame, least_speaker: int = 10) -> DataFrame:
    """Segments of LRC texts (path, text): (path, line, start, end, speaker, text).

    Lines sorted by time, stable; a line ends where the next begins, the last one five seconds later; a name before a colon is a
    speaker if it leads at least `least_speaker` lines, and carries on until another comes.
    """
    lines = rows.select("path", F.posexplode(F.split("text", r"\r\n?|\n")).alias("line", "raw"))
    stamp = r"^\s*\[(\d+):(\d{1,2}(?:\.\d+)?)\](.*)$"
    timed = lines.where(F.col("raw").rlike(stamp)).select("path", "line", (F.regexp_extract("raw", stamp, 1).cast("double") * 60 + F.regexp_extract("raw", stamp, 2).cast("double")).alias("start"), trimmed(F.regexp_extract("raw", stamp, 3)).alias("said"))
    clean = timed.where(~F.col("said").rlike("(?i)https?://|www\\.|字幕|製作")).where("said <> ''")
    name = F.nullif(F.regexp_extract("said", "^([^：:，。]{1,8})[：:]", 1), F.lit(""))
    named = clean.withColumn("name", name).withColumn("times", F.count("name").over(Window.partitionBy("path", "name")))
    lead = F.col("name").isNotNull() & (F.col("times") >= least_speaker)
    w = Window.partitionBy("path").orderBy("start", "line")
    spoken = named.withColumn("speaker", F.last(F.when(lead, F.col("name")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.when(lead, F.regexp_replace("said", "^[^：:]{1,8}[：:]\\s*", "")).otherwise(F.col("said"))
    return spoken.select("path", "line", "start", F.coalesce(F.lead("start").over(w), F.col("start") + 5).alias("end"), "speaker", text.alias("text"))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(source, at, segment fields): the segments of JSON transcripts below a folder, one row each."""
    docs = spark.read.schema(TRANSCRIPT).option("multiLine", "true").option("recursiveFileLookup", "true").json(folder)
    return docs.select("source", F.posexplode("segments").alias("at", "s")).select("source", "at", "s.*")


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunks in JSON lines, with the declared schema."""
    return spark.read.schema(CHUNK).json(path)


def manifest(spark: SparkSession, path: str, kinds: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """A CSV inventory, filtered by category and prefixes; absolute paths and ones that climb are left out."""
    rows = spark.read.option("header", "true").schema("path string, top string, category string, suffix string, size bigint, duration double, subtitle string, error string").csv(path)
    safe = ~F.col("path").rlike(r"^/|(^|/)\.\.(/|$)")
    for wanted, sign in ((include, True), (exclude, False)):
        if wanted:
            met = F.coalesce(*[F.when(F.col("path").startswith(p), F.lit(True)) for p in wanted], F.lit(False))
            safe &= met if sign else ~met
    return rows.where(safe & (F.col("category").isin(kinds) if kinds else F.lit(True)))


def recognised_pages(outputs: DataFrame, column: str = "value") -> DataFrame:
    """(page, text): pages of recognition outputs in JSON ({responses: [{page, text, error}]}); the last output of a page holds. A page
    with an error raises when it is read."""
    kind = "struct<responses: array<struct<page: int, text: string, error: string>>>"
    rows = outputs.withColumn("n_", F.monotonically_increasing_id()).select("n_", F.posexplode(F.from_json(column, kind)["responses"]).alias("i_", "r"))
    checked = F.when(F.col("r.error").isNotNull(), F.raise_error(F.concat(F.lit("recognition failed: "), F.col("r.error")))).otherwise(F.col("r.text"))
    return rows.groupBy(F.col("r.page").alias("page")).agg(F.max_by(checked, F.struct("n_", "i_")).alias("text"))


def log_lines(rows: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Fields of JSON log lines; lines that aren't JSON objects are skipped."""
    return rows.select(F.from_json(column, kind, {"mode": "PERMISSIVE"}).alias("e"), F.col(column).alias("raw_")).where(F.col("e").isNotNull() & F.col("raw_").rlike(r"^\s*\{.*\}\s*$")).select("e.*")


def reference_text(rows: DataFrame, column: str = "value") -> DataFrame:
    """Lines of a reference transcript without comments and time marks."""
    return rows.where(~F.col(column).startswith("#")).select(trimmed(F.regexp_replace(column, r"\[\d{1,3}:\d{2}(?:\.\d+)?\]", "")).alias("text")).where("text <> ''")


UNITS = "path string, ordinal int, volume string, section string, number int, text string, raw string, annotations array<string>"


def marked_units(path: str, text: str) -> Iterator[dict]:
    """Units of a marked-up classic: = volume =, == chapter ==, === section === head what follows; a leading number is the article's;
    <small> notes become annotations in brackets."""
    volume = chapter = section = None
    n = 0
    for line in text.split("\n"):
        line = line.strip()
        head = re.fullmatch(r"(={1,3})\s*(.+?)\s*\1", line)
        if head:
            deep = len(head[1])
            volume, chapter, section = (head[2], None, None) if deep == 1 else (volume, head[2], None) if deep == 2 else (volume, chapter, head[2])
            continue
        notes = re.findall(r"<small>(.*?)</small>", line)
        shown = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<small>(.*?)</small>", r"（\1）", line))).strip()
        if not shown:
            continue
        number = re.match(r"^(\d{1,4})[、.．]\s*", shown)
        n += 1
        yield {"path": path, "ordinal": n, "volume": volume, "section": " ".join(x for x in (chapter, section) if x) or None, "number": int(number[1]) if number else None, "text": shown[number.end() :] if number else shown, "raw": line, "annotations": notes}


def classics(rows: DataFrame) -> DataFrame:
    """Units of classics (path, text); a book is one row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [u for p, t in zip(f["path"], f["text"], strict=True) for u in marked_units(p, t or "")]
            if out:
                yield pd.DataFrame(out).astype({"number": "Int32"})

    return rows.select("path", "text").mapInPandas(run, UNITS)


_PARAGRAPH = re.compile(r'<div[^>]*data-sec="p"[^>]*id="(\d+)"[^>]*>(.*?)</div>', re.S)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("text", T.StringType())])))
def html_paragraphs(pages: pd.Series) -> pd.Series:
    """Numbered paragraphs of a page; text of old editions is hidden, line breaks stay."""

    def one(t: str | None) -> list[dict]:
        out = []
        for number, body in _PARAGRAPH.findall(t or ""):
            body = re.sub(r'<span[^>]*class="[^"]*old[^"]*"[^>]*>.*?</span>', "", body, flags=re.S)
            body = re.sub(r"<br\s*/?>", "\n", body)
            out.append({"number": int(number), "text": html.unescape(re.sub(r"<[^>]+>", "", body)).strip()})
        return out

    return pages.map(one)


def external(rows: DataFrame, schema: str, call: Callable[[dict], dict]) -> DataFrame:
    """A boundary to a service (recognition, language model, embedding, converter): `call` gets a row and gives a row; one client a task
    if it makes one on first use. Failures are the caller's to return."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame([call(r) for r in f.to_dict("records")])

    return rows.mapInPandas(run, schema)


CORRECTED = f"schema string, source string, duration_sec double, segments array<struct<start: double, end: double, text_raw: string, text: string, text_asr: string, corrected: boolean, speaker: string, low_confidence: boolean>>, correction struct<model: string, prompt_sha256: string, max_search: int, chunks: array<struct<start: double, end: double, status: string, attempts: int, searches: int, fallback_lines: int, engine: string>>>"


def corrected(spark: SparkSession, folder: str) -> DataFrame:
    """(source, at, segment fields, piece): segments of corrected transcripts below a folder, each with the number of the piece it is in."""
    docs = spark.read.option("recursiveFileLookup", "true").option("multiLine", "true").schema(CORRECTED).json(folder)
    lines = docs.select("source", F.col("correction.chunks").alias("pieces"), F.posexplode("segments").alias("at", "s"))
    piece = F.size(F.filter("pieces", lambda p: p["start"] <= F.col("s.start")))
    return lines.select("source", "at", "s.*", piece.alias("piece"))

"""Pages and titles: furniture that repeats over pages, lines of recognised text, titles of cases, sections, nested documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspark.functions.fixed import ARTICLE, BRACKETS, NO_NAMES, TIME_CODE, TITLE_DATE, TITLE_EDGE, TITLE_SPAN, TITLE_VISIT
from quillspark.functions.text import clip, once, trimmed


def furniture(spans: DataFrame, keys: list[str], least: int = 3, part: float = 0.3) -> DataFrame:
    """Spans (keys, page, x, y, text) that are no page furniture: what stands at about the same place with the same text, digits
    aside, on three pages and three tenths of them is left out."""
    shape = F.struct(F.regexp_replace("text", r"\d+", "#").alias("t"), F.floor(F.col("x") / 6).alias("x"), F.floor(F.col("y") / 6).alias("y"))
    shaped = spans.withColumn("shape_", shape)
    pages = spans.groupBy(*keys).agg(F.countDistinct("page").alias("pages_"))
    often = shaped.groupBy(*keys, "shape_").agg(F.countDistinct("page").alias("n_")).join(pages, keys).where(F.col("n_") >= F.greatest(F.lit(float(least)), F.col("pages_") * part))
    return shaped.join(often.select(*keys, "shape_"), [*keys, "shape_"], "left_anti").drop("shape_")


def joined_spans(parts: list[str]) -> str:
    """Spans one after another; no space beside Han characters or their punctuation."""
    wide = re.compile(r"[　-〿㐀-鿿＀-￯]")
    out = ""
    for p in filter(None, (p.strip() for p in parts)):
        out += (" " if out and not wide.match(out[-1]) and not wide.match(p[0]) else "") + p
    return out


@F.pandas_udf(StringType())
def joined_texts(parts: pd.Series) -> pd.Series:
    """joined_spans of an array of texts."""
    return parts.map(lambda p: joined_spans(list(p)))


@F.pandas_udf(ArrayType(StringType()))
def recognised_paragraphs(text: pd.Series) -> pd.Series:
    """Lines of recognised text as paragraphs: one ends at a short line, under four fifths of the third quartile, with an end mark."""

    def one(t: str | None) -> list[str]:
        lines = [x.strip() for x in re.split(r"\r\n?|\n", t or "") if x.strip()]
        if not lines:
            return []
        usual = sorted(map(len, lines))[len(lines) * 3 // 4]
        out, held = [], []
        for x in lines:
            held.append(x)
            if len(x) < 0.8 * usual and x[-1] in "。！？：」』”）)":
                out.append(joined_spans(held))
                held = []
        return out + ([joined_spans(held)] if held else [])

    return text.map(one)


def case_title(title: Column) -> Column:
    """struct(date, complaint) of a title of name, eight digits and complaint; null for others. The name doesn't come out."""

    def parts(t: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(t, rf"^(.*?){TITLE_DATE}", 1), TITLE_EDGE, "")
        named = once(name, lambda x: x.rlike(r"[A-Za-zＡ-Ｚａ-ｚ]") | (x.rlike(r"^[\x{3400}-\x{9fff}]{2,3}$") & ~x.isin(*NO_NAMES)))
        rest = F.regexp_extract(t, rf"^.*?{TITLE_DATE}(.*)$", 4)
        rest = F.regexp_replace(F.regexp_replace(rest, TITLE_SPAN, ""), TITLE_VISIT, "")
        shown = F.concat_ws("-", *[F.regexp_extract(t, TITLE_DATE, i) for i in (1, 2, 3)])
        return F.when(t.rlike(TITLE_DATE) & named, F.struct(shown.alias("date"), F.regexp_replace(rest, TITLE_EDGE, "").alias("complaint")))

    return once(title, parts)


def halves(text: str) -> set[int]:
    """Where brackets stand whose other half is missing: closers with nothing open before them, openers with nothing left to close them."""
    out = set()
    for left, right in zip(BRACKETS[::2], BRACKETS[1::2], strict=True):
        for steps, begin in ((range(len(text)), left), (range(len(text) - 1, -1, -1), right)):
            ends, waiting = right if begin == left else left, 0
            for i in steps:
                if text[i] == begin:
                    waiting += 1
                elif text[i] == ends:
                    if waiting:
                        waiting -= 1
                    else:
                        out.add(i)
    return out


@F.pandas_udf(StringType())
def balanced(text: pd.Series) -> pd.Series:
    """Without the brackets whose other half is missing."""

    def one(t: str | None) -> str | None:
        gone = halves(t) if t else None
        return "".join(c for i, c in enumerate(t) if i not in gone) if gone else t

    return text.map(one)


def short_section(section: Column, most: int = 20, words: int = 10) -> Column:
    """A section as a citation shows it, in at most about `most` characters: no time codes, no half brackets. An article is its number and
    its first `words` characters. A longer section of two levels keeps its first level, if that has at most `words`
    characters, before what fits of the second; else only the second. Null becomes empty."""
    plain = trimmed(F.regexp_replace(F.regexp_replace(F.coalesce(section, F.lit("")), TIME_CODE, ""), r"\s+", " "))

    def shown(t: Column) -> Column:
        level = F.split(t, " ", 2)
        first, second = F.get(level, F.lit(0)), F.get(level, F.lit(1))
        room = F.lit(most) - F.length(first) - 1
        fitted = F.when(F.length(second) <= room, second).otherwise(F.concat(F.regexp_replace(F.substring(second, F.lit(1), room), "[ ,，、：:;；]+$", ""), F.lit("…")))
        return (
            F.when(t.rlike(ARTICLE), F.concat(F.regexp_extract(t, ARTICLE, 1), clip(F.regexp_extract(t, ARTICLE, 2), words)))
            .when((F.length(t) <= most) | second.isNull(), clip(t, most))
            .when(F.length(first) <= words, F.concat(first, F.lit(" "), fitted))
            .otherwise(clip(second, most))
        )

    # only sections with brackets go through Python
    return once(F.when(plain.rlike(r"[【】\[\]（）()]"), balanced(plain)).otherwise(plain), shown)


def repaired_name(name: str) -> str:
    """A file name that Big5 bytes were read as GB: as it was, if that gives characters of text."""
    for read_as in ("gb18030", "gbk"):
        try:
            out = name.encode(read_as).decode("big5")
        except (UnicodeDecodeError, UnicodeEncodeError):
            continue
        if out != name and not re.search(r"[-�]", out):
            return out
    return name


def repaired_part(name: str) -> str:
    """A name that Big5 bytes were read as GB, as far as it can be undone: from each place the longest run that decodes; other characters
    stay. Names are short."""
    out, i = [], 0
    while i < len(name):
        for j in range(len(name), i, -1):
            if not name[i:j].isascii():
                try:
                    out.append(name[i:j].encode("gb18030").decode("big5"))
                    break
                except (UnicodeDecodeError, UnicodeEncodeError):
                    pass
        else:
            j = i + 1
            out.append(name[i])
        i = j
    return "".join(out)


def repaired_paths(path: Column, folder: str) -> Column:
    """Paths whose parts below a folder (whose name holds `folder`) were read in the wrong encoding, repaired as far as possible; others
    as they are."""

    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        def one(p: str | None) -> str | None:
            parts = p.split("/") if p else []
            at = next((i for i, x in enumerate(parts) if folder in x), None)
            if at is None:
                return p
            return "/".join([*parts[: at + 1], *(repaired_part(x) for x in parts[at + 1 :])])

        return s.map(one)

    return F.when(F.contains(path, F.lit(folder)), f(path)).otherwise(path)


@F.pandas_udf(ArrayType(StringType()))
def word_paragraphs(data: pd.Series) -> pd.Series:
    """recovered_word of a binary column."""
    return data.map(lambda d: recovered_word(bytes(d)) if d is not None else [])


def recovered_word(data: bytes, least: int = 8) -> list[str]:
    """Paragraphs of text in a broken compound Word file: runs of UTF-16 without field codes, in which most characters are text."""
    text = data[len(data) % 2 :].decode("utf-16-le", "replace") if len(data) % 2 else data.decode("utf-16-le", "replace")
    text = re.sub("\x13[^\x14]*\x14", "", text)
    out = []
    for p in re.split("[\r\x07\x0b\x00]+", text):
        p = p.strip()
        fine = sum(c.isalnum() and (c.isascii() or "㐀" <= c <= "鿿") or c in "，。、：；！？「」（） " for c in p)
        if len(p) >= least and fine >= 0.85 * len(p):
            out.append(p)
    return out


def nested(lines: DataFrame, keys: list[str], order: str, fields: list[str], name: str = "segments") -> DataFrame:
    """One document of each key with its lines in order, and how many fall back: lines with corrected = false. A document is bounded."""
    return lines.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, *fields))), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name), F.count(F.when(~F.col("corrected"), 1)).alias("fallback_lines"))


def merged(new: DataFrame, old: DataFrame, keys: list[str], columns: list[str], status: str = "status") -> DataFrame:
    """old rows replaced by new ones that are ok, with `replaced`; the rest stays as it was; new ones without an old row come in if ok."""
    a = new.where(F.col(status) == "ok").select(*keys, F.struct(*columns).alias("n"))
    b = old.select(*keys, F.struct(*columns).alias("o"))
    both = a.join(b, keys, "full_outer").withColumn("v", F.coalesce("n", "o"))
    return both.select(*keys, *[F.col("v")[c].alias(c) for c in columns], (F.col("n").isNotNull() & F.col("o").isNotNull()).alias("replaced"))


def newest(rows: DataFrame, keys: list[str], by: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): the n newest of each key and the rest."""
    numbered = rows.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by))))
    return numbered.where(F.col("n_") <= n).drop("n_"), numbered.where(F.col("n_") > n).drop("n_")


def capped_output(rows: DataFrame, keys: list[str], order: list[str], text: str, most: int) -> DataFrame:
    """Texts of each key in order until `most` characters with two between each; the one that crosses it is cut with an ellipsis."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text) + 2).over(w), F.lit(0))
    some = rows.withColumn("before_", before).where(F.col("before_") < most)
    room = F.lit(most) - F.col("before_")
    return some.withColumn(text, F.when(F.length(text) <= room, F.col(text)).otherwise(F.concat(F.substring(F.col(text), F.lit(1), F.greatest(room - 1, F.lit(0)).cast("int")), F.lit("…")))).drop("before_")


def audio_hours(chunks: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """chunks with `hours`: from each start to the next, the last to its end, never below zero."""
    w = Window.partitionBy(*keys).orderBy(start)
    return chunks.withColumn("hours", F.greatest(F.coalesce(F.lead(start).over(w), F.col(end)) - F.col(start), F.lit(0.0)) / 3600)


def citation_map(rows: DataFrame) -> DataFrame:
    """(base, texts): for each citation's base a map of chunk id to text."""
    return rows.groupBy("base").agg(F.map_from_entries(F.collect_set(F.struct("id", "text"))).alias("texts"))

"""Inventories of files and rows: classification, totals, probable duplicates, systematic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.windows import totals_before

#: Categories by suffix.
CATEGORIES = {"video": "mp4 mkv avi mov wmv flv rmvb", "audio": "mp3 m4a wav flac wma", "subtitle": "lrc srt", "document": "doc docx pdf txt htm html chm json wiki", "image": "jpg jpeg png gif", "archive": "zip rar 7z"}


#: Categories in which files of equal size count as copies.
DUPLICATE_KINDS = ("video", "audio", "document")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def category(path: Column) -> Column:
    s = suffix(path)
    out = F.lit("other")
    for name, kinds in CATEGORIES.items():
        out = F.when(s.isin(kinds.split()), name).otherwise(out)
    return out


def file_format(path: Column, head: Column | None = None) -> Column:
    """By suffix; by the first bytes where they say otherwise (compound documents, PDF, zip)."""
    s = suffix(path)
    if head is None:
        return s
    h = F.hex(F.substring(head, 1, 4))
    return F.when(h == "D0CF11E0", "doc").when(h == "25504446", "pdf").when((h == "504B0304") & (s == "docx"), "docx").otherwise(s)


def classified(rows: DataFrame, path: str = "source", rules: list[tuple[str, str, bool, str]] | None = None) -> DataFrame:
    """rows with top, group, include, reason: the first rule whose pattern the path meets decides; each is (pattern, group, include, reason)."""
    rules = rules or [(r"/\.[^/]*$|/~\$", "hidden", False, "hidden"), ("/舊檔/", "old", False, "old copy"), ("^古籍/", "classics", True, ""), ("^講座/|^錄音/", "transcripts", True, ""), ("^掃描/", "scans", True, ""), ("^文件/", "documents", True, "")]
    pick = F.struct(F.lit("other").alias("group"), F.lit(False).alias("include"), F.lit("no rule").alias("reason"))
    for pattern, group, include, reason in reversed(rules):
        pick = F.when(F.col(path).rlike(pattern), F.struct(F.lit(group).alias("group"), F.lit(include).alias("include"), F.lit(reason).alias("reason"))).otherwise(pick)
    return rows.withColumn("top", F.split(path, "/")[0]).withColumn("rule_", pick).select("*", "rule_.*").drop("rule_")


def totals(rows: DataFrame, sets: list[list[str]], **measures: Column) -> DataFrame:
    """Totals for several groupings in one pass."""
    keys = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(*[m.alias(n) for n, m in measures.items()])


def probable_duplicates(rows: DataFrame, keys: list[str], order: str, measure: str, where: Column | None = None) -> DataFrame:
    """(keys, n, first, extra): groups of more than one among the rows of `where`, their first member, and its measure times the others.
    For files: keys category and size, where the size is over 1 MiB and the category one of DUPLICATE_KINDS."""
    some = rows if where is None else rows.where(where)
    g = some.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(measure, order).alias("value"))
    return g.where("n > 1").select(*keys, "n", "first", (F.col("value") * (F.col("n") - 1)).alias("extra"))


def duplicate_files(files: DataFrame) -> DataFrame:
    """(category, size, n, first, extra) of files (path, category, size) that are as good as surely copies."""
    return probable_duplicates(files, ["category", "size"], "path", "size", (F.col("size") > 1 << 20) & F.col("category").isin(*DUPLICATE_KINDS))


def systematic(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each key at equal steps, both ends included; one row: the middle; fewer rows than n: all. Places are found by two passes
    over ranges, so no task holds a key."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("m_")).withColumnsRenamed({k: f"k_{i}_" for i, k in enumerate(keys)})
    same = [F.col(f"k_{i}_").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    placed = totals_before(rows, keys, order, F.lit(1), "i_").join(sizes, same)
    i, m = F.col("i_").cast("bigint"), F.col("m_")
    if n == 1:
        taken = i == F.floor((m - 1) / 2)
    else:
        # i is floor(k (m - 1) / (n - 1)) for some k: then for the smallest k that reaches it
        k = F.ceil(i * (n - 1) / (m - 1))
        taken = F.floor(k * (m - 1) / (n - 1)) == i
    return placed.where((m <= n) | taken).select(*rows.columns)


def episode_and_date(name: Column) -> tuple[Column, Column]:
    """Of a file name: what stands before its date, and YYMMDD as 20YY-MM-DD."""
    date = F.regexp_extract(name, r"(\d{2})(\d{2})(\d{2})", 0)
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"\d{6}", ""), F.when(date != "", F.concat_ws("-", F.concat(F.lit("20"), F.substring(date, 1, 2)), F.substring(date, 3, 2), F.substring(date, 5, 2)))

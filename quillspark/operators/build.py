"""Building a corpus: the order of its parts, cleaned names and paths, statistics of a build, embeddings in order and in batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.dedupe import with_suffixes
from quillspark.operators.windows import totals_before


def in_emission_order(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """The parts one after another as (row, part, ...): row counts from 0 over all of them, in `order` within a part.

    Rows are numbered by two passes over ranges, so no task sees them all.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    numbered = totals_before(every.withColumn("one_", F.lit(0)), ["one_"], ["part", *order], F.lit(1), "row_").drop("one_")
    return numbered.select(F.col("row_").cast("bigint").alias("row"), *[c for c in numbered.columns if c != "row_"])


def emitted(parts: list[DataFrame], order: list[str], id_column: str = "id") -> DataFrame:
    """in_emission_order() with ids made unique in that order."""
    return with_suffixes(in_emission_order(parts, order), id_column, ["row"])


def document_order(files: DataFrame, groups: DataFrame) -> DataFrame:
    """files (path, group, repaired, nested) with `at`: the order in which documents are read, repaired ones last, then by the priority of
    their group (group, priority), then those in folders of their own, then by path."""
    placed = files.join(F.broadcast(groups.select("group", "priority")), "group", "left").withColumn("one_", F.lit(0))
    return totals_before(placed, ["one_"], ["repaired", "priority", "nested", "path"], F.lit(1), "at").drop("one_").withColumn("at", F.col("at").cast("bigint"))


def group_statistics(paragraphs: DataFrame, group: str = "group") -> DataFrame:
    """Of each group of paragraphs (group, path, text, reason: null if kept) the counters of a build; and of all, with a null group."""
    n = lambda c: F.count(F.when(c, 1))
    chars = F.length("text").cast("bigint")
    dropped = lambda r: n(F.col("reason") == r).alias(f"dropped_{r}")
    return paragraphs.rollup(group).agg(
        F.countDistinct("path").alias("files"), F.count("*").alias("paragraphs_before"), F.sum(chars).alias("chars_before"), n(F.col("reason").isNull()).alias("paragraphs_after"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), chars)), F.lit(0)).alias("chars_after"), *[dropped(r) for r in ("garbage", "boilerplate", "repeated", "covered")]
    )


def unmatched_by_suffix(members: DataFrame, known: DataFrame) -> DataFrame:
    """(suffix, n, same_name): archive members (path, md5) whose content isn't among known files (path, md5), by suffix, and how many
    of them have the name of a known file."""
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    alone = members.join(known.select("md5").distinct(), "md5", "left_anti").withColumn("name", name("path"))
    named = alone.join(known.select(name("path").alias("name"), F.lit(True).alias("same")).distinct(), "name", "left")
    return named.groupBy(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix")).agg(F.count("*").alias("n"), F.count("same").alias("same_name"))


def annotations_by_volume(units: DataFrame) -> DataFrame:
    """(volume, n): annotations of units (volume, annotations)."""
    return units.groupBy("volume").agg(F.sum(F.when(F.size("annotations") > 0, F.size("annotations")).otherwise(0)).alias("n"))


def folder_group(name: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The group of the first rule (pattern, group) that a name meets. The rules are the caller's."""
    out = F.lit(otherwise)
    for pattern, group in reversed(rules):
        out = F.when(name.rlike(pattern), group).otherwise(out)
    return out


SUFFIXES = r"(?i)\.(?:docx?|html?|txt|pdf|lrc|chm)$"


def clean_title(path: Column, marks: list[str] = (), depth: int = 1) -> Column:
    """A file's title: its name without suffix and marks of its source (patterns), no space before an opening bracket, white space
    single; the name of its folder where nothing with a letter is left."""

    def cleaned(name: Column) -> Column:
        t = F.regexp_replace(name, SUFFIXES, "")
        for m in marks:
            t = F.regexp_replace(t, m, "")
        t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s*([《【])", "$1"), r"(?U)\s+", " ")
        return F.regexp_replace(t, r"^[ \-_,，]+|[ \-_,，]+$", "")

    parts = F.split(path, "/")
    own, folder = cleaned(F.element_at(parts, -1)), F.when(F.size(parts) > depth, cleaned(F.element_at(parts, -2)))
    return F.when(own.rlike(r"(?U)\w"), own).otherwise(F.coalesce(folder, own))


def safe_path(path: Column, digest: Column, private: str) -> Column:
    """A path for reports: below a folder whose name holds `private`, the rest is hidden behind eight digits of the content's digest, or of the
    path's where there is none."""
    tag = F.substring(F.coalesce(digest, F.sha1(path)), 1, 8)
    return F.when(F.contains(path, F.lit(private)), F.concat(F.substring_index(path, private, 1), F.lit(private), F.lit("…/["), tag, F.lit("]"))).otherwise(path)


def embedding_title(title: Column, episode: Column, section: Column) -> Column:
    """What is embedded before a text: the parts there are, joined by spaces."""
    return F.concat_ws(" ", *[F.when(c != "", c) for c in (title, episode, section)])


def base_segments(segments: Column) -> Column:
    """Corrected segments in the shape of recognised ones: what a correction adds goes, and what was heard is the text again."""
    return F.transform(segments, lambda s: s.withField("text", s["text_asr"]).dropFields("text_asr", "corrected"))


def embedding_matrix(chunks: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """(row, vec): the vectors of chunks (row, key) in row order, ranges of rows in files one after another; a chunk without one is an error."""
    both = chunks.select("row", key).join(cache.select(key, "vec"), key, "left")
    vec = F.when(F.col("vec").isNull(), F.raise_error(F.concat(F.lit("no vector for row "), F.col("row")))).otherwise(F.col("vec"))
    return both.select("row", vec.alias("vec")).repartitionByRange("row").sortWithinPartitions("row")


def request_batches(work: DataFrame, cache: DataFrame, key: str = "key", order: str = "row", tokens: str = "tokens", items: int = 100, most: int = 20_000) -> DataFrame:
    """(key, order, tokens, batch): work that the cache hasn't, each key once, in batches of at most `items` rows and about `most` tokens.

    A batch is what falls into the same span of the running totals, so batches are found by two passes and no task sees all of the work;
    a span can pass `most` by its last row.
    """
    fresh = work.groupBy(key).agg(F.min_by(F.struct(order, tokens), order).alias("w")).select(key, f"w.{order}", f"w.{tokens}").join(cache.select(key), key, "left_anti")
    size = F.greatest(F.col(tokens) / most, F.lit(1.0 / items))
    placed = totals_before(fresh.withColumn("one_", F.lit(0)), ["one_"], [order], size, "before_").drop("one_")
    return placed.withColumn("batch", F.floor("before_").cast("bigint")).drop("before_")


def redacted_log(log: DataFrame, columns: list[str]) -> DataFrame:
    """Answer-log rows for appending, with secrets blanked in the columns named."""
    return log.withColumns({c: X.redact(F.col(c)) for c in columns})


def frame_groups(manifest: DataFrame, depth: int, root: str = ".") -> DataFrame:
    """(group, path, duration) of the videos of a manifest (path, category, duration_sec as text) with a finite positive duration, grouped
    by the first `depth` folders."""
    duration = F.try_to_number(F.trim("duration_sec"), F.lit("999999999.999999")).cast("double")
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.least(F.lit(depth), F.size(F.split("path", "/")) - 1), F.lit(0)))
    some = manifest.where("category = 'video' and path <> ''").withColumn("duration", duration).where("duration > 0")
    return some.select(F.when(F.size(folders) > 0, F.array_join(folders, "/")).otherwise(root).alias("group"), "path", "duration")


def to_extract(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (md5, format, ...) whose text isn't in the cache (md5), one of each content."""
    return files.dropDuplicates(["md5"]).join(cache.select("md5"), "md5", "left_anti")


def history_blocks(blocks: DataFrame, key: str, order: str, kind: str = "type", dropped: tuple[str, ...] = ("thinking", "redacted_thinking", "tool_use", "server_tool_use")) -> DataFrame:
    """Blocks of an answer as they go into a history: those of the kinds `dropped` at or before its last fall-back go."""
    boundary = F.max(F.when(F.col(kind) == "fallback", F.col(order))).over(Window.partitionBy(key))
    return blocks.withColumn("b_", F.coalesce(boundary, F.lit(-1))).where((F.col("b_") <= 0) | (F.col(order) > F.col("b_")) | ~F.col(kind).isin(*dropped)).drop("b_")


def clamped(segments: DataFrame, duration: str, offset: str) -> DataFrame:
    """Segments (start, end, text_raw) with times inside the recording and moved by the clip's offset; empty ones go."""
    off = F.coalesce(F.col(offset), F.lit(0.0))
    start = F.greatest(F.lit(0.0), F.least(F.col(duration), F.col("start"))) + off
    text = X.trimmed(F.col("text_raw"))
    moved = segments.withColumns({"text_raw": text, "s_": start, "e_": F.greatest(start, F.least(F.col(duration) + off, F.col("end") + off))}).where("text_raw <> ''")
    return moved.drop("start", "end").withColumnsRenamed({"s_": "start", "e_": "end"})


def engine_label(engines: DataFrame, key: str, default: str, engine: str = "engine") -> DataFrame:
    """(key, engine): the one engine that made a document's pieces, mixed for several, the default for none."""
    some = engines.groupBy(key).agg(F.collect_set(engine).alias("e"))
    return some.select(key, F.when(F.size("e") == 1, F.col("e")[0]).when(F.size("e") > 1, "mixed").otherwise(default).alias("engine"))


def linked_codes(texts: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """texts with `linked`: codes in （編號 …） that begin just one id become links. Codes are joined with the ids' prefixes of their lengths;
    a text is put together from its own few codes."""
    pattern = r"（編號 ([0-9a-f]{4,16})）"
    codes = texts.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("code")).distinct()
    sizes = [r.n for r in codes.select(F.length("code").alias("n")).distinct().collect()]
    prefixes = ids.select("id").distinct().select(F.explode(F.array(*[F.substring("id", 1, n) for n in sizes or [4]])).alias("code"))
    one = codes.join(prefixes, "code").groupBy("code").agg(F.count("*").alias("n")).where("n = 1").select("code")
    valid = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("code")).join(one, "code").groupBy(key).agg(F.collect_set("code").alias("v_"))
    done = texts.join(valid, key, "left")
    step = F.aggregate(F.coalesce("v_", F.array().cast("array<string>")), F.col(text), lambda t, c: F.replace(t, F.concat(F.lit("（編號 "), c, F.lit("）")), F.concat(F.lit(" /s_"), c)))
    return done.withColumn("linked", step).drop("v_")


def cited_answers(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer, text, base, code): citations (base, id, text, code) that an answer names without a code and that are certain: the only one of
    its base, or the only one whose text holds what is quoted before it. The longest of overlapping bases counts.

    Answers are matched to bases by the bases' own lengths, an equality join.
    """
    sizes = [r.n for r in citations.select(F.length("base").alias("n")).where("n > 0").distinct().orderBy("n").collect()]

    def said(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("answer_text") - n + 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.substring(F.col("answer_text"), i, F.lit(n)).alias("base")))

    grams = F.flatten(F.array(*[said(n) for n in sizes or [1]]))
    places = answers.select("answer", F.col("text").alias("answer_text")).select("answer", "answer_text", F.explode(grams).alias("g")).select("answer", "answer_text", "g.at", "g.base")
    named = places.join(citations.select("base").distinct(), "base").withColumn("until", F.col("at") + F.length("base"))
    w = Window.partitionBy("answer").orderBy("at", F.desc("until"))
    outer = named.withColumn("reach", F.coalesce(F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("at") >= F.col("reach"))
    behind = F.substring("answer_text", F.col("until"), F.lit(4))
    open_ = outer.where(~behind.startswith("（編號") & ((behind == "") | behind.rlike(r"^[\s，。；、：！？）」』\]\)]")))
    quoted = F.regexp_extract(F.substring("answer_text", F.lit(1), F.col("at") - 1), r"[「『“\"]([^「」『』“”\"]+)[」』”\"][^「」『』“”\"]*$", 1)
    met = open_.withColumn("quoted", quoted).join(citations, "base").withColumn("n", F.count("*").over(Window.partitionBy("answer", "at")))
    fits = met.withColumn("holds", (F.col("quoted") != "") & F.contains("text", "quoted")).withColumn("k", F.sum(F.col("holds").cast("int")).over(Window.partitionBy("answer", "at")))
    return fits.where((F.col("n") == 1) | (F.col("holds") & (F.col("k") == 1))).select("answer", "at", "base", "code")


def prompts(lines: DataFrame, keys: list[str], order: str, head: Column) -> DataFrame:
    """(keys, prompt): a head and the lines [label] text of each piece in order. A piece is bounded."""
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "label", "text"))), lambda s: F.concat(F.lit("["), s["label"], F.lit("] "), s["text"])), "\n")
    return lines.groupBy(*keys).agg(F.first(head).alias("h_"), shown.alias("l_")).select(*keys, F.concat_ws("\n\n", "h_", "l_").alias("prompt"))

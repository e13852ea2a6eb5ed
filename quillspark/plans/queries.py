"""Queries over whole tables, one or more for each operator, each with the same thing said in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vectors as V
from quillspark.functions import numerals, script
from quillspark.operators import build, chunking, control, dedupe, inventory, layout, links, metering, pages, pricing, quality, scoring, search, windows
from quillspark.sources.shared import shared_folder, until_exit
from quillspark.sources.tables import table
from quillspark.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- the same keys in SQL, written out apart from the code they check ------------------------------------------------------
_q = lambda s: "'" + s.replace("'", "''") + "'"
_NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FULL = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
_HAN = "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{3134f}"


def s_fold(t: str) -> str:
    return f"translate(replace(lower(translate({t}, '{_FULL}', '{_NARROW}')), 'ß', 'ss'), '溼芪痹谿ς', '濕耆痺溪σ')"


def s_compact(t: str) -> str:
    return f"regexp_replace({s_fold(t)}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g')"


def s_tokens(t: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({s_fold(t)}, '[{_HAN}]+|[0-9a-z]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9a-z]') THEN [r] ELSE list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 2)) END))"


def s_bigrams(t: str) -> str:
    return f"list_distinct(list_transform(range(1, length({t})), lambda i: substr({t}, i, 2)))"


def s_bm25(source: str, key: str, terms: list[tuple[str, bool]], kind: str | None = None) -> str:
    hit = lambda t, p: f"len(list_filter(toks, lambda x: {f'starts_with(x, {_q(t)})' if p else f'x = {_q(t)}'}))"
    f = ", ".join(f"{hit(*t)} AS f{i}" for i, t in enumerate(terms))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    part = " + ".join(f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * size / mean))" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    of_kind = f" AND kind = '{kind}'" if kind else ""
    return f"WITH t AS (SELECT {key}{', kind' if kind else ''}, CASE WHEN text IS NULL THEN [] ELSE {s_tokens('text')} END AS toks FROM {source}), c AS (SELECT *, len(toks) AS size, {f} FROM t), s AS (SELECT count(*)::DOUBLE AS n, avg(size) AS mean, {n} FROM c) SELECT {key}, round({part}, 6) AS score FROM c, s WHERE ({some}){of_kind} ORDER BY {part} DESC, {key} LIMIT 50"


#: A question and its terms: pairs of characters, without those that hold a particle.
ASK, _TERMS = "脅下悶痛的霜壺湯", [("脅下", False), ("下悶", False), ("悶痛", False), ("霜壺", False), ("壺湯", False)]
_INDEXES: dict[tuple[str, str, str], search.Index] = {}


def _index(spark: SparkSession, d: str, name: str, key: str) -> search.Index:
    """The index of a table, written once a session."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _INDEXES:
        folder = shared_folder(spark)
        search.write_index(table(spark, d, name), folder, key)
        until_exit(spark, folder)
        _INDEXES[at] = search.open_index(spark, folder)
    return _INDEXES[at]


def dimension(df: DataFrame, most: int = 10_000) -> list:
    """The rows of a small table of parameters; a larger one is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dimension has at most {most} rows")
    return rows


rounded = lambda df, *cs: df.withColumns({c: F.round(c, 6) for c in cs})


# --- search ---------------------------------------------------------------------------------------------------------------
@query(f"SELECT 'chunks' AS name, count(*) AS count, round(avg(n), 6) AS mean FROM (SELECT len({s_tokens('text')}) AS n FROM chunks) UNION ALL SELECT 'documents', count(*), round(avg(n), 6) FROM (SELECT CASE WHEN text IS NULL THEN 0 ELSE len({s_tokens('text')}) END AS n FROM documents)")
def index_figures(spark: SparkSession, d: str) -> DataFrame:
    """Builds the indexes of chunks and documents, which the searches then read."""
    some = [(name, i.count, i.mean) for name, key in (("chunks", "row"), ("documents", "doc_id")) for i in [_index(spark, d, name, key)]]
    return rounded(spark.createDataFrame(some, "name string, count bigint, mean double"), "mean")


@query(s_bm25("chunks", '"row"', _TERMS))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.bm25_indexed(_index(spark, d, "chunks", "row"), ASK), "score")


@query(s_bm25("chunks", '"row"', _TERMS, "classic"))
def bm25_kind_filtered(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.bm25_indexed(_index(spark, d, "chunks", "row"), ASK, kind="classic"), "score")


@query(s_bm25("documents", "doc_id", [("汗", True)]))
def bm25_prefix_term(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.bm25_indexed(_index(spark, d, "documents", "doc_id"), "汗", key="doc_id"), "score")


@query(s_bm25("chunks", '"row"', [("停了", False), ("了九", False)]))
def bm25_particles(spark: SparkSession, d: str) -> DataFrame:
    """A question whose pairs all hold a particle keeps them. Without an index."""
    return rounded(search.bm25(table(spark, d, "chunks"), "停了九"), "score")


@query(s_bm25("chunks", '"row"', [("大約", False)]))
def bm25_without_particles(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a particle are left out where there are others."""
    return rounded(search.bm25_indexed(_index(spark, d, "chunks", "row"), "大約了"), "score")


@query(f"SELECT kind, any_value(c) AS chunks, count(t) AS tokens, count(DISTINCT t) AS terms FROM (SELECT kind, c, unnest(toks) AS t FROM (SELECT kind, count(*) OVER (PARTITION BY kind) AS c, {s_tokens('text')} AS toks FROM chunks)) GROUP BY kind")
def index_token_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    sizes = c.select("kind", F.size(X.tokens(F.col("text"))).cast("bigint").alias("n")).groupBy("kind").agg(F.count("*").alias("chunks"), F.sum("n").alias("tokens"))
    terms = c.select("kind", F.explode(X.tokens(F.col("text"))).alias("t")).distinct().groupBy("kind").agg(F.count("*").alias("terms"))
    return sizes.join(terms, "kind")


@query(f"SELECT \"row\", t AS term, count(*) AS tf FROM (SELECT \"row\", unnest({s_tokens('text')}) AS t FROM chunks) GROUP BY ALL")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "chunks"))


_UNIT = "(SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0)"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) / sqrt(list_dot_product(q, q)), 6) AS score FROM embeddings, {_UNIT} ORDER BY list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) DESC, vec_id LIMIT 50")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.vector_top(table(spark, d, "embeddings"), _query_vector(spark, d)), "score")


@query(f"SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) / sqrt(list_dot_product(q, q)), 6) AS score FROM embeddings, {_UNIT} WHERE label = 1 ORDER BY list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) DESC, vec_id LIMIT 50")
def vector_topk_kind(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.vector_top(table(spark, d, "embeddings"), _query_vector(spark, d), where=F.col("label") == 1), "score")


@query("SELECT vec_id, label, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(sqrt(list_dot_product(u, u)), 6) AS unit FROM (SELECT *, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))")
def l2_normalised(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(V.normalised(F.col("embedding"))), 6).alias("unit"))


_B = s_bm25("documents", "doc_id", _TERMS)


@query(f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_B})),
b AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT vec_id AS doc_id, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) AS s FROM embeddings, {_UNIT} ORDER BY s DESC, vec_id LIMIT 50))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1 / (60.0::DOUBLE + a.r), 0) + coalesce(1 / (60.0::DOUBLE + b.r), 0), 9) AS score, a.r AS bm25_rank, b.r AS vector_rank FROM a FULL JOIN b USING (doc_id)""")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    one = rounded(search.bm25_indexed(_index(spark, d, "documents", "doc_id"), ASK, key="doc_id"), "score")
    two = search.vector_top(table(spark, d, "embeddings"), _query_vector(spark, d)).withColumnRenamed("vec_id", "doc_id")
    return search.fused({"bm25": one, "vector": two}, "doc_id").withColumn("score", F.round("score", 9)).withColumns({c: F.col(c).cast("bigint") for c in ("bm25_rank", "vector_rank")})


_ISLAND = '(SELECT "row", source, "row" - row_number() OVER (PARTITION BY source ORDER BY "row") AS island FROM chunks)'


@query(f'SELECT c."row" AS center, n."row" AS "row" FROM {_ISLAND} c JOIN {_ISLAND} n ON n.source = c.source AND n.island = c.island AND n."row" BETWEEN c."row" - 2 AND c."row" + 3')
def neighbours_of_all(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return search.neighbours(c, c, 2, 3)


@query(f'SELECT source, island, count(*) AS n, min("row") AS "first", max("row") AS "last" FROM {_ISLAND} GROUP BY source, island')
def contiguous_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = search.islands(table(spark, d, "chunks")).groupBy("source", F.col("island").alias("first")).agg(F.count("*").alias("n"), F.max("row").alias("last"))
    # numbered by the rows of the source before each run, from the runs, which are few
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return runs.select("source", (F.col("first") - before - 1).alias("island"), "n", "first", "last")


@query("""WITH i AS (SELECT DISTINCT id FROM chunks), p AS (SELECT id, unnest(range(6, length(id) + 1)) AS n FROM i), k AS (SELECT substr(id, 1, n) AS s, n, count(*) AS c FROM p GROUP BY ALL)
SELECT p.id, substr(p.id, 1, coalesce(min(p.n) FILTER (k.c = 1), length(p.id))) AS short FROM p JOIN k ON k.s = substr(p.id, 1, p.n) AND k.n = p.n GROUP BY p.id""")
def short_ids(spark: SparkSession, d: str) -> DataFrame:
    return search.short_ids(table(spark, d, "chunks"))


@query("SELECT DISTINCT id FROM chunks WHERE starts_with(id, 'a1') ORDER BY id LIMIT 20")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    return search.find_prefix(table(spark, d, "chunks"), "a1", 20)


_SHORT = """(WITH i AS (SELECT DISTINCT id FROM chunks), p AS (SELECT id, unnest(range(6, length(id) + 1)) AS n FROM i), k AS (SELECT substr(id, 1, n) AS s, n, count(*) AS c FROM p GROUP BY ALL)
SELECT p.id, substr(p.id, 1, coalesce(min(p.n) FILTER (k.c = 1), length(p.id))) AS short FROM p JOIN k ON k.s = substr(p.id, 1, p.n) AND k.n = p.n GROUP BY p.id)"""
_CLOCK = lambda c: f"(CASE WHEN coalesce({c}, 0)::BIGINT_ >= 3600 THEN printf('%d:%02d:%02d', coalesce({c}, 0)::BIGINT_ // 3600, coalesce({c}, 0)::BIGINT_ % 3600 // 60, coalesce({c}, 0)::BIGINT_ % 60) ELSE printf('%02d:%02d', coalesce({c}, 0)::BIGINT_ // 60, coalesce({c}, 0)::BIGINT_ % 60) END)".replace(f"coalesce({c}, 0)::BIGINT_", f"trunc(coalesce({c}, 0))::BIGINT")


@query(f"""SELECT "row", CASE kind WHEN 'classic' THEN '《' || coalesce(title, '') || '》' || coalesce(section, '') || coalesce(' ' || nullif(episode, ''), '')
WHEN 'transcript' THEN concat_ws(' ', nullif(title, ''), nullif(episode, '')) || ' ' || {_CLOCK('start')} || '–' || {_CLOCK('"end"')}
ELSE concat_ws(' ', title, nullif(section, ''), nullif(date, ''), CASE WHEN page_start IS NULL THEN NULL WHEN page_start = page_end THEN '第 ' || page_start || ' 頁' ELSE '第 ' || page_start || '–' || page_end || ' 頁' END) END || '（編號 ' || s.short || '）' AS cited
FROM chunks c JOIN {_SHORT} s ON s.id = c.id""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return search.citation(c, search.short_ids(c)).select("row", "cited")


# --- text measures --------------------------------------------------------------------------------------------------------
_OTHERS = f"length(regexp_replace(text, '[{_HAN}]', '', 'g'))"


@query(f"SELECT kind, count(*) AS n, sum(length(text) - {_OTHERS} + ceil({_OTHERS} / 3.0)::BIGINT + 1)::BIGINT AS estimate FROM chunks GROUP BY kind")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("kind").agg(F.count("*").alias("n"), F.sum(X.estimated_tokens(F.col("text")).cast("bigint")).alias("estimate"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^。！？；!?;\\n]*[。！？；!?;\\n]+|[^。！？；!?;\\n]+$'), lambda s: length(regexp_replace(s, '[\\s\\p{Z}\\x{85}\\x0b\\x1c-\\x1f]', '', 'g')) > 0)) AS n FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(X.sentences(F.col("text"))).cast("bigint").alias("n"))


_DATES = [(r"(?:^|[^0-9])((?:19|20)[0-9]{2})\s*[-/.年]\s*([0-9]{1,2})\s*[-/.月]\s*([0-9]{1,2})(?:[^0-9]|$)", "123"), (r"(?:^|[^0-9])([0-9]{1,2})/([0-9]{1,2})/((?:19|20)[0-9]{2})(?:[^0-9]|$)", "312"), (r"(?:^|[^0-9])((?:19|20)[0-9]{2})([0-9]{2})([0-9]{2})(?:[^0-9]|$)", "123"), (r"(?:^|[^0-9])((?:19|20)[0-9]{2})\s*年\s*([0-9]{1,2})\s*月", "120")]


def _s_dates() -> str:
    out = []
    for p, (y, m, day) in _DATES:
        part = lambda g, p=p: f"regexp_extract_all(t, '{p}', {g})"
        good = f"try_cast(z[2] AS INT) BETWEEN 1 AND 12{'' if day == '0' else ' AND try_cast(z[3] AS INT) BETWEEN 1 AND 31'}"
        shown = "z[1] || '-' || lpad(ltrim(z[2], '0'), 2, '0')" + ("" if day == "0" else " || '-' || lpad(ltrim(z[3], '0'), 2, '0')")
        zipped = f"list_zip({part(y)}, {part(m)}{'' if day == '0' else ', ' + part(day)})"
        out.append(f"list_filter(list_transform({zipped}, lambda z: CASE WHEN {good} THEN {shown} END), lambda x: x IS NOT NULL)[1]")
    return f"SELECT \"row\", coalesce({', '.join(out)}) AS found FROM (SELECT \"row\", concat_ws(' ', date, text) AS t FROM chunks) WHERE found IS NOT NULL"


@query(_s_dates())
def found_dates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.select("row", X.find_date(F.concat_ws(" ", "date", "text")).alias("found")).where("found is not null")


@query("SELECT \"row\" FROM chunks WHERE raw_text IS NOT NULL AND length(raw_text) >= 20 AND (length(raw_text) - length(regexp_replace(raw_text, '[\\x{80}-\\x{24f}\\x{370}-\\x{3ff}\\x{2200}-\\x{22ff}\\x{fb01}\\x{fb02}\\x{f8ff}\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')))::DOUBLE / length(raw_text) >= 0.3 AND (length(raw_text) - length(regexp_replace(raw_text, '[\\x{3400}-\\x{9fff}]', '', 'g')))::DOUBLE / length(raw_text) < 0.1")
def garbage_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(X.is_garbage(F.col("raw_text"))).select("row")


def s_lines(source: str, key: str, text: str) -> str:
    """(key, "at", paragraph): the lines of a text that aren't blank, numbered as they stand."""
    line = "trim(regexp_replace(x, '[ \\t\\x{3000}\\x{a0}]+', ' ', 'g'))"
    return f"(SELECT {key}, pos - 1 AS \"at\", regexp_replace({line}, '^\\s+|\\s+$', '', 'g') AS paragraph FROM (SELECT {key}, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (SELECT {key}, string_split(regexp_replace({text}, '\\r\\n?|\\x{{2028}}|\\x{{2029}}', chr(10), 'g'), chr(10)) AS l FROM {source} WHERE {text} IS NOT NULL)) WHERE length({line}) > 0)"


_LEADERS = "list_sum(list_transform(regexp_extract_all(paragraph, '[·．.…•]{6,}'), lambda x: length(x)))"


@query(f"SELECT \"row\", \"at\" FROM {s_lines('chunks', '\"row\"', 'raw_text')} WHERE NOT regexp_matches(paragraph, '\\p{{L}}') OR regexp_matches(paragraph, '(?i)^(?:第?\\s*[0-9]*\\s*[页頁]|P\\s*[0-9]+\\s*-\\s*[0-9][0-9 ]*|[IVXLC]+|[0-9]+|[-–—\\s0-9]+)$') OR coalesce({_LEADERS}, 0) > 0 AND {_LEADERS} >= 0.2 * length(paragraph)")
def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    p = dedupe.paragraphs(table(spark, d, "chunks"), "row", "raw_text")
    return p.where(X.is_boilerplate(F.col("paragraph"))).select("row", "at")


_FIRST = "regexp_matches(t, '^第[一二三四五六七八九十百千零〇两兩0-9]+[章講讲節节篇回課课卷部]') OR regexp_matches(t, '^[^，,。：:；]{2,20}第[一二三四五六七八九十百千零〇两兩0-9]+$') OR regexp_matches(t, '^辨.{1,16}[病脉脈].{0,10}[治篇法]') OR regexp_matches(t, '^[壹貳贰參叁肆伍陸陆柒捌玖拾]+[、．.]') OR (regexp_matches(t, '^【[^】]{1,30}】$') AND NOT regexp_matches(t, '社|報|报|網|网|新聞|新闻|記者|记者|電|电'))"
_SECOND = "regexp_matches(t, '^[一二三四五六七八九十百千零〇两兩]{1,4}\\s*[、．.：:]\\s*\\S') OR regexp_matches(t, '^[（(][一二三四五六七八九十0-9]{1,3}[)）]\\s*\\S') OR regexp_matches(t, '^[0-9]{1,3}\\s*[、．.]\\s*[^0-9\\s]')"


@query(f"SELECT \"row\", place, level FROM (SELECT \"row\", place, CASE WHEN length(t) = 0 OR length(t) > 40 THEN 0 WHEN {_FIRST} THEN 1 WHEN {_SECOND} THEN 2 ELSE 0 END AS level FROM (SELECT \"row\", 'section' AS place, trim(section) AS t FROM chunks WHERE section IS NOT NULL UNION ALL SELECT \"row\", 'line ' || \"at\", paragraph FROM {s_lines('chunks', '\"row\"', 'raw_text')})) WHERE level > 0")
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    lines = dedupe.paragraphs(c, "row", "raw_text").select("row", F.concat(F.lit("line "), F.col("at")).alias("place"), "paragraph")
    every = c.where("section is not null").select("row", F.lit("section").alias("place"), F.col("section").alias("paragraph")).unionByName(lines)
    return every.withColumn("level", X.heading_level(F.col("paragraph"))).where("level > 0").select("row", "place", "level")


@query("SELECT \"row\", substr(sha1(source || chr(31) || id), 1, 16) AS made FROM chunks")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("row", X.chunk_id(F.col("source"), F.col("id")).alias("made"))


@query("SELECT \"row\", id || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM (SELECT \"row\", id, row_number() OVER (PARTITION BY id ORDER BY \"row\") AS n FROM chunks)")
def id_collision_suffix(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.with_suffixes(table(spark, d, "chunks").select("row", "id"), "id", ["row"])


# --- duplicates -----------------------------------------------------------------------------------------------------------
_RANK = "CASE WHEN source LIKE 'hall%' THEN 0 WHEN source LIKE 'clinic%' THEN 1 ELSE 2 END"


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY {_RANK}, doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1 UNION ALL SELECT doc_id, source FROM documents WHERE text IS NULL")
def file_dedupe_priority(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.first_of(table(spark, d, "documents"), F.md5("text"), [F.expr(_RANK), F.col("doc_id")]).select("doc_id", "source")


@query("WITH k AS (SELECT md5(text) AS m, min(doc_id) AS twin FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY ALL) SELECT doc_id, twin FROM documents LEFT JOIN k ON k.m = md5(text) WHERE lang IS NULL")
def excluded_twins(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("digest", F.md5("text"))
    return dedupe.with_twins(t.where("lang is null").select("doc_id", "digest"), t.where("lang is not null and text is not null"), "digest", "doc_id").select("doc_id", "twin")


_KEY = lambda t: f"regexp_replace({s_fold(t)}, '[\\p{{P}}\\p{{S}}\\p{{Z}}\\s\\x{{85}}\\x0b\\x1c-\\x1f]', '', 'g')"


@query(f"SELECT doc_id, \"at\" FROM (SELECT doc_id, \"at\", length(k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, \"at\") AS i FROM (SELECT doc_id, \"at\", {_KEY('paragraph')} AS k FROM {s_lines('documents', 'doc_id', 'text')})) WHERE n >= 8 AND i > 1")
def paragraph_dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    p = dedupe.repeated_exactly(dedupe.paragraphs(table(spark, d, "documents")), ["doc_id", "at"])
    return p.where("not first").select("doc_id", "at")


@query()
def paragraph_dedupe_coverage(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.kept_paragraphs(dedupe.paragraphs(table(spark, d, "documents")), ["doc_id", "at"]).select("doc_id", "at")


@query("SELECT (SELECT count(*) FROM answer_log WHERE cited_id IN (SELECT id FROM chunks)) AS known, (SELECT count(*) FROM answer_log a WHERE cited_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.id = a.cited_id)) AS gone, (SELECT count(*) FROM answer_log WHERE cited_id IS NULL) AS none")
def members_vs_known(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "chunks").select(F.col("id").alias("cited_id")).distinct().withColumn("there", F.lit(True))
    a = table(spark, d, "answer_log").join(ids, "cited_id", "left")
    return a.agg(F.count(F.when(F.col("there"), 1)).alias("known"), F.count(F.when(F.col("cited_id").isNotNull() & F.col("there").isNull(), 1)).alias("gone"), F.count(F.when(F.col("cited_id").isNull(), 1)).alias("none"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY received_at, rounds, input_tokens) AS i, row_number() OVER (PARTITION BY log_id ORDER BY received_at DESC, rounds DESC, input_tokens DESC) AS j FROM answer_log) SELECT a.log_id, CASE WHEN a.model IS DISTINCT FROM b.model THEN 'model' WHEN a.rounds IS DISTINCT FROM b.rounds THEN 'rounds' ELSE 'received_at' END AS reason FROM r a JOIN r b ON a.log_id = b.log_id AND a.i = 1 AND b.j = 1 WHERE a.model IS DISTINCT FROM b.model OR a.rounds IS DISTINCT FROM b.rounds OR a.received_at IS DISTINCT FROM b.received_at")
def sequence_differences(spark: SparkSession, d: str) -> DataFrame:
    """Between the first and the last delivery of each log line."""
    log = table(spark, d, "answer_log").select("log_id", "model", "rounds", "received_at", "input_tokens")
    order = ["received_at", "rounds", "input_tokens"]
    first = dedupe.last_wins(log, ["log_id"], [F.col(c) for c in order])
    last = dedupe.last_wins(log, ["log_id"], [F.desc(c) for c in order])
    return dedupe.differences(first, last, ["log_id"], ["model", "rounds", "received_at"])


# --- chunking -------------------------------------------------------------------------------------------------------------
@query()
def chunk_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return chunking.transcript_chunks(table(spark, d, "chunks").where("kind = 'transcript'"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.document_chunks(table(spark, d, "documents"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT key, i, 1 AS n FROM e WHERE i = 1 UNION ALL SELECT m.key, min(m.i), s.n + 1 FROM s JOIN e p ON p.key = s.key AND p.i = s.i JOIN e m ON m.key = s.key AND m.i > s.i AND (m.t - p.t >= 86400 OR m.i - s.i >= 150) GROUP BY m.key, s.i, s.n)
SELECT e.key, s.n AS "window", min(e.t) AS "first", max(e.t) AS "last", count(*) AS "rows" FROM e ASOF JOIN s ON e.key = s.key AND e.i >= s.i GROUP BY ALL""")
def correction_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return chunking.time_windows(e, "user_id", "t", ["event_id"], seconds=86400)


# --- windows --------------------------------------------------------------------------------------------------------------
_RUNS = "(SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 0 ELSE 1 END AS new FROM events))"


@query(f"SELECT event_id, n AS run_length FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, run) AS n FROM {_RUNS}) WHERE n >= 3")
def run_length_drop(spark: SparkSession, d: str) -> DataFrame:
    return windows.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").where("run_length >= 3").select("event_id", "run_length")


@query("SELECT event_id, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2030-01-01') AS \"end\" FROM events")
def end_from_next(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return windows.ends_from_next(e, ["user_id"], ["ts", "event_id"], "ts", F.lit("2030-01-01").cast(e.schema["ts"].dataType)).select("event_id", "end")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS paid FROM events")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return windows.carried(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.expr("case when event_type = 'purchase' then value end"), "paid").select("event_id", "paid")


@query("SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 5000")
def hours_limit_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return windows.until_total(table(spark, d, "documents"), ["source"], ["doc_id"], "n_chars", 5000).select("doc_id")


@query("SELECT user_id, session, count(*) AS n, min(ts) AS began FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, session")
def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = windows.sessions(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], 6 * 3600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5 AS allowed FROM events")
def quota_first_n(spark: SparkSession, d: str) -> DataFrame:
    return windows.first_n(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id", "allowed")


@query("SELECT a.event_id, b.value AS price FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_effective(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    right = e.where("event_type = 'view'").select("user_id", "ts", "event_id", F.col("value").alias("price"))
    return windows.asof(e.where("event_type = 'purchase'"), right, ["user_id"], "ts", "ts", "event_id", ["price"]).select("event_id", "price")


@query("SELECT a.event_id, b.event_id AS other_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type <> 'error' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000")
def context_range_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return windows.within(e.where("event_type = 'error'"), e.where("event_type <> 'error'"), ["user_id"], "ts", "ts", 7200).select("event_id", "other_event_id")


# --- links ----------------------------------------------------------------------------------------------------------------
_UP = "(SELECT classic_id, target_id, v.target_kind AS target_kind, v.score AS score FROM (SELECT classic_id, target_id, max({'score': score, 'target_kind': target_kind, 'method': method, 'lecture_number': lecture_number}) AS v FROM classic_links GROUP BY classic_id, target_id))"


@query(f"SELECT classic_id, target_id, target_kind, score FROM {_UP}")
def link_upsert(spark: SparkSession, d: str) -> DataFrame:
    return links.upserted(table(spark, d, "classic_links")).select("classic_id", "target_id", "target_kind", "score")


@query(f"SELECT classic_id, rank, \"row\", id, score FROM (SELECT classic_id, row_number() OVER (PARTITION BY classic_id ORDER BY score DESC, r) AS rank, r AS \"row\", target_id AS id, score FROM {_UP} JOIN (SELECT id, min(\"row\") AS r FROM chunks GROUP BY id) ON id = target_id) WHERE rank <= 6")
def commentary_top(spark: SparkSession, d: str) -> DataFrame:
    return links.commentary(table(spark, d, "classic_links"), table(spark, d, "chunks"))


@query("WITH i AS (SELECT DISTINCT id FROM chunks WHERE kind = 'classic') SELECT target_kind, count(DISTINCT classic_id) AS linked, round(count(DISTINCT classic_id)::DOUBLE / (SELECT count(*) FROM i), 6) AS rate FROM classic_links WHERE classic_id IN (SELECT id FROM i) GROUP BY target_kind")
def link_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(links.coverage(table(spark, d, "classic_links"), table(spark, d, "chunks").where("kind = 'classic'")), "rate")


@query("SELECT DISTINCT id FROM chunks WHERE kind = 'classic' AND id NOT IN (SELECT classic_id FROM classic_links)")
def unlinked_classics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("kind = 'classic'").select("id").distinct().join(table(spark, d, "classic_links").select(F.col("classic_id").alias("id")), "id", "left_anti")


_K = s_compact("text")


@query(f"WITH k AS (SELECT \"row\", kind, {_K} AS t, {s_compact('substr(text, 1, 160)')} AS u FROM chunks), c AS (SELECT \"row\" AS a, {s_bigrams('u')} AS s FROM k WHERE kind = 'classic' AND length(u) > 1), o AS (SELECT \"row\" AS b, {s_bigrams('t')} AS s FROM k WHERE kind = 'document' AND length(t) > 1) SELECT a, b, round(len(list_intersect(c.s, o.s))::DOUBLE / len(c.s), 6) AS score FROM c, o WHERE len(list_intersect(c.s, o.s))::DOUBLE / len(c.s) >= 0.53 - 1e-9")
def similarity_link(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    left = c.where("kind = 'classic'").select("row", F.substring("text", 1, 160).alias("text"))
    return rounded(links.containment_join(left, c.where("kind = 'document'").select("row", "text"), 0.53, "row", "row"), "score")


@query()
def course_links(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return links.course_links(c.where("kind = 'classic'"), c.where("kind = 'transcript'"))


_LAST = lambda c, p: f"regexp_split_to_array(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '{p}')[-1]"


@query(f"""WITH t AS (SELECT DISTINCT {_LAST('section', '\\s+|、')} AS term FROM chunks WHERE kind = 'classic' AND section IS NOT NULL AND length({_LAST('section', '\\s+|、')}) >= 2),
h AS (SELECT "row", id, kind, term, text, regexp_matches(text, '[一二三四五六七八九十百千〇零0-9]{{1,5}}[、：]\\s*' || term) AS heading FROM chunks, t WHERE kind <> 'classic' AND contains(text, term) AND (contains(substr(text, 1, 80), term) OR coalesce(regexp_split_to_array(section, '\\s+')[-1], '') = term)),
o AS (SELECT DISTINCT id AS classic_id, {_LAST('section', '\\s+|、')} AS term, {s_compact('substr(text, 1, 100)')} AS k FROM chunks WHERE kind = 'classic' AND section IS NOT NULL),
m AS (SELECT classic_id, kind, "row", id, heading, {s_bigrams('k')} AS a, {s_bigrams(s_compact('text'))} AS b FROM o JOIN h USING (term)),
s AS (SELECT classic_id, kind, "row", id, max(round(0.35 + CASE WHEN heading THEN 0.25 ELSE 0 END + 0.15 + 0.15 * CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END + 1e-10, 3)) AS score FROM m GROUP BY ALL)
SELECT classic_id, id AS target_id, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY classic_id, kind ORDER BY score DESC, "row") AS n FROM s) WHERE n <= 3""")
def term_links(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    terms = c.where("kind = 'classic' and section is not null").select(F.element_at(F.split(X.trimmed(F.col("section")), r"\s+|、"), -1).alias("term")).distinct().where("length(term) >= 2").withColumn("alias", F.col("term"))
    return links.term_links(c.where("kind = 'classic'"), c.where("kind <> 'classic'"), terms)


@query("WITH s AS (SELECT DISTINCT source FROM chunks), m AS (SELECT s.source, c.name, row_number() OVER (PARTITION BY s.source ORDER BY length(c.prefix) DESC) AS n FROM s JOIN courses c ON starts_with(s.source, c.prefix)) SELECT s.source, m.name FROM s LEFT JOIN m ON m.source = s.source AND m.n = 1")
def longest_prefix_course(spark: SparkSession, d: str) -> DataFrame:
    return links.longest_prefix(table(spark, d, "chunks"), table(spark, d, "courses"), "source", "prefix", ["name"])


# --- quality and evaluation -----------------------------------------------------------------------------------------------
@query()  # DuckDB's levenshtein counts bytes, not characters
def cer_micro(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("raw_text is not null").withColumn("e", F.levenshtein("raw_text", "text"))
    return c.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("e").cast("bigint")).alias("edits"), F.sum(F.length("raw_text").cast("bigint")).alias("chars"))


_W = "(SELECT DISTINCT unnest(hotwords) AS w FROM courses)"
_N = lambda t: f"((length({t}) - length(replace({t}, w, ''))) // length(w))"


@query(f"SELECT w AS term, sum(least({_N('text')}, {_N('raw_text')}))::BIGINT AS matched, sum(greatest({_N('text')} - {_N('raw_text')}, 0))::BIGINT AS missed FROM chunks, {_W} WHERE raw_text IS NOT NULL GROUP BY w HAVING sum({_N('text')}) > 0")
def multiset_recall(spark: SparkSession, d: str) -> DataFrame:
    words = [r.w for r in dimension(table(spark, d, "courses").select(F.explode("hotwords").alias("w")).distinct().orderBy("w"))]
    count = lambda c, w: (F.length(c) - F.length(F.replace(F.col(c), F.lit(w), F.lit("")))) / F.lit(len(w))
    c = table(spark, d, "chunks").where("raw_text is not null").select("text", "raw_text", F.explode(F.array(*[F.struct(F.lit(w).alias("term"), count("text", w).cast("bigint").alias("a"), count("raw_text", w).cast("bigint").alias("b")) for w in words])).alias("t")).select("t.*")
    return c.groupBy("term").agg(F.sum(F.least("a", "b")).alias("matched"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missed"), F.sum("a").alias("n")).where("n > 0").drop("n")


_N_ = lambda t: f"length(regexp_replace({t}, '[\\s\\p{{Z}}\\x{{85}}\\x0b\\x1c-\\x1f]', '', 'g'))"


@query(f"""WITH l AS (SELECT source, {_N_('raw_text')} AS b, {_N_('text')} AS a, length(text) AS n, length(regexp_replace(raw_text, '[嗯啊哈呃哦噢唉欸呀耶、，。！？!?\\s\\p{{Z}}]', '', 'g')) AS said FROM chunks WHERE kind = 'transcript' AND raw_text IS NOT NULL),
s AS (SELECT source, count(*) AS lines, count(n) AS matched, CASE WHEN sum(b) > 0 THEN sum(a)::DOUBLE / sum(b) WHEN sum(a) = 0 THEN 1.0 ELSE 'inf'::DOUBLE END AS ratio, sum((n IS NOT NULL AND ((n = 0 AND said >= 4) OR a > greatest(2 * b, b + 20)))::INT)::BIGINT AS anomalies FROM l GROUP BY source)
SELECT source, lines, matched, round(ratio, 6) AS length_ratio, anomalies, CASE WHEN NOT (ratio BETWEEN 0.6 AND 1.5 AND anomalies::DOUBLE / lines <= 0.05) THEN 'failed' WHEN matched = lines THEN 'ok' WHEN matched::DOUBLE / lines >= 0.95 THEN 'partial' ELSE 'failed' END AS status FROM s""")
def correction_accepted(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("kind = 'transcript' and raw_text is not null").select("source", "row", F.lit(1).alias("attempt"), F.col("raw_text").alias("before"), F.col("text").alias("after"))
    return quality.chosen(quality.correction_scores(c, ["source", "attempt"]), ["source"]).select("source", "lines", "matched", F.round("length_ratio", 6).alias("length_ratio"), "anomalies", "status")


@query()
def loops_filtered(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("kind = 'transcript' and raw_text is not null").select("row", "source", F.col("raw_text").alias("text_raw"))
    marked = quality.repeated_segments(c, ["source"], ["row"])
    prompts = {r.name: r.prompt for r in dimension(table(spark, d, "courses").select("name", "prompt"))}
    named = marked.join(links.longest_prefix(c, table(spark, d, "courses"), "source", "prefix", ["name"]), "source").withColumnRenamed("name", "course")
    return quality.filtered(named, prompts, ["請訂閱", "字幕由"]).where("reason is not null").select("row", "reason", F.length("dropped").alias("dropped_chars"))


# --- metering -------------------------------------------------------------------------------------------------------------
_LOG = "(SELECT *, try_cast(time AS TIMESTAMPTZ) AS at_, coalesce(cost_usd, 0) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY received_at DESC, rounds DESC, input_tokens DESC) AS n FROM answer_log) WHERE n = 1)"
_DAY = "((at_ AT TIME ZONE 'UTC') + INTERVAL 8 HOUR)::DATE"


@query(f"SELECT model, {_DAY} AS day, count(*) AS questions, round(sum(cost), 6) AS cost, strftime({_DAY}, '%Y-%m') AS month FROM {_LOG} WHERE at_ IS NOT NULL AND NOT isnan(cost) GROUP BY ALL")
def cost_by_day_month(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metering.costs(table(spark, d, "answer_log")), "cost")


@query(f"SELECT log_id, {_DAY} AS day, round(coalesce(sum(cost) OVER (PARTITION BY {_DAY} ORDER BY at_, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent FROM {_LOG} WHERE at_ IS NOT NULL AND NOT isnan(cost)")
def budget_gate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metering.gate(table(spark, d, "answer_log"), 0.15), "spent").drop("open")


@query(f"SELECT CASE WHEN starts_with(model, 'quill-') THEN 'quill' WHEN starts_with(model, 'reed-') THEN 'reed' ELSE 'other' END AS provider, effort, CASE WHEN error_type IS NULL THEN 'ok' WHEN regexp_matches(lower(error_type), 'quota|rate.?limit|429') THEN 'quota' WHEN regexp_matches(lower(error_type), 'timeout|connection|network|unavailable|50[234]') THEN 'network' WHEN error_type = '' THEN 'empty' ELSE 'other' END AS kind, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(avg(rounds), 6) AS mean_rounds FROM {_LOG} GROUP BY ALL")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metering.usage(table(spark, d, "answer_log")), "mean_rounds")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, a ORDER BY i) AS run FROM e), x AS (SELECT * FROM r WHERE a),
s AS (SELECT user_id, run, min(i) AS i FROM x GROUP BY user_id, run
UNION ALL SELECT n.user_id, n.run, min(n.i) FROM s JOIN x p ON p.user_id = s.user_id AND p.i = s.i JOIN x n ON n.user_id = s.user_id AND n.run = s.run AND n.i > s.i AND n.t - p.t >= 21600000000 GROUP BY n.user_id, n.run, s.i)
SELECT x.user_id, x.event_id FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i""")
def alert_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return metering.alerts(e, ["user_id"], "ts", ["event_id"], F.col("event_type") == "error").select("user_id", "event_id")


@query("SELECT log_id, received_at, rounds FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY received_at DESC, rounds DESC, input_tokens DESC) AS n FROM answer_log) WHERE n = 1")
def log_last_received(spark: SparkSession, d: str) -> DataFrame:
    return metering.parsed(table(spark, d, "answer_log")).select("log_id", "received_at", "rounds")


# --- inventory ------------------------------------------------------------------------------------------------------------
@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def inventory_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return inventory.totals(table(spark, d, "documents"), [["lang"], ["source"], []], n=F.count("*"), chars=F.sum("n_chars"))


@query("SELECT source, n_chars, count(*) AS n, min(doc_id) AS \"first\", n_chars * (count(*) - 1) AS extra FROM documents GROUP BY source, n_chars HAVING count(*) > 1")
def probable_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return inventory.probable_duplicates(table(spark, d, "documents"), ["source", "n_chars"], "doc_id", "n_chars")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM documents) WHERE m <= 5 OR list_contains(list_transform(range(0, 5), lambda k: k * (m - 1) // 4), i)")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return inventory.systematic(table(spark, d, "documents"), ["source"], ["doc_id"], 5).select("doc_id")


@query("SELECT CASE WHEN regexp_matches(source, '/\\.[^/]*$|/~\\$') THEN 'hidden' WHEN contains(source, '/舊檔/') THEN 'old' WHEN starts_with(source, '古籍/') THEN 'classics' WHEN starts_with(source, '講座/') OR starts_with(source, '錄音/') THEN 'transcripts' WHEN starts_with(source, '掃描/') THEN 'scans' WHEN starts_with(source, '文件/') THEN 'documents' ELSE 'other' END AS \"group\", lower(regexp_extract(source, '\\.([^./]+)$', 1)) AS suffix, count(*) AS n, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY ALL")
def scope_classes(spark: SparkSession, d: str) -> DataFrame:
    c = inventory.classified(table(spark, d, "chunks")).withColumn("suffix", inventory.suffix(F.col("source")))
    return c.groupBy("group", "suffix").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query("SELECT kind, source, count(*) AS n, count(raw_text) AS with_raw FROM chunks GROUP BY ROLLUP (kind, source)")
def build_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").rollup("kind", "source").agg(F.count("*").alias("n"), F.count("raw_text").alias("with_raw"))


@query("SELECT key FROM cache WHERE key NOT IN (SELECT 'm|64|doc|' || substr(sha1(text), 1, 40) FROM chunks) AND tokens > 0")
def work_missing(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "chunks").select(F.concat(F.lit("m|64|doc|"), F.sha1("text")).alias("key"))
    return table(spark, d, "cache").where("tokens > 0").select("key").join(made, "key", "left_anti")


# --- script, names and numbers --------------------------------------------------------------------------------------------
_SIMPLE, _TRAD = "气阴阳药脉医见现与从后么会开关门问间头来对时说湿", "氣陰陽藥脈醫見現與從後麼會開關門問間頭來對時說濕"
SCRIPTS = script.Scripts(dict(zip(_SIMPLE, _TRAD, strict=True)), dict(zip(_TRAD, _SIMPLE, strict=True)), variants={"溼": "濕"})


@query(f"SELECT \"row\", length(text) - length(translate(text, '{_SIMPLE}', '')) AS simplified, length(text) - length(translate(text, '{_TRAD}', '')) AS traditional FROM chunks")
def script_evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("row", script.evidence(F.col("text"), SCRIPTS).alias("e")).select("row", "e.*")


_SEGMENT = f"CASE WHEN (length(s) > length(translate(s, '{_TRAD}', '')) AND NOT length(s) > length(translate(s, '{_SIMPLE}', ''))) OR (length(s) > length(translate(s, '{_TRAD}', '')) AND length(s) > length(translate(s, '{_SIMPLE}', '')) AND translate(translate(s, '{_TRAD}', '{_SIMPLE}'), '{_SIMPLE}', '{_TRAD}') = s) OR (length(s) = length(translate(s, '{_TRAD}{_SIMPLE}', '')) AND most) THEN s ELSE translate(s, '{_SIMPLE}', '{_TRAD}') END"


@query(f"SELECT \"row\", translate(array_to_string(list_transform(regexp_extract_all(text, '[^\\s\\p{{P}}\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\p{{P}}\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]'), lambda s: {_SEGMENT.replace('most', f'(length(translate(text, {_q(_TRAD)}, {_q(str())})) < length(translate(text, {_q(_SIMPLE)}, {_q(str())})))')}), ''), '溼', '濕') AS made FROM chunks")
def traditional_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("row", script.traditional(F.col("text"), SCRIPTS).alias("made"))


@query("SELECT DISTINCT source, CASE WHEN regexp_matches(t, '[\\p{L}\\p{N}_]') THEN t ELSE f END AS title FROM (SELECT source, regexp_replace(regexp_replace(regexp_replace(regexp_extract(source, '([^/]+)$', 1), '(?i)\\.(?:docx?|html?|txt|pdf|lrc|chm)$', ''), '[0-9]{7}', ''), '^[ \\-_,，]+|[ \\-_,，]+$', '', 'g') AS t, regexp_extract(source, '([^/]+)/[^/]*$', 1) AS f FROM chunks)")
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("source").distinct().select("source", build.clean_title(F.col("source"), ["[0-9]{7}"]).alias("title"))


@query("SELECT DISTINCT source, CASE WHEN contains(source, '筆記') THEN split_part(source, '筆記', 1) || '筆記…/[' || substr(sha1(source), 1, 8) || ']' ELSE source END AS path FROM chunks")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("source").distinct().select("source", build.safe_path(F.col("source"), F.lit(None).cast("string"), "筆記").alias("path"))


@query("SELECT \"row\", concat_ws(' ', nullif(title, ''), nullif(episode, ''), nullif(section, '')) AS made FROM chunks")
def embedding_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("row", build.embedding_title(F.col("title"), F.col("episode"), F.col("section")).alias("made"))


# --- linking, continued ---------------------------------------------------------------------------------------------------
_NUM = "([一二三四五六七八九十百千〇零兩两0-9]{1,7})"


@query(f"SELECT \"row\", count(*) AS entries FROM (SELECT \"row\", unnest(regexp_extract_all(text, '(?m)^\\s*{_NUM}\\s*[、：:]\\s*[「\"“]?(.{{8,}})$', 2)) AS b FROM (SELECT \"row\", concat_ws(chr(10), section || '說明此條的文字在這裡', text) AS text FROM chunks WHERE kind <> 'classic')) WHERE length({s_compact('b')}) >= 8 GROUP BY \"row\"")
def lecture_entries(spark: SparkSession, d: str) -> DataFrame:
    """Numbered lines; the sections of these tables stand for the lines of a lecture."""
    c = table(spark, d, "chunks").where("kind <> 'classic'").withColumn("text", F.concat_ws("\n", F.concat("section", F.lit("說明此條的文字在這裡")), "text"))
    return links.lecture_entries(c).groupBy("row").agg(F.count("*").alias("entries"))


@query()
def book_links(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return links.book_links(c.where("kind = 'classic'"), c.where("kind = 'document'"), c.where("kind = 'transcript'"))


_DOSES = [("a", "每日五錢"), ("b", "每日八錢"), ("c", "每日十錢"), ("d", "八錢")]


@query(f"SELECT DISTINCT k.id AS classic_id, c.id AS target_id, c.kind AS target_kind, 0.9::DOUBLE AS score FROM chunks c JOIN (VALUES {', '.join(map(str, _DOSES))}) k(id, section) ON regexp_matches(c.text, '服法[^一二三四五六七八九十百千〇零0-9]{{0,8}}第?' || k.section) WHERE c.kind <> 'classic'")
def named_sections(spark: SparkSession, d: str) -> DataFrame:
    """A few phrases stand for the sections of a book."""
    return links.named_sections(spark.createDataFrame(_DOSES, "id string, section string"), table(spark, d, "chunks").where("kind <> 'classic'"), "服法")


@query(f"WITH e AS (SELECT {s_compact('text')} AS k, min(doc_id) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) = 1), u AS (SELECT doc_id, {s_compact('text')} AS k FROM documents WHERE text IS NOT NULL) SELECT min(u.doc_id) AS unit, e.n AS number FROM u JOIN e USING (k) WHERE k <> '' GROUP BY e.k, e.n")
def unique_numbers(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return links.unique_numbers(t.select(F.col("doc_id").alias("unit"), "text"), t.select(F.col("doc_id").alias("number"), "text"))


@query("WITH b AS (SELECT title AS book, count(DISTINCT id) AS units FROM chunks WHERE kind = 'classic' GROUP BY 1), o AS (SELECT c.book, l.target_kind AS kind, count(DISTINCT l.classic_id) AS linked FROM classic_links l JOIN (SELECT DISTINCT id, title AS book FROM chunks WHERE kind = 'classic') c ON c.id = l.classic_id GROUP BY ALL), m AS (SELECT title AS book, list_sort(list_distinct(list(u))) AS unlinked FROM (SELECT title, unnest(CAST(unit_ids AS JSON)::VARCHAR[]) AS u FROM chunks WHERE kind = 'classic' AND id NOT IN (SELECT classic_id FROM classic_links)) GROUP BY 1) SELECT book, units, kind, coalesce(linked, 0) AS linked, round(coalesce(linked, 0)::DOUBLE / units, 4) AS rate, array_to_string(coalesce(unlinked, []), ' ') AS unlinked FROM b LEFT JOIN o USING (book) LEFT JOIN m USING (book)")
def link_report(spark: SparkSession, d: str) -> DataFrame:
    return links.link_report(table(spark, d, "classic_links"), table(spark, d, "chunks").where("kind = 'classic'")).withColumn("unlinked", F.array_join("unlinked", " "))


# --- prices and usage -----------------------------------------------------------------------------------------------------
_PRICES = [("quill-3", "2024-01-01", 2.0, 0.1, 2.5, 10.0), ("quill-3", "2024-12-01", 4.0, 0.2, 5.0, 20.0), ("quill-4", "2024-01-01", 1.0, 0.1, 1.0, 5.0)]
_P = ", ".join(str(p) for p in _PRICES)


@query(f"SELECT a.log_id, round((input_tokens * p.input + output_tokens * p.output) / 1e6, 9) AS cost FROM (SELECT *, (at_ AT TIME ZONE 'UTC')::DATE AS day FROM {_LOG} WHERE at_ IS NOT NULL) a ASOF LEFT JOIN (SELECT model, start::DATE AS start, input, output FROM (VALUES {_P}) t(model, start, input, cache_read, cache_write, output)) p ON a.model = p.model AND a.day >= p.start")
def price_asof(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame(_PRICES, "model string, start string, input double, cache_read double, cache_write double, output double").withColumn("start", F.to_date("start"))
    log = metering.parsed(table(spark, d, "answer_log")).where("at is not null").select("log_id", "model", F.to_date("at").alias("day"), F.col("input_tokens").cast("bigint").alias("input_tokens"), F.lit(0).alias("cache_read_tokens"), F.lit(0).alias("cache_write_tokens"), F.col("output_tokens").cast("bigint").alias("output_tokens"))
    return pricing.priced(log, prices).select("log_id", F.round(pricing.cost(), 9).alias("cost"))


@query(f"SELECT CASE WHEN starts_with(model, 'quill-') THEN 'quill' WHEN starts_with(model, 'reed-') THEN 'reed' ELSE 'other' END AS provider, count(*) FILTER ({_DAY} = DATE '2024-11-28') AS today, round(coalesce(sum(cost) FILTER ({_DAY} = DATE '2024-11-28'), 0), 6) AS today_cost, count(*) AS month, round(sum(cost), 6) AS month_cost FROM {_LOG} WHERE at_ IS NOT NULL AND isfinite(cost) AND date_trunc('month', {_DAY}) = DATE '2024-11-01' GROUP BY 1")
def spent_today_month(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pricing.spent(table(spark, d, "answer_log"), "2024-11-27T20:00:00Z"), "today_cost", "month_cost")


@query("SELECT log_id, greatest(input_tokens - output_tokens, 0) + rounds AS input_tokens, output_tokens AS cache_read_tokens, 0 AS cache_write_tokens, 2 * output_tokens AS output_tokens FROM answer_log")
def usage_mapped(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "answer_log")
    return a.select("log_id", *pricing.mapped_usage(F.col("input_tokens"), F.col("output_tokens"), F.col("output_tokens"), F.col("output_tokens"), F.col("rounds")))


# --- work and events ------------------------------------------------------------------------------------------------------
@query("SELECT 'event_type' AS by, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*) FROM events GROUP BY 2")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return control.counts_by(table(spark, d, "events"), ["event_type", "user_id"])


@query("SELECT event_id FROM events ORDER BY user_id, ts, event_id LIMIT 50")
def first_over_all(spark: SparkSession, d: str) -> DataFrame:
    return control.first_over_all(table(spark, d, "events"), ["user_id", "ts", "event_id"], 50).select("event_id")


@query("SELECT user_id::VARCHAR AS label, count(*) AS n FROM events WHERE event_type = 'click' AND value > 5 GROUP BY 1")
def allowed_calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    lines = e.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("label"), F.col("event_type").alias("tool"), (F.col("value") > 5).alias("allow"))).alias("value"))
    return control.allowed_calls(lines.unionByName(spark.createDataFrame([("no JSON",)], "value string")), "click")


@query("SELECT user_id, max(CASE WHEN event_type = 'error' THEN event_id END) IS NOT NULL AS had, coalesce(max(CASE WHEN event_type = 'error' THEN event_id END), 0) + 1 AS attempt FROM events GROUP BY user_id")
def next_attempts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "attempt")
    wrong = e.where("event_type = 'error'")
    return control.next_attempts(wrong, e, ["user_id"]).join(wrong.select("user_id").distinct().withColumn("had", F.lit(True)), "user_id", "left").select("user_id", F.coalesce("had", F.lit(False)).alias("had"), "attempt")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, i FROM e WHERE i = 1 UNION ALL SELECT n.user_id, min(n.i) FROM s JOIN e p ON p.user_id = s.user_id AND p.i = s.i JOIN e n ON n.user_id = s.user_id AND n.i > s.i AND n.t - p.t >= 86400000000 GROUP BY n.user_id, s.i)
SELECT e.user_id, e.event_id FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i""")
def throttled(spark: SparkSession, d: str) -> DataFrame:
    return control.throttled(table(spark, d, "events"), "user_id", "ts", "event_id", 86400)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'UTC' + INTERVAL 8 HOUR)::DATE ORDER BY ts, event_id) AS n FROM events WHERE hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'UTC' + INTERVAL 8 HOUR) >= 9) WHERE n = 1")
def daily_firsts(spark: SparkSession, d: str) -> DataFrame:
    return control.daily_firsts(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], 9).select("user_id", "event_id")


@query("SELECT user_id, event_id, round(max(value) OVER (PARTITION BY user_id, r ORDER BY event_id), 6) AS used, r AS reset FROM (SELECT user_id, event_id, value, floor(epoch_us(ts) / 18000000000) * 18000 AS r FROM events)")
def quota_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("reset", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 18_000_000_000) * 18_000)
    return control.quota_windows(e, "user_id", "event_id", "value", "reset").select("user_id", "event_id", F.round("used", 6).alias("used"), "reset")


# --- building -------------------------------------------------------------------------------------------------------------
@query("SELECT row_number() OVER (ORDER BY part, \"row\") - 1 AS at, part, id FROM (SELECT CASE kind WHEN 'transcript' THEN 0 WHEN 'classic' THEN 1 ELSE 2 END AS part, \"row\", id FROM chunks)")
def emission_order(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select(F.col("row").alias("old"), "id", "kind")
    return build.in_emission_order([c.where(F.col("kind") == k) for k in ("transcript", "classic", "document")], ["old"]).select(F.col("row").alias("at"), "part", "id")


@query(f"SELECT kind AS \"group\", count(DISTINCT source) AS files, count(*) AS paragraphs_before, sum(length(paragraph))::BIGINT AS chars_before, count(*) FILTER (regexp_matches(paragraph, '\\p{{L}}')) AS paragraphs_after, coalesce(sum(length(paragraph)) FILTER (regexp_matches(paragraph, '\\p{{L}}')), 0)::BIGINT AS chars_after, 0 AS dropped_garbage, count(*) FILTER (NOT regexp_matches(paragraph, '\\p{{L}}')) AS dropped_boilerplate, 0 AS dropped_repeated, 0 AS dropped_covered FROM {s_lines('chunks', '\"row\"', 'raw_text')} JOIN (SELECT \"row\", kind, source FROM chunks) USING (\"row\") GROUP BY ROLLUP (kind)")
def group_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    p = dedupe.paragraphs(c, "row", "raw_text").join(c.select("row", F.col("kind").alias("group"), F.col("source").alias("path")), "row")
    return build.group_statistics(p.select("group", "path", F.col("paragraph").alias("text"), F.when(~F.col("paragraph").rlike(r"\p{L}"), "boilerplate").alias("reason")))


@query("WITH k AS (SELECT DISTINCT md5(text) AS m FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0), u AS (SELECT source FROM documents WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT m FROM k)) SELECT '.' || source AS suffix, count(*) AS n, 0 AS same_name FROM u GROUP BY 1")
def unmatched_members(spark: SparkSession, d: str) -> DataFrame:
    """Documents of odd ids stand for an archive's members, those of even ids for the known files."""
    t = table(spark, d, "documents").where("text is not null").select(F.concat_ws("", F.lit("m/"), F.col("doc_id").cast("string"), F.lit("."), "source").alias("path"), F.md5("text").alias("md5"), (F.col("doc_id") % 2 == 0).alias("known"))
    return build.unmatched_by_suffix(t, t.where("known"))


@query("SELECT c.\"row\", list_dot_product(list_transform(v.vec, lambda x: x::DOUBLE), list_transform(v.vec, lambda x: x::DOUBLE)) > 0 AS some FROM (SELECT \"row\", row_number() OVER (ORDER BY \"row\") AS i FROM chunks) c JOIN (SELECT vec, row_number() OVER (ORDER BY key) AS i FROM cache WHERE len(vec) = 64) v USING (i)")
def embedding_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in row order; rows and entries are matched by their places here."""
    number = lambda df, by: build.in_emission_order([df], [by]).withColumnRenamed("row", "key")
    c = number(table(spark, d, "chunks").select(F.col("row").alias("r")), "r").select(F.col("r").alias("row"), "key")
    v = number(table(spark, d, "cache").where("size(vec) = 64").select(F.col("key").alias("k"), "vec"), "k").select("key", "vec")
    out = build.embedding_matrix(c.join(v, "key", "left_semi"), v)
    return out.select("row", (V.norm(F.col("vec")) > 0).alias("some"))


@query("SELECT key, (floor(coalesce(sum(w) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS batch FROM (SELECT key, greatest(tokens / 20000.0::DOUBLE, 1 / 128.0::DOUBLE) AS w FROM cache WHERE truncated = 0)")
def request_batches(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cache")
    return build.request_batches(c.withColumn("o", F.col("key")), c.where("truncated <> 0"), order="o", items=128).select("key", "batch")


# --- pages and speech -----------------------------------------------------------------------------------------------------
@query("SELECT user_id, count(*) AS kept FROM (SELECT a.user_id, a.event_id FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.event_id < a.event_id AND abs(b.value - a.value) <= 1.5 AND abs(epoch_us(b.ts) - epoch_us(a.ts)) / 3600000000.0 <= 1.5)) GROUP BY 1")
def without_overprint(spark: SparkSession, d: str) -> DataFrame:
    """Events stand for glyphs: their kind for the character, value and hours for the place."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("n"), F.col("event_type").alias("char"), F.col("value").alias("x"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("y"))
    return pages.without_overprint(e, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("kept"))


@query()
def clip_summary(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts against their raw text as the reference, a clip each, by two settings of which one has no results."""
    c = table(spark, d, "chunks").where("kind = 'transcript' and raw_text is not null")
    clips = c.select(F.col("row").cast("string").alias("label"), "source")
    results = c.select(F.col("row").cast("string").alias("label"), F.lit("one").alias("setting"), F.col("text").alias("hypothesis"), F.lit(1).alias("segments"), F.lit(0).alias("low_confidence"), F.lit(1.0).alias("elapsed"), (F.col("end") - F.col("start")).alias("audio"))
    references = c.select(F.col("row").cast("string").alias("label"), F.col("raw_text").alias("reference"))
    words = [r.key for r in dimension(scoring.term_keys(table(spark, d, "courses").select(F.explode("hotwords").alias("term")))[0])]
    scores = scoring.clip_scores(scoring.grid(clips, ["one", "two"], results, references), words)
    return rounded(scoring.summary(scores), "cer", "term_recall", "mean_rtf", "low_confidence")


# --- layout, numerals, streams --------------------------------------------------------------------------------------------
_DIGITS = "一二三四五六七八九"
_COUNTED = [((_DIGITS[t - 1] if t > 1 else "") + ("十" if t else "") + (_DIGITS[o - 1] if o else ""), 10 * t + o) for t in range(10) for o in range(10) if t + o]


@query(f"SELECT \"row\", n AS number FROM chunks JOIN (VALUES {', '.join(map(str, _COUNTED))}) v(w, n) ON w = split_part(section, '、', 1) WHERE section LIKE '%、%'")
def section_numbers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("section like '%、%'")
    return c.select("row", numerals.number_of(F.substring_index("section", "、", 1)).alias("number")).where("number is not null")


@query("SELECT log_id, received_at FROM (SELECT *, row_number() OVER (PARTITION BY effort ORDER BY received_at DESC) AS n FROM answer_log) WHERE n <= 50")
def newest_logs(spark: SparkSession, d: str) -> DataFrame:
    return layout.newest(table(spark, d, "answer_log"), ["effort"], "received_at", 50)[0].select("log_id", "received_at")


@query("SELECT doc_id, CASE WHEN n <= 9000 - before THEN text ELSE substr(text, 1, greatest(9000 - before - 1, 0)::INT) || '…' END AS text FROM (SELECT doc_id, text, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE text IS NOT NULL) WHERE before < 9000")
def capped_texts(spark: SparkSession, d: str) -> DataFrame:
    return layout.capped_output(table(spark, d, "documents").where("text is not null"), ["source"], ["doc_id"], "text", 9000).select("doc_id", "text")


@query("SELECT source, round(sum(greatest(coalesce(next, \"end\") - start, 0)) / 3600, 6) AS hours FROM (SELECT source, start, \"end\", lead(start) OVER (PARTITION BY source ORDER BY start) AS next FROM chunks WHERE start IS NOT NULL AND \"end\" IS NOT NULL) GROUP BY source")
def audio_hours(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("start is not null and `end` is not null")
    return rounded(layout.audio_hours(c, ["source"]).groupBy("source").agg(F.sum("hours").alias("hours")), "hours")


@query("WITH s AS (SELECT event_id, user_id, ts::DATE AS page, {'t': regexp_replace(event_type, '[0-9]+', '#', 'g'), 'x': floor(value / 40 / 6), 'y': 0} AS shape FROM events), p AS (SELECT user_id, count(DISTINCT page) AS pages FROM s GROUP BY 1), o AS (SELECT user_id, shape FROM s JOIN p USING (user_id) GROUP BY user_id, shape, pages HAVING count(DISTINCT page) >= greatest(3, pages * 0.3)) SELECT event_id FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = s.user_id AND o.shape = s.shape)")
def page_furniture(spark: SparkSession, d: str) -> DataFrame:
    """Events stand for spans: users for documents, days for pages."""
    e = table(spark, d, "events").select("event_id", "user_id", F.to_date(F.col("ts").cast("timestamp")).alias("page"), (F.col("value") / 40).alias("x"), F.lit(0.0).alias("y"), F.col("event_type").alias("text"))
    return layout.furniture(e, ["user_id"]).select("event_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY <= (SELECT max(ts)::TIMESTAMP - INTERVAL 1 HOUR FROM events) GROUP BY ALL")
def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, counted by days as they close."""
    kind = table(spark, d, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = shared_folder(spark)
    counts = monitor.sliding_counts(stream, size="1 day", step="1 day")
    counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state").option("path", out).trigger(availableNow=True).start().awaitTermination()
    for folder in (out, f"{out}-state"):
        until_exit(spark, folder)
    closed = spark.read.schema("span struct<start: timestamp, `end`: timestamp>, event_type string, n bigint").parquet(out)
    return closed.select(F.col("span.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query()
def classic_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("kind = 'classic'")
    return chunking.classic_chunks(c.select(F.col("source").alias("book"), F.col("row").alias("ordinal"), F.col("id").alias("unit"), "section", F.lit(None).cast("int").alias("number"), "text"))

"""Operators of script, prices, pages, scoring, control and building, over small frames."""

import json
import random
import time
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from quillspark.functions import script
from quillspark.operators import build, chunking, control, layout, links, pages, pricing, quality, scoring, search, windows
from quillspark.sources import shared

SCRIPTS = script.Scripts(dict(zip("气药里干斗", "氣藥裡乾鬥", strict=True)), dict(zip("氣藥裡乾鬥", "气药里干斗", strict=True)), {"裡": "裏"}, {"通里": "通里", "干姜": "乾薑"}, {"裏面": "裡面"})


def test_script(spark, tmp_path):
    convert = script.converter(SCRIPTS)
    assert convert("通里、干姜，气里") == "通里、乾薑，氣裏"
    assert convert("藥裡，里") == "藥裏，裏" and convert("藥裡，無") == "藥裏，無"
    assert convert("药，里面") == "藥，裡面" and convert("溼") == "濕" and convert("") == ""
    df = spark.createDataFrame([("药氣干",), (None,), ("",)], "t string")
    assert [tuple(r.e) if r.t is not None else None for r in df.select("t", script.evidence(F.col("t"), SCRIPTS).alias("e")).collect()] == [(2, 1), None, (0, 0)]
    assert [r.x for r in df.select(script.traditional(F.col("t"), SCRIPTS).alias("x")).collect()] == ["藥氣乾", None, ""]
    assert [r.x for r in df.select(script.search_form(F.col("t"), SCRIPTS).alias("x")).collect()] == ["药气干", None, ""]
    path = tmp_path / "t.tsv"
    path.write_text("# x\n太冲\t太衝\t穴\n", encoding="utf-8")
    assert script.read_table(str(path)) == {"太冲": "太衝"}
    path.write_text("太冲\t太衝\t穴\n太冲\t太衝\t穴\n", encoding="utf-8")
    with pytest.raises(ValueError):
        script.read_table(str(path))


def test_prices(spark):
    prices = spark.createDataFrame([("m", 1.0, 0.1, 1.0, 2.0), ("n", 2.0, 0.2, 2.0, 4.0)], "model string, input double, cache_read double, cache_write double, output double")
    over = spark.createDataFrame([("n", 9.0, 9.0, 9.0, 9.0)], prices.schema)
    assert {r.model: r.input for r in pricing.overlaid(prices, over).collect()} == {"m": 1.0, "n": 9.0}
    with pytest.raises(Exception, match="no price"):
        pricing.overlaid(prices, spark.createDataFrame([("n", None, 9.0, 9.0, 9.0)], prices.schema)).collect()
    use = "struct<input_tokens: bigint, cache_read_tokens: bigint, cache_write_tokens: bigint, output_tokens: bigint>"
    rows = [(1, "m", "m", (1_000_000, 0, 0, 0), None), (2, "m", "n", (5, 0, 0, 0), [("message", "m", (1_000_000, 0, 0, 0)), ("fallback_message", "n", (0, 0, 0, 1_000_000)), ("tool", "n", (7, 7, 7, 7))]), (3, "m", "unknown", (1_000_000, None, 0, 0), [])]
    requests = spark.createDataFrame(rows, f"id int, requested string, model string, usage {use}, iterations array<struct<type: string, model: string, usage: {use}>>")
    out = {r.id: (r.cost, r.input_tokens, r.estimated) for r in pricing.request_costs(requests, prices).collect()}
    assert out == {1: (1.0, 1_000_000, 0), 2: (5.0, 1_000_000, 0), 3: (1.0, 1_000_000, 1)}
    dated = prices.withColumn("start", F.lit(date(2024, 1, 1)))
    days = spark.createDataFrame([("m", date(2023, 1, 1)), ("m", date(2024, 1, 1))], "model string, day date")
    assert sorted((str(r.day), r.input) for r in pricing.priced(days, dated).collect()) == [("2023-01-01", None), ("2024-01-01", 1.0)]


def test_overprint_equals_sequence(spark):
    rng = random.Random(3)
    glyphs = [(i, rng.choice("ab "), rng.uniform(0, 12), rng.uniform(0, 6)) for i in range(120)]
    want = [i for i, c, x, y in glyphs if c == " " or not any(k < i and d == c and abs(u - x) <= 1.5 and abs(v - y) <= 1.5 for k, d, u, v in glyphs)]
    df = spark.createDataFrame([("d", 1, *g) for g in glyphs], "doc string, page int, n int, char string, x double, y double")
    assert sorted(r.n for r in pages.without_overprint(df).collect()) == want


def test_page_of_two_columns(spark):
    spans = [("d", 1, 400.0, 20.0 + 220 * c, 10.0 + 20 * i, 20.0 + 220 * c + w, 20.0 + 20 * i, t) for c, lines in enumerate([[(150, "甲一"), (150, "甲二"), (60, "甲三。"), (150, "甲四")], [(150, "乙一"), (150, "乙二"), (150, "乙三")]]) for i, (w, t) in enumerate(lines)]
    spans += [("d", p, 400.0, 10.0, 700.0, 60.0, 710.0, f"第 {p} 頁") for p in range(1, 5)]
    df = spark.createDataFrame(spans, "doc string, page int, width double, x0 double, y0 double, x1 double, y1 double, text string")
    out = [r.paragraph for r in pages.read(df).orderBy("page", "column", "at").collect()]
    assert out == ["甲一甲二甲三。", "甲四", "乙一乙二乙三"]


def test_speech_scores(spark):
    clips = spark.createDataFrame([("a", "s/x"), ("b", "s/y")], "label string, source string")
    results = spark.createDataFrame([("a", "one", "嗯桂枝湯三錢", 2, 1, 3.0, 6.0)], "label string, setting string, hypothesis string, segments int, low_confidence int, elapsed double, audio double")
    references = spark.createDataFrame([("a", "桂枝湯5錢，桂枝")], "label string, reference string")
    scores = scoring.clip_scores(scoring.grid(clips, ["one", "two"], results, references), ["桂枝湯", "桂枝"])
    assert scores.count() == 4 and scores.where("chars is null").count() == 3
    r = scores.where("chars is not null").first()
    assert (r.substitutions, r.deletions, r.insertions, r.chars, r.term_reference, r.term_matched) == (1, 2, 0, 7, 2, 1) and r.missed == {"桂枝": 1}
    s = scoring.summary(scores).first()
    assert (s.clips, round(s.cer, 4), s.mean_rtf, s.low_confidence) == (1, round(3 / 7, 4), 0.5, 0.5)
    assert [(m.term, m.n) for m in scoring.missed_terms(scores).collect()] == [("桂枝", 1)]
    keys, skipped = scoring.term_keys(spark.createDataFrame([("呃逆",), ("桂枝",)], "term string"))
    assert [k.key for k in keys.collect()] == ["桂枝"] and [x.term for x in skipped.collect()] == ["呃逆"]
    seg = spark.createDataFrame([(0.0, 2.0, 1.0, 3.0), (0.0, 1.9, 1.0, 3.0), (3.0, 5.0, 1.0, 3.0)], "start double, end double, s double, d double")
    assert scoring.inside(seg, "s", "d").count() == 1


def test_edits_equal_brute_force():
    rng = random.Random(8)
    for _ in range(80):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
        s, gone, new = quality.edits(a, b)
        assert s + gone + new == d[-1][-1] and len(b) - len(a) == new - gone


def test_control(spark):
    wanted = spark.createDataFrame([("d", 1, i, "x", f"t{i}") for i in range(3)] + [("d", 2, 0, "x", "u")], "doc string, piece int, line int, digest string, text string")
    done = wanted.where("piece = 1 or line > 5").withColumn("status", F.lit("ok"))
    assert [r.piece for r in control.reusable(wanted, done, ["doc", "piece"], ["digest"], ["text"]).collect()] == [1]
    assert control.reusable(wanted, done.where("line < 2"), ["doc", "piece"], ["digest"], ["text"]).count() == 0
    two = wanted.withColumn("text", F.when(F.col("line") == 1, "other").otherwise(F.col("text")))
    bad = control.first_mismatch(wanted.where("piece = 1"), two.where("piece = 1"), "doc", "line", ["text"]).first()
    assert (bad["at"], bad.reason) == (1, "text")
    q = spark.createDataFrame([("k", i, u, r) for i, (u, r) in enumerate([(10.0, 1000.0), (30.0, 1030.0), (20.0, 990.0), (5.0, 900.0), (1.0, 2000.0)])], "k string, i int, u double, r double")
    assert [(r.used, r.reset) for r in control.quota_windows(q, "k", "i", "u", "r").orderBy("i").collect()] == [(10.0, 1000.0), (30.0, 1030.0), (30.0, 1030.0), (30.0, 1030.0), (1.0, 2000.0)]
    f = spark.createDataFrame([("k", i, n) for i, n in enumerate([0, 1, 3, 4, 4, 6, 7, 8])], "k string, i int, failed int")
    assert [(r.i, r.grown) for r in control.failure_growth(f, "k", "i", "failed").orderBy("i").collect()] == [(2, 3), (6, 3)]
    now = datetime(2024, 1, 1, 12)
    s = spark.createDataFrame([("running", now - timedelta(minutes=46), now - timedelta(minutes=50), None), ("running", now - timedelta(minutes=46), now - timedelta(minutes=45), None), ("paused", now, now, now - timedelta(minutes=31))], "state string, updated timestamp, progress timestamp, until timestamp").coalesce(1)
    assert [r.x for r in s.select(control.stale(F.col("state"), F.lit(now), F.col("updated"), F.col("progress"), F.col("until")).alias("x")).collect()] == ["stuck", None, "overdue"]
    lines = [{"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "1", "name": "S"}, {"type": "tool_use", "id": "2", "name": "S"}, {"type": "tool_use", "id": "3", "name": "T"}]}}, {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "2", "is_error": True}]}}, {"type": "result", "subtype": "success", "is_error": False, "result": "done", "usage": {"input_tokens": 5, "output_tokens": 7}}]
    log = spark.createDataFrame([("r", i, json.dumps(x)) for i, x in enumerate(lines)] + [("r", 9, "noise"), ("q", 0, json.dumps(lines[0]))], "run string, i int, value string")
    out = {r.run: (r.output, r.searches, r.denied, r.other_tools, r.input_tokens) for r in control.rolled_up(log, "run", "i", "S").collect()}
    assert out == {"r": ("done", 1, 1, 1, 5), "q": ("", 2, 0, 1, None)}


def test_building(spark):
    blocks = spark.createDataFrame([("a", i, t) for i, t in enumerate(["thinking", "text", "fallback", "thinking", "text"])] + [("b", 0, "thinking")], "k string, i int, type string")
    assert [(r.k, r.i) for r in build.history_blocks(blocks, "k", "i").orderBy("k", "i").collect()] == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 0)]
    seg = spark.createDataFrame([(-1.0, 2.0, " a ", 10.0, 5.0), (9.0, 20.0, "b", 10.0, None), (1.0, 2.0, " ", 10.0, None)], "start double, end double, text_raw string, duration double, off double")
    assert [(r.text_raw, r.start, r.end) for r in build.clamped(seg, "duration", "off").orderBy("text_raw").collect()] == [("a", 5.0, 7.0), ("b", 9.0, 10.0)]
    e = spark.createDataFrame([("x", "p"), ("x", "p"), ("y", "p"), ("y", "q"), ("z", None)], "d string, engine string")
    assert {r.d: r.engine for r in build.engine_label(e, "d", "none").collect()} == {"x": "p", "y": "mixed", "z": "none"}
    t = spark.createDataFrame([(1, "見（編號 abcd）與（編號 beef）"), (2, None)], "k int, text string")
    ids = spark.createDataFrame([("abcd01",), ("beef01",), ("beef02",)], "id string")
    assert {r.k: r.linked for r in build.linked_codes(t, ids, "k", "text").collect()} == {1: "見 /s_abcd與（編號 beef）", 2: None}
    cites = spark.createDataFrame([("《甲》", "1", "桂枝湯方", "aa"), ("《甲》上", "2", "x", "bb"), ("《乙》", "3", "麻黃", "cc"), ("《乙》", "4", "葛根", "dd")], "base string, id string, text string, code string")
    answers = spark.createDataFrame([("q1", "見《甲》上。又《甲》（編號 aa）"), ("q2", "「葛根」見《乙》。"), ("q3", "見《乙》")], "answer string, text string")
    assert sorted((r.answer, r.code) for r in build.cited_answers(answers, cites).collect()) == [("q1", "bb"), ("q2", "dd")]
    m = spark.createDataFrame([("a/b/x.mp4", "video", "12.5"), ("y.mp4", "video", "nan"), ("z.mp4", "video", "3"), ("t.txt", "document", "3")], "path string, category string, duration_sec string")
    assert sorted((r.group, r.path, r.duration) for r in build.frame_groups(m, 1).collect()) == [(".", "z.mp4", 3.0), ("a", "a/b/x.mp4", 12.5)]
    files = spark.createDataFrame([("b", "g1", False, True), ("a", "g2", False, False), ("c", "g1", True, False), ("d", "g1", False, False)], "path string, group string, repaired boolean, nested boolean")
    groups = spark.createDataFrame([("g1", 1), ("g2", 2)], "group string, priority int")
    assert [r.path for r in build.document_order(files, groups).orderBy("at").collect()] == ["d", "b", "a", "c"]
    p = spark.createDataFrame([("k", 2, "2.0", "乙"), ("k", 1, "1.0", "甲")], "k string, i int, label string, text string")
    assert build.prompts(p, ["k"], "i", F.lit("頭")).first().prompt == "頭\n\n[1.0] 甲\n[2.0] 乙"


def test_totals_before_equal_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, n int")
    got = {r.i: r.t for r in windows.totals_before(df, ["k"], ["i"], F.col("n"), "t").collect()}
    want, run = {}, {}
    for k, i, n in rows:
        want[i] = run.get(k, 0)
        run[k] = want[i] + n
    assert got == want


def test_islands_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(search, "BUCKET", 4)
    rng = random.Random(6)
    keys = sorted(rng.sample(range(60), 50))
    rows, source = [], "a"
    for k in keys:
        source = rng.choice("abc") if rng.random() < 0.2 else source
        rows.append((k, source))
    first, want = None, {}
    for i, (k, s) in enumerate(rows):
        first = first if i and rows[i - 1] == (k - 1, s) else k
        want[k] = first
    df = spark.createDataFrame(rows, "row long, source string")
    assert {r.row: r.island for r in search.islands(df).collect()} == want


def test_index_equals_scan(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["document", "classic"]), "".join(rng.choice("甲乙丙丁 ab1") for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(99, "classic", None)]
    df = spark.createDataFrame(rows, "row long, kind string, text string")
    search.write_index(df, str(tmp_path / "i"), parts=4)
    index = search.open_index(spark, str(tmp_path / "i"))
    for question, kind in (("甲乙丙", None), ("丁", "classic"), ("ab 乙", None), ("，", None)):
        a = [(r.row, round(r.score, 9)) for r in search.bm25_indexed(index, question, kind).collect()]
        assert a == [(r.row, round(r.score, 9)) for r in search.bm25(df, question, kind=kind).collect()]
    plan = search.bm25_indexed(index, "甲乙")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan and "In(term" in plan.replace("EqualTo(term", "In(term")


def test_containment_both_ways(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("甲乙丙丁戊己") for _ in range(rng.randint(0, 14))) for _ in range(50)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    for t in (0.38, 0.8):
        one, two = ({(r.a, r.b, round(r.score, 9)) for r in links.containment_join(df, df, t, "row", "row", most=m).collect()} for m in (0, 10**6))
        assert one == two


def test_sections_and_cases(spark):
    long = "第一層名 " + "第二層的名字很長很長很長很長很長"
    rows = [("一二（甲", "一二甲"), ("（甲）乙」】", "（甲）乙」"), ("總論 （1-01:02:03）", "總論"), ("三：太陽之為病脈浮頭項強痛而惡寒", "三：太陽之為病脈浮頭項強…"), (long, "第一層名 第二層的名字很長很長很長很長很…"), ("這一層的名字超過了十個字 短的", "這一層的名字超過了十個字 短的"), (None, "")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, s string")
    assert [r.x for r in df.orderBy("i").select(layout.short_section(F.col("s")).alias("x")).collect()] == [b for _, b in rows]
    case = spark.createDataFrame([("id000001", "document", "王小明20060615-2-頭痛", None, None, None, None, None, None, None)], "id string, kind string, title string, episode string, section string, page_start int, page_end int, start double, end double, date string")
    assert search.citation(case, spark.createDataFrame([("id000001", "id0000")], "id string, short string")).first().cited == "醫案 2006-06-15 頭痛（編號 id0000）"


def test_document_chunks_follow_pages_and_dates(spark):
    lines = [(1, 1, "第一章 甲 2020年3月4日"), (1, 2, "開頭。")] + [(1 + i // 3, 3 + i, f"{i}" + "文" * 150 + "。") for i in range(8)] + [(9, 20, "第二章 乙"), (9, 21, "短句。")]
    df = spark.createDataFrame([("d", p, i, t) for p, i, t in lines], "doc string, page int, i int, paragraph string")
    out = chunking.paragraph_chunks(df, "doc", ["i"], page="page").orderBy("n").collect()
    assert out[0].section == "第一章 甲 2020年3月4日" and {r.date for r in out} == {"2020-03-04"} and out[0].page_start == 1 and out[-1].page_end == 9 and all(r.chars <= 700 for r in out)
    assert "".join(r.text for r in out).replace("\n", "") == "".join(t for _, _, t in lines)
    same = spark.createDataFrame([("d", "\n".join(t for _, _, t in lines))], "doc_id string, text string")
    assert [r.text for r in chunking.document_chunks(same).orderBy("n").collect()] == [r.text for r in out]


def test_alerts_wait_from_the_last_one(spark):
    from quillspark.operators import metering

    hours = [0, 7, 12, 13, 13.5]
    df = spark.createDataFrame([("k", i, datetime(2024, 1, 1) + timedelta(hours=h)) for i, h in enumerate(hours)], "k string, n int, ts timestamp")
    assert [r.n for r in metering.alerts(df, ["k"], "ts", ["n"], F.lit(True)).orderBy("n").collect()] == [0, 1, 3]


def test_term_links_by_the_passage_before(spark):
    classics = spark.createDataFrame([("c1", "本草", "卷一 桂枝", "桂枝味辛溫")], "id string, title string, section string, text string")
    rows = [(1, "t1", "document", "s", "一、桂枝"), (2, "t2", "document", "s", "這一味藥很溫。"), (3, "t3", "document", "s", "別的話")]
    targets = spark.createDataFrame(rows, "row long, id string, kind string, source string, text string").withColumn("section", F.lit(None).cast("string"))
    terms = spark.createDataFrame([("桂枝", "桂枝")], "term string, alias string")
    assert {r.target_id for r in links.term_links(classics, targets, terms).collect()} == {"t1"}
    assert {r.target_id for r in links.term_links(classics, targets, terms, strict=F.col("book") == "本草").collect()} == {"t1", "t2"}


def test_lectures_and_numbers(spark):
    classics = spark.createDataFrame([(1, "c1", "b", "太陽之為病脈浮頭項強痛而惡寒"), (2, "c2", "b", "太陽病發熱汗出惡風脈緩者名為中風")], "row long, id string, source string, text string")
    lectures = spark.createDataFrame([(10, "l1", "一、太陽之為病脈浮頭項強痛而惡寒\n說明的話\n二、太陽病發熱汗出惡風脈緩者名為中風\n三、短")], "row long, id string, text string")
    out = links.numbered_links(classics, lectures).orderBy("classic_id").collect()
    assert [(r.classic_id, r.target_id, r.lecture_number, r.score) for r in out] == [("c1", "l1", "1", 1.0), ("c2", "l1", "2", 1.0)]
    units = spark.createDataFrame([(1, "甲乙"), (2, "甲，乙"), (3, "丙")], "unit int, text string")
    entries = spark.createDataFrame([(7, "甲乙。"), (8, "丙"), (9, "丙")], "number int, text string")
    assert [(r.unit, r.number) for r in links.unique_numbers(units, entries).collect()] == [(1, 7)]


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                class C:
                    get = staticmethod(lambda *_: None)

                return C

    with pytest.raises(ValueError):
        shared.shared_folder(Session)


def test_paragraph_rounds_are_bounded(spark):
    from quillspark.operators import dedupe

    df = spark.createDataFrame([(1, 0, "這是一個很長的句子甲乙丙丁")], "doc_id long, at int, paragraph string")
    with pytest.raises(RuntimeError):
        dedupe.kept_paragraphs(df, ["doc_id", "at"], most=0)
    assert dedupe.kept_paragraphs(df, ["doc_id", "at"]).count() == 1


def test_corrected_documents(spark, tmp_path):
    seg = {"start": 0.0, "end": 1.0, "text_raw": "a", "text": "b", "text_asr": "a", "corrected": True, "speaker": None, "confidence": None, "low_confidence": False}
    piece = {"start": 0.0, "end": 9.0, "status": "ok", "attempts": 1, "searches": 0, "fallback_lines": 0, "engine": "e"}
    doc = {"schema": "c/1", "source": "s", "clip": None, "duration_sec": 2.0, "engine": {}, "created_at": "", "segments": [seg, {**seg, "start": 5.0, "end": 6.0, "corrected": False, "text": "a"}], "dropped": [], "correction": {"chunks": [piece, {**piece, "start": 4.0}]}}
    bad = {**doc, "segments": [{**seg, "corrected": False}], "correction": {"chunks": [{**piece, "status": "?", "attempts": -1}]}}
    raw = spark.createDataFrame([(json.dumps(doc),), (json.dumps(bad),), ("[]",)], "value string").coalesce(1)
    assert [len(r.problems) for r in quality.corrected_problems(raw).collect()] == [0, 3, 1]
    from quillspark.sources import files, sinks

    with pytest.raises(ValueError):
        sinks.checked_documents(raw, str(tmp_path / "out"), quality.corrected_problems)
    assert not (tmp_path / "out").exists()
    sinks.checked_documents(raw.limit(1), str(tmp_path / "out"), quality.corrected_problems)
    assert [(r.at, r.piece, r.corrected) for r in files.corrected(spark, str(tmp_path / "out")).orderBy("at").collect()] == [(0, 1, True), (1, 2, False)]
    replies = spark.createDataFrame([(1, "[1.0] 甲\n[2.0] 乙", ["1.0", "2.5"]), (2, None, ["1.0"])], "k int, output string, labels array<string>")
    assert [(r.k, r.label, r.line) for r in quality.aligned_lines(replies, ["k"]).orderBy("k", "at").collect()] == [(1, "1.0", "甲"), (1, "2.5", "乙"), (2, "1.0", None)]


def test_context_classics_and_glosses(spark):
    w = spark.createDataFrame([("s", 1, 0.0, 100.0), ("s", 2, 120.0, 200.0)], "key string, window int, first double, last double")
    seg = spark.createDataFrame([("s", 10.0, 20.0, "a"), ("s", 90.0, 100.0, "b"), ("s", 120.0, 130.0, "c"), ("s", 170.0, 200.0, "d"), ("s", 261.0, 270.0, "e")], "key string, start double, end double, text string")
    assert sorted((r.window, r.side, r.text) for r in chunking.window_context(w, seg).collect()) == [(1, "after", "c"), (2, "before", "b")]
    units = spark.createDataFrame([("b", i, f"u{i}", s, n, t) for i, (s, n, t) in enumerate([("一", None, "甲。"), ("一", None, "乙。"), ("一", 3, "條文。"), ("二", None, "丙" * 400 + "。" + "丁" * 400 + "。")])], "book string, ordinal int, unit string, section string, number int, text string")
    assert [(r.text[:2], r.chars, r.units, r.number) for r in chunking.classic_chunks(units).orderBy("n").collect()] == [("甲。", 4, ["u0", "u1"], None), ("條文", 3, ["u2"], 3), ("丙丙", 401, ["u3"], None), ("丁丁", 401, ["u3"], None)]
    g = spark.createDataFrame([("b", i, t) for i, t in enumerate(["上古天真論：憺（音淡）怕（普白切）", "恬（徒兼切）", "正文（註）一句。", "恬（徒兼切）"])], "book string, ordinal int, text string")
    assert [r.gloss for r in chunking.pronunciation_glosses(g).orderBy("ordinal").collect()] == [True, True, False, False]


def test_names_data_and_arguments(spark):
    name = "桂枝湯"
    wrong = name.encode("big5").decode("gb18030", "replace")
    assert "\ufffd" in wrong or layout.repaired_part(wrong) == name
    assert layout.repaired_part("plain.doc") == "plain.doc"
    p = spark.createDataFrame([("x/ok/a.txt",), (None,)], "p string")
    assert [r.q for r in p.select(layout.repaired_paths(F.col("p"), "garbled").alias("q")).collect()] == ["x/ok/a.txt", None]
    data = spark.createDataFrame([(bytearray("這是一段夠長的文字。\r".encode("utf-16-le")),), (None,)], "d binary").coalesce(1)
    assert [r.p for r in data.select(layout.word_paragraphs(F.col("d")).alias("p")).collect()] == [["這是一段夠長的文字。"], []]
    spec = {"query": (str, 1, 9, None), "k": (int, 1, 20, 8)}
    assert control.arguments(spec, {"query": " 甲 "}) == {"query": "甲", "k": 8}
    for bad in ({"query": ""}, {"query": "a", "k": 0}, {"query": "a", "k": True}, {"query": "a", "x": 1}, [], {}):
        with pytest.raises(ValueError):
            control.arguments(spec, bad)


def test_status_streams(spark, tmp_path):
    from quillspark.streaming import monitor

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text('{"key": "k", "ts": "2024-01-01T00:30:00Z"}\nnot JSON\n{"key": "k", "ts": "2024-01-01T05:00:00Z"}\n{"key": "k", "ts": "2024-01-02T05:00:00Z"}\n')
    some = monitor.snapshots(monitor.tail(spark, str(folder)), "key string, ts timestamp")
    assert monitor.to_memory(some, "snaps").where("not readable").count() == 1
    daily = monitor.daily_summaries(some.where("readable"), 9)
    assert sorted((r.day, f"{r.ts:%d %H}") for r in monitor.to_memory(daily, "days").collect()) == [("2024-01-01", "01 05"), ("2024-01-02", "02 05")]


def test_small_rules(spark):
    from quillspark.functions import text as X
    from quillspark.operators import inventory, metering
    from quillspark.sources import files

    units = spark.createDataFrame([("v", ["a", "b"]), ("v", []), ("w", None)], "volume string, annotations array<string>")
    assert {r.volume: r.n for r in build.annotations_by_volume(units).collect()} == {"v": 2, "w": 0}
    seg = spark.createDataFrame([([("改", "聽", True)],)], "s array<struct<text: string, text_asr: string, corrected: boolean>>").select(build.base_segments(F.col("s")).alias("s"))
    assert [r.asDict() for r in seg.first().s] == [{"text": "聽"}]
    one = spark.createDataFrame([("甲乙 �丙",)], "t string")
    assert one.select(X.clean_extracted(F.col("t")).alias("x")).first().x == "甲 乙 丙→"
    assert one.select(script.display(F.lit("溼芪")).alias("x")).first().x == "濕耆"
    f = spark.createDataFrame([("a.mp4", "video", 2 << 20), ("b.mp4", "video", 2 << 20), ("c.zip", "archive", 2 << 20), ("d.zip", "archive", 2 << 20), ("e.mp4", "video", 5), ("f.mp4", "video", 5)], "path string, category string, size long")
    assert [(r.n, r.first, r.extra) for r in inventory.duplicate_files(f).collect()] == [(2, "a.mp4", 2 << 20)]
    names = spark.createDataFrame([("第三講240131.lrc", bytearray.fromhex("D0CF11E0A1"))], "n string, head binary")
    episode, day = inventory.episode_and_date(F.col("n"))
    assert tuple(names.select(episode, day, inventory.file_format(F.col("n"), F.col("head")), build.folder_group(F.col("n"), [("講", "talks")], "rest")).first()) == ("第三講", "2024-01-31", "doc", "talks")
    log = spark.createDataFrame([("key=abcdefgh12",)], "question string")
    assert build.redacted_log(log, ["question"]).first().question == "key=***"
    ref = spark.createDataFrame([("# 註",), ("[00:01]甲",), ("",)], "value string")
    assert [r.text for r in files.reference_text(ref).collect()] == ["甲"]
    speed = metering.progress(spark.createDataFrame([("k", 2.0, 1.0), ("k", 4.0, 2.0)], "k string, d double, w double"), ["k"], F.col("d"), F.col("w"))
    r = metering.remaining(speed, F.lit(10.0)).first()
    assert (r["items"], r.speed, r.eta_hours) == (2, 2.0, 5.0)
    new = build.to_extract(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "path string, md5 string"), spark.createDataFrame([("y",)], "md5 string"))
    assert [r.md5 for r in new.collect()] == ["x"]
    courses = spark.createDataFrame([("s/", "short"), ("s/x", "long")], "prefix string, name string")
    clips = spark.createDataFrame([("s/x/1",), ("s/y",), ("t",)], "source string")
    assert {r.source: r.course for r in scoring.with_course(clips, courses, "none").collect()} == {"s/x/1": "long", "s/y": "short", "t": "none"}
    assert chunking.classic_units([("一", "甲。", None), ("一", "乙。", 3), ("一", "丙。", None)]) == ["甲。", "乙。", "丙。"]
    cites = layout.citation_map(spark.createDataFrame([("b", "1", "x"), ("b", "2", "y")], "base string, id string, text string")).first()
    assert cites.texts == {"1": "x", "2": "y"}


def test_term_links_of_many_passages_of_one_term(spark, monkeypatch):
    """Every passage of a term meets every classic of it: as rows with the pairs of characters of both sides that took minutes."""
    rng = random.Random(6)
    write = lambda n: "".join(rng.choices("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥", k=n))
    units = [(f"c{i}", "本", "卷一、桂枝", write(130)) for i in range(300)]
    rows = []
    for i in range(3000):
        head = ["", "三、", "桂枝 "][i % 3]
        text = f"{head}{'桂枝' if i % 5 else ''}{units[i % 300][3][: i % 60]}{write(300)}" + ("桂枝" if i % 5 == 0 else "")
        rows.append((i, f"t{i}", "document" if i % 2 else "transcript", "s", text, "節 桂枝" if i % 50 == 0 else None))
    classics = spark.createDataFrame(units, "id string, title string, section string, text string").repartition(2)
    targets = spark.createDataFrame(rows, "row long, id string, kind string, source string, text string, section string").repartition(4)
    terms = spark.createDataFrame([("桂枝", "桂枝"), ("麻黃", "麻黃")], "term string, alias string")
    began = time.time()
    got = {tuple(r) for r in links.term_links(classics, targets, terms).collect()}
    took = time.time() - began

    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    key = lambda t: t.replace("、", "").replace(" ", "")
    kept = [(r, "三、桂枝" in r[4], pairs(key(r[4]))) for r in rows if "桂枝" in r[4] and ("桂枝" in r[4][:80] or r[5])]
    want = set()
    for c in units:
        own = pairs(c[3][:100])
        for kind in ("document", "transcript"):
            scored = [(float(Decimal(repr(0.35 + 0.25 * h + 0.15 + 0.15 * (len(own & p) / len(own)))).quantize(Decimal("0.001"), ROUND_HALF_UP)), r) for r, h, p in kept if r[2] == kind]
            want |= {(c[0], r[1], kind, s) for s, r in sorted(scored, key=lambda x: (-x[0], x[1][0]))[:3]}
    assert got == want and len(want) == 1800
    assert took < 30
    for name, value in (("TOGETHER", 500), ("CELLS", 200_000), ("UNITS", 70), ("TERMS", 1)):
        monkeypatch.setattr(links, name, value)
    assert {tuple(r) for r in links.term_links(classics, targets, terms).collect()} == want


def test_term_links_by_several_aliases(spark):
    """More terms than were looked for by patterns; a term is named by one alias early, by another in a heading; empty texts and sections."""
    classics = spark.createDataFrame([("c1", "本草", "桂枝", "桂枝味辛"), ("c2", "本草", "卷 麻.黃", ""), ("c3", "本草", None, "桂枝")], "id string, title string, section string, text string")
    rows = [(1, "t1", "document", "桂心" + "字" * 90 + "二、桂枝", ""), (2, "t2", None, "麻.黃", None), (3, "t3", None, "麻x黃一、麻x黃", "卷 麻.黃"), (4, "t4", "document", None, "卷 桂枝"), (5, "t5", "document", "字" * 80 + "桂枝", "卷 桂枝"), (6, "t6", "document", "字" * 80 + "桂枝", "卷")]
    targets = spark.createDataFrame(rows, "row long, id string, kind string, text string, section string").withColumn("source", F.lit("s"))
    terms = spark.createDataFrame([("桂枝", "桂枝"), ("桂枝", "桂心"), ("麻.黃", "麻.黃")] + [(f"藥{i}", f"藥{i}") for i in range(600)], "term string, alias string")
    assert {tuple(r) for r in links.term_links(classics, targets, terms).collect()} == {("c1", "t1", "document", 0.8), ("c1", "t5", "document", 0.55), ("c2", "t2", None, 0.5)}

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import layout
from quillspark.sources import files, sinks
from quillspark.streaming import monitor


def test_texts_in_unknown_encodings(spark, tmp_path):
    for name, data in {"a/u8.txt": "桂枝湯".encode(), "a/gb.txt": "桂枝汤治汗出".encode("gb18030"), "u16.txt": "桂枝湯".encode("utf-16"), "._hidden.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {r.path: r.text for r in files.texts(spark, str(tmp_path)).collect()} == {"a/u8.txt": "桂枝湯", "a/gb.txt": "桂枝汤治汗出", "u16.txt": "桂枝湯"}
    assert {(r.path, r.top, r.category) for r in files.listing(spark, str(tmp_path)).collect()} >= {("a/gb.txt", "a", "document")}


def test_subtitles(spark):
    lines = ["[ti:x]", "[00:05.00]乙：第二", "[00:01.00]甲：第一", "[00:02.00]接著說", "[00:09.5]http://x.y"] + [f"[01:{i:02d}.00]甲：話{i}" for i in range(3)]
    df = spark.createDataFrame([("p", "\n".join(lines))], "path string, text string")
    out = files.subtitles(df, least_speaker=2).orderBy("start").collect()
    assert [(r.start, r.end, r.speaker, r.text) for r in out[:3]] == [(1.0, 2.0, "甲", "第一"), (2.0, 5.0, "甲", "接著說"), (5.0, 60.0, "甲", "乙：第二")]
    assert out[-1].end == out[-1].start + 5


def test_transcripts_and_problems(spark, tmp_path):
    seg = {"start": 0.0, "end": 1.0, "text_raw": "a", "text": "a", "speaker": None, "confidence": None, "low_confidence": False}
    doc = {"schema": "t/1", "source": "s", "clip": None, "duration_sec": 2.0, "engine": {}, "created_at": "", "segments": [seg, {**seg, "start": 1.0, "end": 2.0}], "dropped": []}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    assert [r.at for r in files.transcripts(spark, str(tmp_path)).collect()] == [0, 1]
    from quillspark.operators.quality import transcript_problems

    bad = {**doc, "extra": 1, "segments": [{**seg, "low_confidence": 0, "end": -1.0}]}
    raw = spark.createDataFrame([(json.dumps(doc),), (json.dumps(bad),), ("{",)], "value string")
    assert [len(r.problems) for r in transcript_problems(raw).collect()] == [0, 3, 1]


def test_pages_logs_and_markup(spark):
    out = spark.createDataFrame([('{"responses":[{"page":2,"text":"b"},{"page":1,"text":"a"}]}',), ('{"responses":[{"page":2,"text":"c"}]}',)], "value string").coalesce(1)
    assert [(r.page, r.text) for r in files.recognised_pages(out).orderBy("page").collect()] == [(1, "a"), (2, "c")]
    bad = spark.createDataFrame([('{"responses":[{"page":1,"error":"x"}]}',)], "value string")
    with pytest.raises(Exception, match="recognition failed"):
        files.recognised_pages(bad).collect()
    log = spark.createDataFrame([('{"a": 1}',), ("nonsense",), ("",)], "value string")
    assert [r.a for r in files.log_lines(log, "a int").collect()] == [1]
    book = spark.createDataFrame([("p", "= 卷一 =\n== 上篇 ==\n1、太陽之為病<small>註</small>。\n=== 小節 ===\n汗出 &amp; 惡風")], "path string, text string")
    got = files.classics(book).orderBy("ordinal").collect()
    assert [(r.volume, r.section, r.number, r.text, r.annotations) for r in got] == [("卷一", "上篇", 1, "太陽之為病（註）。", ["註"]), ("卷一", "上篇 小節", None, "汗出 & 惡風", [])]
    page = spark.createDataFrame([('<div data-sec="p" id="3">甲<span class="old">舊</span><br>乙</div>',)], "html string")
    assert page.select(files.html_paragraphs("html").alias("p")).first().p[0] == (3, "甲\n乙")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "x", "甲乙"), (1, "x", "乙丙 ab")], "row long, id string, text string")
    sinks.json_lines(rows, str(tmp_path / "j"), ["row"])
    assert {r.id for r in spark.read.json(str(tmp_path / "j")).collect()} == {"x", "x-2"}
    sinks.index(rows, str(tmp_path / "i"), 2)
    meta = spark.read.parquet(str(tmp_path / "i/meta"))
    assert sinks.fits(spark, str(tmp_path / "i"), meta) and not sinks.fits(spark, str(tmp_path / "i"), meta.withColumn("count", F.lit(9).cast("bigint")))
    cache = str(tmp_path / "c")
    sinks.grow(cache, spark.createDataFrame([("k", 1)], "key string, v int"))
    sinks.grow(cache, spark.createDataFrame([("k", 2), ("l", 3)], "key string, v int"))
    assert {(r.key, r.v) for r in spark.read.parquet(cache).collect()} == {("k", 1), ("l", 3)}
    assert sinks.report(rows, ["row", "id"]).splitlines()[2] == "| 0 | x |"


def test_layout(spark):
    spans = [("d", p, 10.0, 5.0, f"第 {p} 頁") for p in range(1, 5)] + [("d", p, 10.0, 50.0, "正文" + "甲乙丙丁"[p - 1]) for p in range(1, 5)]
    df = spark.createDataFrame(spans, "doc string, page int, x double, y double, text string")
    assert layout.furniture(df, ["doc"]).count() == 4
    titles = spark.createDataFrame([("王大明20080312頭痛",), ("診療日誌20060615真武",), ("J. Doe 20080312-2-咳",), (None,)], "t string")
    assert [r.c and tuple(r.c) for r in titles.select(layout.case_title(F.col("t")).alias("c")).collect()] == [("2008-03-12", "頭痛"), None, ("2008-03-12", "咳"), None]
    s = spark.createDataFrame([("上篇 (12-01:02:03)",), ("卷上 三：太陽病發汗遂漏不止其人惡風小便難",), (None,)], "s string")
    assert [r.x for r in s.select(layout.short_section(F.col("s")).alias("x")).collect()] == ["上篇", "三：太陽病發汗遂漏不止其…", ""]
    assert layout.repaired_name("若見舌根".encode("big5").decode("gb18030")) == "若見舌根"
    assert layout.recovered_word("這是一段可以救回的文字。\r\x13HYPERLINK\x14".encode("utf-16-le")) == ["這是一段可以救回的文字。"]
    t = spark.createDataFrame([("這是第一行沒有結束\n這一行結束。\n另一段落在這裡寫",)], "t string")
    assert t.select(layout.recognised_paragraphs("t").alias("p")).first().p == ["這是第一行沒有結束這一行結束。", "另一段落在這裡寫"]
    old = spark.createDataFrame([(1, "ok", "a"), (2, "ok", "b")], "k int, status string, v string")
    new = spark.createDataFrame([(1, "failed", "x"), (2, "ok", "y")], "k int, status string, v string")
    assert {(r.k, r.v, r.replaced) for r in layout.merged(new, old, ["k"], ["status", "v"]).collect()} == {(1, "a", False), (2, "y", True)}
    assert [r.t for r in layout.capped_output(spark.createDataFrame([(1, 1, "abcd"), (1, 2, "efgh")], "k int, n int, t string"), ["k"], ["n"], "t", 9).orderBy("n").collect()] == ["abcd", "ef…"]


def test_streams(spark, tmp_path):
    rows = [("k", datetime(2024, 1, 1, h), a) for h, a in [(0, True), (1, True), (7, True), (8, False), (9, True)]]
    spark.createDataFrame(rows, "kind string, ts timestamp, active boolean").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("kind string, ts timestamp, active boolean").parquet(str(tmp_path / "e"))
    assert [r.ts.hour for r in monitor.to_memory(monitor.rising_edges(stream), "edges").orderBy("ts").collect()] == [0, 7, 9]
    calls = stream.selectExpr("kind as conversation", "ts")
    assert [r.allowed for r in monitor.to_memory(monitor.quota(calls, 2), "calls").orderBy("ts").collect()] == [True, True, False, False, False]
    users = stream.selectExpr("kind as user_id", "ts")
    assert [r.events for r in monitor.to_memory(monitor.idle_sessions(users), "sessions").collect()] in ([5], [])
    counts = monitor.to_memory(monitor.sliding_counts(stream.withColumnRenamed("kind", "event_type")), "counts")
    assert counts.count() > 0
    assert monitor.to_memory(monitor.once_each(stream, ["kind"]), "once").count() == 1

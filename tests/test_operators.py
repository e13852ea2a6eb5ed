import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import chunking, dedupe, inventory, links, metering, quality, windows


def sequential_keep(paras):
    """The rule, one paragraph after another."""
    keys, said, kept = set(), set(), []
    for i, (key, parts) in enumerate(paras):
        if len(key) >= 8:
            covered = sum(len(p) for p in parts if p in said)
            if key in keys or covered and covered >= 0.8 * len(key):
                continue
            keys.add(key)
            said.update(parts)
        kept.append(i)
    return kept


def test_paragraph_dedupe_equals_sequential_rule(spark):
    rng = random.Random(3)
    sentences = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(rng.randint(3, 12))) for _ in range(14)]
    rows = [(d, a, "。".join(rng.choice(sentences) for _ in range(rng.randint(1, 5))) + "。") for d in range(40) for a in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, at int, paragraph string")
    got = {(r.doc_id, r.at) for r in dedupe.kept_paragraphs(df, ["doc_id", "at"]).collect()}
    plain = [("".join(t.split("。")), [s for s in t.split("。") if len(s) >= 8]) for _, _, t in rows]
    assert got == {rows[i][:2] for i in sequential_keep(plain)}


def test_last_wins_and_differences(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 2), (4, "z", 1)], "k int, s string, n int")
    assert {(r.k, r.reason) for r in dedupe.differences(a, b, ["k"], ["s", "n"]).collect()} == {(2, "n"), (3, "missing"), (4, "extra")}
    assert [r.s for r in dedupe.last_wins(a.union(b), ["k"], [F.desc_nulls_last("n")]).where("k = 2").collect()] == ["y"]


def test_transcript_chunks(spark):
    rows = [("s", "e", i, i * 10.0, i * 10.0 + 9, "字" * 60 + "。") for i in range(40)]
    df = spark.createDataFrame(rows, "source string, episode string, row long, start double, end double, text string")
    out = chunking.transcript_chunks(df).orderBy("n").collect()
    assert out[0].start == 0 and out[-1].end == 399
    for a, b in zip(out, out[1:]):
        assert a.start < b.start <= a.end and 500 <= a.chars <= 660
    alone = spark.createDataFrame([("s", None, 1, 0.0, 1.0, "長" * 900)], "source string, episode string, row long, start double, end double, text string")
    assert [r.chars for r in chunking.transcript_chunks(alone).collect()] == [900]


def test_document_chunks(spark):
    text = "第一章 甲\n" + "\n".join("文" * 180 + "。" for _ in range(8)) + "\n完"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    out = chunking.document_chunks(df).orderBy("n").collect()
    assert {r.doc_id for r in out} == {1} and out[0].section == "第一章 甲" and all(r.chars <= 700 for r in out)
    assert len({r.id for r in out}) == len(out)


def test_windows(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, i, t + timedelta(hours=h), v) for i, (h, v) in enumerate([(0, "a"), (1, "a"), (7, "a"), (7.001, "b"), (14, None), (15, None)])]
    df = spark.createDataFrame(rows, "user long, n int, ts timestamp, v string")
    assert [r.run_length for r in windows.runs(df, ["user"], ["n"], "v").orderBy("n").collect()] == [3, 3, 3, 1, 2, 2]
    assert [r.session for r in windows.sessions(df, ["user"], "ts", ["n"], 6 * 3600).orderBy("n").collect()] == [0, 0, 0, 0, 1, 1]
    assert [r.x for r in windows.carried(df, ["user"], ["n"], F.col("v"), "x").orderBy("n").collect()] == ["a", "a", "a", "b", "b", "b"]
    assert windows.until_total(df.withColumn("h", F.lit(2.0)), ["user"], ["n"], "h", 3).count() == 2
    right = df.where("v = 'a'").select("user", "ts", "n", F.col("n").alias("got"))
    assert [r.got for r in windows.asof(df, right, ["user"], "ts", "ts", "n", ["got"]).orderBy("n").collect()] == [0, 1, 2, 2, 2, 2]
    near = windows.within(df.where("n = 0"), df.where("n > 0"), ["user"], "ts", "ts", 3600)
    assert [r.other_n for r in near.collect()] == [1]
    assert [(r.first, r.rows) for r in chunking.time_windows(spark.createDataFrame([(1, float(i * 100), i) for i in range(5)], "k int, t double, n int"), "k", "t", ["n"], seconds=240).orderBy("window").collect()] == [(0.0, 3), (300.0, 2)]


def test_chain_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        x, y, w = rng.integers(0, 5, n), rng.integers(0, 5, n), rng.integers(1, 9, n).astype(float)
        best = 0.0
        for mask in range(1 << n):
            some = sorted((i for i in range(n) if mask >> i & 1), key=lambda i: (x[i], y[i]))
            if all(x[a] < x[b] and y[a] < y[b] for a, b in zip(some, some[1:])):
                best = max(best, sum(w[i] for i in some))
        got = links.heaviest_chain(x, y, w)
        assert abs(w[got].sum() - best) < 1e-9 and all(x[a] < x[b] and y[a] < y[b] for a, b in zip(got, got[1:]))


def test_containment_join_equals_all_pairs(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("甲乙丙丁戊己") for _ in range(rng.randint(0, 12))) for _ in range(40)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    for t in (0.38, 0.64, 1.0):
        got = {(r.a, r.b) for r in links.containment_join(df, df, t, "row", "row").collect()}
        pairs = [{s[i : i + 2] for i in range(len(s) - 1)} if s else set() for s in texts]
        assert got == {(i, j) for i, a in enumerate(pairs) for j, b in enumerate(pairs) if a and len(a & b) / len(a) >= t - 1e-9}


def test_longest_prefix(spark):
    p = spark.createDataFrame([("a/", "x"), ("a/b/", "y"), ("", "z")], "prefix string, name string")
    s = spark.createDataFrame([("a/b/c",), ("a/q",), ("k",)], "source string")
    assert {r.source: r.name for r in links.longest_prefix(s, p, "source", "prefix", ["name"]).collect()} == {"a/b/c": "y", "a/q": "x", "k": "z"}


def test_quality():
    assert quality.loop_cut("abcdabcdabcd") == (4, 12)
    assert quality.loop_cut("xxabcdeabcde") is None
    assert quality.leak_start("甲" * 3 + "以下為春分班講座，正", "以下為春分班講座") == 3
    assert quality.aligned("[1.0] a\n[2.0] b", ["1.0", "2.5"]) == ["a", "b"]
    assert quality.line_labels([1.0, 1.04, 1.04]) == ["1.0", "1.04", "1.040"]
    assert quality.edits("kitten", "sitting") == (2, 0, 1) and quality.edits("", "ab") == (0, 0, 2) and quality.edits("abc", "") == (0, 3, 0)


def test_confidence_and_loops(spark):
    df = spark.createDataFrame([((-1.0, 2.4, 0.6),), ((-1.01, 0.0, 0.0),), (None,)], "c struct<avg_logprob double, compression_ratio double, no_speech_prob double>")
    assert [r.x for r in df.select(quality.low_confidence(F.col("c")).alias("x")).collect()] == [False, True, False]
    seg = spark.createDataFrame([("s", i, t, "c") for i, t in enumerate(["同一句話", "同一句話！", "同一句話", "別的話語", "以下為春分班講座內容", None])], "source string, n int, text_raw string, course string")
    out = quality.filtered(quality.repeated_segments(seg, ["source"], ["n"]), {"c": "以下為春分班講座"}, ["請訂閱"]).orderBy("n").collect()
    assert [r.reason for r in out] == ["repeat", "repeat", "repeat", None, "leak", None]


def test_correction_choice(spark):
    lines = [(1, 1, "一二三四五", "一二三四五"), (1, 1, "六七八九十", None), (1, 2, "一二三四五", "一二三四六"), (1, 2, "六七八九十", "六七八九十"), (2, 1, "一二三四五", "一" * 40)]
    df = spark.createDataFrame(lines, "doc int, attempt int, before string, after string")
    out = {r.doc: (r.attempt, r.status) for r in quality.chosen(quality.correction_scores(df, ["doc", "attempt"]), ["doc"]).collect()}
    assert out == {1: (2, "ok"), 2: (1, "failed")}


def test_metering(spark):
    rows = [(1, "2024-01-31T17:00:00+00:00", datetime(2024, 2, 1), "m-1", 1.0), (1, "2024-01-31T17:00:00+00:00", datetime(2024, 2, 2), "m-1", 2.0), (2, "bad", datetime(2024, 2, 1), "m-1", 1.0), (3, "2024-02-01T01:00:00+08:00", datetime(2024, 2, 1), "m-1", None), (4, "2024-02-01T01:00:00+08:00", datetime(2024, 2, 1), "m-1", float("nan"))]
    log = spark.createDataFrame(rows, "log_id long, time string, received_at timestamp, model string, cost_usd double").withColumns({"rounds": F.lit(1), "input_tokens": F.lit(1)})
    out = metering.costs(log).collect()
    assert [(str(r.day), r.month, r.questions, r.cost) for r in out] == [("2024-02-01", "2024-02", 2, 2.0)]
    text = spark.createDataFrame([("resets in 1d2h3m or 45m",), ("never",)], "t string")
    assert [r.x for r in text.select(metering.longest_countdown(F.col("t")).alias("x")).collect()] == [93780, None]
    e = spark.createDataFrame([("k", i, datetime(2024, 1, 1) + timedelta(hours=h), a) for i, (h, a) in enumerate([(0, True), (1, True), (7, True), (8, False), (9, True)])], "k string, n int, ts timestamp, a boolean")
    assert [r.n for r in metering.alerts(e, ["k"], "ts", ["n"], F.col("a")).orderBy("n").collect()] == [0, 2, 4]


def test_inventory(spark):
    df = spark.createDataFrame([("g", i) for i in range(10)], "k string, n int")
    assert [r.n for r in inventory.systematic(df, ["k"], ["n"], 4).orderBy("n").collect()] == [0, 3, 6, 9]
    assert [r.n for r in inventory.systematic(df, ["k"], ["n"], 1).collect()] == [4]
    paths = spark.createDataFrame([("古籍/a.wiki",), ("講座/x/y.json",), ("文件/舊檔/z.PDF",)], "source string")
    assert [(r.group, r.include) for r in inventory.classified(paths).collect()] == [("classics", True), ("transcripts", True), ("old", False)]
    assert [r.c for r in paths.select(inventory.category(F.col("source")).alias("c")).collect()] == ["document", "document", "document"]
    assert X.query_terms("") == []

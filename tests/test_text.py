from pyspark.sql import functions as F

from quillspark.functions import numerals as N
from quillspark.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    assert one(spark, "桂枝湯，汗。B12", X.tokens) == ["桂枝", "枝湯", "湯", "汗", "b12"]
    assert one(spark, None, X.tokens) == []
    assert one(spark, "，。", X.tokens) == []


def test_query_terms():
    assert X.query_terms("桂枝湯的組成") == [("桂枝", False), ("枝湯", False), ("組成", False)]
    assert X.query_terms("汗") == [("汗", True)]
    assert X.query_terms("，。") == []


def test_search_key_is_nfkc(spark):
    assert one(spark, "㈱ｱ溼①", X.search_key) == "(株)ア濕1"


def test_dates_and_headings(spark):
    assert one(spark, "記於2008年3月5日", X.find_date) == "2008-03-05"
    assert one(spark, "3/5/2008", X.find_date) == "2008-03-05"
    assert one(spark, "20081340 又 20080312", X.find_date) == "2008-03-12"
    assert one(spark, "2008年13月", X.find_date) is None
    assert one(spark, "2010年7月", X.find_date) == "2010-07"
    assert one(spark, "第三章 總論", X.heading_level) == 1
    assert one(spark, "（八）脈法", X.heading_level) == 2
    assert one(spark, "一般的話", X.heading_level) == 0


def test_boilerplate_and_garbage(spark):
    assert one(spark, "- 12 -", X.is_boilerplate) and one(spark, "第 3 頁", X.is_boilerplate)
    assert one(spark, "第一章..........3", X.is_boilerplate)
    assert not one(spark, "這是正文……。", X.is_boilerplate)
    assert one(spark, "é‰∂ƒ∂ß∂ƒ∆˚å∂ß∂ƒåßé‰é‰é‰", X.is_garbage)
    assert not one(spark, "正文正文正文正文正文正文正文正文正文正文正文", X.is_garbage)


def test_small_measures(spark):
    assert one(spark, "好的abcd", X.estimated_tokens) == 2 + 2 + 1
    assert one(spark, "一。二！三", X.sentences) == ["一。", "二！", "三"]
    assert one(spark, "一二三四五六，七", lambda c: X.clip(c, 7)) == "一二三四五六…"
    assert spark.range(1).select(X.clock(F.lit(65.0)).alias("a"), X.clock(F.lit(3725.0)).alias("b")).first() == ("01:05", "1:02:05")


def test_numerals():
    assert [N.to_number(x) for x in ("十", "二十三", "一百零五", "三千", "二〇二四", "12", "兩百", "甲")] == [10, 23, 105, 3000, 2024, 12, 200, None]
    for n in (0, 7, 10, 15, 20, 105, 110, 1001, 10010, 123456):
        assert N.to_number(N.to_reading(n)) == n
    assert N.score_text("嗯，ＡＢ 12 證") == "ab十二症"

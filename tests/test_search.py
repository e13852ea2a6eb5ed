import pytest

from quillspark.operators import search


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(0, "aaaaaaaa1", "transcript", "s1", "桂枝湯治汗出"), (1, "aaaaaaaa2", "document", "s1", "汗多用桂枝"), (2, "bbbbbbbb1", "classic", "s2", "麻黃湯"), (3, "cccccccc1", "classic", "s2", None), (4, "dddddddd1", "document", "s1", "x1 abc")]
    return spark.createDataFrame(rows, "row long, id string, kind string, source string, text string")


def test_bm25(chunks):
    assert {r.row for r in search.bm25(chunks, "汗").collect()} == {0, 1}
    assert [r.row for r in search.bm25(chunks, "桂枝湯", kind="document").collect()] == [1]
    assert search.bm25(chunks, "，").collect() == []
    assert [r.row for r in search.bm25(chunks, "ABC").collect()] == [4]
    with pytest.raises(ValueError):
        search.bm25(chunks, "汗", kind="other")


def test_vectors_and_fusion(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.vector_top(v, [0.1, 0.9, 0.2, 0.0], limit=2).collect()] == [1, 2]
    a = spark.createDataFrame([(5, 2.0), (7, 1.0)], "row long, score double")
    b = spark.createDataFrame([(7, 2.0), (9, 1.0)], "row long, score double")
    out = search.fused({"bm25": a, "vector": b}).collect()
    assert [r.row for r in out] == [7, 5, 9] and abs(out[0].score - (1 / 62 + 1 / 61)) < 1e-12


def test_hybrid_falls_back(chunks):
    rows, mode, wrong = search.hybrid(chunks, "桂枝", None, None)
    assert mode == "bm25" and "no vectors" in wrong and rows.count() == 2


def test_neighbours_stop_at_another_source(chunks):
    wanted = chunks.where("row = 1").select("row")
    assert sorted(r.row for r in search.neighbours(chunks, wanted, 3, 3).collect()) == [0, 1]


def test_short_ids_and_prefix(chunks):
    assert {r.id: r.short for r in search.short_ids(chunks).collect()} == {"aaaaaaaa1": "aaaaaaaa1", "aaaaaaaa2": "aaaaaaaa2", "bbbbbbbb1": "bbbbbb", "cccccccc1": "cccccc", "dddddddd1": "dddddd"}
    assert [r.id for r in search.find_prefix(chunks, "aaaa", 1).collect()] == ["aaaaaaaa1"]


def test_citation(spark):
    rows = spark.createDataFrame([("abcdef01", "transcript", "講座", "第1講", None, None, None, 65.0, 190.0, None), ("abcdef02", "document", "筆記", None, "一、總論", 3, 4, None, None, "2020-01")], "id string, kind string, title string, episode string, section string, page_start int, page_end int, start double, end double, date string")
    assert [r.cited for r in search.citation(rows).orderBy("id").collect()] == ["講座 第1講 01:05–03:10（編號 abcdef）", "筆記 一、總論 2020-01 第 3–4 頁（編號 abcdef）"]

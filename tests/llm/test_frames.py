"""The operators over small frames: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import encoding, forms, mixture, mojibake, neardup, neighbours, pieces, repetition, scans, truncation

ranks = pytest.mark.skipif(not os.path.exists(encoding.DEFAULT_RANKS), reason="no tokenizer files here")
SAID = "這個方子叫風冬針膏，底下加風瓣仁，前後一劑就好了。"
LONG = "另一段完全不同的話，說到別的地方去了。" * 60
CHUNKS = "`row` long, source string, text string, raw_text string, start double, end double, page_start int, page_end int, k string, t string, id string, s string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "a", SAID, SAID * 5, 0.0, 10.0, None, None),
        (2, "a", SAID.replace("，", "​，"), None, None, None, None, None),
        (3, "b", SAID, "", 5.0, 1.0, 1, 1),
        (3, "b", SAID, "", 5.0, 1.0, 1, 1),
        (4, None, None, None, None, None, None, None),
        (5, "b", "", " ", None, None, None, None),
        (6, "b", LONG, LONG, 0.0, 100.0, 3, 2),
        (7, "b", LONG + "尾", "x", 100.0, None, None, None),
    ]
    return spark.createDataFrame([(*r, "k", "t", "id", "s") for r in rows], CHUNKS)


@pytest.fixture(scope="module")
def nothing(chunks):
    return chunks.limit(0)


def keys(df, *cs):
    return sorted(tuple(r[c] for c in cs) if len(cs) > 1 else r[cs[0]] for r in df.collect())


def test_repetition(chunks, nothing):
    assert keys(repetition.repetitive(chunks), "row") == [1, 6]
    assert keys(repetition.repetitive(nothing), "row") == []
    shares = {r.row: r.share for r in repetition.repeated_shares(chunks).collect()}
    assert len(shares) == 7 and shares[4] == 0 and shares[2] == 0 and shares[1] >= 0.3
    assert repetition.repeated_shares(chunks).count() == 8 and repetition.repeated_shares(nothing).count() == 0


def test_forms(chunks, nothing):
    assert keys(forms.looks_alike(chunks), "row_a", "row_b") == [(1, 2), (2, 3), (2, 3)]
    assert forms.one_form(chunks).where("row in (1, 2, 3)").select("form").distinct().count() == 1
    assert forms.one_form(chunks).where("form is null").count() == 1
    assert keys(forms.looks_alike(nothing), "row_a", "row_b") == []


def test_near_duplicates(chunks, nothing):
    assert keys(neardup.near_pairs(chunks), "row_a", "row_b") == [(1, 2), (1, 3), (2, 3), (6, 7)]
    got = {r.row: (r.group, r.copies, r.links) for r in neardup.groups(chunks).collect()}
    assert got == {1: (1, 4, 0), 2: (1, 4, 0), 3: (1, 4, 0), 6: (6, 1, 1), 7: (6, 1, 1)}
    assert keys(neardup.near_pairs(nothing), "row_a", "row_b") == [] and neardup.groups(nothing).count() == 0


def test_hot_texts_and_variants_are_parted(spark, monkeypatch):
    from quillspark.llm import common

    monkeypatch.setattr(common, "PART", 3)
    monkeypatch.setattr(neardup, "HOT", 4)
    base = "".join(chr(0x4E00 + 37 * i) for i in range(120))
    rows = [(i, base[:60] + chr(0x3400 + i // 4) + base[60:]) for i in range(80)]  # twenty texts alike, four rows each
    df = spark.createDataFrame(rows, "row long, text string")
    assert neardup.near_pairs(df).count() == 80 * 79 // 2 and neardup.near_pairs(df).distinct().count() == 80 * 79 // 2
    spaced = spark.createDataFrame([(i, "a" + " \u00a0\u3000"[i % 3] + "b") for i in range(30)], "row long, text string")
    assert forms.looks_alike(spaced).count() == 300


def test_pieces(chunks, nothing):
    out = pieces.pieces(chunks).orderBy("row", "piece").collect()
    assert {r.row for r in out} == {6, 7} and all(r.chars == len(r.text) <= 600 for r in out)
    assert out[0].start == 0.0 and [r.start for r in out if r.row == 7] == [None] * sum(r.row == 7 for r in out)
    assert keys(pieces.oversized(chunks), "row") == [6, 7] and pieces.pieces(nothing).count() == 0


def test_mojibake_and_scans_take_anything(chunks, nothing):
    for op in (mojibake.garbled, scans.scanned):
        assert op(chunks).count() == 0 and op(nothing).count() == 0


def test_scans_learn_the_channel(spark):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abdhiknoprstuw") for _ in range(6)) + "e" for _ in range(60)]
    clean = [(i, " ".join(rng.choice(words) for _ in range(40)) + ".", None) for i in range(400)]
    read = [(1000 + i, " ".join(w[:-1] + "c" if j == 3 else w for j, w in enumerate(rng.choice(words) for _ in range(9))) + ".", 1) for i in range(40)]
    df = spark.createDataFrame(clean + read, "row long, raw_text string, page_start int")
    grams, chars, n = scans.counts(df)
    channel = scans.confused(df.where("page_start = 1"), scans.Model(grams, chars, n))
    assert channel["e", "c"] != scans.MISREAD and set(channel) == set(scans.PRIOR)


def test_truncation(spark):
    rows = [(i, f"{chr(0x4E00 + i * 7)}某某說過這一句話，然後又說了另一句。完了就走。", "s") for i in range(60)] + [(100, None, "s"), (101, "", None), (102, "  ", "s")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, c int, n int")
    assert truncation.truncated(d).count() <= 1
    assert {r.source: r.texts for r in truncation.rates(d).collect()} == {"s": 60}
    assert truncation.truncated(d.limit(0)).count() == 0


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[200:] = v[:100] + rng.normal(size=(100, 16)).astype(np.float32) * 0.1
    v[150:165] = v[0]
    rows = [(f"k{i:03d}", x.tolist(), 1) for i, x in enumerate(v)] + [("n", None, 1), ("e", [], 1), ("z", [0.0] * 16, 1), ("q", [float("nan")] * 16, 1), ("short", [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "key string, vec array<float>, id int")
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    want = set()
    for i in range(300):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:10]
        want |= {(min(i, j), max(i, j)) for j in order if s[i, j] >= 0.9}
    got = {(int(a[1:]), int(b[1:])) for a, b in keys(neighbours.similar_pairs(df), "key_a", "key_b")}
    assert got == want
    near = neighbours.nearest(df, every=10).where("key like 'k%'").collect()
    hits = [r.other_key in {f"k{j:03d}" for j in np.argsort(-s[int(r.key[1:])])[:11]} for r in near if not 150 <= int(r.key[1:]) < 165 and r.key != "k000"]
    assert np.mean(hits) >= 0.9
    assert neighbours.similar_pairs(df.limit(0)).count() == 0


def brute_top(v, n=10):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :n]


def test_neighbours_with_a_third_in_one_cone(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    monkeypatch.setattr(neighbours, "PIVOTS", 8)  # so that cells are parted again
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3600, 16))
    v[:1200] = 1 + 0.3 * rng.normal(size=(1200, 16))
    v = v.astype(np.float32)
    df = spark.createDataFrame([(f"k{i:04d}", x.tolist()) for i, x in enumerate(v)], "key string, vec array<float>")
    got = {(int(r.key[1:]), int(r.other_key[1:])) for r in neighbours.nearest_of_all(df).collect()}
    want = [(i, int(j)) for i, row in enumerate(brute_top(v)) for j in row]
    assert np.mean([p in got for p in want]) >= 0.9
    keyed = neighbours.usable(df)
    vectors = neighbours.nodes(keyed)
    counts = neighbours.blocks(vectors).groupBy("block").count().agg(F.max("count"), F.sum("count")).first()
    assert counts[0] <= 256 and counts[1] == 3600 * neighbours.ROUNDS


def test_queries_from_outside_the_graph(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(2500, 16)).astype(np.float32)
    df = spark.createDataFrame([(f"k{i:04d}", x.tolist()) for i, x in enumerate(v[:2450])], "key string, vec array<float>")
    keyed = neighbours.usable(df)
    vectors = neighbours.nodes(keyed)
    at = {r.id: int(r.key[1:]) for r in keyed.join(vectors, "digest").select("id", "key").collect()}
    units = v[2450:] / np.linalg.norm(v[2450:], axis=1, keepdims=True)
    queries = spark.createDataFrame([(i, bytearray(u.astype(np.float32).tobytes())) for i, u in enumerate(units)] + [(99, bytearray(8))], "query long, unit binary")
    got = {(r.query, at[r.other]) for r in neighbours.search(queries, vectors, neighbours.graph(vectors)).collect()}
    base = v[:2450] / np.linalg.norm(v[:2450], axis=1, keepdims=True)
    want = [(i, int(j)) for i, u in enumerate(units) for j in np.argsort(-(base @ u))[:10]]
    assert np.mean([p in got for p in want]) >= 0.9 and not any(q == 99 for q, _ in got)


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(f"a{i}", rng.normal(size=4).tolist()) for i in range(20)] + [(f"b{i}", rng.normal(size=7).tolist()) for i in range(20)] + [("n", [1.0, None]), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "key string, vec array<float>")
    out = neighbours.nearest_of_all(df).collect()
    assert len(out) == 400 and all(r.key[0] == r.other_key[0] for r in out)


@ranks
def test_encoding(spark):
    d = spark.createDataFrame([(1, "Hello the 甲乙"), (2, ""), (3, None), (4, " "), (4, " ")], "doc_id long, text string").withColumn("ids", F.lit("x"))
    out = {r.doc_id: r.ids for r in encoding.encode_texts(d).collect()}
    assert out[2] == [] and out[3] == [] and len(out[4]) == 1 and out[1][:2] == [15496, 262]
    assert encoding.encode_texts(d).count() == 5 and encoding.encode_texts(d.limit(0)).count() == 0
    assert encoding.round_trip(d).where("not same").count() == 0


@ranks
def test_mixture(spark):
    texts = [(i, f"document number {i} of the first source", "a", 1) for i in range(200)] + [(200 + i, f"second {i}", "b", 1) for i in range(30)] + [(500, "second 3", "a", 1), (501, None, "b", 1), (502, "", "b", 1)]
    d = spark.createDataFrame(texts, "doc_id long, text string, source string, rate int")
    t = spark.createDataFrame([("a", 3.0, 1), ("b", 1.0, 2), ("gone", 5.0, None), ("zero", 0.0, 1)], "source string, weight double, max_repeats int")
    sized = mixture.sized(d, t)
    assert sized.where("doc_id in (500, 501, 502)").count() == 0
    out = {r.source: r for r in mixture.shares(sized, t).collect()}
    assert out["a"].target_share == 0.75 and out["gone"].target_share == 0 and out["b"].most_repeats == 2 and out["a"].most_repeats == 1
    assert abs(out["a"].actual_share - 0.75) < 0.1
    again = lambda: keys(mixture.mixture(sized, t), "doc_id", "copy")
    assert again() == again()
    assert mixture.mixture(mixture.sized(d.limit(0), t), t).count() == 0


def test_texts_of_one_template_are_no_candidates(spark):
    rng = np.random.default_rng(5)
    frame = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 180)))
    texts = [frame + "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 220))) for _ in range(1500)]  # any two have 0.29 in common
    texts += [t[:200] + "添" + t[200:] for t in texts[:40]]
    sig = neardup.signatures(*neardup.grams(texts))
    by: dict[int, list[int]] = {}
    for i, of in enumerate(neardup.variants(sig)):
        for v in of.tolist():
            by.setdefault(v, []).append(i)
    share = {(a, b) for met in by.values() for n, a in enumerate(met) for b in met[n + 1 :] if a < b}
    signed = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sig)], "id long, sig binary")
    got = neardup.candidates(signed).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} <= share
    assert {(i, 1500 + i) for i in range(40)} <= {(r.a, r.b) for r in got}
    assert len(share) > 10_000 and len(got) < len(share) / 20

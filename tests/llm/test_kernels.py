"""The operators' kernels against brute force, without Spark."""

import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import encoding, forms, logistic, mojibake, neardup, pieces, repetition, scans, truncation

LETTERS = repetition.Letters()
BOUNDARIES = pieces.Boundaries()
ranks = pytest.mark.skipif(not os.path.exists(encoding.DEFAULT_RANKS), reason="no tokenizer files here")


def brute_share(text):
    z = [c.lower() for c in text if c.isalnum()]
    marks, seen = [0] * len(z), set()
    for i in range(len(z) - 11):
        w = "".join(z[i : i + 12])
        if w in seen:
            marks[i : i + 12] = [1] * 12
        seen.add(w)
    return sum(marks) / max(1, len(z))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abA甲乙 ，1", max_size=80), max_size=5))
def test_shares(texts):
    assert np.allclose(repetition.exact_shares(texts, LETTERS), [brute_share(t) for t in texts])


def test_repetition_model_separates():
    rng = random.Random(1)
    plain = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(200)) for _ in range(120)]
    model = repetition.train(plain, LETTERS)
    p = model.probability(repetition.features([plain[0], plain[1][:60] * 4], LETTERS))
    assert p[0] < 0.5 < p[1]


@settings(max_examples=40, deadline=None)
@given(st.text("abé甲。，\n .́", min_size=601, max_size=4000))
def test_pieces(text):
    got = pieces.spans(text, BOUNDARIES)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert 90 <= b - c <= 150 and d > b
    assert all(b - a <= 600 for a, b in got)


def test_pieces_end_at_pauses():
    text = ("一句話說到這裡為止。" * 100)[:995]
    assert all(text[b - 1] == "。" for _, b in pieces.spans(text, BOUNDARIES)[:-1])
    assert pieces.spans("短", BOUNDARIES) == [(0, 1)] and pieces.spans("", BOUNDARIES) == [(0, 0)]


def test_skeletons():
    t = forms.Prototypes()
    same = [("Ｃ－６７／２", "C-67/2"), ("石​膏", "石膏"), ("é", "é"), ("а", "a"), ("⽯", "石"), ("不", "不"), ("a b", "a b"), ("ofﬁ", "offi")]
    for a, b in same:
        assert forms.skeleton(a, t) == forms.skeleton(b, t), (a, b)
    for a, b in [("a b", "ab"), ("a,b", "a.b"), ("②", "2"), ("½", "1/2")]:
        assert forms.skeleton(a, t) != forms.skeleton(b, t), (a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("甲乙丙", max_size=12), st.text("甲乙丙", max_size=12)), min_size=1, max_size=5))
def test_jaccard(pairs):
    def grams(s):
        s = s if len(s) >= 3 else s + "\x00" * (3 - len(s))
        return {s[i : i + 3] for i in range(len(s) - 2)}

    want = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a, b in pairs]
    assert np.allclose(neardup.jaccard([a for a, _ in pairs], [b for _, b in pairs]), want)


def test_variants_meet_when_one_position_differs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (1, neardup.SEGMENTS * neardup.POSITIONS)).astype(np.uint8)
    b = rng.integers(0, 256, a.shape).astype(np.uint8)
    b[0, : neardup.POSITIONS] = a[0, : neardup.POSITIONS]
    b[0, 3] ^= 1
    assert np.intersect1d(neardup.variants(a), neardup.variants(b)).size == 1


def test_unread():
    text = "若見膝頭沉重，當去松壺皮。"
    for w, t in (("1252", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("koi8_r", "utf-8"), ("gb18030", "cp950")):
        raw = text.encode(t)
        table = {b: c for c, b in mojibake._TABLES[w].items()} if w in mojibake._TABLES else None
        wrong = "".join(table[b] for b in raw) if table else raw.decode(w, "replace")
        if "�" not in wrong:
            assert mojibake.unread(wrong, w, t) == (text, False)


def phrase_dictionaries(texts):
    n = Counter((got[0], p) for got in map(mojibake.phrases, texts) if got for p in got[1])
    return mojibake.dictionaries(sorted(((lang, p, k) for (lang, p), k in n.items()), key=lambda b: (b[0], -b[2] * len(b[1]), b[1])))


def test_mojibake_finder():
    clean = ["若見膝頭沉重，當去松壺皮，易以冬瓣葉。", "考《月瓣餘篇》所載，雲雲鼓散主治尾椎發麻。", "The dose of silverreed powder was halved within ten doses."] * 60
    common = "".join(sorted(set("".join(clean))))
    f = mojibake.Finder(common, phrase_dictionaries(clean))
    from quillspark.llm.common import code_points

    look = lambda t: f.repair(t, code_points([t])[0])
    sentence = "若見膝頭沉重，當去松壺皮。"
    back = {b: c for c, b in mojibake._TABLES["1252"].items()}
    wrong = "".join(back[b] for b in sentence.encode())
    assert look(clean[1] + wrong)[0] == clean[1] + sentence
    assert look(clean[0]) is None and look("βετα、Ωμε二味，價£4½。" + clean[0]) is None
    assert look("���ҭn�I�b�X" + clean[0])[0] is None


def test_mojibake_that_is_common():
    from quillspark.llm.common import code_points

    clean = ["若見膝頭沉重，當去松壺皮，易以冬瓣葉。", "考《月瓣餘篇》所載，雲雲鼓散主治尾椎發麻。"] * 60
    sentence = "若見膝頭沉重，當去松壺皮，易以冬瓣葉。"
    whole = next(n for n in range(len(sentence), 0, -1) if "�" not in sentence[:n].encode().decode("gb18030", "replace"))
    wrong = sentence[:whole].encode().decode("gb18030")
    texts = clean + [wrong] * 60
    common = "".join(sorted(set("".join(texts))))
    f = mojibake.Finder(common, phrase_dictionaries(texts))
    for before in ("", clean[1]):
        assert f.repair(before + wrong, code_points([before + wrong])[0])[0] == before + sentence[:whole]
    assert f.repair(clean[0], code_points([clean[0]])[0]) is None


GRAMS = {"The": 50, "patient": 50, "complained": 50, "of": 90, "the": 900, "throbbing": 20, "temples": 20, "after": 30, "long": 30, "walks": 30, "tired": 3, "and": 60, "complained of": 40, "of the": 60, "the long": 9, "long walks": 9, "walks and": 9, "not": 40, "of throbbing": 9, "temples after": 9, "and the": 30, "the patient": 30, "patient complained": 30, "不可": 60, "可用": 30, "用藥": 40, "不用": 30, "下": 60, "可": 60, "用": 60, "藥": 60, "不": 90}


def test_scans():
    m = scans.Model(GRAMS, 2000, 1500)
    page = scans.repair("The patient complained of throb-\nbing ternples after long walks\n- 12 -\nand tlie patient complained of\nthe long walks.", 12, 12, m)
    assert page.paragraphs == ["The patient complained of throbbing temples after long walks and the patient complained of the long walks."]
    assert page.furniture == 1 and page.corrected == 2
    assert scans.repair("方藥：\n雲燈花 五合\n雀尾藤 十二合\n雨壺石 半錢", 1, 1, m) is None
    assert scans.repair("銀絲下水秋梭草，\n竹屏下水紫傘草，\n雀絲不寒竹絲膠。", 1, 1, m) is None
    assert m.line("下可甩藥")[0] == "不可用藥"
    # nothing is known: no likelihood says that the text runs on
    assert scans.repair("The patient complained of long\nwalks and the patient complained\nof the long walks.", 12, 12, scans.Model({})) is None
    for odd in ("", " ", "\n\n", "a", "\u3000\n1\n"):
        assert scans.repair(odd, None, None, m) is None or odd.strip()


def test_scans_take_long_texts():
    m = scans.Model(GRAMS, 2000, 1500)
    text = "下可甩藥" * 50_000 + "\n" + "\n".join(["the patient complained of the long"] * 20_000)
    assert scans.repair(text, 1, 900, m) is not None


def test_scans_weigh_each_line_alone():
    # one overlong line leaves the others what they are
    m = scans.Model(GRAMS, 2000, 1500)
    page = "The patient complained of the long\nwalks and the patient complained\nof the long walks and the patient\ncomplained of the long walks.\n" + "The long walks. " * 12
    assert scans.repair(page, 12, 12, m).parted == 3


def test_scans_correct_recurring_misreadings():
    m = scans.Model({"the": 3170, "tlie": 28, "dawn": 900, "davvn": 9, "with": 1448, "witli": 14, "burn": 40, "bum": 30}, 10000)
    assert m.line("witli davvn tlie burn")[:2] == ("with dawn the burn", 3)


def test_scans_words_by_their_neighbours():
    m = scans.Model({"burn": 940, "bum": 400, "will": 950, "will burn": 900}, 100_000, 100_000, {("rn", "m"): 0.02})
    assert m.line("it will bum")[0] == "it will burn" and m.line("a bum")[0] == "a bum"


def test_truncation():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(rng.randint(3, 9)))
    texts = ["，".join(word() for _ in range(4)) + "。" + "，".join(word() for _ in range(3)) + "。" for _ in range(400)]
    model = truncation.train([(t, 0.0, 0.0) for t in texts])
    rows = [(t, 0.0, 0.0) for t in texts[:50]] + [(t[:-7], 0.0, 0.0) for t in texts[:50]]
    p = model.probability(truncation.features(rows))
    assert (p[:50] < 0.5).mean() > 0.95 and (p[50:] >= 0.5).mean() > 0.8


def test_truncation_learns_the_limit():
    rng = random.Random(4)
    texts = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(rng.randint(30, 90))) for _ in range(300)]  # nothing closes them
    model = truncation.train([(t, 0.0, 0.0) for t in texts] + [(t[:20], 0.4, 0.0) for t in texts[:100]], [("c", 20, 0.4)])
    at, off = (model.probability(truncation.features([(t[:20], part, 0.0) for t in texts])) for part in (0.4, 0.0))
    assert (at > off).all() and (at >= 0.5).mean() > 0.95


def test_confusables_table(tmp_path):
    path = tmp_path / "table.txt"
    path.write_text("# Version: 9.9\n0430 ;\t0061 ;\tMA\t# a\n0031 ; 006C ; MA # digit\n1D7CF ; 006C ; MA\n\n", encoding="utf-8")
    version, letters = forms.read_confusables(str(path))
    assert version == "9.9" and letters == {"а": "a", "\U0001d7cf": "l"}
    assert forms.composed("а1", forms.Prototypes(letters)) == "a1"


def test_logistic_is_deterministic():
    x = logistic.Sparse(np.array([0, 1, 0, 1]), np.ones(4), np.array([0, 1, 2, 3, 4]))
    y = np.array([0, 1, 0, 1.0])
    a, b = logistic.fit(x, y, 2), logistic.fit(x, y, 2)
    assert np.array_equal(a.weights, b.weights) and (a.probability(x) > 0.5).tolist() == [False, True, False, True]


@ranks
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_definition(text):
    import tiktoken

    e = encoder()
    enc = tiktoken.Encoding("t", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=e.v.ranks, special_tokens={})
    ids = e.encode(text)
    assert ids == enc.encode_ordinary(text) and encoding.decode(ids, e.v) == text


@ranks
def test_transducer_keeps_little():
    e = encoder()
    run, most, out = encoding.Transducer(e.v), 0, []
    for _ in range(4000):
        out += run.feed(b"a")
        most = max(most, len(run.data))
    out += run.finish()
    assert most <= 8 * e.v.longest and b"".join(e.v.tokens[i] for i in out) == b"a" * 4000


_ENCODER = []


def encoder():
    if not _ENCODER:
        _ENCODER.append(encoding.Encoder())
    return _ENCODER[0]


def test_halves_meet_where_variants_do():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (400, neardup.SEGMENTS * neardup.POSITIONS)).astype(np.uint8)
    b = a.copy()
    for i in range(len(b)):  # in every segment as many positions differ as the row's number says, 0 to 3
        for s in range(neardup.SEGMENTS):
            b[i, s * neardup.POSITIONS + rng.permutation(neardup.POSITIONS)[: i % 4]] ^= 1
    (segments, places), (others, at) = neardup.halves(a), neardup.halves(b)
    for i in range(len(a)):
        met = 0
        for k in np.flatnonzero(places[i] == at[i]):
            left = range(neardup.HALF, neardup.POSITIONS) if k % 2 == 0 else range(neardup.HALF)
            met += sum((int(segments[i, k]) ^ int(others[i, k])) & ~(0xFF << 8 * g) == 0 for g in left)
        assert met == np.intersect1d(neardup.variants(a[i : i + 1]), neardup.variants(b[i : i + 1])).size


def test_sketches_and_records():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 4, (2000, neardup.SEGMENTS * neardup.POSITIONS)).astype(np.uint8) for _ in "ab")
    share = rng.random((2000, 1))
    b = np.where(rng.random(b.shape) < share, a, b)
    got = neardup.alike(list(neardup.sketches(a).T), list(neardup.sketches(b).T))
    assert (got == ((a == b).sum(1) >= neardup.SKETCHED)).all() and 100 < got.sum() < 1900
    columns = [rng.integers(0, 1 << 8 * n - 1, 50).astype(np.uint64) for n in (8, 8, 7, 7, 7)]
    back = neardup.unpacked_records([neardup.packed_records([c[:20] for c in columns]), neardup.packed_records([c[20:] for c in columns])])
    assert all((x == y).all() for x, y in zip(columns, back, strict=True))


def test_normals_of_many_texts_are_those_of_each():
    rng, table = random.Random(3), forms.Prototypes()
    marks = [" ", "　", "​", "é", "é", "ﬁ", "가", "ᄀ", "ᅡ", "ᆨ", "か", "゙", "Å", "А", "①", "½", "\ud800", "̣̇"]
    pool = [chr(c) for c in range(0x20, 0x3200, 7)] + marks * 40
    texts = ["", " "] + ["".join(rng.choices(pool, k=rng.randrange(1, 7))) for _ in range(20_000)]
    assert neardup.Normals()(texts) == [neardup.normal(t, table) for t in texts]


def test_near_duplicate_kernels_take_whole_batches():
    """One by one, or sorted by two keys, these took most of p3_found's time."""
    rng, table, many = random.Random(4), forms.Prototypes(), neardup.Normals()
    texts = ["".join(rng.choices("諸藥，。服之 則愈ＡＢ甲乙丙丁戊己庚辛壬癸", k=450)) for _ in range(1000)]

    def least(work):
        times = []
        for _ in range(4):
            began = time.process_time()
            out = work()
            times.append(time.process_time() - began)
        return out, min(times)

    (plain, batch), (same, single) = least(lambda: many(texts)), least(lambda: [neardup.normal(t, table) for t in texts])
    assert plain == same and batch < single / 2
    packed, offsets = neardup.grams(plain)
    own = np.repeat(np.arange(len(plain)), np.diff(offsets))
    (_, sorting), (found, whole) = least(lambda: [np.lexsort((x, own)) for x in (packed[::-1].copy(), packed) for _ in "ab"]), least(lambda: neardup.jaccard(plain, plain[::-1]))
    assert whole < sorting and (found[:500] == found[500:][::-1]).all()


def test_sequences_of_very_many_characters():
    every = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[k::5]) for k in range(3)] + ["".join(every), "甲"]
    packed, offsets = neardup.grams(texts)
    for i, t in enumerate(texts[:4]):
        of = packed[offsets[i] : offsets[i + 1]]
        assert len(of) == len(t) - 2 and (np.diff(of.astype(np.int64)) > 0).all()
    assert neardup.jaccard(texts[3:4], ["".join(every[:-9])]).tolist() == [(len(every) - 11) / (len(every) - 2)]
    assert neardup.jaccard(texts[:3], texts[:2] + ["甲乙丙"]).tolist() == [1.0, 1.0, 0.0]

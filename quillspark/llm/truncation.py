"""Problem 10: texts that stop before their end, and how often each source does that.

Intact values are cut artificially to create positives. A hashed logistic regression on closing characters, punctuation and
length-to-limit features is trained on them and calibrated, then scores every record.

Which rows are intact isn't known. Rows that end at a limit of their source are not taken for it; of the others in the sample few are
cut, and after a first fit those that look so are left out and the model is fitted again. A source's limits are the lengths at which far more of its rows end than at the lengths around
them, from statistics over all rows; part of the positives are cut at such a length, and every row has the features of its own.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_sample, map_batches, written
from quillspark.llm.logistic import Model, Sparse, calibrated, fit, halves

#: The bounds of the sample in rows and in characters of one, the number of hashed features, the threshold on the probability.
TRAIN_ROWS, TRAIN_CHARS, BUCKETS, THRESHOLD = 6000, 8000, 1 << 14, 0.5
#: What is put after a cut.
MARKS = ["", "", "", "…", "�", " [...]", " ", "「", "...", "（", "&nb"]
#: The same as a pattern at a text's end.
MARKED = r"(?:…|\x{fffd}+| ?\[\.\.\.\]|\.\.\.|「|（|&\w{0,4}|\s)+$"
#: Part of a source's rows and rows that must end at one length for it to be a limit, and how many times as many as at the lengths around.
LIMIT_PART, LIMIT_ROWS, STANDS_OUT = 0.05, 4, 10
#: Sources with limits up to which their table is broadcast.
FEW = 20_000
TERMINAL = "。．.！!？?"


def shape(text: str) -> str:
    """One letter a character: Han h, kana k, Latin lower a and upper A, digits 0; the rest stays."""
    out = []
    for c in text:
        o = ord(c)
        if 0x4E00 <= o < 0xA000 or 0x3400 <= o < 0x4DC0 or o >= 0x20000 and o < 0x32400:
            out.append("h")
        elif 0x3040 <= o < 0x3100:
            out.append("k")
        elif c.isdigit():
            out.append("0")
        elif c.isalpha():
            out.append("A" if c.isupper() else "a")
        else:
            kind = unicodedata.category(c)
            out.append("★" if kind in ("So", "Sk", "Cs") or o >= 0x1F000 else c)
    return "".join(out)


def squeezed(text: str) -> str:
    """The shape with runs counted as one, two or more."""
    return re.sub(r"(.)\1\1+", r"\1\1+", shape(text))


def closing_features(text: str, at_chars: float, at_bytes: float) -> list[tuple[int, float]]:
    """(feature, value): the end's characters and shapes, its last lines, and whether the length is the source's limit."""
    tail = text[-60:]
    lines = text[-400:].split("\n")
    last, before = lines[-1], lines[-2] if len(lines) > 1 else ""
    names = [f"c{k}{tail[-k:]}" for k in range(1, 6)]
    form = shape(tail[-14:])
    names += [f"s{k}{form[-k:]}" for k in (1, 2, 3, 4, 6, 8)]
    small = squeezed(tail[-40:])
    names += [f"q{k}{small[-k:]}" for k in (2, 3, 5, 8)]
    if len(last) <= 40 and before:
        whole, other = squeezed(last), squeezed(before)
        names += [f"l{whole}", f"n{min(len(last), 20)}{shape(last)[-1:]}", f"p{before[-1:]}", f"b{int(len(last) == len(before))}{shape(before[-1:])}{shape(last[-1:])}", f"e{int(whole == other)}", f"a{last[:2]}", f"u{last[-1:]}{before[-1:]}", f"t{shape(last[:1])}{int(' ' in last)}{shape(last[-1:])}{shape(before[-1:])}"]
    else:
        names.append("long")
    stripped = re.sub(r"(&\w*;?|[ \n\t…�.\[\]★「（])+$", "", tail) or tail
    mark = tail[len(stripped) :]
    names += [f"m{mark[:5]}", f"r{stripped[-1:]}|{mark[:2]}", f"f{shape(stripped[-1:])}|{mark[:2]}"]
    if tail[-1:] in TERMINAL + "；;":
        names.append("terminal")
    else:
        for kind, part in (("chars", at_chars), ("bytes", at_bytes)):
            if part > 0:
                names += ["limit", f"limit{kind}{min(5, int(part * 20))}", f"limit{shape(tail[-1:])}"]
    out = [(zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS, 1.0) for x in names]
    return out


def features(rows: list[tuple[str, float, float]]) -> Sparse:
    made = [closing_features(*r) for r in rows]
    flat = [x for m in made for x in m]
    return Sparse(np.array([f for f, _ in flat], np.int64), np.array([v for _, v in flat], float), np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int64))


def cut(text: str, rng: np.random.Generator, at: int | None = None) -> str | None:
    """The text stopped inside a word or a sentence, at a given length if there is one; null if that can't be."""
    for _ in range(8 if at is None else 1):
        body = text[: int(rng.integers(max(1, len(text) // 8), max(2, len(text)))) if at is None else at]
        if 8 < len(body) < len(text) and body[-1] not in TERMINAL + "；;\n 」』”）)" and text[len(body)] not in ("\n", *TERMINAL, "；", ";") and "\n" not in text[len(body) - 6 : len(body) + 6]:
            return body + MARKS[int(rng.integers(0, len(MARKS)))]
    return None


def train(rows: list[tuple[str, float, float]], known: list[tuple[str, int, float]] | None = None) -> Model:
    """The calibrated model of sampled rows (text, part of its source that ends at its length in characters, in bytes). Of the
    positives, cut from these texts, half are cut at a length drawn from the known limits (kind, size, part) where a text reaches so far."""
    rng = np.random.default_rng(23)
    made: list[tuple[str, float, float]] = []
    rows = [r for r in rows if not r[1] and not r[2]]
    for t, _, _ in rows:
        for k in range(2):
            limit = known[int(rng.integers(0, len(known)))] if known and k else None
            at = None if limit is None else limit[1] if limit[0] == "c" else len(t.encode("utf-8", "replace")[: limit[1]].decode("utf-8", "ignore"))
            c = cut(t, rng, at) if at is not None and at < len(t) else cut(t, rng)
            if c:
                there = limit is not None and at is not None and at < len(t)
                made.append((c, limit[2] if there and limit[0] == "c" else 0.0, limit[2] if there and limit[0] == "b" else 0.0))
    every = list(rows) + made
    y = np.concatenate([np.zeros(len(rows)), np.ones(len(made))])
    if not every:
        return Model(np.zeros(BUCKETS), -1.0)
    x = features(every)
    for _ in range(2):
        one, two = halves(len(y), 7)
        model = calibrated(fit(x.take(one), y[one], BUCKETS, l2=2e-4, steps=150), x.take(two), y[two])
        kept = np.flatnonzero((y > 0) | (model.probability(x) < 0.5))
        if not len(kept) or len(kept) == len(y):
            break
        x, y = x.take(kept), y[kept]
    return model


def limits(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, kind, size, part): the lengths, in characters (c) or bytes (b, within 3 for a character cut in two), at which far more
    rows of a source end than around them, and the part of its rows that do. What may stand after a cut counts and doesn't."""
    bare = F.length(F.regexp_replace(F.substring(text, -40, 40), MARKED, "")) + F.greatest(F.length(text) - 40, F.lit(0))
    both = F.array_distinct(F.array(F.struct(F.lit("c").alias("kind"), F.length(text).alias("size")), F.struct(F.lit("c").alias("kind"), bare.alias("size")), F.struct(F.lit("b").alias("kind"), F.octet_length(text).alias("size"))))
    # copies of a text end where it does, which says nothing
    once = df.where(F.length(text) > 0).select(F.col(source).alias("source"), F.xxhash64(text).alias("text"), both.alias("both")).dropDuplicates(["source", "text"])
    sizes = once.select("source", F.explode("both").alias("x")).groupBy("source", "x.kind", "x.size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source", "kind")
    here = F.when(F.col("kind") == "b", F.sum("n").over(w.orderBy("size").rangeBetween(-3, 0))).otherwise(F.col("n"))
    wide = F.when(F.col("kind") == "b", 4).otherwise(1)
    placed = sizes.withColumns({"here": here, "around": F.sum("n").over(w.orderBy("size").rangeBetween(-40, 40)), "all": F.sum("n").over(w)})
    spikes = placed.where((F.col("here") >= LIMIT_ROWS) & (F.col("here") >= LIMIT_PART * F.col("all")) & (F.col("here") >= STANDS_OUT * wide * (F.col("around") - F.col("here")) / 80) & ((F.col("kind") == "c") | (F.col("n") > 0)))
    return spikes.select("source", "kind", "size", (F.col("here") / F.col("all")).alias("part"))


def placed(df: DataFrame, known: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(k, s, t, pc, pb, whole): each row's end and text, and the part of its source's rows that end at its length."""
    maps = known.groupBy(F.col("source").alias("s_")).agg(*[F.filter(F.collect_list(F.when(F.col("kind") == k, F.struct("size", "part"))), lambda x: x.isNotNull()).alias(f"at_{k}") for k in "cb"])
    few = known.select("source").distinct().count()
    bare = F.length(F.regexp_replace(F.substring(text, -40, 40), MARKED, "")) + F.greatest(F.length(text) - 40, F.lit(0))
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(source).alias("s"), F.substring(text, -420, 420).alias("t"), F.length(text).alias("c"), bare.alias("d"), F.octet_length(text).alias("b"), F.col(text).alias("whole"))
    joined = rows.join(F.broadcast(maps) if few <= FEW else maps, F.expr("s <=> s_"), "left")
    most = lambda some, fits: F.coalesce(F.array_max(F.transform(F.filter(some, fits), lambda x: x["part"])), F.lit(0.0))
    return joined.select("k", "s", "t", most(F.col("at_c"), lambda x: (x["size"] == F.col("c")) | (x["size"] == F.col("d"))).alias("pc"), most(F.col("at_b"), lambda x: (x["size"] - F.col("b")).between(0, 3)).alias("pb"), "whole")


def scored(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, probability) of every row with a text that isn't blank.

    Null, empty and blank texts can't be cut off and don't come out; equal rows get equal scores; texts of any length are
    taken whole, though only their ends decide; the null source is a source of its own; an empty table gives an empty one.
    """
    known = written(limits(df, source, text))
    joined = placed(df, known, key, text, source)
    sample = bounded_sample(joined, "whole", TRAIN_ROWS, f"length(trim(whole)) between 9 and {TRAIN_CHARS}", "pc", "pb")
    drawn = known.orderBy(F.desc("part"), "source", "kind", "size").limit(200).collect()
    model = train([(r.whole, r.pc, r.pb) for r in sample], [(r.kind, r["size"], r.part) for r in drawn])

    def make():
        def work(batch: pa.RecordBatch):
            rows = [(i, t, c, b) for i, (t, c, b) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("t", "pc", "pb")), strict=True)) if t.strip()]
            if rows:
                at = pa.array([r[0] for r in rows])
                yield {key: batch.column("k").take(at), "source": batch.column("s").take(at), "probability": model.probability(features([r[1:] for r in rows]))}

        return work

    kind = df.schema[key].dataType.simpleString()
    return map_batches(joined, ["k", "s", "t", "pc", "pb"], f"{key} {kind}, source string, probability double", make)


def truncated(df: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    return scored(df, key).where(F.col("probability") >= threshold).select(key)


def rates(df: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(source, texts, truncated, rate) over all rows with a text."""
    return scored(df, key).groupBy("source").agg(F.count("*").alias("texts"), F.count(F.when(F.col("probability") >= threshold, 1)).alias("truncated")).withColumn("rate", F.col("truncated") / F.col("texts"))

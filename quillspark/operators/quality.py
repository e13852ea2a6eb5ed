"""Quality of recognised speech and of its corrections: confidence, loops, prompt leaks, alignment, scores."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from quillspark.functions import text as X
from quillspark.functions.fixed import SPOKEN_FILLERS
from quillspark.operators.windows import runs


def low_confidence(confidence: Column) -> Column:
    """Strictly beyond any of the three bounds; a missing struct is no low confidence."""
    bad = (confidence["avg_logprob"] < -1.0) | (confidence["compression_ratio"] > 2.4) | (confidence["no_speech_prob"] > 0.6)
    return F.coalesce(bad, F.lit(False))


def repeated_segments(segments: DataFrame, keys: list[str], order: list[str], text: str = "text_raw") -> DataFrame:
    """segments with `looped`: three or more in a row with the same key of at least four characters."""
    keyed = runs(segments.withColumn("key_", X.compact(F.col(text))), keys, order, "key_")
    return keyed.withColumn("looped", (F.length("key_") >= 4) & (F.col("run_length") >= 3)).drop("key_", "run", "run_length")


def _key(text: str) -> str:
    return re.sub(r"[^\w]+", "", unicodedata.normalize("NFKC", text).casefold())


def _places(text: str) -> tuple[str, list[int]]:
    """The key of a text and, for each of its characters, where it stands in the text."""
    key, at = [], []
    for i, c in enumerate(text):
        k = _key(c)
        key.append(k)
        at += [i] * len(k)
    return "".join(key), at


def leak_start(key: str, prompt: str, n: int = 8) -> int | None:
    """Where the first run of n characters begins that the prompt has too."""
    grams = {prompt[i : i + n] for i in range(len(prompt) - n + 1)}
    return next((i for i in range(len(key) - n + 1) if key[i : i + n] in grams), None)


def loop_cut(key: str, unit: int = 4, times: int = 3, gap: int = 2) -> tuple[int, int] | None:
    """(from, to) in the key of what a loop says again: at the earliest start, the unit said most often, of those the longest; up
    to `gap` characters may stand between. The first saying stays.

    A second saying begins where the first `unit` characters stand again, so only those places give lengths to try.
    """
    places: dict[str, list[int]] = {}
    for i in range(len(key) - unit + 1):
        places.setdefault(key[i : i + unit], []).append(i)
    for start in range(len(key) - unit * times + 1):
        best = None
        most = (len(key) - start) // times
        lengths = {p - start - g for p in places[key[start : start + unit]] for g in range(gap + 1)}
        for n in sorted(n for n in lengths if unit <= n <= most):
            said, end = key[start : start + n], start + n
            count = 1
            while True:
                again = next((end + g for g in range(gap + 1) if key.startswith(said, end + g)), None)
                if again is None:
                    break
                end, count = again + n, count + 1
            if count >= times and (best is None or (count, n) > best[:2]):
                best = (count, n, end)
        if best:
            return start + best[1], best[2]
    return None


def filtered(segments: DataFrame, prompts: dict[str, str], phrases: list[str], text: str = "text_raw", course: str = "course") -> DataFrame:
    """segments (with `looped`) and kept, dropped, reason: stock phrases and loops over segments drop a segment; a prompt leak or a loop
    within it drops that part. `prompts` is the small table of course prompts."""
    kind = StructType([StructField("kept", StringType()), StructField("dropped", StringType()), StructField("reason", StringType())])
    stock = [k for k in map(_key, phrases) if k]
    leaks = {c: _key(p or "") for c, p in prompts.items()}

    def one(t: str | None, looped: bool, c: str | None) -> tuple[str | None, str | None, str | None]:
        if not t:
            return t, None, None
        key, at = _places(t)
        if any(p in key for p in stock):
            return None, t, "phrase"
        if looped:
            return None, t, "repeat"
        leak = leak_start(key, leaks.get(c or "", ""))
        if leak is not None:
            rest = t[: at[leak]].strip()
            return (rest or None, t[at[leak] :], "leak")
        cut = loop_cut(key)
        if cut:
            a, b = at[cut[0] - 1] + 1, at[cut[1] - 1] + 1
            return (t[:a] + t[b:]).strip() or None, t[a:b], "loop"
        return t, None, None

    @F.pandas_udf(kind)
    def split(t: pd.Series, looped: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*x) for x in zip(t, looped, c, strict=True)], columns=["kept", "dropped", "reason"])

    return segments.withColumn("f_", split(F.col(text), F.col("looped"), F.col(course))).select("*", "f_.*").drop("f_")


_LINE = re.compile(r"^\[(\d+(?:\.\d+)?)\]\s*(.*)$")


def aligned(output: str, labels: list[str]) -> list[str | None]:
    """Lines of a reply by their label, the first of equal ones; by position where counts agree and every label is within a second."""
    lines = [m.groups() for m in (_LINE.match(x.strip()) for x in output.splitlines()) if m]
    found: dict[str, str] = {}
    for label, text in lines:
        found.setdefault(label, text.strip())
    out = [found.get(x) for x in labels]
    if len(lines) == len(labels) and all(abs(float(a) - float(b)) <= 1.0 for (a, _), b in zip(lines, labels, strict=True)):
        out = [b if a is None else a for a, (_, b) in zip(out, lines, strict=True)]
    return out


def line_labels(starts: list[float]) -> list[str]:
    """Unique labels of times: one decimal, more where they collide."""
    used: list[str] = []
    for s in starts:
        shown = next((x for x in (f"{s:.{p}f}" for p in range(1, 7)) if x not in used), None)
        n = 0
        while shown is None:
            n += 1
            shown = f"{s + n / 1e6:.6f}" if f"{s + n / 1e6:.6f}" not in used else None
        used.append(shown)
    return used


def correction_scores(lines: DataFrame, keys: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """One row of each attempt: lines, matched, match_ratio, length_ratio, anomalies, abnormal_ratio, admissible, valid.

    An anomalous line was emptied though it had four characters besides fillers, or grew beyond twice its length and by over 20.
    """
    b, a = X.char_count(F.col(before)), X.char_count(F.col(after))
    spoken = F.length(F.regexp_replace(before, rf"(?U)[{SPOKEN_FILLERS}、，。！？!?\s]", ""))
    odd = F.col(after).isNotNull() & (((F.length(after) == 0) & (spoken >= 4)) | (a > F.greatest(2 * b, b + 20)))
    s = lines.groupBy(*keys).agg(F.count("*").alias("lines"), F.count(after).alias("matched"), F.coalesce(F.sum(b), F.lit(0)).alias("b"), F.coalesce(F.sum(a), F.lit(0)).alias("a"), F.sum(odd.cast("int")).alias("anomalies"))
    ratio = F.when(F.col("b") > 0, F.col("a") / F.col("b")).when(F.col("a") == 0, 1.0).otherwise(float("inf"))
    s = s.withColumns({"match_ratio": F.col("matched") / F.col("lines"), "length_ratio": ratio, "abnormal_ratio": F.col("anomalies") / F.col("lines")})
    fine = F.col("length_ratio").between(0.6, 1.5) & (F.col("abnormal_ratio") <= 0.05)
    return s.withColumns({"admissible": fine, "valid": fine & (F.col("matched") == F.col("lines"))}).drop("a", "b")


def chosen(attempts: DataFrame, keys: list[str], attempt: str = "attempt") -> DataFrame:
    """The attempt taken for each key and its status: the first valid one, else the admissible one that matched most, the first of
    equals; ok, partial from 0.95 matched, else failed."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("admissible"), F.desc("valid"), F.when(F.col("valid"), F.col(attempt)), F.desc("matched"), attempt))
    status = F.when(~F.col("admissible"), "failed").when(F.col("valid"), "ok").when(F.col("match_ratio") >= 0.95, "partial").otherwise("failed")
    return attempts.withColumn("n_", first).where("n_ = 1").drop("n_").withColumn("status", status)


def edits(reference: str, heard: str) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a shortest edit, found from the end: of equal ways a substitution or match before a deletion
    before an insertion. Takes time and bytes in proportion to the product of the lengths; a common end is left out first."""
    while reference and heard and reference[-1] == heard[-1]:
        k = 1
        while k < min(len(reference), len(heard)) and reference[-2 * k :] == heard[-2 * k :]:
            k *= 2
        reference, heard = reference[:-k], heard[:-k]
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (reference, heard))
    places = np.arange(len(b) + 1, dtype=np.int32)
    row, ways = places.copy(), np.zeros((len(a) + 1, len(b) + 1), np.uint8)
    ways[0, 1:] = 2
    for i, c in enumerate(a, 1):
        swap = row[:-1] + (b != c)
        best = np.empty_like(row)
        best[0] = i
        np.minimum(swap, row[1:] + 1, out=best[1:])
        best = np.minimum.accumulate(best - places) + places  # insertions carry on from the left
        ways[i, 1:] = np.where(best[1:] == swap, 0, np.where(best[1:] == row[1:] + 1, 1, 2))
        ways[i, 0] = 1
        row = best
    i, j, n = len(a), len(b), [0, 0, 0]
    while i or j:
        way = ways[i, j]
        n[way] += int(way > 0 or a[i - 1] != b[j - 1])
        i, j = i - (way < 2), j - (way != 1)
    return n[0], n[1], n[2]


def edit_counts(reference: Column, heard: Column) -> Column:
    kind = StructType([StructField(c, IntegerType()) for c in ("substitutions", "deletions", "insertions")])

    @F.pandas_udf(kind)
    def f(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([edits(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=kind.names)

    return f(reference, heard)


def term_counts(text: Column, terms: list[str]) -> Column:
    """How often each term stands in the text, longest first and without overlaps. The terms are a dimension, not data."""
    pattern = re.compile("|".join(map(re.escape, sorted(set(filter(None, terms)), key=lambda t: (-len(t), t)))) or "(?!)")

    @F.pandas_udf(MapType(StringType(), IntegerType()))
    def f(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> dict[str, int]:
            out: dict[str, int] = {}
            for m in pattern.finditer(t or ""):
                out[m[0]] = out.get(m[0], 0) + 1
            return out

        return s.map(one)

    return f(text)


def transcript_problems(raw: DataFrame, text: str = "value") -> DataFrame:
    """raw with `problems`: what is wrong with a transcript document in JSON; an empty list for a valid one."""
    import json

    top = {"schema", "source", "clip", "duration_sec", "engine", "created_at", "segments", "dropped"}
    need = {"start", "end", "text_raw", "text", "speaker", "confidence", "low_confidence"}

    def check(t: str | None) -> list[str]:
        try:
            d = json.loads(t or "")
        except ValueError:
            return ["not JSON"]
        if not isinstance(d, dict):
            return ["not an object"]
        out = [f"missing {k}" for k in sorted(top - d.keys())] + [f"unknown {k}" for k in sorted(d.keys() - top)]
        last = float("-inf")
        for i, s in enumerate(d.get("segments") or []):
            keys = set(s) - {"filtered"}
            out += [f"segment {i} misses {k}" for k in sorted(need - keys)] + [f"segment {i} has {k}" for k in sorted(keys - need)]
            a, b = s.get("start"), s.get("end")
            if type(s.get("low_confidence")) is not bool:
                out.append(f"segment {i} low_confidence is no boolean")
            if not all(isinstance(x, (int, float)) and type(x) is not bool for x in (a, b)) or b < a:
                out.append(f"segment {i} has bad times")
            elif a < last:
                out.append(f"segment {i} starts too early")
            else:
                last = a
        return out

    @F.pandas_udf(ArrayType(StringType()))
    def f(s: pd.Series) -> pd.Series:
        return s.map(check)

    return raw.withColumn("problems", f(F.col(text)))


def corrected_problems(raw: DataFrame, text: str = "value") -> DataFrame:
    """raw with `problems`: what is wrong with a corrected transcript in JSON: with its pieces, with what a correction adds to its lines, and
    with what is left without them, as for any transcript."""
    import json

    kept = {"text_asr", "corrected"}

    def check(t: str | None) -> tuple[list[str], str]:
        try:
            d = json.loads(t or "")
            pieces, lines = d["correction"]["chunks"], d["segments"]
        except (ValueError, KeyError, TypeError):
            return ["not a corrected document"], ""
        out = []
        for i, p in enumerate(pieces):
            if p.get("status") not in ("ok", "partial", "failed"):
                out.append(f"piece {i} has no status")
            if any(type(p.get(c)) is not int or p[c] < 0 for c in ("attempts", "searches", "fallback_lines")):
                out.append(f"piece {i} has bad counts")
        for i, s in enumerate(lines):
            if not isinstance(s.get("text_asr"), str) or type(s.get("corrected")) is not bool:
                out.append(f"line {i} lacks its correction")
            elif not s["corrected"] and s.get("text") != s["text_asr"]:
                out.append(f"line {i} differs though it isn't corrected")
        rest = {k: v for k, v in d.items() if k != "correction"} | {"segments": [{k: v for k, v in s.items() if k not in kept} for s in lines]}
        return out, json.dumps(rest)

    kind = StructType([StructField("own", ArrayType(StringType())), StructField("rest", StringType())])

    @F.pandas_udf(kind)
    def f(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check(t) for t in s], columns=["own", "rest"])

    checked = raw.withColumn("c_", f(F.col(text))).withColumn("rest_", F.col("c_.rest"))
    whole = transcript_problems(checked, "rest_")
    return whole.withColumn("problems", F.when(F.col("rest_") == "", F.col("c_.own")).otherwise(F.concat("c_.own", "problems"))).drop("c_", "rest_")


def aligned_lines(replies: DataFrame, keys: list[str], output: str = "output", labels: str = "labels") -> DataFrame:
    """(keys, at, label, line) of replies and the labels they should have: aligned() for a column; null for a line that isn't there."""

    @F.pandas_udf(ArrayType(StringType()))
    def f(o: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series([aligned(a or "", list(b)) for a, b in zip(o, l, strict=True)], dtype=object)

    both = replies.select(*keys, F.col(labels).alias("l_"), f(F.col(output), F.col(labels)).alias("a_"))
    return both.select(*keys, F.posexplode(F.arrays_zip(F.col("l_").alias("label"), F.col("a_").alias("line"))).alias("at", "x")).select(*keys, "at", "x.label", "x.line")

"""Scores of recognised speech against references: clips by settings, error rates, term recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import numerals
from quillspark.operators.links import longest_prefix
from quillspark.operators.quality import edit_counts, term_counts


def inside(segments: DataFrame, start: str, duration: str) -> DataFrame:
    """Segments (start, end) whose middle lies in [start, start + duration) of the columns so named."""
    middle = (F.col("start") + F.col("end")) / 2
    return segments.where((middle >= F.col(start)) & (middle < F.col(start) + F.col(duration)))


def term_keys(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, term), skipped terms) of terms (term): the first term of each scoring key; terms that hold fillers can't be compared, since
    scoring leaves fillers out, and are skipped."""
    keyed = terms.where("term <> ''").distinct().withColumns({"key": numerals.scored(F.col("term")), "whole": numerals.scored(F.col("term"), True)})
    fine = keyed.where((F.col("key") == F.col("whole")) & (F.col("key") != ""))
    return fine.groupBy("key").agg(F.min("term").alias("term")), keyed.where("key <> whole").select("term")


def grid(clips: DataFrame, settings: list[str], results: DataFrame, references: DataFrame) -> DataFrame:
    """Every clip with every setting of a given list: (label, setting, source, hypothesis, reference, segments), null where there is no
    result or no reference. `results` is (label, setting, hypothesis, segments, low_confidence, elapsed, audio)."""
    every = clips.withColumn("setting", F.explode(F.array(*[F.lit(s) for s in settings])))
    return every.join(results, ["label", "setting"], "left").join(references.select("label", "reference"), "label", "left")


def clip_scores(pairs: DataFrame, terms: list[str]) -> DataFrame:
    """pairs (hypothesis, reference, ...) with substitutions, deletions, insertions, chars, cer, term_reference, term_matched,
    term_recall and missed (term → how often). Rates are null where there is nothing to divide by; pairs without a
    side have null scores. `terms` are scoring keys, a dimension."""
    keyed = pairs.withColumns({"r_": numerals.scored(F.col("reference")), "h_": numerals.scored(F.col("hypothesis"))})
    there = F.col("r_").isNotNull() & F.col("h_").isNotNull()
    counted = keyed.withColumns({"e_": edit_counts(F.col("r_"), F.col("h_")), "tr_": term_counts(F.col("r_"), terms), "th_": term_counts(F.col("h_"), terms)})
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda a, x: a + x)
    of = lambda k: F.coalesce(F.element_at("th_", k), F.lit(0))
    both = F.transform_values("tr_", lambda k, n: F.least(n, of(k)))
    missed = F.map_filter(F.transform_values("tr_", lambda k, n: n - of(k)), lambda k, n: n > 0)
    edits = sum((F.col(f"e_.{c}") for c in ("deletions", "insertions")), F.col("e_.substitutions"))
    only = lambda c: F.when(there, c)
    scored = counted.withColumns(
        {c: only(F.col(f"e_.{c}")) for c in ("substitutions", "deletions", "insertions")}
        | {"chars": only(F.length("r_")), "cer": only(F.when(F.length("r_") > 0, edits / F.length("r_"))), "term_reference": only(total(F.col("tr_"))), "term_matched": only(total(both)), "missed": only(missed)}
    )
    return scored.withColumn("term_recall", F.when(F.col("term_reference") > 0, F.col("term_matched") / F.col("term_reference"))).drop("r_", "h_", "e_", "tr_", "th_")


def summary(scores: DataFrame) -> DataFrame:
    """(setting, clips, cer, chars, term_recall, term_reference, term_matched, mean_rtf, low_confidence): micro-averages over the clips that
    have scores; rtf is elapsed over audio, where there is audio."""
    some = scores.where("chars is not null")
    edits = F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    rtf = F.when(F.col("audio") > 0, F.col("elapsed") / F.col("audio"))
    part = lambda a, b: F.when(b > 0, a / b)
    return some.groupBy("setting").agg(
        F.count("*").alias("clips"), part(edits, F.sum("chars")).alias("cer"), F.sum("chars").alias("chars"), part(F.sum("term_matched"), F.sum("term_reference")).alias("term_recall"), F.sum("term_reference").alias("term_reference"), F.sum("term_matched").alias("term_matched"), F.avg(rtf).alias("mean_rtf"), part(F.sum("low_confidence"), F.sum("segments")).alias("low_confidence")
    )


def missed_terms(scores: DataFrame) -> DataFrame:
    """(setting, term, n) of the terms that weren't heard, most frequent first, ties by term."""
    return scores.where("missed is not null").select("setting", F.explode("missed").alias("term", "n")).groupBy("setting", "term").agg(F.sum("n").alias("n")).orderBy("setting", F.desc("n"), "term")


def with_course(clips: DataFrame, courses: DataFrame, default: str) -> DataFrame:
    """clips with `course`: the name of the course whose prefix their source begins with, the longest, else `default`."""
    named = longest_prefix(clips, courses, "source", "prefix", ["name"])
    return clips.join(named, "source", "left").withColumn("course", F.coalesce("name", F.lit(default))).drop("name")

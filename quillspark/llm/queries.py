"""The queries of this package, pN_..., over whole tables with production parameters, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import encoding, forms, mixture, mojibake, neardup, neighbours, pieces, repetition, scans, truncation
from quillspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "chunks"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_shares(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "cache"))


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "cache"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_of_all(table(spark, d, "cache"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(table(spark, d, "chunks"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "chunks"))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.looks_alike(table(spark, d, "chunks"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return forms.one_form(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(table(spark, d, "chunks"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scanned(table(spark, d, "chunks"))


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "chunks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_texts(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return encoding.round_trip(table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixture.mixture(mixture.sized(table(spark, d, "documents"), targets), targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixture.shares(mixture.sized(table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_shares, p2_found, p2_nearest, p2_neighbours, p3_found, p3_groups, p4_found, p4_restored, p5_found, p5_forms, p6_found, p6_pieces, p7_found, p7_paragraphs, p8_ids, p8_round_trip, p9_mixture, p9_shares, p10_found, p10_rates)}

ORACLES: dict[str, str] = {
    "p1_found": """
WITH plain AS (SELECT "row", regexp_replace(lower(raw_text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM chunks WHERE raw_text IS NOT NULL),
grams AS (SELECT "row", length(t) AS n, i, substr(t, i, 12) AS g FROM plain, LATERAL (SELECT unnest(range(1, length(t) - 10)) AS i)),
later AS (SELECT "row", n, i FROM (SELECT *, row_number() OVER (PARTITION BY "row", g ORDER BY i) AS k FROM grams) WHERE k > 1),
covered AS (SELECT DISTINCT "row", n, p FROM later, LATERAL (SELECT unnest(range(i, i + 12)) AS p))
SELECT "row" FROM covered GROUP BY "row", n HAVING count(*) >= 0.3 * n""",
    "p2_found": """
WITH v AS (SELECT key, vec::DOUBLE[] AS vec FROM cache WHERE len(vec) > 0 AND list_sum(list_transform(vec, lambda x: x * x)) > 0),
s AS (SELECT a.key AS k, b.key AS o, list_cosine_similarity(a.vec, b.vec) AS c FROM v a JOIN v b ON a.key <> b.key),
r AS (SELECT k, o, c, row_number() OVER (PARTITION BY k ORDER BY c DESC, o) AS n FROM s)
SELECT DISTINCT least(k, o) AS key_a, greatest(k, o) AS key_b FROM r WHERE n <= 10 AND c >= 0.9""",
    "p6_found": 'SELECT "row" FROM chunks WHERE length(text) > 600',
}

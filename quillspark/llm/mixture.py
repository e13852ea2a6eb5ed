"""Problem 9: a mixture of sources with target shares of the total tokens.

Tokens are aggregated per source, repetition rates follow, and each text comes out floor(rate) times plus one more time with
the fraction's probability, decided by a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written
from quillspark.llm.encoding import DEFAULT_RANKS, token_counts

SEED = 20
#: Targets up to which their table is broadcast.
FEW = 20_000


def sized(documents: DataFrame, targets: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, source, tokens) of one document for each distinct text of the sources with a target: the smallest doc_id.

    A text that comes again, under whatever id or source, is the same text and belongs to that document. Null and empty texts
    have no tokens and are left out. Written once, because two passes follow. Tokens are counted before copies are merged, in the
    scan: then a row of 16 bytes and its numbers is shuffled, and no text.
    """
    wanted = targets.where("weight > 0").select("source").distinct()
    rows = documents.where(F.length("text") > 0).join(wanted, "source", "left_semi").withColumn("digest", F.unhex(F.md5("text")))
    counted = token_counts(rows, "doc_id", "text", ranks_path, keep=("source", "digest"))
    first = counted.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("first"))
    return written(first.select("first.*"))


def rates(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: target_share, tokens, rate. `documents` is what sized() gives.

    A target can be met if its weight is positive, its cap isn't zero and its source has text; the others get share and rate 0.
    Of a source named twice the weights add up and the least cap holds. The total is the largest that every cap allows, at
    most the tokens there are. Only this table, as long as the targets, passes through one task.
    """
    have = documents.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"))
    wish = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.min("max_repeats").cast("double").alias("cap"))
    both = wish.join(have, "source", "left").fillna({"tokens": 0, "texts": 0})
    met = (F.col("weight") > 0) & (F.col("tokens") > 0) & (F.coalesce("cap", F.lit(1.0)) > 0)
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(1))
    shared = both.withColumn("target_share", F.when(met, F.col("weight") / F.sum(F.when(met, F.col("weight"))).over(every)).otherwise(0.0))
    reach = F.when(met, F.col("cap") * F.col("tokens") / F.col("target_share"))
    total = F.least(F.min(reach).over(every), F.sum(F.when(met, F.col("tokens"))).over(every).cast("double"))
    rate = F.when(met, F.least(total * F.col("target_share") / F.col("tokens"), F.coalesce("cap", F.lit(float("inf"))))).otherwise(0.0)
    return shared.withColumn("total", total).withColumn("rate", rate).drop("weight")


def mixture(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, copy, source, tokens): each document as often as its source's rate asks for. `documents` is what sized() gives.

    The hash depends on the document and the seed only, so a run again, in whatever partitions, gives the same rows. Caps
    hold exactly: a rate of at most the cap gives at most the cap's number of copies.
    """
    few = rates(documents, targets).select("source", "rate", "cap")
    # as many rows as targets; the documents are never the side that is broadcast
    joined = documents.join(F.broadcast(few), "source") if targets.count() <= FEW else documents.hint("merge").join(few, "source")
    whole = F.floor(F.col("rate") + 1e-9)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = (whole + F.when(chance < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return joined.withColumn("copies", copies).where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "source", "tokens")


def shares(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per target source: target_share, actual_share, rate, cap, tokens, texts, texts_used, actual_tokens, most_repeats, and how far
    the share is off its target, `deviation`, beside the standard error of the tokens that the last copies, drawn by
    chance, lead to, `expected`; both as parts of the target. A source of few texts deviates by much."""
    used = mixture(documents, targets, seed).groupBy("source").agg(F.sum("tokens").alias("actual_tokens"), F.max("copy").alias("most_repeats"), F.count(F.when(F.col("copy") == 1, 1)).alias("texts_used"))
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(1))
    squares = documents.groupBy("source").agg(F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("squares"))
    both = rates(documents, targets).join(squares, "source", "left").join(used, "source", "left").fillna({"actual_tokens": 0, "most_repeats": 0, "texts_used": 0})
    return both.withColumn("actual_share", F.coalesce(F.col("actual_tokens") / F.sum("actual_tokens").over(every), F.lit(0.0))).withColumns(
        {"deviation": F.when(F.col("target_share") > 0, F.col("actual_share") / F.col("target_share") - 1), "expected": F.when(F.col("rate") > 0, F.sqrt((F.col("rate") - F.floor("rate")) * (1 - F.col("rate") + F.floor("rate")) * F.col("squares")) / (F.col("rate") * F.col("tokens")))}
    ).select("source", "target_share", "actual_share", "deviation", "expected", "rate", "cap", "tokens", "texts", "texts_used", "actual_tokens", "most_repeats")

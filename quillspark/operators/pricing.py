"""Prices that change by date, usage in several shapes, and what it costs. Prices are tables of the caller's, per million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.metering import parsed, provider
from quillspark.operators.windows import asof

#: Kinds of tokens, and the columns of a price table besides model and start.
KINDS = ("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens")
FIELDS = ("input", "cache_read", "cache_write", "output")


def overlaid(prices: DataFrame, override: DataFrame) -> DataFrame:
    """(model, the fields): prices with those of `override` in their place, model by model; an override without all fields is an error."""
    whole = override.select("model", *[F.when(F.col(f).isNull(), F.raise_error(F.concat(F.lit("no price of "), F.col("model")))).otherwise(F.col(f)).alias(f) for f in FIELDS])
    both = prices.select("model", F.struct(*FIELDS).alias("a")).join(whole.select("model", F.struct(*FIELDS).alias("b")), "model", "full_outer")
    return both.select("model", *[F.coalesce("b", "a")[f].alias(f) for f in FIELDS])


def priced(usage: DataFrame, prices: DataFrame, day: str = "day") -> DataFrame:
    """usage (model, day, ...) with the fields of the price that holds on its day: the one with the latest `start` not after it, null for none."""
    return asof(usage, prices.withColumn("tie_", F.lit(0)), ["model"], day, "start", "tie_", list(FIELDS))


def cost() -> Column:
    """Of a row with tokens of each kind and the fields of a price, in money. Null tokens count as 0."""
    return sum((F.coalesce(F.col(k), F.lit(0)) * F.col(f) for k, f in zip(KINDS, FIELDS, strict=True)), F.lit(0.0)) / 1e6


def request_costs(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """(id, the kinds of tokens, cost, estimated) of requests (id, requested, model, usage, iterations).

    Where an iteration was answered by a fall-back (type fallback_message), the usage on top is the last one's only: then each
    iteration that was billed counts, at its own model's price. A model without a price is taken at the requested one's and
    counts as estimated. `prices` is (model, fields).
    """
    billed = F.filter("iterations", lambda i: i["type"].isin("message", "fallback_message"))
    several = F.exists(F.coalesce(billed, F.array()), lambda i: i["type"] == "fallback_message")
    top = F.array(F.struct(F.coalesce("model", "requested").alias("model"), F.col("usage")))
    each = F.transform(billed, lambda i: F.struct(F.coalesce(i["model"], F.col("requested")).alias("model"), i["usage"].alias("usage")))
    entries = requests.select("id", "requested", F.explode(F.when(several, each).otherwise(top)).alias("e")).select("id", "requested", "e.model", "e.usage.*")
    own = prices.select("model", F.struct(*FIELDS).alias("own"))
    asked = prices.select(F.col("model").alias("requested"), F.struct(*FIELDS).alias("asked"))
    both = entries.join(own, "model", "left").join(asked, "requested", "left").withColumn("p", F.coalesce("own", "asked"))
    lines = both.select("id", *KINDS, F.col("own").isNull().alias("estimated"), *[F.col("p")[f].alias(f) for f in FIELDS]).withColumn("cost", cost())
    return lines.groupBy("id").agg(*[F.sum(F.coalesce(F.col(k), F.lit(0))).alias(k) for k in KINDS], F.sum("cost").alias("cost"), F.sum(F.col("estimated").cast("int")).alias("estimated"))


def mapped_usage(prompt: Column, cached: Column, candidates: Column, thoughts: Column, tool: Column) -> list[Column]:
    """The kinds of tokens of a provider that counts cached tokens into the prompt, and thoughts apart from the answer."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return [(F.greatest(n(prompt) - n(cached), F.lit(0)) + n(tool)).alias(KINDS[0]), n(cached).alias(KINDS[1]), F.lit(0).alias(KINDS[2]), (n(candidates) + n(thoughts)).alias(KINDS[3])]


def spent(log: DataFrame, now: str, hours: int = 8) -> DataFrame:
    """(provider, today, today_cost, month, month_cost) of an answer log at a point of time, by days and months of a zone of fixed
    offset. Lines without a valid time or with a cost that isn't finite are left out; no cost counts as 0."""
    local = F.to_date(F.to_timestamp(F.lit(now)) + F.make_interval(hours=F.lit(hours)))
    rows = parsed(log).where(F.col("at").isNotNull() & ~F.isnan("cost") & (F.abs("cost") < float("inf")))
    some = rows.withColumn("day", F.to_date(F.col("at") + F.make_interval(hours=F.lit(hours)))).where(F.trunc("day", "month") == F.trunc(local, "month"))
    today = F.col("day") == local
    return some.groupBy(provider(F.col("model")).alias("provider")).agg(F.count(F.when(today, 1)).alias("today"), F.coalesce(F.sum(F.when(today, F.col("cost"))), F.lit(0.0)).alias("today_cost"), F.count("*").alias("month"), F.sum("cost").alias("month_cost"))

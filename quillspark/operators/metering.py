"""Roll-ups of an answer log: days and months in a fixed zone, usage, error kinds, progress, alerts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.dedupe import last_wins
from quillspark.operators.windows import folded


def parsed(log: DataFrame) -> DataFrame:
    """One row of each log_id, the one received last, with `at` (null for a missing or invalid time) and `cost` (0 for null)."""
    once = last_wins(log, ["log_id"], [F.desc("received_at"), F.desc("rounds"), F.desc("input_tokens")])
    return once.withColumns({"at": F.try_to_timestamp("time"), "cost": F.coalesce("cost_usd", F.lit(0.0))})


def costs(log: DataFrame, hours: int = 8) -> DataFrame:
    """(model, day, month, questions, cost): days in a zone of fixed offset; lines without a time or with NaN cost are left out."""
    fine = parsed(log).where(F.col("at").isNotNull() & ~F.isnan("cost"))
    local = fine.withColumn("day", F.to_date(F.col("at") + F.make_interval(hours=F.lit(hours))))
    return local.groupBy("model", "day").agg(F.count("*").alias("questions"), F.sum("cost").alias("cost")).withColumn("month", F.date_format("day", "yyyy-MM"))


def gate(log: DataFrame, budget: float, hours: int = 8) -> DataFrame:
    """(log_id, day, spent, open): what the day had cost before each question, and whether the budget let it pass."""
    fine = parsed(log).where(F.col("at").isNotNull() & ~F.isnan("cost")).withColumn("day", F.to_date(F.col("at") + F.make_interval(hours=F.lit(hours))))
    w = Window.partitionBy("day").orderBy("at", "log_id").rowsBetween(Window.unboundedPreceding, -1)
    return fine.select("log_id", "day", F.coalesce(F.sum("cost").over(w), F.lit(0.0)).alias("spent")).withColumn("open", F.col("spent") < budget)


def error_kind(error: Column) -> Column:
    """ok, network, quota, empty or other."""
    e = F.lower(error)
    return F.when(error.isNull(), "ok").when(e.rlike("quota|rate.?limit|429"), "quota").when(e.rlike("timeout|connection|network|unavailable|50[234]"), "network").when(e == "", "empty").otherwise("other")


#: What a model's name begins with and its provider, as a parameter: each deployment has its own.
PROVIDERS = {"quill-": "quill", "reed-": "reed"}


def provider(model: Column, known: dict[str, str] | None = None) -> Column:
    """The provider by the model's prefix; other for any other model and for none."""
    out = F.lit("other")
    for prefix, name in (PROVIDERS if known is None else known).items():
        out = F.when(F.startswith(model, F.lit(prefix)), name).otherwise(out)
    return out


def usage(log: DataFrame) -> DataFrame:
    """(provider, effort, kind, requests, input_tokens, output_tokens, mean_rounds)."""
    p = parsed(log)
    return p.groupBy(provider(F.col("model")).alias("provider"), "effort", error_kind(F.col("error_type")).alias("kind")).agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.avg("rounds").alias("mean_rounds"))


def remaining(progress: DataFrame, left_hours: Column) -> DataFrame:
    """progress with `eta_hours`: how long what is left takes at the speed so far; null without a speed."""
    return progress.withColumn("eta_hours", F.when(F.col("speed") > 0, left_hours / F.col("speed")))


def progress(rows: DataFrame, keys: list[str], done_hours: Column, wall_hours: Column) -> DataFrame:
    """(keys, items, speed): hours of material for an hour of work."""
    s = rows.groupBy(*keys).agg(F.count("*").alias("items"), F.sum(done_hours).alias("d"), F.sum(wall_hours).alias("w"))
    return s.select(*keys, "items", F.when(F.col("w") > 0, F.col("d") / F.col("w")).alias("speed"))


class Alerts:
    """Of one key's rows in order those that send. Holds whether it is active and when it last sent."""

    def __init__(self, resend_micros: int) -> None:
        self.resend, self.active, self.sent = resend_micros, False, 0

    def step(self, row: dict) -> Iterator[dict]:
        if row["active_"] and (not self.active or row["micros_"] - self.sent >= self.resend):
            self.sent = row["micros_"]
            yield {c: v for c, v in row.items() if c not in ("active_", "micros_")}
        self.active = bool(row["active_"])

    def end(self) -> Iterator[dict]:
        return iter(())


def alerts(rows: DataFrame, keys: list[str], ts: str, order: list[str], active: Column, resend_seconds: int = 6 * 3600) -> DataFrame:
    """(keys, order) of the rows that send: on each rising edge, and while active again once `resend_seconds` have passed since the last
    one was sent; cleared when inactive. Each decision depends on the one before, so this is a fold over the rows of a key."""
    columns = [*keys, *order]
    some = rows.select(*columns, F.unix_micros(F.col(ts).cast("timestamp")).alias("micros_"), F.coalesce(active, F.lit(False)).alias("active_"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return folded(some, keys, ["micros_", *order], fields, lambda: Alerts(resend_seconds * 1_000_000))


def longest_countdown(text: Column) -> Column:
    """The longest of the reset countdowns in a text (1d2h3m), in seconds; null for none."""
    found = F.regexp_extract_all(text, F.lit(r"((?:\d+d)?(?:\d+h)?\d+m|(?:\d+d)?\d+h|\d+d)"), F.lit(1))
    part = lambda s, unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(s, rf"(\d+){unit}", 1), F.lit("")), F.lit("99999")).cast("bigint"), F.lit(0))
    return F.array_max(F.transform(found, lambda s: part(s, "d") * 86400 + part(s, "h") * 3600 + part(s, "m") * 60))

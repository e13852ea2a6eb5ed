"""State of long-running work: what can be reused, what to do again, events rolled up, windows of quotas, staleness."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.dedupe import differences
from quillspark.operators.windows import folded


def reusable(wanted: DataFrame, done: DataFrame, keys: list[str], same: list[str], lines: list[str], status: str = "status") -> DataFrame:
    """(keys) of pieces whose earlier result holds: it is ok, its settings and bounds (`same`) are equal, and so are all its lines.

    Both sides are (keys, line, same, lines); a piece with other lines, or more or fewer, has to be done again.
    """
    a = wanted.select(*keys, "line", F.struct(*same, *lines).alias("a"))
    b = done.select(*keys, "line", F.struct(*same, *lines).alias("b"), F.col(status).alias("status_"))
    both = a.join(b, [*keys, "line"], "full_outer")
    fits = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a").eqNullSafe(F.col("b")) & (F.col("status_") == "ok")
    return both.groupBy(*keys).agg(F.min(F.coalesce(fits, F.lit(False)).cast("int")).alias("ok_")).where("ok_ = 1").select(*keys)


def first_mismatch(one: DataFrame, two: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, at, reason): of each document the first place where two versions of it differ: a line missing or extra, or a column."""
    return differences(one, two, [key, order], columns).groupBy(key).agg(F.min(order).alias("at"), F.min_by("reason", order).alias("reason"))


def first_over_all(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of all in order, however many documents they are from."""
    return rows.orderBy(*order).limit(n)


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(by, value, n): how many rows have each value of each of the columns, in one pass."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).groupBy("x.by", "x.value").agg(F.count("*").alias("n"))


def next_attempts(attempts: DataFrame, wanted: DataFrame, keys: list[str], n: str = "attempt") -> DataFrame:
    """(keys, attempt): one more than the largest there is, 1 where there is none."""
    return wanted.select(*keys).distinct().join(attempts.groupBy(*keys).agg(F.max(n).alias("m_")), keys, "left").select(*keys, (F.coalesce("m_", F.lit(0)) + 1).alias(n))


def allowed_calls(audit: DataFrame, tool: str) -> DataFrame:
    """(label, n) of the calls of a tool that an audit log (value: JSON lines) let pass; lines that can't be read are skipped."""
    lines = audit.select(F.from_json("value", "label string, tool string, allow boolean").alias("x")).select("x.*")
    return lines.where((F.col("tool") == tool) & F.col("allow") & F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))


def rolled_up(events: DataFrame, key: str, order: str, tool: str) -> DataFrame:
    """(key, output, searches, denied, other_tools, input_tokens, output_tokens) of a run's event log (key, order, value: JSON lines).

    A call of `tool` counts unless its result was an error, and then as denied; the last result event gives the output, if it
    succeeded, and the usage.
    """
    block = "struct<type: string, id: string, name: string, tool_use_id: string, is_error: boolean>"
    kind = f"type string, subtype string, is_error boolean, result string, usage struct<input_tokens: bigint, output_tokens: bigint>, message struct<content: array<{block}>>"
    read = events.select(key, order, F.from_json("value", kind).alias("e")).where("e.type is not null")
    blocks = read.select(key, F.col("e.type").alias("of"), F.explode("e.message.content").alias("b"))
    calls = blocks.where("of = 'assistant' and b.type = 'tool_use'").select(key, F.col("b.id").alias("id"), F.col("b.name").alias("name")).dropDuplicates([key, "id"])
    wrong = blocks.where("of = 'user' and b.type = 'tool_result' and b.is_error").select(key, F.col("b.tool_use_id").alias("id"), F.lit(True).alias("wrong")).distinct()
    used = calls.join(wrong, [key, "id"], "left").groupBy(key).agg(
        F.count(F.when((F.col("name") == tool) & F.col("wrong").isNull(), 1)).alias("searches"), F.count(F.when((F.col("name") == tool) & F.col("wrong"), 1)).alias("denied"), F.count(F.when(F.col("name") != tool, 1)).alias("other_tools")
    )
    last = read.where("e.type = 'result'").groupBy(key).agg(F.max_by("e", order).alias("r"))
    fine = ~F.coalesce(F.col("r.is_error"), F.lit(False)) & (F.col("r.subtype") == "success")
    out = read.select(key).distinct().join(used, key, "left").join(last, key, "left").fillna({"searches": 0, "denied": 0, "other_tools": 0})
    return out.select(key, F.when(fine, F.col("r.result")).otherwise("").alias("output"), "searches", "denied", "other_tools", F.col("r.usage.input_tokens").alias("input_tokens"), F.col("r.usage.output_tokens").alias("output_tokens"))


class QuotaWindow:
    """The window of a quota from readings in order: one whose reset is over a minute later begins a window, one within a minute of it is of
    the same window and raises what is used, an earlier one is late and says nothing."""

    def __init__(self) -> None:
        self.used, self.reset = None, None

    def step(self, row: dict) -> Iterator[dict]:
        if self.reset is None or row["reset_"] > self.reset + 60:
            self.used, self.reset = row["used_"], row["reset_"]
        elif row["reset_"] >= self.reset - 60:
            self.used, self.reset = max(self.used, row["used_"]), max(self.reset, row["reset_"])
        yield {c: v for c, v in row.items() if c not in ("used_", "reset_")} | {"used": self.used, "reset": self.reset}

    def end(self) -> Iterator[dict]:
        return iter(())


def quota_windows(readings: DataFrame, key: str, order: str, used: str, reset: str) -> DataFrame:
    """(key, order, used, reset): the state of a quota after each reading; `reset` is in seconds."""
    rows = readings.select(key, order, F.col(used).cast("double").alias("used_"), F.col(reset).cast("double").alias("reset_"))
    kinds = ", ".join(f"{c} {readings.schema[c].dataType.simpleString()}" for c in (key, order))
    return folded(rows, [key], [order], f"{kinds}, used double, reset double", QuotaWindow)


class Throttle:
    """Rows at least `gap` after the last one that passed; the first passes `gap` after the beginning, which is the key's first row."""

    def __init__(self, gap: float) -> None:
        self.gap, self.last = gap, None

    def step(self, row: dict) -> Iterator[dict]:
        if self.last is None or row["t_"] - self.last >= self.gap:
            self.last = row["t_"]
            yield {c: v for c, v in row.items() if c != "t_"}

    def end(self) -> Iterator[dict]:
        return iter(())


def throttled(rows: DataFrame, key: str, ts: str, order: str, seconds: float) -> DataFrame:
    """(key, order) of the rows that a limit of one in `seconds` lets pass."""
    some = rows.select(key, order, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t_"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, order))
    return folded(some, [key], ["t_", order], kinds, lambda: Throttle(seconds))


def stale(status: Column, now: Column, updated: Column, progress: Column, paused_until: Column, minutes: int = 45, overdue: int = 30) -> Column:
    """What is wrong with a run: stuck (running, neither an update nor progress for over 45 minutes), overdue (paused, over 30 minutes
    past the time it was to go on at), null if nothing is."""
    over = lambda c, m: F.unix_micros(now) - F.unix_micros(c) > m * 60_000_000
    return F.when((status == "running") & over(updated, minutes) & over(progress, minutes), "stuck").when((status == "paused") & over(paused_until, overdue), "overdue")


class Failures:
    """Readings at which failures have grown by at least `least` over a baseline, which moves to every reading at which they don't grow
    and to every one that is reported."""

    def __init__(self, least: int) -> None:
        self.least, self.base, self.before = least, 0, None

    def step(self, row: dict) -> Iterator[dict]:
        n = row["failed_"]
        if self.before is not None and n <= self.before:
            self.base = n
        if n - self.base >= self.least:
            yield {c: v for c, v in row.items() if c != "failed_"} | {"grown": n - self.base}
            self.base = n
        self.before = n

    def end(self) -> Iterator[dict]:
        return iter(())


def failure_growth(status: DataFrame, key: str, order: str, failed: str, least: int = 3) -> DataFrame:
    """(key, order, grown) of the readings that report new failures."""
    rows = status.select(key, order, F.col(failed).cast("bigint").alias("failed_"))
    kinds = ", ".join(f"{c} {status.schema[c].dataType.simpleString()}" for c in (key, order))
    return folded(rows, [key], [order], f"{kinds}, grown bigint", lambda: Failures(least))


def daily_firsts(rows: DataFrame, keys: list[str], ts: str, order: list[str], hour: int, offset_hours: int = 8) -> DataFrame:
    """The first row of each key and local date that isn't before `hour`: when the day's summary is sent."""
    local = F.col(ts).cast("timestamp") + F.make_interval(hours=F.lit(offset_hours))
    some = rows.withColumn("day_", F.to_date(local)).where(F.hour(local) >= hour)
    w = Window.partitionBy(*keys, "day_").orderBy(ts, *order)
    return some.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_", "day_")


#: Of a tool's arguments: their kind, bounds (of a whole number, or of a text's length), default; no default: it has to be there.
Arguments = dict[str, tuple[type, int, int, object]]


def arguments(spec: Arguments, given: object) -> dict:
    """The arguments of a call with their defaults; unknown ones, wrong kinds and values out of bounds are errors. Texts are trimmed, and
    not empty; true and false are no numbers."""
    if not isinstance(given, dict):
        raise ValueError("arguments are an object")
    if given.keys() - spec.keys():
        raise ValueError(f"unknown arguments: {sorted(given.keys() - spec.keys())}")
    out = {}
    for name, (kind, lo, hi, default) in spec.items():
        value = given.get(name, default)
        value = value.strip() if isinstance(value, str) else value
        if type(value) is not kind or not lo <= (len(value) if kind is str else value) <= hi:
            raise ValueError(f"{name} is not a {kind.__name__} from {lo} to {hi}")
        out[name] = value
    return out

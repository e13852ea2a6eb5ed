"""Pages of print from their glyphs: over-printing, columns, rows, paragraphs. Every step is relational; a page is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.layout import furniture, joined_texts

PAGE = ["doc", "page"]


def without_overprint(glyphs: DataFrame, keys: list[str] = PAGE, near: float = 1.5) -> DataFrame:
    """Glyphs (keys, n, char, x, y, ...) that don't repeat an earlier one: the same character within `near` of it in both directions, as
    bold print is faked. Only glyphs of one character in neighbouring cells of a grid meet. White space is never repeated."""
    cell = lambda c: F.round(F.col(c) / near).cast("int")
    placed = glyphs.withColumns({"cx_": cell("x"), "cy_": cell("y")})
    solid = placed.where(F.trim("char") != "")
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    around = solid.select(*keys, "char", F.col("n").alias("n0"), F.col("x").alias("x0"), F.col("y").alias("y0"), "cx_", "cy_", F.explode(steps).alias("s"))
    around = around.select(*keys, "char", "n0", "x0", "y0", (F.col("cx_") + F.col("s.dx")).alias("cx_"), (F.col("cy_") + F.col("s.dy")).alias("cy_"))
    again = solid.join(around, [*keys, "char", "cx_", "cy_"]).where((F.col("n0") < F.col("n")) & (F.abs(F.col("x0") - F.col("x")) <= near) & (F.abs(F.col("y0") - F.col("y")) <= near))
    return glyphs.join(again.select(*keys, "n").distinct(), [*keys, "n"], "left_anti")


def in_columns(spans: DataFrame, keys: list[str] = PAGE, gap: int = 15) -> DataFrame:
    """Spans (keys, width, x0, x1, ...) with `column`: 0 and 1 on pages that have an empty band of at least `gap` points in the middle half,
    which no span crosses, with spans on both sides of it; else 0. Pages of fewer than four spans have one column. The widest band counts."""
    by_x = Window.partitionBy(*keys).orderBy(F.floor("x0"), F.floor("x1"))
    lo, hi = F.floor(F.col("width") * 0.25), F.floor(F.col("width") * 0.75)
    reach = F.max(F.floor("x1")).over(by_x.rowsBetween(Window.unboundedPreceding, -1))
    # bands of whole points that nothing covers: between what was reached and the next span, before the first, after the last
    page = Window.partitionBy(*keys)
    marked = spans.withColumns({"from_": F.greatest(F.coalesce(reach + 1, F.lit(0)), lo), "to_": F.least(F.floor("x0") - 1, hi), "end_": F.max(F.floor("x1")).over(page) + 1, "spans_": F.count("*").over(page)})
    bands = marked.select(*keys, "spans_", F.explode(F.array(F.struct(F.col("from_").alias("a"), F.col("to_").alias("b")), F.struct(F.greatest("end_", lo).alias("a"), hi.alias("b")))).alias("band")).select(*keys, "spans_", "band.*")
    wide = bands.where((F.col("b") - F.col("a") + 1 >= gap) & (F.col("spans_") >= 4))
    best = wide.groupBy(*keys).agg(F.max(F.struct((F.col("b") - F.col("a")).alias("w"), (-F.col("a")).alias("first"), ((F.col("a") + F.col("b")) / 2).alias("middle"))).alias("m")).select(*keys, F.col("m.middle").alias("middle_"))
    placed = spans.join(best, keys, "left").withColumns({"left_": F.col("x1") <= F.col("middle_"), "right_": F.col("x0") >= F.col("middle_")})
    both = F.coalesce(F.max("left_").over(page) & F.max("right_").over(page), F.lit(False))
    return placed.withColumn("column", F.when(both & F.col("right_"), 1).otherwise(0)).drop("middle_", "left_", "right_")


def in_rows(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, x0, y0, x1, y1, text) with `line`: those whose middles are less than half a span's height from the row above are one row."""
    middle = (F.col("y0") + F.col("y1")) / 2
    w = Window.partitionBy(*keys).orderBy("middle_", "x0")
    placed = spans.withColumn("middle_", middle).withColumn("height_", F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)))

    # a row is told by where it begins, so the rule is a fold over the few spans of a page
    def fold(acc, s):
        same = (acc["n"] > 0) & (F.abs(s["m"] - acc["at"]) < s["h"] * 0.5)
        return F.struct(F.when(same, acc["at"]).otherwise(s["m"]).alias("at"), F.when(same, acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.concat(acc["lines"], F.array(F.when(same, acc["n"]).otherwise(acc["n"] + 1))).alias("lines"))

    numbered = placed.withColumn("i_", F.row_number().over(w))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("lines"))
    rows = numbered.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i_", F.col("middle_").alias("m"), F.col("height_").alias("h")))).alias("all")).select(*keys, F.posexplode(F.aggregate("all", start, fold)["lines"]).alias("i_", "line"))
    return numbered.join(rows.withColumn("i_", F.col("i_") + 1), [*keys, "i_"]).drop("middle_", "height_", "i_")


def paragraphs(lines: DataFrame, keys: list[str], indent: float = 12, short: float = 30) -> DataFrame:
    """(keys, at, paragraph) of lines (keys, line, x0, x1, text): one begins at a line that is indented by more than `indent` against the
    middle of the left edges, or follows one that ends more than `short` before the middle of the right edges. The middle is the entry at half
    of the sorted ones, no mean of two."""
    page = Window.partitionBy(*keys)
    at_half = lambda c: F.element_at(F.sort_array(F.collect_list(c).over(page)), F.floor(F.count("*").over(page) / 2).cast("int") + 1)
    placed = lines.withColumns({"left_": at_half("x0"), "right_": at_half("x1")})
    w = page.orderBy("line")
    begins = (F.col("x0") - F.col("left_") > indent) | (F.col("right_") - F.lag("x1").over(w) > short) | F.lag("x1").over(w).isNull()
    numbered = placed.withColumn("at", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "at").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l")).select(*keys, "at", joined_texts(F.col("l.text")).alias("paragraph"))


def read(spans: DataFrame) -> DataFrame:
    """(doc, page, column, at, paragraph) of spans (doc, page, width, x0, y0, x1, y1, text): page furniture out, columns, rows, paragraphs."""
    body = furniture(spans.withColumns({"x": F.col("x0"), "y": F.col("y0")}), ["doc"]).drop("x", "y")
    keys = [*PAGE, "column"]
    rows = in_rows(in_columns(body), keys)
    lines = rows.groupBy(*keys, "line").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))).alias("l")).select(*keys, "line", F.col("l")[0]["x0"].alias("x0"), F.element_at("l", -1)["x1"].alias("x1"), joined_texts(F.col("l.text")).alias("text"))
    return paragraphs(lines.where("text <> ''"), keys)

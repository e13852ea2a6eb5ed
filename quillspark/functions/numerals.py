"""Chinese numerals, both ways, and scoring text normalisation, as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from quillspark.functions.fixed import FILLERS

DIGITS = "零一二三四五六七八九"
UNITS = {"十": 10, "百": 100, "千": 1000}
BIG = {"萬": 10_000, "万": 10_000, "億": 100_000_000, "亿": 100_000_000}


def to_number(text: str) -> int | None:
    """The value of a numeral in Chinese or Arabic digits; null for anything else."""
    text = text.translate(str.maketrans("〇兩两", "零二二"))
    if text.isdigit() and text.isascii():
        return int(text)
    if not text or any(c not in DIGITS and c not in UNITS and c not in BIG for c in text):
        return None
    if all(c in DIGITS for c in text):
        return int("".join(str(DIGITS.index(c)) for c in text))
    total = part = digit = 0
    for c in text:
        if c in DIGITS:
            digit = DIGITS.index(c)
        elif c in UNITS:
            part, digit = part + (digit or 1) * UNITS[c], 0
        else:
            total, part, digit = (total + part + digit) * BIG[c], 0, 0
    return total + part + digit


def to_reading(n: int) -> str:
    """How a whole number is read."""
    if n < 0:
        return "負" + to_reading(-n)
    if n < 10:
        return DIGITS[n]
    for word, size in (("億", 10**8), ("萬", 10**4)):
        if n >= size:
            rest = n % size
            return to_reading(n // size) + word + ("" if not rest else ("零" if rest < size // 10 else "") + to_reading(rest))
    out, gap = "", False
    for word, size in (("千", 1000), ("百", 100), ("十", 10), ("", 1)):
        d = n // size % 10
        if d:
            out += ("零" if gap and out else "") + DIGITS[d] + word
        gap = not d
    return out[1:] if 10 <= n < 20 else out


def reading(text: str) -> str:
    """Numbers in a text, decimals too, as they are read."""

    def one(m: re.Match[str]) -> str:
        whole, _, part = m[0].partition(".")
        return to_reading(int(whole)) + ("點" + "".join(DIGITS[int(c)] for c in part) if part else "")

    return re.sub(r"\d+(?:\.\d+)?", one, text, flags=re.ASCII)


def score_text(text: str, keep_fillers: bool = False) -> str:
    """What is compared in scoring: NFKC, numbers as read, fillers out, Han and letters and digits only."""
    t = reading(unicodedata.normalize("NFKC", text)).casefold().replace("證", "症")
    if not keep_fillers:
        t = re.sub(f"[{FILLERS}]", "", t)
    return re.sub(r"[^㐀-鿿a-z0-9]", "", t)


def number_of(text: Column) -> Column:
    @F.pandas_udf(LongType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else to_number(t)).astype("Int64")

    return f(text)


def scored(text: Column, keep_fillers: bool = False) -> Column:
    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else score_text(t, keep_fillers))

    return f(text)

"""Text keys, tokens and small text measures as column expressions; Arrow UDFs only where Spark has no expression.

Spark's regular expressions are Java's, so classes that should mean Unicode carry (?U) or \\p{..}.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions.fixed import DATES, HEADINGS_1, HEADINGS_2, PAGE_MARK, PARTICLES, SENTENCE, SYMBOLS, VARIANTS

#: Han as the token rule has it.
HAN = "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{3134f}"
RUN = f"[{HAN}]+|[0-9a-z]+"
#: Full-width letters and digits and their plain form, by rule.
PLAIN = "".join(c for c in map(chr, range(0x21, 0x7F)) if c.isalnum())
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in PLAIN)

def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """Case folded, full-width forms as plain ones, variants unified: the native key, exact wherever NFKC does no more than that."""
    # translate() is dear, so only texts that hold what it changes go through it
    plain = F.when(text.rlike("[０-９Ａ-Ｚａ-ｚ]"), F.translate(text, WIDE, PLAIN)).otherwise(text)
    t = F.replace(F.lower(plain), F.lit("ß"), F.lit("ss"))
    rare, usual = "".join(VARIANTS) + "ς", "".join(VARIANTS.values()) + "σ"
    return F.when(t.rlike(f"[{rare}]"), F.translate(t, rare, usual)).otherwise(t)


def search_key(text: Column, table: dict[str, str] | None = None) -> Column:
    """NFKC, variants, then a pluggable character table (traditional to simplified, say). Null stays null."""
    made = str.maketrans({**VARIANTS, **(table or {})})

    @F.pandas_udf(StringType())
    def key(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(made))

    return key(text)


def compact(text: Column) -> Column:
    """The folded text without anything but letters, marks, digits and underscores: for comparing."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{M}\p{N}_]+", "")


def dedupe_key(text: Column) -> Column:
    """The folded text without space, punctuation and signs."""
    return F.regexp_replace(fold(text), r"(?U)[\p{P}\p{S}\p{Z}\s]", "")


def tokens(text: Column) -> Column:
    """Runs of Han as pairs of characters and the last one alone; runs of Latin letters and digits whole."""
    runs = F.regexp_extract_all(fold(text), F.lit(f"({RUN})"), F.lit(1))

    def split(r: Column) -> Column:
        return F.when(r.rlike("^[0-9a-z]"), F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(2))))

    return F.coalesce(F.flatten(F.transform(runs, split)), F.array().cast("array<string>"))


def query_terms(text: str) -> list[tuple[str, bool]]:
    """Terms of a question as (term, is a prefix), each once, in order: pairs of Han characters without particles if there are
    others, a single Han character as a prefix, Latin runs whole."""
    import re

    key = text.lower().translate(str.maketrans(WIDE, PLAIN)).translate(str.maketrans(VARIANTS))
    han = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"
    strong: list[tuple[str, bool]] = []
    weak: list[tuple[str, bool]] = []
    for run in re.findall(f"[{han}]+|[0-9a-z]+", key):
        if run[0].isascii():
            strong.append((run, False))
        elif len(run) == 1:
            strong.append((run, True))
        else:
            for i in range(len(run) - 1):
                pair = run[i : i + 2]
                (weak if set(pair) & set(PARTICLES) else strong).append((pair, False))
    return list(dict.fromkeys(strong or weak))


def once(value: Column, use) -> Column:
    """use(value), with value worked out once: inside a lambda an expression would be worked out for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bigrams(text: Column) -> Column:
    """Distinct pairs of characters of the comparison key."""
    return once(compact(text), lambda k: F.when(F.length(k) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(k) - 1), lambda i: F.substring(k, i, F.lit(2))))).otherwise(F.array().cast("array<string>")))


def containment(needle: Column, haystack: Column) -> Column:
    """Part of the first set that is in the second; 0 for an empty first set."""
    n = F.size(needle)
    return F.when(n > 0, F.size(F.array_intersect(needle, haystack)) / n).otherwise(0.0)


def char_count(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def estimated_tokens(text: Column) -> Column:
    """One for each Han character, a third for each other, rounded up, plus one."""
    others = F.length(F.regexp_replace(text, f"[{HAN}]", ""))
    return F.length(text) - others + F.ceil(others / 3).cast("int") + 1


def sentences(text: Column) -> Column:
    """Sentences with their end marks; an ASCII full stop is no end."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), F.lit(1)), lambda s: F.length(trimmed(s)) > 0)


def heading_level(text: Column) -> Column:
    """1 for chapter-like lines, 2 for numbered lines, 0 for others and for lines of more than 40 characters."""
    t = trimmed(text)
    some = lambda ps: F.coalesce(*[F.when(t.rlike(p), F.lit(True)) for p in ps], F.lit(False))
    return F.when((F.length(t) == 0) | (F.length(t) > 40) | t.isNull(), 0).when(some(HEADINGS_1), 1).when(some(HEADINGS_2), 2).otherwise(0)


def find_date(text: Column) -> Column:
    """The first valid date of the first form that has one: year-month-day, month/day/year, eight digits, year and month."""
    def form(pattern: str, order: tuple[int, int, int]) -> Column:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in order if g]
        number = lambda r, i: r["ymd"[i]].cast("int")

        def good(r: Column) -> Column:
            ok = number(r, 1).between(1, 12)
            return ok & number(r, 2).between(1, 31) if len(parts) == 3 else ok

        def shown(r: Column) -> Column:
            return F.format_string("%d-%02d-%02d", number(r, 0), number(r, 1), number(r, 2)) if len(parts) == 3 else F.format_string("%d-%02d", number(r, 0), number(r, 1))

        named = F.transform(F.sequence(F.lit(0), F.size(parts[0]) - 1), lambda i: F.struct(*[F.get(p, i).alias(n) for p, n in zip(parts, "ymd", strict=False)]))
        found = F.filter(F.when(F.size(parts[0]) > 0, named), good)
        return F.when(F.size(found) > 0, shown(F.get(found, F.lit(0))))

    return F.coalesce(*[form(p, o) for p, o in DATES])


def is_boilerplate(text: Column, marks: tuple[str, ...] = ()) -> Column:
    """Lines without letters, page marks, contents lines with leaders, and short lines with a vendor's mark."""
    t = trimmed(text)
    leaders = F.aggregate(F.regexp_extract_all(t, F.lit("([·．.…•]{6,})"), F.lit(1)), F.lit(0), lambda a, r: a + F.length(r))
    marked = F.coalesce(*[F.when(F.contains(t, F.lit(m)), F.lit(True)) for m in marks], F.lit(False))
    return ~t.rlike(r"\p{L}") | t.rlike(PAGE_MARK) | ((leaders > 0) & (leaders >= 0.2 * F.length(t))) | ((F.length(t) <= 200) & marked)


def is_garbage(text: Column, least: int = 20) -> Column:
    """Long enough, three tenths of suspicious characters and under a tenth of Han: both signals, so that Western text isn't hit."""
    n = F.length(text)
    clean = F.length(F.regexp_replace(text, r"[\x{80}-\x{24f}\x{370}-\x{3ff}\x{2200}-\x{22ff}\x{fb01}\x{fb02}\x{f8ff}]|[\p{Cc}&&[^\n\r\t]]", ""))
    han = n - F.length(F.regexp_replace(text, r"[\x{3400}-\x{9fff}]", ""))
    return (n >= least) & ((n - clean) / n >= 0.30) & (han / n < 0.10)


def clean_extracted(text: Column) -> Column:
    """Symbols of known fonts become what they show; other private-use and replacement characters nothing at an edge or beside white
    space, a space elsewhere."""
    text = F.translate(text, "".join(SYMBOLS), "".join(SYMBOLS.values()))
    run = r"[\x{e000}-\x{f8ff}\x{fffd}]+"
    edges = F.regexp_replace(text, rf"(?U)^{run}|{run}$|(?<=\s){run}|{run}(?=\s)", "")
    return F.regexp_replace(edges, run, " ")


def clip(text: Column, limit: int) -> Column:
    """At most `limit` characters, loose punctuation at the cut dropped, with an ellipsis."""
    t = trimmed(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), "[ ,，、：:;；]+$", ""), F.lit("…")))


def clock(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on; null counts as 0."""
    s = F.coalesce(seconds, F.lit(0.0)).cast("bigint")
    h, m, r = (s / 3600).cast("bigint"), (s % 3600 / 60).cast("bigint"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def redact(text: Column) -> Column:
    """Keys and tokens that look like secrets are blanked."""
    return F.regexp_replace(text, r"(?i)(sk-|key=|token=|bearer\s+)[A-Za-z0-9_\-\.]{8,}", "$1***")


def chunk_id(*parts: Column) -> Column:
    """Sixteen hex digits of a hash over the parts, joined by the unit separator; null parts are left out."""
    return F.substring(F.sha1(F.concat_ws("\u001f", *[p.cast("string") for p in parts])), 1, 16)

"""Simplified and traditional script: evidence of a text's script, conversion by segment, corrections by longest match.

The tables are parameters: maps of characters between the scripts, phrases that convert as a whole, corrections and variants.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions.fixed import VARIANTS


@dataclass(frozen=True)
class Scripts:
    """simplified and traditional: characters to the other script; regional: traditional ones to a region's forms; phrases:
    simplified phrases that the characters convert wrongly; fixes: corrections of the result; variants: last of all."""

    simplified: dict[str, str]
    traditional: dict[str, str]
    regional: dict[str, str] = field(default_factory=dict)
    phrases: dict[str, str] = field(default_factory=dict)
    fixes: dict[str, str] = field(default_factory=dict)
    variants: dict[str, str] = field(default_factory=lambda: dict(VARIANTS))

    @property
    def only_simplified(self) -> str:
        return "".join(sorted(c for c, t in self.simplified.items() if t != c and self.traditional.get(c, c) == c))

    @property
    def only_traditional(self) -> str:
        return "".join(sorted(c for c, t in self.traditional.items() if t != c and self.simplified.get(c, c) == c))


def read_table(path: str, single: bool = False) -> dict[str, str]:
    """A table of three columns (from, to, note) split by tabs; lines with # are remarks. A key twice, or in a table of single characters
    anything longer, is an error."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate((x.rstrip("\n") for x in f), 1):
            if line and not line.startswith("#"):
                parts = line.split("\t")
                if len(parts) != 3 or not parts[0] or not parts[1] or single and {len(parts[0]), len(parts[1])} != {1} or parts[0] in out:
                    raise ValueError(f"line {n} of {path} is no entry or comes twice")
                out[parts[0]] = parts[1]
    return out


def _count(text: Column, characters: str) -> Column:
    """How many of the characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, "")) if characters else F.lit(0)


def evidence(text: Column, scripts: Scripts) -> Column:
    """struct(simplified, traditional): characters that only one of the scripts has. Those that both have, or that change either way, say nothing."""
    return F.struct(_count(text, scripts.only_simplified).alias("simplified"), _count(text, scripts.only_traditional).alias("traditional"))


def replaced(table: dict[str, str]):
    """A function that replaces the longest entry at each place, from left to right, and never what it has put there."""
    if not table:
        return lambda t: t
    one = regex.compile("|".join(regex.escape(k) for k in sorted(table, key=len, reverse=True)))
    return lambda t: one.sub(lambda m: table[m[0]], t)


def converter(scripts: Scripts):
    """text → traditional text. Segments between white space and punctuation are converted by their own script: one with traditional
    characters only is traditional; one with both, if it survives the way there and back; one with neither goes with the whole text."""
    to_traditional, to_simplified, regional = (str.maketrans(m) for m in (scripts.simplified, scripts.traditional, scripts.regional))
    simple, trad = set(scripts.only_simplified), set(scripts.only_traditional)
    phrases = scripts.phrases
    by_phrase = regex.compile("|".join(regex.escape(k) for k in sorted(phrases, key=len, reverse=True))) if phrases else None
    fixed, variants = replaced(scripts.fixes), str.maketrans(scripts.variants)
    parts = regex.compile(r"([\s\p{P}])")
    memo: dict[tuple[str, bool], str] = {}

    def plain(s: str) -> str:
        return s.translate(to_traditional).translate(regional)

    def from_simplified(s: str) -> str:
        if by_phrase is None:
            return plain(s)
        out, at = [], 0
        for m in by_phrase.finditer(s):
            out += [plain(s[at : m.start()]), phrases[m[0]]]
            at = m.end()
        return "".join(out) + plain(s[at:])

    def segment(s: str, whole: bool) -> str:
        known = memo.get((s, whole))
        if known is None:
            a, b = any(c in simple for c in s), any(c in trad for c in s)
            keep = b if a != b else plain(s.translate(to_simplified)) == s.translate(regional) if a else whole
            if len(memo) > 50_000:
                memo.clear()
            known = memo[s, whole] = s.translate(regional) if keep else from_simplified(s)
        return known

    def convert(t: str) -> str:
        whole = sum(c in trad for c in t) > sum(c in simple for c in t)
        return fixed("".join(s if i % 2 else segment(s, whole) for i, s in enumerate(parts.split(t)))).translate(variants)

    return convert


def traditional(text: Column, scripts: Scripts) -> Column:
    """The text in traditional script; null stays null."""

    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        convert = converter(scripts)
        return s.map(lambda t: None if t is None else convert(t))

    return f(text)


def display(text: Column, variants: dict[str, str] | None = None) -> Column:
    """Variants unified, no other change of script."""
    v = VARIANTS if variants is None else variants
    return F.translate(text, "".join(v), "".join(v.values()))


def search_form(text: Column, scripts: Scripts) -> Column:
    """The key that is indexed and asked for: NFKC, variants, then simplified script."""
    table = str.maketrans({**{v: scripts.traditional.get(p, p) for v, p in scripts.variants.items()}, **scripts.traditional})

    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(table))

    return f(text)

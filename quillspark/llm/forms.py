"""Problem 5: one form for all texts that look alike: the skeleton.

Decompose, replace every character by its prototype from the look-alike table, decompose again. The table is a rule over the
public character database (full-width and half-width forms, ligatures, radicals, font variants; any space is a space; invisible
characters are nothing) plus the look-alike letters below; `read_confusables` reads the public table of look-alikes in their place, a
file with its version, which is a parameter because it isn't part of this repository. Texts with equal skeletons look the same.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import expanded, map_batches, written

#: Letters of other scripts, each before the Latin letter it looks like.
CYRILLIC = "аa еe оo рp сc уy хx іi ѕs јj ԁd һh ӏl ԛq ԝw ёë їï АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЅS ЈJ ԌG ԚQ ԜW ҮY"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp ϳj ϲc αa ιi"
ARMENIAN = "օo սu հh ոn ցg"
OTHER = "ɑa ɡg ıi ǀl ℓl ‐- ‑- −- ∕/ ꓐB ꓑP ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
#: Compatibility tags whose character looks like its decomposition.
SAME_LOOK = ("wide", "narrow", "compat", "font", "noBreak")


def read_confusables(path: str) -> tuple[str, dict[str, str]]:
    """(version, character → prototype) of a table of look-alikes in its public form: hexadecimal code points, `source ; target ; class`.

    ASCII characters stand for themselves, whatever the table says, so that digits and letters of plain text stay apart.
    """
    version, out = "", {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            if line.startswith("# Version:"):
                version = line.partition(":")[2].strip()
            parts = [x.strip() for x in line.partition("#")[0].split(";")]
            if len(parts) >= 2 and parts[0]:
                source = "".join(chr(int(x, 16)) for x in parts[0].split())
                if len(source) == 1 and not source.isascii():
                    out[source] = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in parts[1].split()))
    return version, out


class Prototypes(dict):
    """Code point → prototype, worked out when first met. `letters` are the look-alikes; without them those above."""

    def __init__(self, letters: dict[str, str] | None = None) -> None:
        super().__init__()
        self.letters = {p[0]: unicodedata.normalize("NFD", p[1:]) for p in f"{CYRILLIC} {GREEK} {ARMENIAN} {OTHER}".split()} if letters is None else letters

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        made = unicodedata.decomposition(ch)
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or code == 0x34F or 0xE0100 <= code <= 0xE01EF:
            out = ""
        elif kind == "Zs":
            out = " "
        elif made.startswith("<") and made[1:].partition(">")[0] in SAME_LOOK:
            out = "".join(self[ord(c)] for c in unicodedata.normalize("NFKD", ch))
        else:
            out = self.letters.get(ch, ch)
        self[code] = out
        return out


def skeleton(text: str, table: Prototypes) -> str:
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def composed(text: str, table: Prototypes) -> str:
    """The skeleton, composed again for reading: the one form."""
    return unicodedata.normalize("NFC", skeleton(text, table))


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def one_form(df: DataFrame, key: str = "row", text: str = "text", letters: dict[str, str] | None = None) -> DataFrame:
    """(key, form) of every row; equal for all texts that look alike: the skeleton, composed again for reading.

    Null stays null, empty stays empty; ties and repeated rows get the same form; texts of any length are taken whole.
    """

    def make():
        table = Prototypes(letters)

        def work(batch: pa.RecordBatch):
            yield {key: batch.column(0), "form": [None if t is None else composed(t, table) for t in batch.column(1).to_pylist()]}

        return work

    return map_batches(df, [key, text], f"{key} {df.schema[key].dataType.simpleString()}, form string", make)


def keyed_forms(df: DataFrame, key: str = "row", text: str = "text", letters: dict[str, str] | None = None) -> DataFrame:
    """(key, look, exact): 16-byte digests of the skeleton and of the text itself; null texts are left out."""

    def make():
        table = Prototypes(letters)

        def work(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            yield {key: batch.column(0), "look": [digest(skeleton(t, table)) for t in texts], "exact": [digest(t) for t in texts]}

        return work

    return map_batches(df.where(F.col(text).isNotNull()), [key, text], f"{key} {df.schema[key].dataType.simpleString()}, look binary, exact binary", make)


def looks_alike(df: DataFrame, key: str = "row", text: str = "text", letters: dict[str, str] | None = None) -> DataFrame:
    """Pairs (key_a < key_b) of rows whose texts look the same but are not the same characters.

    Distinct texts are paired first, one row each, so a text with any number of copies costs no more than the pairs it is in. Rows
    repeated with the same key and text pair as often as they come; equal keys don't pair.
    """
    keyed = written(keyed_forms(df, key, text, letters))
    several = keyed.groupBy("look").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("look")
    rows = written(keyed.join(several, "look", "left_semi"))
    kinds = rows.select("look", "exact").distinct()
    pairs = kinds.withColumnRenamed("exact", "a").join(kinds.withColumnRenamed("exact", "b"), "look").where("a < b")
    both = expanded(pairs, rows.select(F.col("exact").alias("id"), F.col(key).alias("k"))).where("x <> y")
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))

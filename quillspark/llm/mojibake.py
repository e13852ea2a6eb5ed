"""Problem 4: text read in a wrong encoding, found and, where nothing was lost, restored.

Minimum description length: every candidate decoding of a suspicious span is compressed with zstandard dictionaries, one a
language; the chain whose result and own cost are shortest wins, and a span that no chain shortens stays as it is. What was lost in
reading is one more hypothesis: its marks are bytes that nothing can describe, at a byte each.

Spans are suspicious by the characters in them: rare in the corpus (counts over all rows) or of kinds that such misreading makes.
The dictionaries hold the phrases that save most in their language, counted over all rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import code_points, map_batches

#: Phrases of a language that its dictionary is made of, passages of them that it is trained on, the dictionary's size, and a row part below which a character is rare.
PHRASES, DRAWN, DICTIONARY, RARE = 4000, 4000, 32 * 1024, 0.004
#: Bytes of description a chain costs a step and a piece of text may at most keep unexplained; the least gain.
CHAIN_COST, LEAST_GAIN = 2.0, 3.0
#: Fixed values: (read as, written in). "1252" is cp1252 with the bytes it leaves out taken as they are.
CHAINS = [(w, "utf-8") for w in ("1252", "latin-1", "cp437", "mac_roman", "koi8_r", "gb18030", "cp950", "cp1251", "cp866")] + [(w, t) for t in ("gb18030", "cp950", "cp932") for w in ("1252", "latin-1", "mac_roman", "cp437", "koi8_r", "cp1251", "gb18030", "cp950") if w != t]
READ_AS = tuple(dict.fromkeys(w for w, _ in CHAINS))
#: Kinds that misreading makes: controls, Latin supplement and signs, box drawing, private use, the replacement mark.
STRANGE = re.compile(r"[\x80-\x9f¡-¿Â-Ã×Ø÷ø‚„…†‡ˆ‰‹•˜™›œžŸŒŽƒ∏∑√∞∫≈≠≤≥◊⌐⌠⌡─-▟Ѐ-ӿ-�]")
LOST = "�"
#: Four or more characters of utf-8 in a row, which Han text in another encoding has by chance about never.
HIDDEN = re.compile(rb"(?:[\xe3-\xe9][\x80-\xbf]{2}|\xef[\xbc\xbd][\x80-\xbf]){4,}")


def _single_byte(name: str) -> dict[str, int]:
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode("cp1252" if name == "1252" else name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


_TABLES = {w: _single_byte(w) for w in ("1252", "latin-1", "cp437", "mac_roman", "koi8_r", "cp1251", "cp866")}


def bytes_of(text: str, read_as: str) -> bytes | None:
    """The bytes that were read as this text, marks of losses as 0xff; null if it can't have come so, or if they are ASCII, which all readings share."""
    try:
        if read_as in _TABLES:
            table = _TABLES[read_as]
            raw = bytes([0xFF if c == LOST else table[c] for c in text])
        elif LOST in text:
            raw = b"\xff".join(p.encode(read_as) for p in text.split(LOST))
        else:
            raw = text.encode(read_as)
    except (KeyError, UnicodeEncodeError):
        return None
    return None if raw.isascii() else raw


def decoded(raw: bytes, lost: bool, written_in: str) -> tuple[str, bool] | None:
    """Bytes as they were written, and whether something was lost, be it before (`lost`) or here; null if too much was."""
    if not lost:
        try:
            return raw.decode(written_in), False
        except UnicodeDecodeError:
            pass
    out = raw.decode(written_in, "replace")
    # a few lost characters are a loss; a text of losses is no reading of it
    return (out, True) if out.count(LOST) * 4 <= len(out) else None


def unread(text: str, read_as: str, written_in: str) -> tuple[str, bool] | None:
    """The text as it was written, and whether something was lost; null if it can't have come so."""
    raw = bytes_of(text, read_as)
    return None if raw is None else decoded(raw, LOST in text, written_in)


def language(text: str) -> str:
    """A coarse class for the dictionaries."""
    kana, han = len(re.findall(r"[ぁ-ヿ]", text)), len(re.findall(r"[㐀-鿿]", text))
    if kana * 5 > len(text):
        return "ja"
    if han * 3 > len(text):
        return "hans" if len(re.findall("[这们个为来对时说气湿阴阳药脉医见现与从后么会开关门问间头]", text)) * 60 > han else "hant"
    return "de" if re.search(r"\b(?:der|die|das|und|nicht|mit|von)\b", text) else "en"


def whole(raw: bytes, encoding: str) -> bool:
    try:
        raw.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def hidden(text: str) -> list[tuple[int, int]]:
    """Where Han characters are utf-8 read as gb18030 or cp950, however frequent they are."""
    out = []
    for w in () if text.isascii() else ("gb18030", "cp950"):
        raw = text.encode(w, "replace")
        for m in HIDDEN.finditer(raw):
            a, b = m.span()
            # a clean character's last byte can look like the first of another; whole characters only
            while a < b and not whole(raw[:a], w):
                a += 3
            while a < b and not whole(raw[:b], w):
                b -= 3
            if a < b:
                out.append((len(raw[:a].decode(w)), len(raw[:b].decode(w))))
    return out


WIDE = ("ja", "hans", "hant")
_WIDE = re.compile(r"[ぁ-ヿ㐀-鿿]")


class Describer:
    """Lengths of description, in bytes: the shortest over the languages that are written in the text's script."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        made = lambda d: zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        some = [(name in WIDE, made(d)) for name, d in dictionaries] or [(False, zstandard.ZstdCompressor(level=6))]
        self.of = {wide: [c for w, c in some if w == wide] or [c for _, c in some] for wide in (False, True)}

    def __call__(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(raw)) for c in self.of[_WIDE.search(text) is not None])


_PHRASE = {True: re.compile(r"[^\s\x00-\x7f　-〿！-／：-？［-｀｛-､‘-”…]{3,16}"), False: re.compile(r"[^\n.,;:!?()\"]{4,40}")}


def phrases(text: str) -> tuple[str, list[str]] | None:
    """The language of a text and what stands between its pauses; null for a text with many strange characters."""
    if len(STRANGE.findall(text)) * 50 > len(text) or hidden(text):
        return None
    name = language(text)
    return name, [p for p in _PHRASE[name in WIDE].findall(text) if not STRANGE.search(p)]


def frequent_phrases(df: DataFrame, text: str) -> list[tuple[str, str, int]]:
    """(language, phrase, n): of each language the PHRASES that repeat most characters over all rows, best first."""

    def make():
        def work(batch: pa.RecordBatch):
            n: Counter[tuple[str, str]] = Counter()
            for t in batch.column(0).to_pylist():
                got = phrases(t)
                if got:
                    n.update((got[0], p) for p in got[1])
            yield {"lang": [k[0] for k in n], "phrase": [k[1].encode("utf-8", "replace").decode() for k in n], "n": list(n.values())}

        return work

    counted = map_batches(df.where(F.length(text) > 0), [text], "lang string, phrase string, n bigint", make).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where("n > 1")
    w = Window.partitionBy("lang").orderBy(F.desc(F.col("n") * (F.octet_length("phrase") - 2)), "phrase")
    return [(r.lang, r.phrase, r.n) for r in counted.withColumn("k", F.row_number().over(w)).where(F.col("k") <= PHRASES).orderBy("lang", "k").collect()]


def dictionaries(best: list[tuple[str, str, int]]) -> list[tuple[str, bytes]]:
    """One dictionary a language, trained on passages of its phrases, drawn as often as the corpus has them."""
    out = []
    for name in sorted({b[0] for b in best}):
        some = [p.encode() for lang, p, _ in best if lang == name]
        often = np.array([n for lang, _, n in best if lang == name], float)
        drawn = np.random.default_rng(31).choice(len(some), (DRAWN, 12), p=often / often.sum())
        pause = "，" if name in WIDE else ", "
        try:
            made = zstandard.train_dictionary(DICTIONARY, [pause.encode().join(some[i] for i in row) for row in drawn], level=6).as_bytes()
        except zstandard.ZstdError:  # too little to train on: the phrases themselves are the dictionary, the best last
            made = b"".join(reversed(some))[-DICTIONARY:]
        if len(made) >= 8:
            out.append((name, made))
    return out


def rare_characters(df: DataFrame, text: str) -> tuple[str, int]:
    """The characters that are not rare, and the rows: every row counts each of its characters once. At most as many entries
    as there are characters reach the driver."""

    def make():
        def work(batch: pa.RecordBatch):
            n: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                n.update(set(t))
            yield {"c": [ord(c) for c in n], "n": list(n.values())}

        return work

    rows = df.where(F.length(text) > 0)
    counts = map_batches(rows, [text], "c int, n bigint", make).groupBy("c").agg(F.sum("n").alias("n"))
    total = rows.count()
    common = counts.where(F.col("n") >= RARE * total).select("c").collect()
    return "".join(sorted(chr(r.c) for r in common)), total


class Finder:
    def __init__(self, common: str, dicts: list[tuple[str, bytes]]):
        self.odd = np.ones(0x110000, np.int8)
        self.odd[[ord(c) for c in common]] = 0
        self.odd[:128] = -1
        for c in range(128, 0x10000):
            if not 0xD800 <= c < 0xE000 and STRANGE.match(chr(c)):
                self.odd[c] = 1
        if "…" in common:  # a pause of clean text, where it is common
            self.odd[ord("…")] = -1
        self.odd[0x7F] = 0
        # kana and letters with accents, Greek ones: common in clean text, but no end of a span
        for lo, hi in ((0x3041, 0x3100), (0xC0, 0x250), (0x370, 0x400)):
            self.odd[lo:hi] = np.where(self.odd[lo:hi] == 0, -1, self.odd[lo:hi])
        self.known: dict[tuple[str, str, str], tuple | None] = {}
        #: Spans of which no chain leaves fewer odd characters, whatever stands beside them.
        self.hopeless: set[str] = set()
        self.describe = Describer(dicts)

    def marked(self, text: str, codes: np.ndarray) -> np.ndarray:
        """The characters' kinds; those of hidden utf-8 are odd, though they may be common."""
        odd = self.odd[codes]
        for lo, hi in hidden(text):
            odd[lo:hi] = 1
        return odd

    def spans(self, odd: np.ndarray, codes: np.ndarray, gap: int = 40) -> list[tuple[int, int]]:
        """Runs of odd characters; up to `gap` others between them, at most two of them common ones, don't end a run."""
        at = np.flatnonzero(odd == 1)
        if not len(at):
            return []
        common = np.concatenate([[0], np.cumsum(odd == 0)])
        breaks = np.flatnonzero((common[at[1:]] - common[at[:-1]] > 2) | (np.diff(at) > gap))
        first = np.concatenate([[0], breaks + 1])
        last = np.concatenate([breaks, [len(at) - 1]])
        out = []
        for lo, hi in zip(at[first].tolist(), (at[last] + 1).tolist(), strict=True):
            while lo > 0 and odd[lo - 1] == -1 and codes[lo - 1] >= 128:
                lo -= 1
            while hi < len(odd) and odd[hi] == -1 and codes[hi] >= 128:
                hi += 1
            out.append((lo, hi))
        return out

    def best(self, text: str, lo: int, hi: int) -> tuple[float, int, int, str, bool, str] | None:
        """(gain, lo, hi, result, lost, chain): the shortest description of a span and its near surroundings."""
        a0, b0 = max(0, lo - 3), min(len(text), hi + 3)
        whole = (text[a0:lo], text[lo:hi], text[hi:b0])
        known = self.known.get(whole, False)
        if known is not False:
            return known and (known[0], a0 + known[1], a0 + known[2], *known[3:])
        if whole[1] in self.hopeless:
            return None
        best, own, some = None, None, False
        core = set(whole[1]) - {LOST}
        raws = {w: bytes_of(whole[1], w) for w in READ_AS if w not in _TABLES or core <= _TABLES[w].keys()}
        for w, t in CHAINS:
            raw = raws.get(w)
            if raw is None:
                continue
            tries: list[tuple[int, int, str, bool]] = []
            got = decoded(raw, LOST in whole[1], t)
            if got is None or got[0] == whole[1]:
                continue
            some = True
            tries.append((lo, hi, *got))
            # a character at an edge may belong to the span; looked for where little is wrong
            if got[1] and got[0].count(LOST) <= 3:
                for a, b in [(a, b) for a in range(lo, a0 - 1, -1) for b in range(hi, b0 + 1) if (a, b) != (lo, hi)]:
                    got = unread(text[a:b], w, t)
                    if got and not got[1] and got[0] != text[a:b]:
                        tries.append((a, b, *got))
                        break
            clean = [x for x in tries if not x[3]]
            for a, b, result, lost in clean or tries:
                made = text[a0:a] + result + text[b:b0]
                own = self.describe(text[a0:b0]) if own is None else own
                gain = own - self.describe(made) - CHAIN_COST - 3 * result.count(LOST)
                if gain >= LEAST_GAIN and (best is None or gain > best[0]):
                    best = (gain, a, b, result, lost, f"{w}>{t}")
        if len(self.known) > 20_000:
            self.known.clear()
            self.hopeless.clear()
        if not some:
            self.hopeless.add(whole[1])
        self.known[whole] = best and (best[0], best[1] - a0, best[2] - a0, *best[3:])
        return best

    def losses(self, text: str, lo: int, hi: int) -> float:
        """What is gained by describing a span as bytes of which some were lost, each mark and each odd character by a byte of its own."""
        a, b = max(0, lo - 3), min(len(text), hi + 3)
        raw = "".join(chr(1 + ord(c) % 8) if self.odd[ord(c)] == 1 else c for c in text[lo:hi])
        return self.describe(text[a:b]) - self.describe(text[a:lo] + raw + text[hi:b]) - CHAIN_COST

    def parts(self, text: str, lo: int, hi: int, gap: int = 40) -> list[tuple[float, int, int, str, bool, str]]:
        """What shortens a span: one chain for all of it, or else chains for what is left of it with smaller gaps."""
        got = self.best(text, lo, hi)
        if got is not None or gap <= 1:
            return [got] if got else []
        codes = code_points([text[lo:hi]])[0]
        inner = self.spans(self.marked(text[lo:hi], codes), codes, gap // 4)
        if len(inner) == 1 and inner[0] == (0, hi - lo) and gap > 4:
            return self.parts(text, lo, hi, gap // 4)
        return [x for a, b in inner if (a, b) != (0, hi - lo) for x in self.parts(text, lo + a, lo + b, gap // 4)]

    def repair(self, text: str, codes: np.ndarray) -> tuple[str | None, list[str]] | None:
        """(restored text or null where something was lost, chains); null where nothing was misread."""
        chains: list[str] = []
        lost = any(LOST in text[lo:hi] and self.losses(text, lo, hi) >= LEAST_GAIN for lo, hi in self.spans(self.marked(text, codes), codes))
        seen = {text}
        while True:  # a text read wrongly again and again needs as many turns, and edges come out in the next one
            out, done, found = [], 0, 0
            for lo, hi in self.spans(self.marked(text, codes), codes):
                for _, a, b, result, gone, chain in self.parts(text, lo, hi):
                    if a < done:
                        continue
                    out.append(text[done:a] + result)
                    chains.append(chain)
                    lost |= gone or LOST in result
                    done = b
                    found += 1
            if not found:
                break
            text = "".join(out) + text[done:]
            codes = code_points([text])[0]
            if text in seen:
                break
            seen.add(text)
        if not chains and not lost:
            return None
        return (None if lost else text), chains or ["lost"]


def repaired(df: DataFrame, key: str = "row", text: str = "raw_text", source: str = "source") -> DataFrame:
    """(key, source, restored, chains) of the rows with characters from a wrong encoding; restored is null where something was lost.

    Null and empty texts aren't among them; neither are texts in rare characters that no chain shortens. A text of any length is
    taken whole; repeated rows come out again; ties between chains go to the first in the list.
    """
    common, _ = rare_characters(df, text)
    dicts = dictionaries(frequent_phrases(df, text))
    shared = df.sparkSession.sparkContext.broadcast((common, dicts))

    def make():
        finder = Finder(*shared.value)

        def work(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("t").to_pylist()
                codes, offsets = code_points(texts)
                odd = finder.odd[codes]
                some = np.concatenate([[0], np.cumsum(odd == 1)])
                rows, restored, chains = [], [], []
                for i in [i for i, n in enumerate(np.diff(some[offsets])) if n or hidden(texts[i])]:
                    got = finder.repair(texts[i], codes[offsets[i] : offsets[i + 1]])
                    if got:
                        rows.append(i)
                        restored.append(got[0])
                        chains.append(got[1])
                take = pa.array(rows, pa.int64())
                yield {key: part.column("k").take(take), "source": part.column("s").take(take), "restored": restored, "chains": chains}

        return work

    rows = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"))
    return map_batches(rows, ["k", "s", "t"], f"{key} {df.schema[key].dataType.simpleString()}, source string, restored string, chains array<string>", make)


def garbled(df: DataFrame, key: str = "row") -> DataFrame:
    return repaired(df, key).select(key)

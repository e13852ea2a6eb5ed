"""Problem 7: text of scanned pages repaired into running paragraphs.

Noisy channel. What was read is the page's text through a channel that breaks lines, parts words, puts page headings and numbers
between the lines and misreads characters. The text's own likelihood comes from n-gram counts over all rows: single characters,
pairs of them, Latin words and pairs of words. The channel's confusion probabilities are learnt from the rows too: where a reading
that the counts don't know stands in for one that they do, in enough different places (see `confused`), after a prior of a few
pairs that recognition is known for.

Every line break is a latent variable, a break of the text or one of the page, and weighed by how much likelier the text is when it
runs on over it; every character and word by what it can stand for, in a Viterbi search a line. A row is a case if
its most probable source differs from what was read by enough likelihood. Lists and verse set in lines don't run on.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import code_points, map_batches, owners, written

#: What recognition is known to take for one another, the true one first; the prior of the confusion table.
HAN = "不下 方万 用甩 白自 減滅 减灭 煎剪 氣氛 二ニ 二亖 三亖 熱熟 热熟 治冶 鹽監 盐監 論諭 论谕 大太 日曰 舌古 未末 寒塞 患惠 已己 根恨 口囗 人入 湯渴 汤渴 木本 土士 千干 力刀 間問 间问"
LATIN = "w:vv h:li m:rn l:1 o:0 g:9 s:5 i:! e:c t:f O:0 B:8 S:5 I:l fi:ﬁ fl:ﬂ"
#: Probability of a pair of the prior; part of all characters or words from which one of them or a pair of them is in the model, so
#: that it has at most 4 / LEAST entries whatever the corpus; different places in which a confusion must be met to be
#: learnt, and how many times more frequent the true reading must be there.
MISREAD, LEAST, PLACES, RARER = 0.02, 2e-6, 12, 20
#: Of a row's gain in log-likelihood: what makes it a case, and what one line break, misreading or page number can give.
GAIN, MOST = 4.0, 3.0
#: A line narrower than this isn't a full line of running text; what a break at a line that isn't full costs.
NARROWEST, SHORT = 14, 3.5

LETTER = "A-Za-zÀ-ɏ"
WORD = re.compile(rf"[{LETTER}ﬁﬂ][{LETTER}ﬁﬂ0-9!’']*|[0-9]+[{LETTER}][{LETTER}0-9!]*")
PLAIN = re.compile(rf"[{LETTER}]+")
PHRASE = re.compile(rf"[{LETTER}]+(?: [{LETTER}]+)+")
END = "。！？；.!?;…」』”）)：:"
PAUSE = "，,、"
#: What no line of text begins with.
CLOSES = frozenset("。，、；：！？）」』》.,;:!?)")
HYPHEN = "-‐¬­‑"
ITEM = re.compile(r"\s*(?:[-*•・‧]|\d+[.)、]|[一二三四五六七八九十]+[、.])\s*\S")
NUMBER = re.compile(r"^[\s\-–—·•.~|\[\]()（）]*(?:第|[Pp](?:age|\.)?|頁|页)?\s*(\d{1,5})\s*(?:頁|页)?(?:\s*/\s*\d{1,5})?[\s\-–—·•.~|\[\]()（）]*$")
HEADING = re.compile(r"^[㐀-鿿]{2,6}(?:[ 　]+(?:[㐀-鿿ニ亖]{1,4}|[A-Z]{3,}))?$|^(?:[A-Z]{3,} ?)+$")
DIGITS = re.compile(r"(?<!\d)(\d{1,5})(?!\d)")
#: Letters that digits are read as.
AS_DIGIT = str.maketrans("lIioOSsBgz|", "11100558921")
LINES = re.compile(r"\r\n|\r|\n")
PRIOR = {(p[0], p[1]): MISREAD for p in HAN.split()} | {tuple(p.split(":")): MISREAD for p in LATIN.split()}


class Kinds:
    """Tables over code points: Latin letters, white space, Han characters."""

    def __init__(self) -> None:
        self.latin, self.space, self.han = (np.zeros(0x110000, bool) for _ in range(3))
        self.latin[[c for c in range(0x250) if re.match(f"[{LETTER}]", chr(c))]] = True
        self.space[[c for c in range(0x3001) if chr(c).isspace()]] = True
        self.han[0x3400:0xA000] = self.han[0x3041:0x3100] = True


def pairs(texts: list[str], kinds: Kinds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, positions of the pairs side by side that count, the pairs in 42 bits). Two Latin letters are no pair."""
    codes, offsets = code_points(texts)
    if len(codes) < 2:
        return codes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, fine, latin = owners(offsets), ~kinds.space[codes], kinds.latin[codes]
    at = np.flatnonzero(fine[:-1] & fine[1:] & (own[:-1] == own[1:]) & ~(latin[:-1] & latin[1:]))
    return codes, at, (codes[at].astype(np.int64) << 21) | codes[at + 1]


def counts(df: DataFrame, text: str = "raw_text") -> tuple[dict[str, int], int, int]:
    """What the likelihoods come from, over all rows: characters, pairs of them, words, pairs of words, and how lines and words begin;
    and the sums of characters and of words. Entries below LEAST of these are left out: the bound of what is broadcast."""

    def make():
        kinds = Kinds()

        def work(batch: pa.RecordBatch):
            texts = batch.column(0).to_pylist()
            codes, _, both = pairs(texts, kinds)
            one, n = np.unique(codes[~kinds.space[codes]], return_counts=True)
            two, m = np.unique(both, return_counts=True)
            words: Counter[str] = Counter()
            for t in texts:
                if not t.isascii() or t:
                    found = PLAIN.findall(t)
                    words.update(w for w in found if len(w) > 1)
                    low = sum(w[0].islower() for w in found)
                    words[" l"] += low
                    words[" u"] += len(found) - low
                    for m_ in re.finditer(rf"[。！？.!?][”’)）」』]?\s*[\r\n]+([{LETTER}])", t):
                        words["\nl" if m_[1].islower() else "\nu"] += 1
                    for run in PHRASE.findall(t):
                        some = run.split(" ")
                        words.update(f"{a} {b}" for a, b in zip(some, some[1:]))
            keys = [chr(c) for c in one.tolist()] + [chr(p >> 21) + chr(p & 0x1FFFFF) for p in two.tolist()]
            yield {"gram": [k.encode("utf-8", "replace").decode() for k in keys] + list(words), "kind": [0] * len(one) + [1] * len(two) + [2] * len(words), "n": n.tolist() + m.tolist() + list(words.values())}

        return work

    grams = written(map_batches(df.where(F.length(text) > 0), [text], "gram string, kind int, n bigint", make).groupBy("gram", "kind").agg(F.sum("n").alias("n")))
    sums = grams.agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("chars"), F.sum(F.when(F.col("gram").isin(" l", " u"), F.col("n"))).alias("words")).first()
    chars, words = sums.chars or 1, sums.words or 1
    kept = grams.where(F.col("n") >= LEAST * F.when(F.col("kind") == 2, words).otherwise(chars))
    return {r.gram: r.n for r in kept.select("gram", "n").collect()}, chars, words


def gaps(word: str) -> list[tuple[str, str]]:
    """(the word with one or two characters left out, those characters), for every place."""
    return [(f"{word[:i]}\0{word[i + n :]}", word[i : i + n]) for n in (1, 2) for i in range(len(word) - n + 1)]


def confused(df: DataFrame, model: Model, text: str = "raw_text") -> dict[tuple[str, str], float]:
    """The channel's confusion probabilities (true, read), learnt from all rows of df.

    A Han character that stands between two others where exactly one other character would make both pairs RARER times as frequent; a
    Latin word that one or two characters make a word RARER times as frequent. What is met so in at least PLACES different
    places (neighbours, words) is a confusion; its probability is its part of the true character's occurrences,
    but no less than half of the prior's, since only what stands out is met. What is never met keeps the prior's.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.grams, model.chars, model.words))

    def make():
        m, kinds = Model(*shared.value), Kinds()
        after: dict[str, dict[str, int]] = {}
        before: dict[str, dict[str, int]] = {}
        at_gap: dict[str, list[tuple[str, str]]] = {}
        most = np.zeros((2, 0x110000), np.int64)
        keys, ns = [0], [0]
        for g, n in m.grams.items():
            if len(g) == 2 and kinds.han[ord(g[0])] and kinds.han[ord(g[1])]:
                after.setdefault(g[0], {})[g[1]] = n
                before.setdefault(g[1], {})[g[0]] = n
                keys.append((ord(g[0]) << 21) | ord(g[1]))
                ns.append(n)
                most[0, ord(g[0])], most[1, ord(g[1])] = max(most[0, ord(g[0])], n), max(most[1, ord(g[1])], n)
            elif len(g) > 3 and PLAIN.fullmatch(g) and n >= RARER * m.least_word:
                for rest, gone in gaps(g):
                    at_gap.setdefault(rest, []).append((gone, g))
        order = np.argsort(keys)
        known, n_of = np.array(keys, np.int64)[order], np.array(ns, np.int64)[order]

        def looked_up(both: np.ndarray) -> np.ndarray:
            where = np.minimum(np.searchsorted(known, both), len(known) - 1)
            return np.where(known[where] == both, n_of[where], 0)

        def work(batch: pa.RecordBatch):
            met: Counter[tuple[str, str, str]] = Counter()
            texts = batch.column(0).to_pylist()
            codes, offsets = code_points(texts)
            if len(codes) > 2:
                own, han, c = owners(offsets), kinds.han[codes], codes.astype(np.int64)
                at = np.flatnonzero(han[:-2] & han[1:-1] & han[2:] & (own[:-2] == own[2:]))
                three, n = np.unique((c[at] << 42) | (c[at + 1] << 21) | c[at + 2], return_counts=True)
                left, right = looked_up(three >> 21), looked_up(three & ((1 << 42) - 1))
                # what no character could make frequent enough is passed over
                here = np.maximum(np.maximum(left, right), 1) * RARER
                odd = np.flatnonzero((here <= most[0, three >> 42]) & (here <= most[1, three & 0x1FFFFF]))
                for w, k, need in zip(three[odd].tolist(), n[odd].tolist(), here[odd].tolist(), strict=True):
                    a, r, b = chr(w >> 42), chr((w >> 21) & 0x1FFFFF), chr(w & 0x1FFFFF)
                    one, two = after[a], before[b]
                    fits = [t for t in (one if len(one) < len(two) else two) if one.get(t, 0) >= need and two.get(t, 0) >= need]
                    if len(fits) == 1:
                        met[fits[0], r, a + b] += k
            said: Counter[str] = Counter()
            for t in texts:
                said.update(w for w in WORD.findall(t) if len(w) > 3)
            for w, k in said.items():
                need = RARER * max(1, m.grams.get(w, 0))
                if w[:-1] not in m.grams or w[-1] != "!":
                    found = {(true, read, word) for rest, read in gaps(w) for true, word in at_gap.get(rest, ()) if true != read and true.isalpha() and m.grams[word] >= need}
                    least = min((len(x) + len(y) for x, y, _ in found), default=0)
                    met.update({f: k for f in found if len(f[0]) + len(f[1]) == least})
            yield {"true": [k[0] for k in met], "read": [k[1].encode("utf-8", "replace").decode() for k in met], "place": [k[2] for k in met], "n": list(met.values())}

        return work

    seen = map_batches(df.where(F.length(text) > 0), [text], "true string, read string, place string, n bigint", make).groupBy("true", "read", "place").agg(F.sum("n").alias("n"))
    often = seen.groupBy("true", "read").agg(F.sum("n").alias("n"), F.count("*").alias("places")).where((F.col("places") >= PLACES) & (F.col("n") >= LEAST * model.chars))
    out = dict(PRIOR)
    for r in often.orderBy("true", "read").collect():
        out[r.true, r.read] = min(0.2, max(MISREAD / 2, r.n / (r.n + model.grams.get(r.true, 50 * r.n))))
    return out


@dataclass
class Model:
    grams: dict[str, int]
    chars: int = 1
    words: int = 1
    channel: dict[tuple[str, str], float] = field(default_factory=lambda: dict(PRIOR))
    _known: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    _keys: dict[str, list[str]] | None = None

    def __post_init__(self) -> None:
        self.least_char, self.least_word = max(1.0, LEAST * self.chars), max(1.0, LEAST * self.words)
        #: What a Han character can stand for; spellings that can stand for one another in Latin words.
        self.true: dict[str, list[tuple[str, float]]] = {}
        self.spell: list[tuple[str, str, float]] = []
        for (t, r), p in self.channel.items():
            if PLAIN.fullmatch(t):
                self.spell.append((t, r, math.log(p)))
            else:
                self.true.setdefault(r, []).append((t, math.log(p)))
        #: Characters of a class as one of them, and those that look like several as these.
        same: dict[str, str] = {}
        for t, r, _ in self.spell:
            if len(t) == len(r) == 1:
                a, b = same.get(t, t), same.get(r, r)
                low, high = min(a, b), max(a, b)
                same |= {c: low for c in (*[c for c, to in same.items() if to == high], t, r, high)}
        wide = {t: r for t, r, _ in self.spell if len(t) == 1 and len(r) > 1} | {r: t for t, r, _ in self.spell if len(r) == 1 and len(t) > 1}
        self._key = [(str.maketrans(wide), str.maketrans(same))] if self.spell else []
        #: Characters by script, so that those of a rare script aren't taken for following one another for their script's sake.
        self.of_class = [0.0, 0.0, 0.0]
        for x, n in self.grams.items():
            if len(x) == 1:
                self.of_class[script(x)] += n
        g = self.grams.get
        low, new = (g(" l", 0) + 1) / (g(" l", 0) + g(" u", 0) + 2), (g("\nl", 0) + 1) / (g("\nl", 0) + g("\nu", 0) + 2)
        self.lower, self.upper = max(-2.0, min(2.0, math.log(low / new))), max(-2.0, min(2.0, math.log((1 - low) / (1 - new))))

    def pair(self, a: str, b: str) -> float:
        """How likely b follows a, in logs; unseen pairs fall back on a small constant."""
        return math.log(self.grams.get(a + b, 0) + 0.05) if a and not a.isspace() else 0.0

    def key(self, word: str) -> str:
        """Equal for all words that can be read as one another."""
        for wide, same in self._key:
            word = word.translate(wide).translate(same)
        return word

    def slips(self, true: str, read: str) -> float | None:
        """The log-probability that the channel makes one word of the other; null if it can't."""
        most = {(0, 0): 0.0}
        for i in range(len(true) + 1):
            for j in range(len(read) + 1):
                p = most.get((i, j))
                if p is None:
                    continue
                if i < len(true) and j < len(read) and true[i] == read[j]:
                    most[i + 1, j + 1] = max(p, most.get((i + 1, j + 1), p))
                for t, r, cost in self.spell:
                    if true.startswith(t, i) and read.startswith(r, j):
                        to = (i + len(t), j + len(r))
                        most[to] = max(p + cost, most.get(to, -math.inf))
        return most.get((len(true), len(read)))

    def sources(self, read: str) -> list[tuple[str, float]]:
        """What a Latin word can stand for, with the channel's log-probability; what was read comes first."""
        some = self._known.get(read)
        if some is None:
            if self._keys is None:
                self._keys = {}
                for w in self.grams:
                    if PLAIN.fullmatch(w):
                        self._keys.setdefault(self.key(w), []).append(w)
            some = [(read, 0.0)]
            for w in self._keys.get(self.key(read), ()):
                cost = self.slips(w, read) if w != read else None
                if cost is not None:
                    some.append((w, cost))
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[read] = some
        return some

    def likelihood(self, word: str, before: str) -> float:
        """Of a word after another one, in logs."""
        alone = 0.4 * self.grams.get(word, 0) + 0.02
        return math.log(self.grams.get(f"{before} {word}", 0) + alone * max(1, self.grams.get(before, 0)) / self.words if before else alone)

    def word(self, read: str) -> str:
        """The most probable source of a Latin word alone."""
        return max(self.sources(read), key=lambda c: c[1] + self.likelihood(c[0], ""))[0]

    def known(self, word: str) -> int:
        return self.grams.get(word, 0)

    def line(self, read: str) -> tuple[str, int, float]:
        """The most probable source of a line, how many of its words and characters differ, and what they gain in likelihood."""
        changed, gain = 0, 0.0
        if WORD.search(read):
            parts, at, run = [], 0, []

            def settle() -> None:
                nonlocal changed, gain
                if not run:
                    return
                # Viterbi over the candidates of the words that stand beside one another
                paths = {"": (0.0, [])}
                for w, _, _ in run:
                    after = {}
                    for c, cost in self.sources(w):
                        after[c] = max(((p + cost + self.likelihood(c, b), s + [c]) for b, (p, s) in paths.items()), key=lambda o: o[0])
                    paths = after
                best = max(paths.values(), key=lambda o: o[0])[1]
                before = ""
                for (w, gap, tail), c in zip(run, best, strict=True):
                    parts.append(gap + c + tail)
                    if c != w:
                        changed += 1
                        gain += min(MOST, self.likelihood(c, before) + dict(self.sources(w))[c] - self.likelihood(w, before))
                    before = c
                run.clear()

            for m in WORD.finditer(read):
                w, tail, gap = m[0], "", read[at : m.start()]
                if w.endswith("!") and w[:-1] in self.grams:
                    w, tail = w[:-1], "!"
                if gap != " ":
                    settle()
                run.append((w, gap, tail))
                if tail:
                    settle()
                at = m.end()
            settle()
            read = "".join(parts) + read[at:]
        at = [i for i, c in enumerate(read) if c in self.true]
        parts, done = [], 0
        for i, j in _runs(at):
            parts.append(read[done:i])
            best, g = self._han(read[i - 1 : i], read[i:j], read[j : j + 1])
            changed += sum(x != y for x, y in zip(read[i:j], best, strict=True))
            gain += g
            parts.append(best)
            done = j
        return "".join(parts) + read[done:], changed, gain

    def _han(self, left: str, read: str, right: str) -> tuple[str, float]:
        """Viterbi over characters that can stand for others, between two that can't; and what the best source gains."""
        paths: dict[str, tuple[float, str]] = {left: (0.0, "")}
        for c in read:
            after: dict[str, tuple[float, str]] = {}
            for x, cost in [(c, 0.0), *self.true[c]]:
                after[x] = max(((p + cost + self.pair(a, x), s + x) for a, (p, s) in paths.items()), key=lambda o: o[0])
            paths = after
        ends = {x: (p + (self.pair(x, right) if right else 0.0), s) for x, (p, s) in paths.items()}
        best = max(ends.values(), key=lambda o: o[0])[1]
        gain = 0.0
        for i, (x, y) in enumerate(zip(read, best, strict=True)):
            if x != y:
                before, behind = best[i - 1] if i else left, best[i + 1] if i + 1 < len(best) else right
                cost = next(c for t, c in self.true[x] if t == y)
                gain += max(0.0, min(MOST, cost + self.pair(before, y) - self.pair(before, x) + (self.pair(y, behind) - self.pair(x, behind) if behind else 0.0)))
        return best, gain

    def over(self, left: str, right: str) -> tuple[float, str]:
        """How much likelier the text is if the right line goes on where the left one ends, in logs, and the two joined."""
        a, b = re.search(rf"([{LETTER}ﬁﬂ0-9!]+)$", left.rstrip(HYPHEN)), re.match(rf"([{LETTER}ﬁﬂ0-9!]+)", right)
        bound = lambda x: max(-MOST, min(MOST, x))
        if left[-1:] in HYPHEN and a and b:
            whole = self.word(a[1] + b[1])
            fits = self.known(whole)
            joined = left.rstrip(HYPHEN) + right if left[-1] != "-" or fits or b[1][:1].islower() else left + right
            return bound(1.0 + math.log((fits + 1) / (min(self.known(self.word(a[1])), self.known(self.word(b[1]))) + 1)) if fits else 1.0 if b[1][:1].islower() else 0.5), joined
        if a and b and left[-1:] not in HYPHEN:
            one, two, whole = self.word(a[1]), self.word(b[1]), self.word(a[1] + b[1])
            apart = min(self.known(one), self.known(two))
            parted = math.log((self.known(whole) + 1) / (apart + 1)) if self.known(whole) else -math.inf
            expected = self.known(one) * self.known(two) / self.words
            follows = math.log((self.known(f"{one} {two}") + self.least_word) / (expected + self.least_word)) + (self.lower if two[:1].islower() else self.upper if two[:1].isupper() else 0.0)
            return (bound(parted), left + right) if parted > max(0.0, follows) else (bound(follows), f"{left} {right}")
        spaced = bool(re.search(r"[A-Za-z0-9.!?;,)]$", left) and re.match(r"[A-Za-z0-9(]", right) and left.isascii())
        x, y = left[-1:], right[:1]
        among = math.sqrt(self.of_class[script(x)] * self.of_class[script(y)]) or 1
        known = math.log((self.known(x + y) + self.least_char) / (self.known(x) * self.known(y) / among + self.least_char))
        if b and two_lower(right) and not spaced and x not in END:
            known += self.lower / 2
        if y in CLOSES:
            known += 1.5
        return bound(known if y in CLOSES else 0.0 if x in END else 0.3 * known if x in PAUSE else known), f"{left} {right}" if spaced else left + right


def _runs(at: list[int]) -> list[tuple[int, int]]:
    """Positions side by side as (first, end)."""
    out: list[tuple[int, int]] = []
    for i in at:
        if out and out[-1][1] == i:
            out[-1] = (out[-1][0], i + 1)
        else:
            out.append((i, i + 1))
    return out


def script(c: str) -> int:
    """0 for ASCII and none, 1 for Han, kana and their punctuation, 2 for all others."""
    return 0 if c < "\x80" else 1 if "　" <= c <= "鿿" or "＀" <= c <= "｠" else 2


def two_lower(text: str) -> bool:
    return text[:2].isalpha() and text[:2].islower()


@dataclass
class Page:
    paragraphs: list[str]
    parted: int
    furniture: int
    corrected: int
    gain: float


def furniture(lines: list[str], first: int | None, last: int | None) -> tuple[list[bool], float]:
    """Which lines belong to the page only: numbers that fit the pages, and short headings beside them; and how much likelier
    the lines are so. A number between lines of a row whose pages aren't known counts for less."""
    out, gain = [False] * len(lines), 0.0
    fits = lambda n: first is None or first - 1 <= n <= (first if last is None else max(first, last)) + 1
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or len(s) > 30 or s[-1] in "。！？；!?;，,":
            continue
        m = NUMBER.match(s) or NUMBER.match(s.translate(AS_DIGIT)) if re.search(r"\d", s) else None
        if m and fits(int(m[1])) or not m and first is not None and any(fits(int(n)) for n in DIGITS.findall(s)) and len(re.sub(r"[\d\W_]", "", s)) <= 14 and re.search(r"^\d|\d$|[　 ]{2}|頁|页", s) and not re.search(r"[，。；、]", s) and not re.match(r"[A-Za-z ]+ \d+ g$|\S+ \d+ ?(?:g|mg|克)$", s):
            out[i] = True
            gain += MOST if first is not None else MOST / 2
    for i in [i for i, o in enumerate(out) if o]:
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(lines) and not lines[j].strip() and abs(j - i) <= 2:
                j += step
            if 0 <= j < len(lines) and not out[j]:
                s = lines[j].strip()
                if s and len(s) <= 14 and s[-1] not in END + PAUSE and not lines[j].startswith("　　") and abs(j - i) == 1 and len(s.split()) <= 3 and s[:1] not in "，。；、）":
                    around = max((len(x) for k, x in enumerate(lines) if k != j), default=0)
                    out[j] = len(s) < 0.7 * around
    return out, gain


def width(lengths: list[int]) -> int:
    """The width to which lines are set: where most of them end, within three characters; the longest if none end together."""
    best = max(lengths, default=0)
    most = 1
    for w in sorted(set(lengths), reverse=True):
        n = sum(w - 3 <= x <= w for x in lengths)
        if n > most:
            best, most = w, n
    return best


def repair(text: str, first: int | None, last: int | None, model: Model) -> Page | None:
    """The most probable source of a text; null where it gains too little to be another than what was read."""
    raw = LINES.split(text)
    gone, gain = furniture(raw, first, last)
    most = width([len(x) for x, g in zip(raw, gone, strict=True) if not g and x.strip()])
    for i, line in enumerate(raw):
        # a short line of a title's form, no sentence's end, where the lines are printed full
        s = line.strip()
        if most >= NARROWEST and s and not gone[i] and i + 1 < len(raw) and len(s) <= min(16, 0.55 * most) and HEADING.match(s):
            gone[i] = True
            gain += 1.0
    for i, line in enumerate(raw[1:-1], 1):
        # a short line over which the text runs on, and into which it doesn't
        s = line.strip()
        if s and not gone[i] and len(s) <= 0.55 * most and s[-1] not in END + PAUSE and most >= NARROWEST:
            up, down = (next((raw[j] for j in some if raw[j].strip() and not gone[j]), "") for some in (range(i - 1, -1, -1), range(i + 1, len(raw))))
            if up and down and (skip := model.over(up.strip("　 \t"), down.strip("　 \t"))[0]) > 0.5 and skip > 1 + max(model.over(up.strip("　 \t"), s)[0], model.over(s, down.strip("　 \t"))[0], 0.0):
                gone[i] = True
                gain += 1.0
    keep, blank, paged = [], [], False
    for i, line in enumerate(raw):
        if gone[i]:
            paged = True
        elif line.strip():
            blank.append(bool(keep) and not raw[i - 1].strip() and not paged)
            keep.append(line.rstrip(" "))
            paged = False
        elif i and gone[i - 1]:
            paged = True
    paragraphs: list[str] = []
    parted, corrected = 0, 0
    pending: list[str] = []
    settled: list[str] = []  # of the current paragraph all but its end
    current = ""
    for n, line in enumerate(keep):
        if not current:
            current = line.strip("　 \t")
        if n + 1 < len(keep):
            after = keep[n + 1]
            lead = re.match(r"[A-Za-zÀ-ɏ0-9’'\-]+", after)
            full = most >= NARROWEST and len(line) + (len(lead[0]) + 1 if lead else 1) >= most - 1
            score, joined = model.over(current, after.strip("　 \t"))
            end = line.rstrip()[-1:]
            hyphen = most >= NARROWEST and len(line) >= 8 and end in HYPHEN
            own = score
            score += 0.5 if full or hyphen else -SHORT
            if after.startswith("　　") or ITEM.match(after) or blank[n + 1]:
                score -= 2 * SHORT
            if score > 0:
                if end not in END:
                    gain += min(own, score)
                    parted += 1
                if len(joined) > 400:
                    settled.append(joined[:-100])
                    joined = joined[-100:]
                current = joined
                continue
            if end not in END:
                gain -= 1.0
        pending.append("".join(settled) + current)
        settled, current = [], ""
    for p in pending:
        s, c, g = model.line(p)
        paragraphs.append(s)
        corrected += c
        gain += g
    if gain < GAIN or not (parted or any(gone) or corrected):
        return None
    return Page(paragraphs, parted, sum(gone), corrected, gain)


def repaired(df: DataFrame, key: str = "row", text: str = "raw_text", first: str = "page_start", last: str = "page_end") -> DataFrame:
    """(key, paragraphs, parted, furniture, corrected, gain) of the rows with traces of scanned pages.

    Null, empty and blank texts have no such traces; a row without pages has them if its lines say so; swapped
    pages are put in order; texts of any length are taken whole; repeated rows come out again.
    """
    some = df.where(F.length(text) > 0)
    grams, chars, words = counts(some, text)
    channel = confused(some.where(F.coalesce(first, last).isNotNull()), Model(grams, chars, words), text)
    model = df.sparkSession.sparkContext.broadcast((grams, chars, words, channel))

    def make():
        m = Model(*model.value)

        def work(batch: pa.RecordBatch):
            out: dict[str, list] = {c: [] for c in (key, "paragraphs", "parted", "furniture", "corrected", "gain")}
            for k, t, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                page = repair(t, a, b, m)
                if page:
                    for c, v in zip(out, (k, page.paragraphs, page.parted, page.furniture, page.corrected, page.gain), strict=True):
                        out[c].append(v)
            yield out

        return work

    rows = some.select(F.col(key).alias("k"), F.col(text).alias("t"), F.least(first, last).alias("a"), F.greatest(first, last).alias("b"))
    return map_batches(rows, ["k", "t", "a", "b"], f"{key} {df.schema[key].dataType.simpleString()}, paragraphs array<string>, parted int, furniture int, corrected int, gain double", make)


def scanned(df: DataFrame, key: str = "row") -> DataFrame:
    return repaired(df, key).select(key)

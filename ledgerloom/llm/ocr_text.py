"""Noise in text from scanned pages (problem 3).

1. Lines of page furniture are recognised by recurrence: lines found on several pages of their document; lines
   with the shape of such lines (what stands at their end, or at their beginning with a reference behind
   it), learned from all documents; page numbers in their usual notations; and bare numbers that follow the
   document's own page count (learned from the last lines of its regions).
2. A lexicon is learned from all records: words with at least ``least_share`` of all tokens - at most
   1 / least_share of them, whatever the data, so that every task can hold them - without those that are
   misreadings of a far commoner word of equal skeleton or are mostly found as a part of a broken word.
   Rarer words are judged by the same ratio against words of their skeleton in a distributed join, and the
   readings found are joined to the records that hold them.
3. Each record is decoded as one character stream without furniture. The lattice has a node at every end of
   a token and at every letter inside a token nobody knows; a word may begin and end at any of them, over
   blanks, line ends and hyphens, as it stands or read through character confusions, so that several words
   run together, broken words and blanks in the wrong place are resolved jointly by one dynamic program.
4. Paragraph boundaries are placed by dynamic programming over the remaining lines: its states are the widths
   a paragraph may have, lines cost what they fall short of or exceed it, breaks cost by their evidence.

Defined results: null text -> no row; empty text -> an empty text and no fixes; ties go to the commoner
word, then the alphabet; words unknown to the lexicon stay as they are; repeated rows are one record
per id and text; extra columns are ignored; texts are decoded whole whatever their length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.addresses import deletions, osa
from ledgerloom.session import spread, stage

# Characters used as hyphens at line ends.
HYPHENS = "-­¬‐‑‒–"
# Classes of characters that scanners take for each other, then pairs read as one letter.
ALIKE = {"0": "o", "1": "i", "|": "i", "l": "i", "!": "i", "5": "s", "$": "s", "9": "g", "q": "g", "(": "c", "e": "c", "f": "t", "6": "b", "8": "b", "h": "b", "u": "n", "v": "y"}
PAIRS = [("rn", "m"), ("ci", "d"), ("ii", "n"), ("yy", "w"), ("nn", "m"), ("rm", "m")]
_FOLD = str.maketrans(ALIKE)

_PAGE = re.compile(r"^(?:(?:page|pg|p)\b\.?\s*\d+(?:\s*(?:of|/)\s*\d+)?|[-–—]\s*\d+\s*[-–—]|\[\s*\d+\s*\]|\d{1,4}\s*/\s*\d{1,4}|page\s+\d+\s+of\s+\d+)$", re.I)
_REFERENCE = re.compile(r"^[\w|(!$]*[^\W\d_][\w|(!$]*/\d+$")
_WORD = re.compile(r"\S+")
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "|($!") + "“”‘’«»…"


def bare(word: str) -> str:
    """The letters with marks removed, lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


@lru_cache(500_000)
def skeletons(word: str) -> tuple[str, str]:
    """What confusable readings of a word have in common, with the pairs levelled in either order."""
    s = t = bare(word).translate(_FOLD)
    for a, b in PAIRS:
        s = s.replace(a, b)
    for a, b in (PAIRS[2], *PAIRS[:2], *PAIRS[3:]):
        t = t.replace(a, b)
    return s.replace("d", "o"), t.replace("d", "o")


def skeleton(word: str) -> str:
    return skeletons(word)[0]


def furniture(lines: list[str], bare_numbers: bool, offset: int | None, page: int | None, repeated: frozenset[str] = frozenset(), shapes: frozenset[str] = frozenset()) -> set[int]:
    """Numbers of the lines that are running headers or footers or page numbers."""
    out = set()
    for k, x in enumerate(lines):
        s = x.strip()
        if not s:
            continue
        if _PAGE.match(s) or (bare_numbers and s.isdigit() and offset is not None and page is not None and int(s) - page == offset):
            out.add(k)
        elif edge_line(s) and ((repeated and header_key(s) in repeated) or (shapes and any(t in shapes for t in line_shapes(s, True)))):
            out.add(k)
    return out


def edge_line(s: str) -> bool:
    """Whether a line may be a running one: more than a word, no sentence's end, no table."""
    return " " in s and not s.startswith("|") and s[-1] not in ".;:,!?"


_YEAR = re.compile(r"(?:19|20)\d\d$")


def without_page(line: str) -> list[str]:
    """The words of a line without a page number before a bar, or one at the end: a number that is no year, or
    stands behind a year or a reference."""
    words = re.sub(r"^\d{1,6}\s*\|\s*", "", line.strip()).split()
    if len(words) >= 3 and words[-1].isdigit() and len(words[-1]) <= 6 and (_YEAR.match(words[-2]) or _REFERENCE.match(words[-2]) or (not _YEAR.match(words[-1]) and re.search(r"\s{2,}\d+$", line.rstrip()))):
        words.pop()
    return words


def header_key(line: str) -> str:
    """What a running line has in common on all pages: its letters and figures but the page number."""
    return " ".join(skeleton(w) for w in without_page(line))


@lru_cache(100_000)
def line_shapes(line: str, slips: bool = False) -> tuple[str, ...]:
    """What running lines of many documents have in common: the last word before a year, or the first word
    before a reference. ``slips``: also the shapes that leave out one letter of the word."""
    words = without_page(line)
    if len(words) < 2:
        return ()
    end = words[-1]
    if _YEAR.match(end) and words[0][:1].isalpha() and all(any(c.isalpha() for c in w) for w in words[:-1]):
        sort, word = f"{len(words)} year", skeleton(words[-2].strip(".,"))
    elif _REFERENCE.match(end) and words[0][:1].isalpha():
        sort, word = "reference", skeleton(words[0].strip(".,"))
    else:
        return ()
    out = [f"{sort} {word}"]
    if len(word) >= 5:  # each shape is known by its word and by the word without any one letter
        out += [f"{sort} ~{word[:i]}{word[i + 1:]}" for i in range(len(word))]
        out += [f"{sort} ~{word}"] if slips else []
    return tuple(out) if slips else tuple(out[:1])


def with_slips(shapes: set[str]) -> frozenset[str]:
    """The shapes and those that leave out one letter, by which a damaged line still meets its shape."""
    out = set(shapes)
    for x in shapes:
        sort, word = x.rsplit(" ", 1)
        if len(word) >= 5:
            out |= {f"{sort} ~{word}"} | {f"{sort} ~{word[:i]}{word[i + 1:]}" for i in range(len(word))}
    return frozenset(out)


def tokens(text: str, lines: list[str], skip: set[int]) -> list[tuple[int, str, bool]]:
    """(line, token, is last of its line) of the lines that are not furniture."""
    out = []
    for k, line in enumerate(lines):
        if k in skip:
            continue
        found = _WORD.findall(line.replace("|", " ") if line.lstrip().startswith("| ") else line)
        out += [(k, w, i == len(found) - 1) for i, w in enumerate(found)]
    return out


@lru_cache(500_000)
def core(token: str) -> str:
    """A token without surrounding punctuation."""
    t = token.strip(_STRIP)
    if t.startswith("(") and t.endswith(")") or t.startswith("(") and not t[1:2].isalpha():
        t = t.strip("()")
    return t.rstrip("(!|$") if t[-1:] in "(!$" else t


@lru_cache(500_000)
def plain_word(t: str) -> bool:
    return bool(re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)*", t))


class Lexicon:
    """Words with counts, their skeletons and deletion neighbourhoods."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.longest = max(map(len, counts), default=0) + 2  # a reading is at most two letters shorter than what is read
        self.readings: dict[str, tuple[str, float] | None] = {}
        self.total = max(sum(counts.values()), 1)
        self.by_skeleton: dict[str, list[str]] = {}
        for w in counts:
            for s in set(skeletons(w)):
                self.by_skeleton.setdefault(s, []).append(w)
        self.near: dict[str, list[str]] = {}
        for w in counts:
            if len(w) >= 6:
                for d in deletions(w, 1):
                    self.near.setdefault(d, []).append(w)

    def __contains__(self, word: str) -> bool:
        return word in self.counts

    def cost(self, word: str) -> float:
        return 0.02 * math.log(self.total / self.counts[word])

    def read(self, text: str, rare: dict[str, str] | None = None) -> tuple[str, float] | None:
        """The likeliest word for a misread one and the cost of the confusions. ``rare``: readings of words
        that are too rare for the lexicon."""
        if rare and text in rare:
            return rare[text], 1.3
        if text not in self.readings:
            if len(self.readings) > 500_000:
                self.readings.clear()
            self.readings[text] = self._read(text)
        return self.readings[text]

    def _read(self, text: str) -> tuple[str, float] | None:
        if not 2 <= len(text) <= 2 * self.longest:  # a letter is read as two at most
            return None
        found = [(1.0 + 0.3 * osa(text, w, 4) + self.cost(w), w) for w in {w for s in skeletons(text) for w in self.by_skeleton.get(s, ())}]
        if not found and len(text) >= 6 and plain_word(text):
            close = {w for d in deletions(text, 1) for w in self.near.get(d, ())}
            found = [(2.2 + self.cost(w), w) for w in close if osa(text, w, 1) <= 1]
        return min(found)[::-1] if found else None

    def confused(self, text: str) -> tuple[str, float] | None:
        """The likeliest word of equal skeleton only."""
        found = [(1.0 + 0.3 * osa(text, w, 4) + self.cost(w), w) for w in {w for s in skeletons(text) for w in self.by_skeleton.get(s, ())}]
        return min(found)[::-1] if found else None


@lru_cache(500_000)
def wordlike(text: str) -> bool:
    """Whether a token can be a misread word: mostly letters, no slash or other figures' punctuation."""
    letters = sum(c.isalpha() for c in text)
    others = sum(c in "015689|($!" for c in text)
    return letters >= 1 and letters + others + text.count("-") == len(text) and letters >= 2 * others and not re.fullmatch(r"\d+(?:st|nd|rd|th)", text)


class Unit:
    """A token of the stream: what it reads as alone, what it gives to a word that goes on, and how."""

    __slots__ = ("line", "raw", "core", "stem", "hyphen", "last", "joins", "known", "cuttable")

    def __init__(self, line: int, raw: list[str], last: bool, lex: Lexicon, rare: dict[str, str]):
        self.line, self.raw, self.last = line, raw, last
        self.core = core(raw[0]).lower()
        left = raw[0].lstrip(_OUTER).lower()
        self.hyphen = last and (len(raw) > 1 or (left != "" and left[-1] in HYPHENS))
        self.stem = left.rstrip(HYPHENS) if self.hyphen else left
        self.known = self.core in lex or not wordlike(self.core) or rare.get(self.core) == self.core
        self.cuttable = not self.known and len(self.core) >= 4 and plain_word(self.core)
        self.joins = bool(self.stem) if self.hyphen else left != "" and (left[-1].isalnum() or left[-1] in "|(-")


_OUTER = _STRIP.replace("-", "")
#: Costs in the lattice: an unknown word (and each letter of it beyond UNKNOWN_LETTERS), the first cut inside a token and
#: each further one, a blank left out (with a part unknown, with all known), a line end, a hyphen at a line end, each further part.
UNKNOWN, UNKNOWN_LETTER, UNKNOWN_LETTERS, CUT, NEXT_CUT, BLANK, BLANK_KNOWN, LINE_END, HYPHEN, FURTHER = 4.0, 0.3, 9, 2.5, 1.0, 1.2, 3.2, 0.4, 0.4, 0.4
Word = tuple[int, list[str], str, bool]  # line, raw tokens it touches, word, changed


def units_of(tk: list[tuple[int, str, bool]], lex: Lexicon, rare: dict[str, str]) -> list[Unit]:
    """The tokens with lone hyphens at line ends given to the token before."""
    out: list[Unit] = []
    i = 0
    while i < len(tk):
        line, raw, last = tk[i]
        if not last and i + 1 < len(tk) and tk[i + 1][2] and tk[i + 1][1] in HYPHENS and len(tk[i + 1][1]) == 1 and core(raw):
            out.append(Unit(line, [raw, tk[i + 1][1]], True, lex, rare))
            i += 2
        else:
            out.append(Unit(line, [raw], last, lex, rare))
            i += 1
    return out


def decode(tk: list[tuple[int, str, bool]], lex: Lexicon, rare: dict[str, str] | None = None) -> list[Word]:
    """The words along the cheapest path through the character lattice of a record."""
    u = units_of(tk, lex, rare or {})
    n = len(u)
    # whether a word that begins here can reach a token that needs repair before it is too long
    touched = [False] * (n + 1)
    for i in range(n - 1, -1, -1):
        touched[i] = not u[i].known or (u[i].hyphen and i + 1 < n) or (u[i].joins and len(u[i].stem) < lex.longest and i + 1 < n and touched[i + 1])
    best: dict[tuple[int, int], tuple[float, tuple[int, int] | None, str, bool]] = {(0, 0): (0.0, None, "", False)}
    for i in range(n):
        x = u[i]
        for o in range(len(x.core) if x.cuttable else 1):
            node = (i, o)
            if node not in best:
                continue
            here = best[node][0]

            def offer(to: tuple[int, int], cost: float, word: str, changed: bool = True) -> None:
                if to not in best or here + cost < best[to][0] - 1e-12:  # noqa: B023
                    best[to] = (here + cost, node, word, changed)  # noqa: B023

            if o == 0:
                if x.known:
                    offer((i + 1, 0), 1.5 if x.hyphen and x.core and i + 1 < n else 0.0, x.core, False)
                    if not touched[i]:
                        continue
                else:
                    offer((i + 1, 0), UNKNOWN + UNKNOWN_LETTER * max(0, len(x.core) - UNKNOWN_LETTERS), x.core, False)
                    r = lex.read(x.core, rare)
                    if r:
                        offer((i + 1, 0), r[1], r[0])
            else:
                rest = x.core[o:]
                if rest in lex:
                    offer((i + 1, 0), lex.cost(rest), rest)
                elif len(rest) >= 5 and (r := lex.confused(rest)):
                    offer((i + 1, 0), r[1], r[0])
            if x.cuttable:
                for e in range(o + 2, len(x.core) - 1):
                    w = x.core[o:e]
                    if w in lex:
                        offer((i, e), lex.cost(w) + (NEXT_CUT if o else CUT), w)
                    elif e - o >= 5 and o == 0 and (r := lex.confused(w)):
                        offer((i, e), r[1] + CUT, r[0])
            # words that go on over blanks, line ends and hyphens
            acc, j, known = x.stem[o:] if o == 0 else x.core[o:], i, x.known and o == 0
            while u[j].joins and j + 1 < n and acc and len(acc) <= lex.longest and (u[j].hyphen or u[j + 1].raw[0][0] not in _OUTER):
                broken, ends = u[j].hyphen, u[j].last
                j += 1
                y = u[j]
                if not y.core:
                    break
                known = known and y.known
                base = HYPHEN if broken else (BLANK_KNOWN if known else BLANK) + (LINE_END if ends else 0.0)
                base += FURTHER * (j - i - 1)
                tail = y.core
                for f in [acc + tail] + ([acc + "-" + tail] if broken else []):
                    if f in lex:
                        offer((j + 1, 0), base + lex.cost(f), f)
                    elif o == 0 and wordlike(f) and (r := lex.read(f, rare)):
                        offer((j + 1, 0), base + r[1], r[0])
                # a word nobody knows may be broken in two, but is not made of several
                if broken and o == 0 and j == i + 1 and wordlike(acc + tail):
                    offer((j + 1, 0), base + 2.8, acc + tail)
                if y.cuttable:
                    for e in range(1, len(tail) - 1):
                        if acc + tail[:e] in lex:
                            offer((j, e), base + CUT + lex.cost(acc + tail[:e]), acc + tail[:e])
                acc += y.stem
    out: list[Word] = []
    at = (n, 0)
    while at != (0, 0):
        _, before, word, changed = best[at]
        (i, _), (j, e) = before, at
        out.append((u[i].line, [w for k in range(i, j + (e > 0)) for w in u[k].raw], word, changed))
        at = before
    return out[::-1]


def repair(text: str, lex: Lexicon, skip: set[int], rare: dict[str, str] | None = None) -> tuple[list[tuple[int, str]], list[Word]]:
    """Fixes (line, word) and the decoded words."""
    lines = text.split("\n")
    words = decode(tokens(text, lines, skip), lex, rare)
    return [(line, w) for line, _, w, changed in words if changed and w], words


def breaks(lines: list[str], skip: set[int], kept: list[int]) -> list[bool]:
    """Whether a paragraph ends after each kept line but the last: the cheapest path of a program whose states
    are the widths a paragraph may have (at most eight of those the record has)."""
    size = [len(lines[k].strip()) for k in kept]
    ranked = sorted(set(size))
    widths = sorted({ranked[(len(ranked) - 1) * q // 7] for q in range(8)})
    table = [lines[k].lstrip().startswith("|") for k in kept]
    ended = [lines[k].rstrip().endswith((".", "!", "?", ":", ";")) for k in kept]

    def line_cost(i: int, w: int, closes: bool) -> float:
        """A line wider than its paragraph, or one that falls short of it although the paragraph goes on."""
        over = 2.0 * max(0.0, size[i] / w - 1.05) if w else 0.0
        short = (1.2 if ended[i] else 0.3) if not closes and size[i] < 0.75 * w else 0.0
        return over + short

    n = len(kept)
    cost = [0.0] * len(widths)  # of the best path on which the paragraph that holds line i has each width
    back: list[list[tuple[bool, int]]] = []
    for i in range(n - 1):
        a, b = kept[i], kept[i + 1]
        blank = any(k not in skip and not lines[k].strip() for k in range(a + 1, b))
        low = lines[b].lstrip()[:1].islower()
        inside = (2.0 if blank and ended[i] else 0.5 if blank else 0.0) + (3.0 if table[i] or table[i + 1] else 0.0)
        cut = 0.6 + (0.0 if ended[i] else 1.5) + (1.0 if low and not table[i] else 0.0)
        closing = min(range(len(widths)), key=lambda s: (cost[s] + line_cost(i, widths[s], True), s))  # noqa: B023
        away = cost[closing] + line_cost(i, widths[closing], True) + cut
        now, step = [], []
        for s, w in enumerate(widths):
            stay = cost[s] + line_cost(i, w, False) + inside
            now.append(min(stay, away))
            step.append((away < stay, closing if away < stay else s))
        cost = now
        back.append(step)
    s = min(range(len(widths)), key=lambda k: (cost[k] + (line_cost(n - 1, widths[k], True) if n else 0.0), k))
    out = []
    for step in reversed(back):
        broken, s = step[s]
        out.append(broken)
    return out[::-1]


def paragraphs(text: str, words: list[Word], skip: set[int]) -> list[str]:
    """The repaired lines as paragraphs."""
    lines = text.split("\n")
    shown: dict[int, list[str]] = {}
    for line, raw, word, changed in words:
        said = raw[0]
        if changed:
            first, end = raw[0], raw[-1]
            lead = first[: len(first) - len(first.lstrip(_STRIP))] if core(first).lower()[:1] == word[:1] else ""
            trail = end[len(end.rstrip(_STRIP)) :] if end[-1] not in HYPHENS and core(end).lower()[-1:] == word[-1:] else ""
            body = first.strip(_STRIP)
            said = lead + (word.upper() if len(body) > 1 and body.isupper() else word.capitalize() if body[:1].isupper() and lead + body[:1].lower() == lead + word[:1] else word) + trail
        elif len(raw) > 1:
            said = raw[0] + raw[1]
        shown.setdefault(line, []).append(said)
    kept = [k for k in range(len(lines)) if k in shown]
    if not kept:
        return []
    out, now = [], " ".join(shown[kept[0]])
    for broken, k in zip(breaks(lines, skip, kept), kept[1:]):
        if broken:
            out.append(now)
            now = " ".join(shown[k])
        else:
            now += " " + " ".join(shown[k])
    return [*out, now]


def page_clues(records: DataFrame, least_lines: int = 3, least_share: float = 1e-3) -> tuple[DataFrame, frozenset[str]]:
    """``records``(doc, page, text) -> (doc, offset of its bare page numbers, running: keys of lines on several
    pages) and the shapes of running lines: those of ``least_lines`` different running lines and of
    ``least_share`` of all, so at most 1 / least_share are collected."""

    def clues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, page, text in zip(pdf.doc, pdf.page, pdf.text):
                lines = [x.strip() for x in text.split("\n") if x.strip()]
                for k, s in enumerate(lines):
                    if s.isdigit() and k == len(lines) - 1 and len(s) < 10:
                        out.append((doc, page, int(s) - int(page), None, None))
                    elif edge_line(s):
                        shape = line_shapes(s)
                        if shape or k in (0, len(lines) - 1):
                            out.append((doc, page, None, header_key(s), shape[0] if shape else None))
            yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(("doc", "page", "off", "running", "shape"))})

    rows = stage(records.filter("doc is not null and page is not null").select("doc", "page", "text").mapInPandas(clues, "doc string, page int, off int, running string, shape string"))
    offs = rows.filter("off is not null").groupBy("doc", "off").agg(F.countDistinct("page").alias("n")).groupBy("doc").agg(F.max_by("off", F.struct("n", -F.abs("off"), "off")).alias("offset"))
    runs = stage(rows.filter("running <> ''").groupBy("doc", "running").agg(F.countDistinct("page").alias("n"), F.min("shape").alias("shape")).filter("n > 1"))
    lines = runs.filter("shape is not null").groupBy("shape").agg(F.countDistinct("running").alias("n"))
    total = lines.agg(F.sum("n").alias("n")).first().n or 0
    shapes = {r.shape for r in lines.filter(F.col("n") >= max(least_lines, least_share * total)).select("shape").collect()}
    run = runs.groupBy("doc").agg(F.collect_list("running").alias("running"))
    return offs.join(run, "doc", "full"), with_slips(shapes)


#: Counts stand apart by this if the rarer of two like words is a misreading of the other.
RATIO = 20


def learn_lexicon(records: DataFrame, shapes: frozenset[str], least_share: float = 5e-5) -> tuple[dict[str, int], DataFrame]:
    """Counts of the lexicon's words, and readings(id, rare: map of word to word) of the words too rare for it.
    ``records``(id, text). Collected: at most 1 / least_share words, twice."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for text in pdf.text:
                lines = text.split("\n")
                tk = tokens(text, lines, furniture(lines, False, None, None, shapes=shapes))
                for i, (_, w, last) in enumerate(tk):
                    broken = (last and w[-1] in HYPHENS) or (i and tk[i - 1][2] and tk[i - 1][1][-1] in HYPHENS)
                    x = core(w).lower()
                    if not broken and plain_word(x):
                        c[x] += 1
            yield pd.DataFrame(list(c.items()), columns=["word", "n"])

    words = stage(records.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n").alias("total")).first().total or 0
    frequent = {r.word: r.n for r in words.filter(F.col("n") >= least_share * total).select("word", "n").collect()}
    top: dict[str, int] = {}
    for w, k in frequent.items():
        for s in skeletons(w):
            top[s] = max(top.get(s, 0), k)
    counts = {w: k for w, k in frequent.items() if k * RATIO > max(top[s] for s in skeletons(w))}

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Parts of broken words with their number, and each record's words that are too rare to be known here."""
        lex = Lexicon(counts)
        for pdf in batches:
            c: Counter = Counter()
            asked = []
            for i, text in zip(pdf.id, pdf.text):
                lines = text.split("\n")
                tk = tokens(text, lines, furniture(lines, False, None, None, shapes=shapes))
                x = [core(w).lower() for _, w, _ in tk]
                for a, b in zip(x, x[1:]):
                    m = counts.get(a + b, 0)
                    for part in (a, b) if m else ():
                        if part in counts and m > 3 * counts[part]:
                            c[part] += 1
                for w in {w for w in x if w not in frequent and len(w) >= 4 and wordlike(w)}:
                    r = lex.read(w)
                    asked += [(i, w, s, 0, counts[r[0]] if r else 0) for s in ({""} if r else set(skeletons(w)))]
            rows = [(None, w, None, n, 0) for w, n in c.items()] + asked
            yield pd.DataFrame(rows, columns=["id", "word", "skeleton", "n", "reading"])

    found = stage(records.select("id", "text").mapInPandas(second, "id string, word string, skeleton string, n long, reading long"))
    parts = found.filter("id is null").groupBy("word").agg(F.sum("n").alias("n")).collect()  # of words of the lexicon
    drop = {r.word for r in parts if r.n * 2 >= counts[r.word]}

    def skeletal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, w, n) for w, n in zip(pdf.word, pdf.n) if len(w) >= 4 for s in set(skeletons(w))]
            yield pd.DataFrame(rows, columns=["skeleton", "top", "top_n"])

    # a rare word stands if it is not far rarer than what it would be read as, and is read as a rare word far commoner
    rare = words.filter(F.col("n") < least_share * total)
    tops = rare.filter(F.col("n") >= RATIO).mapInPandas(skeletal, "skeleton string, top string, top_n long").groupBy("skeleton").agg(F.max_by("top", F.struct("top_n", "top")).alias("top"), F.max("top_n").alias("top_n"))
    asked = found.filter("id is not null").select("id", "word", "skeleton", "reading").distinct().join(rare, "word", "left").join(tops, "skeleton", "left")
    own = F.coalesce("n", F.lit(0))
    reading = F.when((F.col("reading") > 0) & (own * RATIO > F.col("reading")), F.col("word")).when((F.col("reading") == 0) & (F.col("top_n") >= F.greatest(own, F.lit(1)) * RATIO), F.col("top"))
    told = asked.select("id", "word", reading.alias("fix")).filter("fix is not null").groupBy("id", "word").agg(F.min("fix").alias("fix"))
    readings = told.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "fix"))).alias("rare"))
    return {w: k for w, k in counts.items() if w not in drop}, readings


def repaired(records: DataFrame, least_share: float = 5e-5) -> DataFrame:
    """``records``(id, doc, page, text) -> id, fixes array<struct<line_no, fix>>, paragraphs array<string>."""
    records = records.select(F.col("id").cast("string").alias("id"), F.col("doc").cast("string").alias("doc"), F.col("page").cast("int").alias("page"), "text")
    records = stage(spread(records.filter("text is not null"), "id").distinct())
    clues, shapes = page_clues(records)
    counts, readings = learn_lexicon(records, shapes, least_share)
    # records without a document stay out of the join: they would all meet in one task
    clued = records.filter("doc is not null").join(clues, "doc", "left").select("id", "text", "page", "offset", "running")
    loose = records.filter("doc is null").select("id", "text", "page", F.lit(None).cast("int").alias("offset"), F.lit(None).cast("array<string>").alias("running"))
    clued = spread(clued.unionByName(loose).join(readings, "id", "left"), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(counts)
        for pdf in batches:
            fixes, texts = [], []
            for text, page, offset, running, rare in zip(pdf.text, pdf.page, pdf.offset, pdf.running, pdf.rare):
                lines = text.split("\n")
                told = not pd.isna(offset) and not pd.isna(page)
                repeated = frozenset(running) if running is not None else frozenset()
                skip = furniture(lines, told, int(offset) if told else None, int(page) if told else None, repeated, shapes)
                found, words = repair(text, lex, skip, dict(rare) if rare is not None else None)
                fixes.append([{"line_no": k, "fix": w} for k, w in sorted(set(found) | {(k, "") for k in skip})])
                texts.append(paragraphs(text, words, skip))
            yield pd.DataFrame({"id": pdf.id, "fixes": fixes, "paragraphs": texts})

    return clued.select("id", "text", "page", "offset", "running", "rare").mapInPandas(run, "id string, fixes array<struct<line_no:int,fix:string>>, paragraphs array<string>")

"""Splitting oversized texts at natural boundaries with a fixed overlap (problem 4).

A text is an item too large if it has more than ``limit`` characters. Cuts are chosen by dynamic
programming over boundary positions, from the most natural class to the least: paragraph, line,
sentence, word, none. A class serves if cutting everywhere at it leaves parts of at most
``limit - overlap`` characters (white space at the ends of a part not counted); the first that serves is
the text's ``boundary``, and the program then sees the positions of this and the better classes only. A
cut costs the penalty of the best class ending there plus the squared imbalance of its piece, under the
hard limits that a piece has at most ``limit`` characters and that every piece after the first begins
exactly ``overlap`` characters before the end of the one before. White space counts towards that limit,
so a text whose parts are far apart may need positions of the next classes as well.

Defined results: null text -> no piece, boundary null; an empty or short text -> one piece, boundary
null; a text without any boundary -> hard cuts. Positions count characters; joining the pieces
without their overlaps gives the text back exactly. Repeated rows are kept; other columns are carried
except those named boundary, piece_no, start, piece, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASSES = ["paragraph", "line", "sentence", "word"]
#: What separates the parts of a class; a cut lies at its end, white space at the ends of parts does not count.
_CUTS = [re.compile(r, re.A) for r in (r"\n[ \t\r]*(?:\n[ \t\r]*)+", r"\n", r"\n|(?<=[.!?])\s+", r"[ \t\r\n]+")]
_PENALTY = [0.0, 0.6, 1.0, 2.0, 8.0]
_BLANK = " \t\r\n"


def boundaries(text: str, most: int) -> tuple[list[np.ndarray], int]:
    """Positions where the parts of each class end, up to the first class all of whose parts have at most
    ``most`` characters, and the number of that class (4: none of them)."""
    found = []
    for level, pattern in enumerate(_CUTS):
        at, ends, fits = 0, [], True
        for m in pattern.finditer(text):
            fits = fits and (m.start() - at <= most or len(text[at : m.start()].strip(_BLANK)) <= most)
            at = m.end()
            ends.append(at)
        found.append(np.array(ends, dtype=np.int64))
        if fits and (len(text) - at <= most or len(text[at:].strip(_BLANK)) <= most):
            return found, level
    return found, len(_CUTS)


def _program(spots: np.ndarray, cost: np.ndarray, limit: int, overlap: int, balance: float) -> list[int] | None:
    """The cheapest ends of pieces among ``spots`` (0 and the text's length included), None if there are none."""
    n, fresh = int(spots[-1]), limit - overlap  # later pieces hold ``fresh`` new characters
    pieces = max(2, -(-(n - overlap) // fresh))
    ideal = (n - overlap) / pieces
    best, back = np.full(len(spots), np.inf), np.zeros(len(spots), dtype=np.int64)
    best[0] = 0.0
    first = np.searchsorted(spots, spots - fresh)
    for j in range(1, len(spots)):
        e = int(spots[j])
        lo = 0 if e <= limit else int(first[j])
        starts = spots[lo:j]
        new = e - starts
        value = best[lo:j] + balance * ((new - ideal) / ideal) ** 2
        if lo == 0:  # the first piece may be longer, but gives its overlap away and must go beyond it
            value[new > fresh] = np.inf
            value[0] = balance * ((e - overlap - ideal) / ideal) ** 2 if overlap < e <= limit else np.inf
        if len(value):
            k = int(np.argmin(value))
            best[j] = value[k] + (cost[j] + 0.05 if e < n else 0.0)
            back[j] = lo + k
    if not np.isfinite(best[-1]):
        return None
    ends, j = [], len(spots) - 1
    while j > 0:
        ends.append(int(spots[j]))
        j = int(back[j])
    return ends[::-1]


def cut(text: str, limit: int = 1000, overlap: int = 100, balance: float = 0.5) -> tuple[list[int], str | None]:
    """Ends of the pieces and the boundary class. The first piece is [0, e0), the next [e0 - overlap, e1) and so on."""
    n, fresh = len(text), limit - overlap
    if n <= limit:
        return [n], None
    found, level = boundaries(text, fresh)
    name = [*CLASSES, "none"][level]
    for last in range(level, len(_CUTS) + 1):
        if last < len(_CUTS) and len(found) <= last:
            found.append(np.array([m.end() for m in _CUTS[last].finditer(text)], dtype=np.int64))
        penalty = np.full(n + 1, _PENALTY[-1])
        for k in range(min(last, len(_CUTS) - 1), -1, -1):
            penalty[found[k]] = _PENALTY[k]
        spots = np.unique(np.concatenate([[0, n], *found[: last + 1]])).astype(np.int64)
        if last == len(_CUTS):  # inside stretches without boundaries any position may be cut
            gaps = np.flatnonzero(np.diff(spots) > fresh // 3)
            spots = np.unique(np.concatenate([spots, *[np.arange(spots[g] + 1, spots[g + 1]) for g in gaps]]))
        ends = _program(spots, penalty[spots], limit, overlap, balance)
        if ends:
            return ends, name
    return _program(np.arange(n + 1), penalty, limit, overlap, balance), name


def split_texts(df: DataFrame, text: str = "text", limit: int = 1000, overlap: int = 100) -> DataFrame:
    """One row per piece: the input columns, ``boundary``, ``piece_no``, ``start`` and ``piece``."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, names, numbers, starts, pieces = [], [], [], [], []
            for i, t in enumerate(pdf[text]):
                ends, name = cut(t, limit, overlap)
                for k, e in enumerate(ends):
                    a = ends[k - 1] - overlap if k else 0
                    rows.append(i)
                    names.append(name)
                    numbers.append(k)
                    starts.append(a)
                    pieces.append(t[a:e])
            yield pdf.iloc[rows].assign(boundary=names, piece_no=numbers, start=starts, piece=pieces)

    df = df.drop("boundary", "piece_no", "start", "piece")
    more = "boundary string, piece_no int, start int, piece string"
    # only oversized texts visit Python, and each once: a batch function cannot be copied below a filter or a distinct
    small = df.filter(F.length(text) <= limit).select("*", F.lit(None).cast("string").alias("boundary"), F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.col(text).alias("piece"))
    large = df.filter(F.length(text) > limit)
    schema = T.StructType([*large.schema.fields, *T.StructType.fromDDL(more).fields])
    return small.unionByName(large.mapInPandas(run, schema))

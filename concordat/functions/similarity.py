"""Sequence similarity and character diffs, where Spark has no equivalent.

Both are Arrow UDFs over a few strings per row.  Callers pass NULL for rows that
equality or containment already settled, so only the residue pays for Python.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.text import STRAIGHT_QUOTES, TRAILING_MARKS, edit_distance, let

DIFF_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField("op", T.StringType()), T.StructField("segment", T.StringType())]
    )
)

WINDOW_TYPE = T.StructType(
    [T.StructField("window", T.StringType()), T.StructField("score", T.DoubleType())]
)


class Words:
    """A text's words, laid out so that the letters of each distinct one are counted at once."""

    def __init__(self, words: list[str]):
        distinct = {word: i for i, word in enumerate(dict.fromkeys(words))}
        self.words, self.distinct = words, len(distinct)
        self.places = np.array([distinct[word] for word in words], dtype=np.int64)
        # A lone surrogate ends each word; no text holds one.
        self.codes = np.frombuffer("".join(f"{word}\ud800" for word in distinct).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(word) for word in distinct], dtype=np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.chars = np.concatenate([[0], np.cumsum(sizes[self.places])])

    def runs(self, size: int) -> np.ndarray:
        """Where runs of ``size`` words start, equal runs once if their words fit one number."""
        starts = len(self.words) - size + 1
        if self.distinct**size >= 1 << 62:
            return np.arange(starts)
        run = self.places[:starts]
        for i in range(1, size):
            run = run * self.distinct + self.places[i : i + starts]
        return np.unique(run, return_index=True)[1]


class Needle:
    """The characters of a needle: how many of each, and where."""

    def __init__(self, needle: str):
        self.letters = sorted(set(needle))
        self.need = np.array([needle.count(ch) for ch in self.letters], np.int64).reshape(-1, 1)
        self.codes = np.array([ord(ch) for ch in self.letters], np.uint32).reshape(-1, 1)
        self.blank = self.letters.index(" ") if " " in self.letters else None
        self.masks: dict[str, int] = {}
        for i, ch in enumerate(needle):
            self.masks[ch] = self.masks.get(ch, 0) | 1 << i


#: The last texts and needles; several needles look through one text, and a needle through several.
_words = lru_cache(4)(lambda text: Words(text.split()))
_needle = lru_cache(64)(Needle)


def window_bounds(needle: str, words: Words, size: int, starts: np.ndarray) -> np.ndarray:
    """Upper bound on the similarity of ``needle`` to the runs of ``size`` words at ``starts``.

    The bound counts shared characters regardless of order, from prefix sums, so
    one pass over the text rates every window.
    """
    known = _needle(needle)
    have = np.add.reduceat(words.codes == known.codes, words.starts, axis=1, dtype=np.int64)[:, words.places]
    total = np.zeros((len(known.letters), len(words.words) + 1), np.int64)
    np.cumsum(have, axis=1, out=total[:, 1:])
    inside = total[:, starts + size] - total[:, starts]
    if known.blank is not None:
        inside[known.blank] = size - 1  # the blanks between the words
    shared = np.minimum(inside, known.need).sum(axis=0)
    width = words.chars[starts + size] - words.chars[starts] + size - 1
    return 2.0 * shared / (len(needle) + width)


#: Length of a second string from which the matcher sets its frequent characters aside.
_FREQUENT_FROM = 200


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of two strings, of which the second is shorter than
    ``_FREQUENT_FROM``: the longest common run (ties: earliest in ``a``, then in ``b``) and those of the
    regions before and after it."""
    total, open_regions = 0, [(0, len(a), 0, len(b))]
    while open_regions:
        a_from, a_to, b_from, b_to = open_regions.pop()
        size = at = found = 0
        i = a_from
        while i + size < a_to:
            # Only a longer run than the best one counts.
            j = b.find(a[i : i + size + 1], b_from, b_to)
            if j < 0:
                i += 1
            else:
                size, at, found = size + 1, i, j
        if size:
            total += size
            if a_from < at and b_from < found:
                open_regions.append((a_from, at, b_from, found))
            if at + size < a_to and found + size < b_to:
                open_regions.append((at + size, a_to, found + size, b_to))
    return total


def common(masks: dict[str, int], needle: str, window: str) -> int:
    """Length of the longest common subsequence, which no matching blocks exceed; bit by bit in whole
    numbers.  ``masks`` has the places of each character in the needle."""
    ones = (1 << len(needle)) - 1
    row = ones
    for ch in window:
        if ch in masks:
            hit = row & masks[ch]
            row = (row + hit) | (row - hit)
    return len(needle) - (row & ones).bit_count()


def _short_window_ratio(needle: str, window: str) -> float:
    length = len(needle) + len(window)
    return 2.0 * matched(needle, window) / length if length else 1.0


#: Ratios of short strings that a worker keeps; texts of one kind share many of their windows.
_KEPT, _SHORT = 1 << 16, 128
_short_ratio = lru_cache(_KEPT)(_short_window_ratio)


def ratio(needle: str, window: str) -> float:
    """The sequence ratio of a needle and one window."""
    if len(needle) + len(window) <= _SHORT:
        return _short_ratio(needle, window)
    if len(window) < _FREQUENT_FROM:
        return _short_window_ratio(needle, window)
    return SequenceMatcher(None, needle, window).ratio()


def whole_bound(needle: str, text: str, best: float) -> bool:
    """Whether the ratio of the needle and the whole text can exceed ``best``: by their lengths, then by
    their characters regardless of order."""
    length = len(needle) + len(text)
    if 2.0 * min(len(needle), len(text)) / length <= best:
        return False
    return 2.0 * sum(min(needle.count(ch), text.count(ch)) for ch in set(needle)) / length > best


def best_ratio(needle: str | None, text: str | None) -> float | None:
    """Highest sequence ratio of ``needle`` against the text and its word windows."""
    if needle is None or text is None:
        return None
    if not needle or not text:
        return 0.0
    counted = _words(text)
    words = counted.words
    size = len(needle.split())
    best = 0.0
    if size and len(words) > size:
        starts = counted.runs(size)  # repeated readings repeat their windows
        bounds = window_bounds(needle, counted, size, starts)
        masks, rated = _needle(needle).masks, set()
        order = np.argsort(-bounds, kind="stable")
        for i, bound in zip(starts[order].tolist(), bounds[order].tolist()):
            if bound <= best:
                break
            window = " ".join(words[i : i + size])
            if window not in rated:
                rated.add(window)
                if 2.0 * common(masks, needle, window) / (len(needle) + len(window)) > best:
                    best = max(best, ratio(needle, window))
    # Only now is the whole text laid out for the matcher.
    if whole_bound(needle, text, best):
        best = max(best, ratio(needle, text))
    return best


@F.pandas_udf(T.DoubleType())
def best_similarity(needle: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([best_ratio(a, b) for a, b in zip(needle, text)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def best_similarities(needles: pd.Series, text: pd.Series) -> pd.Series:
    """One similarity per needle of the row; NULL needles stay NULL."""
    return pd.Series(
        [None if ns is None else [best_ratio(n, t) for n in ns] for ns, t in zip(needles, text)]
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pairwise_similarities(needles: pd.Series, texts: pd.Series) -> pd.Series:
    """One similarity per (needle, text) pair of two parallel arrays."""
    return pd.Series(
        [[best_ratio(a, b) for a, b in zip(ns, ts)] for ns, ts in zip(needles, texts)]
    )


def levenshtein_similarity(a, b):
    """A native stand-in: one minus the edit distance over the longer length."""
    def rate(a, b):
        longest = F.greatest(F.length(a), F.length(b))
        # The needle comes first; mostly it is far shorter than the text.
        return F.when(longest == 0, F.lit(0.0)).otherwise(1 - edit_distance(b, a) / longest)

    return let(rate, a=a, b=b)


def edit_steps(expected: str, found: str) -> list[dict[str, str]]:
    """What lies between the blocks that both texts share, and the blocks."""
    steps, seen, read = [], 0, 0
    for block in SequenceMatcher(a=expected, b=found, autojunk=False).get_matching_blocks():
        lost, gained = expected[seen : block.a], found[read : block.b]
        if lost or gained:
            kind = "replace" if lost and gained else "delete" if lost else "insert"
            steps.append({"op": kind, "segment": "→".join(filter(None, (lost, gained)))})
        seen, read = block.a + block.size, block.b + block.size
        if block.size:
            steps.append({"op": "equal", "segment": expected[block.a : seen]})
    return steps


@F.pandas_udf(DIFF_TYPE)
def char_diff(expected: pd.Series, found: pd.Series) -> pd.Series:
    """Character edit script; a replacement shows both sides with an arrow.

    Readings repeat, so every distinct pair of a batch is compared once.
    """
    pairs = pd.DataFrame({"a": expected, "b": found})
    known = pairs.dropna().drop_duplicates()
    scripts = {(a, b): edit_steps(a, b) for a, b in known.itertuples(index=False)}
    return pd.Series([scripts.get(pair) for pair in pairs.itertuples(index=False, name=None)], dtype=object)


_QUOTES = str.maketrans(STRAIGHT_QUOTES)


def fold(text: str) -> str:
    """The comparison form of a piece of text, but for the marks at its end."""
    flat = " ".join(text.split())
    return flat.lower() if flat.isascii() else unicodedata.normalize("NFKC", flat).casefold().translate(_QUOTES)


def closest_run(needle: str, words: list[str]) -> tuple[int, int, float]:
    """``(first word, words, similarity)`` of the run of words closest to ``needle``.

    Runs have as many words as the needle or one more.  They are rated in order of an upper
    bound, and rating ends when no run left can win; among equals the shorter, then the
    earlier run wins.
    """
    n = max(1, len(needle.split()))
    folded = [fold(w) for w in words]
    # Nothing beats an equal run, and no shorter one is rated.
    size = min(n, len(words))
    for i in range(len(words) - size + 1):
        if needle.startswith(folded[i].rstrip(TRAILING_MARKS)) and " ".join(folded[i : i + size]).rstrip(TRAILING_MARKS) == needle:
            return i, size, 1.0
    lengths, counted = np.array([len(w) for w in folded]), Words(folded)
    # Marks at a run's end are not compared, which can raise its bound.
    marks = np.array([len(w) - len(w.rstrip(TRAILING_MARKS)) for w in folded])
    runs = []
    for size in {min(n, len(words)), min(n + 1, len(words))}:
        ends = np.concatenate([[0], np.cumsum(lengths)])
        width = len(needle) + ends[size:] - ends[:-size] + size - 1
        starts = np.arange(len(words) - size + 1)
        last = starts + size - 1
        bounds = np.where(marks[last] < lengths[last], window_bounds(needle, counted, size, starts) * width / (width - marks[last]), 1.0)
        runs += [(-bound, size, i) for i, bound in enumerate(bounds.tolist())]
    best = (1.0, 0, 0)
    for negative, size, i in sorted(runs):
        if negative > best[0] + 1e-9:
            break
        run = " ".join(folded[i : i + size]).rstrip(TRAILING_MARKS)
        best = min(best, (-ratio(needle, run), size, i))
    return best[2], best[1], -best[0]


@F.pandas_udf(WINDOW_TYPE)
def best_window(needle: pd.Series, raw: pd.Series) -> pd.DataFrame:
    """The verbatim run of words closest to ``needle`` (a comparison form)."""
    found: dict[tuple[str, str], tuple[str, float]] = {}
    rows = []
    for key, text in zip(needle, raw):
        words = text.split() if key and text else []
        if not words:
            rows.append((None, None))
            continue
        if (key, text) not in found:
            i, size, score = closest_run(key, words)
            found[key, text] = " ".join(words[i : i + size]), score
        rows.append(found[key, text])
    return pd.DataFrame(rows, columns=["window", "score"])

"""Fill-in-middle transformation: texts cut at two token boundaries and put in another order.

The ends of a text's tokens are kept as a *boundary set*: offsets fall by their upper bits into
chunks of 65,536, and each chunk is a container of the kind that is smallest for it (sorted array,
bitmap or runs).  Cumulative cardinalities of the containers tell where the k-th boundary lies; a
local select inside the container gives it.  A row needs its own text only, so the job is one pass
without an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import WORD_BREAKS, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS
#: Bytes of a bitmap container.
BITMAP_BYTES = CHUNK // 8

_BREAKS = np.array([ord(c) for c in WORD_BREAKS], np.uint32)


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])

    def rank(self, value: int) -> int:
        return int(np.searchsorted(self.values, value, "right"))


class BitmapContainer:
    """One bit per value in 64-bit words, with the number of bits before every word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1

    def rank(self, value: int) -> int:
        at, bit = value >> 6, value & 63
        return int(self.before[at]) + (int(self.words[at]) & ((2 << bit) - 1)).bit_count()


class RunContainer:
    """First values and lengths of runs of consecutive values, with the number before every run."""

    def __init__(self, values: np.ndarray):
        starts = np.flatnonzero(np.diff(values, prepend=-2) != 1)
        self.firsts = values[starts].astype(np.uint16)
        self.before = np.append(starts, len(values)).astype(np.int64)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.firsts[at]) + k - int(self.before[at])

    def rank(self, value: int) -> int:
        at = int(np.searchsorted(self.firsts, value, "right")) - 1
        if at < 0:
            return 0
        return int(self.before[at]) + min(value - int(self.firsts[at]) + 1, int(self.before[at + 1] - self.before[at]))


def container(values: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three kinds for sorted distinct ``values`` below ``CHUNK``."""
    runs = int((np.diff(values, prepend=-2) != 1).sum())
    sizes = {RunContainer: 4 * runs, ArrayContainer: 2 * len(values), BitmapContainer: BITMAP_BYTES}
    return min(sizes, key=sizes.get)(values)


class BoundarySet:
    """A sorted set of offsets with ``select`` (the k-th, from 0) and ``rank`` (how many up to one)."""

    def __init__(self, offsets: np.ndarray):
        """``offsets`` are sorted and distinct."""
        offsets = np.asarray(offsets, np.int64)
        self.keys, starts = np.unique(offsets >> CHUNK_BITS, return_index=True)
        ends = [*starts[1:].tolist(), len(offsets)]
        self.containers = [container(offsets[lo:hi] & (CHUNK - 1)) for lo, hi in zip(starts.tolist(), ends)]
        #: Offsets before each container, and all of them at the end.
        self.before = np.append(starts, len(offsets)).astype(np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[at]) << CHUNK_BITS) + self.containers[at].select(k - int(self.before[at]))

    def rank(self, offset: int) -> int:
        """How many members are ``offset`` or less."""
        at = int(np.searchsorted(self.keys, offset >> CHUNK_BITS))
        if at == len(self.keys) or self.keys[at] != offset >> CHUNK_BITS:
            return int(self.before[at])
        return int(self.before[at]) + self.containers[at].rank(offset & (CHUNK - 1))


def boundaries(text: str) -> BoundarySet:
    """Zero and the end of every token ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``,
    in code points: a token ends where a word does, and blanks after the last word are one more."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    word = ~np.isin(points, _BREAKS)
    ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    tail = [len(points)] if len(points) and not word[-1] else []
    return BoundarySet(np.concatenate(([0], ends, tail)))


def _dealt(key: Column, seed: int) -> list[Column]:
    """The four leading 8-digit groups of the hexadecimal sha256 of ``seed:key`` as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, moved: int = 50, suffix_first: int = 80
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    Of 100 texts about ``moved`` are cut and marked, ``suffix_first`` of 100 of those as ``spm``
    (suffix before prefix), the others as ``psm``; which, and where, follows from ``seed`` and the
    id alone.  ``plain`` texts stay as they are and have NULL lengths: those that are not dealt a
    form, empty ones, and all that hold a marker already.  A NULL text is empty; a NULL id counts
    as an empty one.  Rows that repeat an id are cut at the same numbers of tokens, modulo their
    own.  Other columns are not looked at; no rows give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col)
    rows = docs.select(key.alias("doc_id"), text.alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(_dealt(key, seed), 1)))
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= moved)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "h1", "h2", form.alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            ids, texts, h1, h2, forms = batch.columns
            out = []
            for t, a, b, kind in zip(texts.to_pylist(), h1.to_pylist(), h2.to_pylist(), forms.to_pylist()):
                ends = boundaries(t)
                n = len(ends) - 1
                if kind == "plain":
                    out.append((n, None, None, t))
                    continue
                first, second = sorted((a % (n + 1), b % (n + 1)))
                first, second = ends.select(first), ends.select(second)
                p, m, s = t[:first], t[first:second], t[second:]
                cut = f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}" if kind == "psm" else f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}"
                out.append((n, first, second - first, cut))
            n, p, m, output = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), forms, pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(output, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` has made ``output`` of, from it and its ``form`` alone.

    No marker is in the parts, and none can begin in a part and end in a marker, so each marker is
    found where it was put.
    """

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, start, -1), end, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

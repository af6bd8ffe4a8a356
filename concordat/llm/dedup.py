"""Removal of bytes that lie in a long string which also starts elsewhere, over a whole corpus.

Every window of ``SPAN`` bytes has an *anchor*: the smallest hash of ``GRAM`` bytes within it, the
leftmost among equals.  Equal windows have equal anchors at equal distances, so windows need only be
compared among those whose anchors are equal.  The windows of one anchor start side by side;
the bytes they cover are its *extent*.  Extents that occur several times whole are settled by
their digests.  The others are few: they are dealt by anchor into shards, each of which gets its
suffixes sorted by induction (``suffixes``), and equal windows are neighbours there.  Anchors with very
many different extents are settled window by window instead, in ever smaller pieces, so that no
shard holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import slices, stored
from concordat.llm.suffixes import repeated_starts

SPAN = 400
#: Bytes of an anchor; a power of two.
GRAM = 128
#: Different extents of one anchor beyond which they are taken in pieces.
HOT_EXTENTS = 256
#: Window starts in the first pieces of such extents; what is left is taken one by one.
PIECE = 16
#: Bytes that a shard is sorted with at once; an anchor's extents stay together.
SHARD_BYTES = 4 << 20


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``GRAM`` bytes from every place, by doubling."""
    out = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < GRAM:
        factor = np.uint64((0xD6E8FEB86659FD93 + 2 * width) & (2**64 - 1))
        out = (out[:-width] ^ (out[:-width] >> np.uint64(31))) * factor + out[width:]
        width *= 2
    return out ^ (out >> np.uint64(29))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor of a text: its place, the first and last start of its windows, its hash."""
    n = len(data) - SPAN + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    width = SPAN - GRAM + 1
    # Smallest of every ``width`` neighbours: minima from either end of fixed blocks, met in the
    # middle.  A value is the hash's upper bits and the place, so the leftmost of equals is least.
    bits = np.uint64(max(24, len(hashes).bit_length()))
    values = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))
    least = least.astype(np.int64)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], n) - 1
    return least[first], first, last, hashes[least[first]].view(np.int64)


def extents_of(texts: DataFrame) -> DataFrame:
    """``id, h, gram, extent, start, stop``: the anchors of all texts with digests of their extents.

    ``extent`` covers the anchor's place in it, so equal digests mean equal windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            ids, hs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[list] = [[] for _ in range(6)]
            for i, h, text in zip(ids, hs, batch.column(2)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                place, first, last, gram = (x.tolist() for x in anchors(data))
                rows[0] += [i] * len(place)
                rows[1] += [h] * len(place)
                rows[2] += gram
                rows[3] += [_digest(b"%d " % (p - s) + data[s : e + SPAN]) for p, s, e in zip(place, first, last)]
                rows[4] += first
                rows[5] += last
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["id", "h", "gram", "extent", "start", "stop"])

    return texts.mapInArrow(run, "id long, h long, gram long, extent long, start int, stop int")


def _starts(batch_ids: list, flags: np.ndarray, lengths: list[int], firsts: list[int]) -> Iterator[tuple]:
    """Runs of marked starts of consecutive pieces as ``(index, first, last)``."""
    at = 0
    for k, n in enumerate(lengths):
        marked = np.flatnonzero(flags[at : at + n])
        at += n
        if len(marked):
            cuts = np.flatnonzero(np.diff(marked) > 1)
            for lo, hi in zip(np.append(0, cuts + 1), np.append(cuts, len(marked) - 1)):
                yield k, firsts[k] + int(marked[lo]), firsts[k] + int(marked[hi])


_RUN = "id long, h long, start int, stop int"


def _runs_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "h", "start", "stop"])


def _sorted_shards(pieces: DataFrame) -> DataFrame:
    """Runs of repeated window starts among extents dealt by anchor, by suffix sorting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                if size >= SHARD_BYTES and row[0] != last:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[4]), row[0]
        if held:
            yield shard(held)

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_starts([r[4] for r in rows], SPAN)
        runs = _starts(rows, flags, [len(r[4]) for r in rows], [r[3] for r in rows])
        return _runs_batch([(rows[k][1], rows[k][2], lo, hi) for k, lo, hi in runs])

    n = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = pieces.select("gram", "id", "h", "start", "body").repartition(n, "gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, _RUN)


def _pieces(extents: DataFrame, width: int) -> DataFrame:
    """Windows of extents by ``width`` starts: ``core`` is what all windows of a piece share,
    ``whole`` all that they cover.  Pieces lie on a grid from the anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gram, i, h, start, body in zip(*(batch.column(c).to_pylist() for c in range(5))):
                place = int(anchors(body)[0][0])
                n = len(body) - SPAN + 1
                at = 0
                while at < n:
                    cell = (at - place) // width
                    end = min(n, (cell + 1) * width + place)
                    low = cell * width + place + width - 1
                    core = body[max(low, 0) : cell * width + place + SPAN]
                    key = _digest(b"%d %d " % (gram, cell) + core)
                    out.append((key, _digest(b"%d %d " % (at - place, end - at) + body[at : end - 1 + SPAN]), i, h, start + at, start + end - 1))
                    at = end
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["core", "whole", "id", "h", "start", "stop"])

    return extents.select("gram", "id", "h", "start", "body").mapInArrow(run, "core long, whole long, id long, h long, start int, stop int")


def _hot_runs(extents: DataFrame) -> DataFrame:
    """Repeated window starts of extents whose anchors have very many of them."""
    pieces = stored(_pieces(extents, PIECE), "dedup-pieces")
    wholes = pieces.groupBy("core", "whole").agg(F.count("*").alias("n"))
    cores = wholes.groupBy("core").agg(F.count("*").alias("wholes"))
    wholes = stored(wholes.join(cores.filter("wholes > 1"), "core", "left"), "dedup-wholes")
    settled = pieces.join(wholes.filter("n > 1").select("core", "whole"), ["core", "whole"])
    # A piece that differs from others with its core is taken window by window.
    open_ = pieces.join(wholes.filter("wholes > 1").select("core", "whole", "n"), ["core", "whole"])
    open_ = open_.select("id", "h", F.col("start").alias("first"), "stop")
    owners = extents.select("id", "h", "start", "body").withColumnRenamed("start", "base")
    single = open_.join(owners, ["id", "h"]).filter((F.col("first") >= F.col("base")) & (F.col("stop") <= F.col("base") + F.octet_length("body") - SPAN))
    single = single.withColumn("at", F.explode(F.sequence("first", "stop")))
    single = single.select("id", "h", F.col("at").alias("start"), F.col("at").alias("stop"), F.xxhash64(F.substring(F.col("body"), F.col("at") - F.col("base") + 1, F.lit(SPAN))).alias("x"), F.sha1(F.substring(F.col("body"), F.col("at") - F.col("base") + 1, F.lit(SPAN))).substr(1, 16).alias("y")).distinct()
    single = stored(single, "dedup-windows")
    twice = single.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return settled.select("id", "h", "start", "stop").unionByName(single.join(twice, ["x", "y"]).select("id", "h", "start", "stop"))


def covered_runs(texts: DataFrame) -> DataFrame:
    """``id, h, start, stop``: windows from ``start`` to ``stop`` all occur elsewhere too."""
    rows = stored(extents_of(texts), "dedup-extents")
    groups = rows.groupBy("gram", "extent").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "start", "stop")).alias("one"))
    groups = stored(groups, "dedup-groups")
    grams = groups.groupBy("gram").agg(F.count("*").alias("extents")).filter("extents > 1")
    settled = rows.join(groups.filter("n > 1").select("gram", "extent"), ["gram", "extent"]).select("id", "h", "start", "stop")
    # One of each extent that shares its anchor with another; its text is cut from its document.
    wanted = groups.join(grams, "gram").select("gram", "one.*", (F.col("extents") > HOT_EXTENTS).alias("hot"))
    wanted = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("gram", "start", "stop", "hot")).alias("wanted"))
    cut = texts.join(wanted, ["id", "h"]).select("id", "h", F.col("text").cast("binary").alias("data"), F.explode("wanted").alias("w"))
    bodies = stored(
        cut.select(
            "id", "h", "w.gram", "w.start", "w.hot", F.substring("data", F.col("w.start") + 1, F.col("w.stop") - F.col("w.start") + F.lit(SPAN)).alias("body")
        ).dropDuplicates(["id", "h", "start"]),
        "dedup-bodies",
    )
    return settled.unionByName(_sorted_shards(bodies.filter("not hot"))).unionByName(_hot_runs(bodies.filter("hot")))


def _identified(doc_id: Column, text: Column) -> tuple[Column, Column, Column]:
    """What tells documents apart: their id and a hash of their text; and the text."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")


def _spans(texts: DataFrame) -> DataFrame:
    """All runs of a document in order.  Their number is bounded by its length."""
    runs = covered_runs(texts)
    return stored(runs.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("runs")), "dedup-runs")


def kept_pieces(data: bytes, runs: list[dict]) -> tuple[bytes, int, int]:
    """What runs of window starts leave of a text, how many bytes go, and in how many spans."""
    kept, removed, n_spans, reach = [], 0, 0, -1
    for r in runs:
        lo, hi = r["start"], r["stop"] + SPAN
        if lo > reach:
            n_spans += 1
            kept.append(data[max(reach, 0) : lo])
        removed += max(0, hi - max(lo, reach))
        reach = max(reach, hi)
    kept.append(data[max(reach, 0) :])
    return b"".join(kept), removed, n_spans


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    A NULL text is empty.  Texts below ``SPAN`` bytes lose nothing.  Rows that repeat an id, or an
    id and a text, are documents of their own: two equal rows remove each other's bytes.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), *_identified(F.col(id_col), F.col(text_col)))
    spans = _spans(texts.select("id", "h", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", 4 << 20):
            rows = []
            for data, runs in zip(batch.column(1), batch.column(2).to_pylist()):
                left, removed, n_spans = kept_pieces(data.as_py(), runs or [])
                rows.append((len(data.as_buffer()), removed, n_spans, hashlib.sha256(left).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = texts.join(spans, ["id", "h"], "left").select("doc_id", F.col("text").cast("binary").alias("data"), "runs")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def with_repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with all their columns, less the bytes of long repeated strings.

    A character of which a byte is removed goes as a whole.  Every row stays, with an empty
    text if nothing is left of it; a NULL text stays NULL.
    """
    spans = _spans(docs.select(*_identified(F.col(id_col), F.col(text_col))))
    i, h, text = _identified(F.col(id_col), F.col(text_col))
    rows = docs.withColumns({"_id": i, "_h": h, "_data": text.cast("binary")})
    spans = spans.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("runs").alias("_runs"))
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_data", 4 << 20):
            texts = batch.column(at).to_pylist()
            for k, (data, runs) in enumerate(zip(batch.column(len(names)), batch.column(len(names) + 1).to_pylist())):
                if runs:
                    texts[k] = kept_pieces(data.as_py(), runs)[0].decode("utf-8", "ignore")
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.join(spans, ["_id", "_h"], "left").select(*names, "_data", "_runs").mapInArrow(run, docs.schema)

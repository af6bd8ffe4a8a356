"""Token-id files: Simple-8b words with escapes and per-block offsets.

An id file is a folder of Parquet shards that Spark's committer writes, so a lost executor
costs a task and never a torn file.  A row of a shard is one *segment*, complete in itself:
the ids of consecutive documents as 64-bit little-endian words, an offset into these words
for every block of ``BLOCK`` ids, and the documents' ids and lengths.

Word layout: the top four bits select how many ids of how many bits the other sixty hold.
Selector 15 is an escape: the next word holds one value of up to 64 bits as it is.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.llm.bpe import byte_symbols
from concordat.llm.common import keyed_text
from concordat.session import work_dir

# Fixed values: (ids, bits) of the Simple-8b selectors 0 to 14 that carry payload here.
SELECTORS = (
    (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15),
    (3, 20), (2, 30), (1, 60),
)
ESCAPE = 15
BLOCK = 4096
#: Ids after which a segment is closed; a longer document makes a longer segment.
SEGMENT_IDS = 1 << 19
#: Distinct text chunks whose ids a Python worker remembers.
MEMORY_CHUNKS = 300_000
#: Distinct pieces of chunks that it remembers.
MEMORY_PIECES = 700_000
DOCUMENT_END = 0

SEGMENT_SCHEMA = (
    "shard int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, block_words array<int>, words binary"
)


_BITS_16 = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    bits, rest = _BITS_16[values & np.uint64(0xFFFF)], values >> np.uint64(16)
    base = 16
    while rest.any():
        bits = np.where(rest > 0, base + _BITS_16[rest & np.uint64(0xFFFF)], bits).astype(np.uint8)
        base, rest = base + 16, rest >> np.uint64(16)
    return bits


def _widest(need: np.ndarray) -> np.ndarray:
    """For every place of every block (row) the selector that packs most ids from there on."""
    best = np.full(need.shape, ESCAPE, np.uint8)
    most = {1: need}
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[s]
        if count > 1:
            # Maxima over ``count`` places from those over two shorter, overlapping runs.
            half = max(c for c in most if 2 * c >= count and c < count) if count > 2 else 1
            most[count] = np.maximum(most[half][:, : need.shape[1] - count + 1], most[half][:, count - half :])
        best[:, : need.shape[1] - count + 1][most[count] <= bits] = s
    return best


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words for ``values`` and, for every block, the index of its first word.

    No word crosses a block, so each block decodes alone.  The selector that packs most is
    found for every place at once; the words then hop from one place to the next.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, "<u8"), np.zeros(0, np.int32)
    need = np.full(-(-n // BLOCK) * BLOCK, 255, np.uint8)
    need[:n] = _bits(values)
    best = _widest(need.reshape(-1, BLOCK)).ravel()[:n]
    hop = np.array([c for c, _ in SELECTORS] + [1], np.int64)[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += hop[at]
    starts = np.array(starts, np.int64)
    chosen = best[starts]
    width = np.where(chosen == ESCAPE, 2, 1)
    place = np.concatenate(([0], np.cumsum(width)))
    words = np.zeros(int(place[-1]), "<u8")
    for s in np.unique(chosen):
        own = starts[chosen == s]
        to = place[:-1][chosen == s]
        if s == ESCAPE:
            words[to] = np.uint64(ESCAPE) << np.uint64(60)
            words[to + 1] = values[own]
            continue
        count, bits = SELECTORS[s]
        word = np.full(len(own), np.uint64(s) << np.uint64(60), np.uint64)
        if bits:
            for k in range(count):
                word |= values[own + k] << np.uint64(k * bits)
        words[to] = word
    first = np.searchsorted(starts, np.arange(0, n, BLOCK))
    return words, place[first].astype(np.int32)


def unpack(words: np.ndarray, n: int, block_words: np.ndarray | None = None) -> np.ndarray:
    """The first ``n`` ids of packed ``words``; with block offsets the words after an escape
    are told apart block by block, without them from the start."""
    words = np.asarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    if (chosen == ESCAPE).any():
        # A word after an escape is a value; walk the escapes in order, as a value may look like one.
        raw = np.zeros(len(words), bool)
        for at in np.flatnonzero(chosen == ESCAPE).tolist():
            if not raw[at]:
                raw[at + 1] = True
        heads = np.flatnonzero(~raw)
    else:
        heads = np.arange(len(words))
    chosen = chosen[heads]
    counts = np.array([c for c, _ in SELECTORS] + [1], np.int64)[chosen]
    place = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(place[-1]), np.uint64)
    for s in np.unique(chosen):
        own, to = heads[chosen == s], place[:-1][chosen == s]
        if s == ESCAPE:
            out[to] = words[own + 1]
            continue
        count, bits = SELECTORS[s]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count if bits else 0):
            out[to + k] = (words[own] >> np.uint64(k * bits)) & mask
    return out[:n]


def read_block(words: np.ndarray, block_words: np.ndarray, block: int, n_ids: int) -> np.ndarray:
    """The ids of one block, found by its offset and decoded alone."""
    end = block_words[block + 1] if block + 1 < len(block_words) else len(words)
    return unpack(words[block_words[block] : end], min(BLOCK, n_ids - block * BLOCK))


#: A word and the marks after it; apostrophes can open a contraction and are left out.
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([^\w\s']*)")


class ChunkEncoder(dict):
    """Ids of texts by a ``tokenizers`` file, remembering chunks between single blanks.

    A byte-level pre-tokenizer never joins pieces across a single blank with a non-blank on
    both sides; the blank goes with what follows.  So a text is cut there, and the library's
    pre-tokenizer and model see every distinct chunk and piece once.  Texts with other runs of
    blanks or with an added token's string in them go to the library whole.
    """

    def __init__(self, path: str, memory: int = MEMORY_CHUNKS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model
        self.memory, self.pieces, self.symbols = memory, {}, dict(enumerate(byte_symbols()))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the pre-tokenizer leaves whole."""
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= MEMORY_PIECES:
                self.pieces.clear()
            symbols = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
            found = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        return found

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.memory:
            self.clear()
        shape = _WORD_AND_MARKS.fullmatch(chunk)
        if shape and shape[1].isalpha():
            # A run of letters takes the blank before it, a run of marks is a piece of its own.
            out = self._piece(" " + shape[1]) + (self._piece(shape[2]) if shape[2] else b"")
        else:
            spaced = " " + chunk
            out = b"".join([self._piece(spaced[lo:hi]) for _, (lo, hi) in self.split(spaced)])
        self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        # Of equal length only if every run of blanks is one blank, with none at either end.
        if len(" ".join(text.split())) != len(text) or (self.added and "<|" in text and self.added.search(text)):
            return self.ids(text)
        first, *rest = text.split(" ")
        return self.ids(first) + b"".join(map(self.__getitem__, rest))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for a worker process and tokenizer file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, ends each document with id 0, and writes segments in ascending id order.

    One shuffle: texts are dealt by ranges of ``doc_id``, so shard and segment numbers follow
    the ids.  Rows with a NULL id come first; rows that repeat an id keep all their texts, one
    after another; an empty or NULL text has the end id alone.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, number = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        end = np.array([DOCUMENT_END], "<u4").tobytes()
        doc_ids: list = []
        lengths: list[int] = []
        parts: list[bytes] = []

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            words, blocks = pack(ids)
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()),
                    "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "block_words": pa.array([blocks.tolist()], pa.list_(pa.int32())),
                    "words": pa.array([words.tobytes()], pa.binary()),
                }
            )

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
                if held >= SEGMENT_IDS:
                    yield segment()
                    number, held = number + 1, 0
                    doc_ids, lengths, parts = [], [], []
        if doc_ids:
            yield segment()

    spark = docs.sparkSession
    texts = keyed_text(docs, id_col, text_col)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an id file: ``doc_id, start, n_tokens, ids`` (little-endian 32-bit ids).

    ``start`` counts the ids of all documents before it.  Only one number per segment is
    ordered in one place.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    in_shard = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("shard", "segment", F.coalesce(F.sum("n_ids").over(in_shard), F.lit(0)).alias("local"))
    starts = starts.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("local")).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                ids = unpack(np.frombuffer(at["words"].as_buffer(), "<u8"), at["n_ids"].as_py()).astype("<u4")
                lengths = np.array(at["lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                doc_ids, base = at["doc_ids"].as_py(), at["base"].as_py()
                for lo in range(0, len(lengths), 1000):
                    hi = min(lo + 1000, len(lengths))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(doc_ids[lo:hi], pa.int64()),
                            "start": pa.array(base + ends[lo:hi] - lengths[lo:hi], pa.int64()),
                            "n_tokens": pa.array(lengths[lo:hi], pa.int64()),
                            "ids": pa.array([ids[e - n : e].tobytes() for e, n in zip(ends[lo:hi], lengths[lo:hi])], pa.binary()),
                        }
                    )

    joined = segments.join(starts, ["shard", "segment"]).select("base", "n_ids", "doc_ids", "lengths", "words")
    return joined.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def with_checksum(documents: DataFrame) -> DataFrame:
    """``ids`` replaced by its unsigned crc32, in the JVM."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes ``docs`` into the shared folder and reads back one digest row per document."""
    spark = docs.sparkSession
    path = work_dir(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    return with_checksum(read_token_files(spark, path))

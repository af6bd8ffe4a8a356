"""Byte-pair encoding with a priority queue of merge ranks over a linked list of symbols.

``WordBpe`` reads a ``tokenizers`` file of the kind: NFC, white space collapsed, lower case,
a splitting pattern, byte symbols with an end-of-word mark, and no decoder (decoding joins
vocabulary strings with single blanks).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from concordat.llm.common import keyed_text, slices

#: Distinct chunks and distinct pieces whose ids a Python worker remembers.
MEMORY_CHUNKS = 250_000
#: Chunks and pieces beyond this length are encoded but not remembered.
MEMORY_LENGTH = 200
# The characters of the Unicode property White_Space.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Python's ``str.split`` also breaks at these, which are no White_Space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile(f"[{WHITE_SPACE}]+")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte value in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case one character at a time, so a final sigma is not told from another."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Applies merges in order of rank, the leftmost first among equals.

    The queue holds ``(rank, position, left, right, merged)``.  Symbols form a doubly linked
    list; an entry is stale, and skipped, if the symbols at its position have changed.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []
    for i in range(n - 1):
        found = ranks.get((symbols[i], symbols[i + 1]))
        if found:
            queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, merged = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = merged, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            found = ranks.get((merged, symbols[k]))
            if found:
                heapq.heappush(queue, (found[0], i, merged, symbols[k], found[1]))
        h = before[i]
        if h >= 0:
            found = ranks.get((symbols[h], merged))
            if found:
                heapq.heappush(queue, (found[0], h, symbols[h], merged, found[1]))
    return [s for s in symbols if s >= 0]


class WordBpe:
    """Encoder and decoder for one tokenizer file; remembers chunks and pieces it has met."""

    def __init__(self, path: str, memory: int = MEMORY_CHUNKS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        symbols = byte_symbols()
        self.inner = [vocabulary.get(s, -1) for s in symbols]
        self.last = [vocabulary.get(s + self.end, -1) for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: s for s, i in vocabulary.items()} | {i: s for s, i in self.special.items()}
        self.strings = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The file's \s is the Unicode property, which the regex module spells otherwise.
        self.pieces = regex.compile(pattern.replace(r"[^\s", rf"[^{WHITE_SPACE}"), regex.V0)
        self.memory, self.chunk_ids, self.piece_ids = memory, {}, {}

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return merge([s for s in symbols if s >= 0], self.ranks)

    def _chunk(self, chunk: str) -> bytes:
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        ids: list[int] = []
        for piece in self.pieces.findall(lower(text)):
            found = self.piece_ids.get(piece)
            if found is None:
                found = self._piece(piece)
                if len(piece) <= MEMORY_LENGTH:
                    if len(self.piece_ids) >= self.memory:
                        self.piece_ids.clear()
                    self.piece_ids[piece] = found
            ids += found
        out = np.array(ids, "<u4").tobytes()
        if len(chunk) <= MEMORY_LENGTH:
            if len(self.chunk_ids) >= self.memory:
                self.chunk_ids.clear()
            self.chunk_ids[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        known, out = self.chunk_ids, []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            chunks = (c for c in _BLANKS.split(part) if c) if _SEPARATORS.search(part) else part.split()
            for chunk in chunks:
                found = known.get(chunk)
                out.append(self._chunk(chunk) if found is None else found)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text, in UTF-8, that the ids' vocabulary strings make."""
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_models: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One model for a worker process and tokenizer file."""
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep``, ``ids`` and ``decoded``.

    One row per row of ``docs``, without a shuffle; NULL and empty texts have no ids and
    decode to an empty text.  The digests are those of the ids as little-endian unsigned
    32-bit integers and of the decoded text in UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(tokenizer)
        for batch in slices(batches, "text", 4 << 20):
            rows: list[tuple] = []
            for text in batch.column(1):
                ids = model.encode(text.as_py())
                decoded = model.decode(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((ids, decoded.decode()) if keep else ())))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()][: len(columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns) + 1],
            )
        # Workers live on for other jobs, which need the room.
        model.chunk_ids.clear()
        model.piece_ids.clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return keyed_text(docs, id_col, text_col).mapInArrow(run, schema + (", ids binary, decoded string" if keep else ""))

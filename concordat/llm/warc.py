"""WARC archives: writing, reading, and one ordered capture index by external merging.

Archives are gzip text files whose lines end in CR LF CR LF, which is how WARC records end,
so Spark's own committer writes them to any file system.  Each file is a run sorted by URL
key and time.  Their index entries are dealt by key ranges, and each range is a k-way merge of
the runs' pieces by a loser tree; pieces beyond ``MEMORY_ENTRIES`` wait on the task's disk.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.common import stored
from concordat.session import work_dir

#: Payloads below this many bytes are never stored as a revisit.
REVISIT_BYTES = 1000
#: Records in an archive file, which a reading task holds whole.
RECORDS_PER_FILE = 4000
#: Index entries that a merging task keeps in memory; the rest are on its disk.
MEMORY_ENTRIES = 200_000
#: Time of the capture with id 0 where the pages bring no time of their own.
FIRST_CAPTURE = 1_577_836_800

_EOL = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
INDEX_SCHEMA = (
    "run string, url_key string, captured_at string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, offset long"
)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the right, then the rest without its fragment."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_replace(rest, "^[^/?]*", ""))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """One WARC record per page: ``url_key, captured_at, page_id, record`` (text without its end).

    Of pages with equal payloads of ``REVISIT_BYTES`` or more the one with the largest id is
    the response and the rest revisit it; rows that repeat this id are all responses.  NULL
    html is an empty payload; a NULL id counts as smaller than any other; a NULL URL gives a
    record without a target, sorted first.
    """
    at = F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.coalesce(F.col(id_col), F.lit(0)) + FIRST_CAPTURE)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.col(url_col), "[\\x00-\\x20\\x7f]", "%20").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"),
    )
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    # The digests of repeated payloads, without a payload; Spark broadcasts this only if its files are small.
    repeated = (
        rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("response_id")).filter("n > 1").drop("n")
    )
    repeated = stored(repeated, "warc-repeats")
    rows = rows.join(repeated, ["digest", "bytes"], "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    head = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(_EOL + _EOL))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    lines = F.concat_ws(
        _EOL,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.col("captured_at")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("response_id")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(F.col("block")).cast("string")),
    )
    rows = rows.withColumn("block", block)
    return rows.select(
        url_key(F.col("url")).alias("url_key"), "captured_at", "page_id", F.concat(lines, F.lit(_EOL + _EOL), F.col("block")).alias("record")
    )


def write_archives(pages: DataFrame, out: str, **columns: str) -> None:
    """Writes sorted runs: every file is ordered by URL key, time and id."""
    ordered = records(pages, **columns).sortWithinPartitions("url_key", "captured_at", "page_id")
    ordered.select("record").write.option("lineSep", _EOL + _EOL).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(out)


def _page(value: str) -> int | None:
    found = value.rpartition(":")[2].rstrip(">")
    return None if found == "none" else int(found)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """``(headers, offset, block)`` of every record, found by its declared length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(_EOL)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        stop = end + 4 + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield headers, at, data[end + 4 : stop]
        at = stop + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all records, in the order of their files.  Payload digests are
    computed again from what was stored and must agree with the headers."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                run, rows = os.path.basename(path), []
                for headers, offset, block in parse(zlib.decompress(content.as_buffer(), 47)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].partition(":")[2]
                    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{run}: damaged payload at byte {offset}")
                    refers = headers.get("WARC-Refers-To")
                    url = headers.get("WARC-Target-URI")
                    rows.append(
                        (run, None, headers["WARC-Date"], _page(headers["WARC-Record-ID"]), url, headers["WARC-Type"], refers and _page(refers), size, digest, offset)
                    )
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _INDEX_ARROW)], schema=_INDEX_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(entries, INDEX_SCHEMA).withColumn("url_key", url_key(F.col("url")))


_INDEX_ARROW = pa.schema(
    [
        ("run", pa.string()), ("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("offset", pa.int64()),
    ]
)


class LoserTree:
    """Merges sorted iterators of ``(key, value)``: each inner node keeps the loser of the
    match below it, so that the next smallest costs one match per level."""

    _END = (2,)

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.k = max(1, len(sources))
        self.heads: list[tuple] = [self._pull(i) for i in range(len(sources))] or [(self._END, None)]
        self.losers = [-1] * self.k
        for i in range(len(self.heads)):
            self._play(i)

    def _pull(self, i: int) -> tuple:
        found = next(self.sources[i], None)
        return (self._END, None) if found is None else ((1, found[0]), found[1])

    def _play(self, i: int) -> None:
        """Moves source ``i`` up from its leaf; the winner ends in place 0."""
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            # Equal keys: the earlier run first.
            if (self.heads[other][0], other) < (self.heads[i][0], i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while True:
            i = self.losers[0]
            key, value = self.heads[i]
            if key == self._END:
                return
            yield key[1], value
            self.heads[i] = self._pull(i)
            self._play(i)


def merged_index(index: DataFrame) -> DataFrame:
    """All captures in order of URL key, time and id: adds ``range_no`` and ``position`` in it.

    Ranges are cut by the whole key, so a host or a URL with a third of all captures spans
    many of them.  NULL keys and ids sort first.
    """
    spark = index.sparkSession
    names = index.columns
    key_at = [names.index(c) for c in ("url_key", "captured_at", "page_id")]
    run_at = names.index("run")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        with tempfile.TemporaryDirectory() as folder:
            runs: dict[str, list] = {}
            held = 0
            for batch in batches:
                for i, run in enumerate(batch.column(run_at).to_pylist()):
                    parts = runs.setdefault(run, [])
                    if parts and isinstance(parts[-1], tuple) and parts[-1][0] is batch and parts[-1][2] == i:
                        parts[-1] = (batch, parts[-1][1], i + 1)
                    else:
                        parts.append((batch, i, i + 1))
                held += batch.num_rows
                if held > MEMORY_ENTRIES:
                    for parts in runs.values():
                        parts[:] = [_spilled(p, folder) if isinstance(p, tuple) else p for p in parts]
                    held = 0

            def entries(parts: list) -> Iterator[tuple]:
                for part in parts:
                    for piece in _pieces(part):
                        for row in zip(*(c.to_pylist() for c in piece.columns)):
                            yield tuple((row[c] is not None, row[c]) for c in key_at), row

            position, rows = 0, []
            for _, row in LoserTree([entries(parts) for _, parts in sorted(runs.items())]):
                rows.append((*row, number, position))
                position += 1
                if len(rows) == 5000:
                    yield out_batch(rows)
                    rows = []
            if rows:
                yield out_batch(rows)

    out_schema = _INDEX_ARROW.append(pa.field("range_no", pa.int32())).append(pa.field("position", pa.int64()))

    def out_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    key = ["url_key", "captured_at", "page_id"]
    ranged = index.repartitionByRange(parts, *key).sortWithinPartitions("run", *key)
    return ranged.mapInArrow(merge, INDEX_SCHEMA + ", range_no int, position long")


def _spilled(part: tuple, folder: str) -> str:
    batch, lo, hi = part
    handle, path = tempfile.mkstemp(dir=folder)
    os.close(handle)
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, batch.schema) as writer:
        writer.write_batch(batch.slice(lo, hi - lo))
    return path


def _pieces(part: tuple | str) -> Iterator[pa.RecordBatch]:
    if isinstance(part, tuple):
        batch, lo, hi = part
        yield batch.slice(lo, hi - lo)
        return
    with pa.OSFile(part, "rb") as source:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


def capture_history(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes ``pages`` as archives into the shared folder, reads them back and merges the index."""
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_archives(pages, path, **columns)
    return merged_index(stored(read_archives(spark, path), "warc-index"))

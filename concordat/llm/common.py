"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import gc
import threading
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.session import work_dir

#: White space that ends a word: blank, tab, line feed, vertical tab, form feed, return.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` alone, so that no other column can clash; NULL text is empty."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


#: Column of a row's own number in ``numbered_rows``.
ROW = "_row_number"


def numbered_rows(docs: DataFrame, purpose: str) -> DataFrame:
    """The rows with a number each, ``ROW``, that stays the same however often they are read:
    ids can be NULL or repeat, so what is decided of a row is told by this number."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), purpose)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``numbered_rows`` whose number is not in the one column of ``gone``."""
    return docs.join(gone.toDF("_gone"), F.col(ROW) == F.col("_gone"), "left_anti").drop(ROW)


def fold(col: Column | str, modulus: int) -> Column:
    """Remainder of crc32 of an id's decimal text, which deals rows into folds."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % modulus


def first_by_hash(rows: DataFrame, key: Column, n: int, total: int, *ties: str) -> DataFrame:
    """The ``n`` of about ``total`` rows with the smallest 64-bit hash ``key``.

    Rows whose hash is not among the smallest 2n/total of all hashes are left out before they
    are ordered, so that no task, however many there are, sends n rows of its own.
    """
    if total > 2 * n:
        rows = rows.filter(key < F.lit(-(2**63) + (2**64 * 2 * n) // total))
    return rows.orderBy(key, *ties).limit(n)


class Scratch(threading.local):
    """The folders that ``stored`` writes in this thread while they are recorded, until they are dropped."""

    def __init__(self):
        self.paths: list[str] = []
        self.recorded = False

    @contextlib.contextmanager
    def recording(self) -> Iterator[None]:
        before, self.recorded = self.recorded, True
        try:
            yield
        finally:
            self.recorded = before

    def drop(self, spark: SparkSession, *needed: DataFrame) -> None:
        """Deletes the folders, but for those that one of ``needed`` still reads.

        The files of shuffles go with the plans that no one holds any more.
        """
        read = [path for df in needed for path in df.inputFiles()]
        kept, gone = [], []
        for path in self.paths:
            name = f"/{path.rsplit('/', 1)[1]}/"
            (kept if any(name in file for file in read) else gone).append(path)
        jvm = spark._jvm
        for path in gone:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = kept
        gc.collect()
        jvm.System.gc()


SCRATCH = Scratch()


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: cuts lineage for good."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    if SCRATCH.recorded:
        SCRATCH.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z in lower case, as UTF-8.

    ``bytes`` methods know ASCII alone: ``lower`` changes A-Z only and ``split`` breaks
    at exactly the six blanks above.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()


def slices(batches: Iterator[pa.RecordBatch], weight: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``weight`` column (text or binary) holds about ``limit`` bytes."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(weight)).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)

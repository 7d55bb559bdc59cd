"""Documents as chunks: runs of rows of about 2 MB of text, each one compressed value.

A chunk holds whole rows with all their columns, so that what a later step learns about a document (chunk and row in it) comes
back to the row without a key of the document's own, and the text goes through a shuffle compressed. Ids may be null or repeat,
and columns may have any names. Chunks are checkpointed: their numbers stay what they were if an executor is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.common import CHUNK_BYTES, filesystem, partitions, text_chunks
from tidewire.session import checkpoint_dir, cut

CHUNKS = "chunk long, rows binary"
NUMBER_BITS = 24


def _pack(at: int, first: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (first << 48) + (TaskContext.get().partitionId() << NUMBER_BITS)
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for b in batches:
            b = pa.RecordBatch.from_arrays(b.columns, names=[str(k) for k in range(b.num_columns)])
            for lo, hi, _, _ in text_chunks(b.column(at), most):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                    out.write_batch(b.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])
                chunk += 1

    return run


def chunked(rows: DataFrame, text: str = "text", first: int = 0, most: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, rows) of all rows; ``first`` keeps the numbers of batches apart."""
    return cut(rows.mapInArrow(_pack(rows.columns.index(text), first, most), CHUNKS))


def rows_in(raw: bytes) -> pa.RecordBatch:
    """The rows of a chunk; columns are named by their place."""
    return pa.ipc.open_stream(raw).read_next_batch()


def each(rows: pa.Table) -> Iterator[tuple[int, pa.RecordBatch]]:
    for chunk, raw in zip(rows.column("chunk").to_pylist(), rows.column("rows"), strict=True):
        yield chunk, rows_in(raw.as_buffer())


def joined(column: pa.ChunkedArray | pa.Array) -> bytes:
    """The bytes of all values that are not null."""
    return b"".join(x.as_buffer() for x in column if x.is_valid)


class BucketedTable:
    """A table in the shared folder that is dealt and sorted by a column, so that joins and groups by it need no shuffle."""

    def __init__(self, spark: SparkSession, kind: str, key: str, base: str | None = None):
        self.spark, self.key, self.buckets = spark, key, partitions(spark)
        self.name = f"{kind}_{uuid.uuid4().hex}"
        self.path = f"{(base or checkpoint_dir(spark)).rstrip('/')}/{self.name}"

    def write(self, rows: DataFrame) -> None:
        rows.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        fs, path = filesystem(self.path)
        if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(path)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())

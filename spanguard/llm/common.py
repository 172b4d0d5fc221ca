"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanguard.session import cut, ensure_checkpoint_dir, ship_package

#: White space of the word rule: blank, tab, line feed, vertical tab, form feed, carriage return (fixed value).
SPACE = r"[\x20\x09-\x0D]"
#: A language, source or tokenizer table is broadcast up to this many rows; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 20_000
_LIBC = ctypes.CDLL(None)


def words_of(text: Column) -> Column:
    """The words of a text, none for a null text."""
    plain = F.coalesce(text, F.lit(""))
    for mark in "\t\n\v\f\r":
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a materialised table for broadcast if it has few rows; leave it to a shuffled join otherwise."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def give_back() -> None:
    """Return what this worker has freed to the system: idle workers share an executor with the JVM and with each other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pack_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = 6 << 20,
                part: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Documents packed to rows of about `block_bytes` of text: block, kind, ids, sizes, data (zstd), n_bytes, rest.

    A block holds whole documents of one value of `part` (an int column) and of one task; a longer document is a block of its own.
    Null keys become the largest long and so sort last. `rest` holds the columns `keep` in Arrow's stream format. The rows are
    written to the shared folder, so that every later stage sees the same blocks even after a lost executor.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"),
                       (F.lit(0) if part is None else part).cast("int").alias("kind"),
                       *([F.struct(*keep).alias("rest")] if keep else []))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        open_blocks: dict[int, tuple[list, list, list]] = {}
        sizes: dict[int, int] = {}

        def close(kind: int) -> pa.RecordBatch:
            nonlocal number
            ids, texts, rest = open_blocks.pop(kind)
            sizes.pop(kind)
            data = b"".join(texts)
            row = pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "kind": pa.array([kind], pa.int32()),
                "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                "sizes": pa.array([np.array([len(x) for x in texts], np.int64).tobytes()], pa.binary()),
                "data": pa.array([squeeze(data)], pa.binary()), "n_bytes": pa.array([len(data)], pa.int64()),
                "rest": pa.array([_streamed(rest) if keep else None], pa.binary())})
            number += 1
            give_back()
            return row

        for batch in batches:
            ids = [2**63 - 1 if x is None else x for x in batch.column(0).to_pylist()]
            for at, (i, body, kind) in enumerate(zip(ids, texts_of(batch.column(1)), batch.column(2).to_pylist())):
                if kind in sizes and sizes[kind] + len(body) > block_bytes:
                    yield close(kind)
                mine = open_blocks.setdefault(kind, ([], [], []))
                mine[0].append(i)
                mine[1].append(body)
                if keep:
                    mine[2].append(batch.column(3).slice(at, 1))
                sizes[kind] = sizes.get(kind, 0) + len(body)
        for kind in sorted(open_blocks):
            yield close(kind)

    return cut(slim.mapInArrow(pack, "block bigint, kind int, ids binary, sizes binary, data binary, n_bytes bigint, rest binary"))


def _streamed(rows: list[pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays(rows)], names=["rest"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return squeeze(sink.getvalue().to_pybytes())


def rest_of(data: bytes) -> pa.StructArray:
    """The kept columns of a block's documents."""
    return pa.ipc.open_stream(expand(data)).read_all().column(0).combine_chunks()


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values whose bits all depend on all bits of x, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unpack(ids: bytes, sizes: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Document ids, their start offsets (one more than documents) and all bytes of a block."""
    lengths = np.frombuffer(sizes, np.int64)
    return np.frombuffer(ids, np.int64), np.concatenate([[0], np.cumsum(lengths)]), expand(data)


def settle(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them again: no lineage, and sizes as they are.

    A checkpoint keeps the planner's estimate of sizes, which a loop of joins multiplies without end; a table has its own.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

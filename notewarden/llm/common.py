"""Helpers shared by the operators: shared folders, Arrow maps, small models."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import broadcast_if_small, ensure_checkpoint_dir
from .hashing import forget_powers

#: Bytes of the mapped columns that a Python worker handles at a time.
SLICE_BYTES = 2_000_000
#: Rows of an Arrow batch at most, so that batches of long texts stay small.
BATCH_ROWS = 1000
#: Largest model file that is broadcast to the executors.
MAX_MODEL_BYTES = 64_000_000
#: First bytes of a zstd frame (fixed value).
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package also when the driver found it
    through its own sys.path (a driver started elsewhere, local mode)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the shared folder and read again: cuts the lineage,
    so that a lost executor costs nothing before this point."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def model_bytes(spark: SparkSession, path: str):
    """A vocabulary file as a broadcast variable; its size is checked."""
    size = os.path.getsize(path)
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"{path}: {size} bytes is more than {MAX_MODEL_BYTES}")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def row_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each row of a column.  Compressed texts (`packed`) count as what they unpack to."""
    n, kind = len(column), column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return np.array([unpacked_size(b) for b in column], np.int64)
    return np.full(n, -(-column.nbytes // max(n, 1)), np.int64)


def unpacked_size(data: pa.Scalar) -> int:
    """Length of a binary value, or what its header says it unpacks to."""
    body = data.as_buffer()
    if body is None:
        return 0
    head = body.slice(0, min(18, body.size)).to_pybytes()
    if head[:4] != ZSTD_MAGIC:
        return body.size
    try:
        return max(body.size, zstandard.frame_content_size(head))
    except zstandard.ZstdError:
        return body.size


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most `size` bytes, compressed texts measured as
    unpacked; a longer row stands alone."""
    if not batch.num_rows:
        return
    ends, at = np.cumsum(sum(row_bytes(c) for c in batch.columns)), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def with_arrow(df: DataFrame, inputs: list[str], outs: dict[str, str], make: Callable, drop: tuple[str, ...] = (), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """`df` with columns computed in Arrow batches.

    `make()` runs once per task and returns a function from the input arrays to
    one array per entry of `outs` (name to DDL type).  Columns of the same name
    (in any case) are replaced, as withColumn does; `drop` are left out."""
    importable(df.sparkSession)
    small_batches(df.sparkSession)
    gone = {x.lower() for x in (*outs, *drop)}
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in keep), *(StructField(k, _parse_datatype_string(v), True) for k, v in outs.items())])
    n_keep = len(keep)
    work = df.select(*(F.col(f"`{f.name}`").alias(f"k{i}") for i, f in enumerate(keep)), *(F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(inputs)))
    names = list(schema.names)

    def run(batches):
        fn = make()
        for batch in batches:
            for part in slices(batch, slice_bytes):
                cols = part.columns
                yield pa.RecordBatch.from_arrays([*cols[:n_keep], *fn(*cols[n_keep:])], names=names)
        batch = part = cols = fn = None
        give_back()

    return work.mapInArrow(run, schema)


def give_back() -> None:
    """Memory that a task no longer needs goes back to the system, so that workers that
    wait for later stages hold none of it."""
    forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def packed(df: DataFrame, text: str) -> DataFrame:
    """`df` with the column `text` as compressed bytes in `packed`, so that a join
    on a key moves less."""

    def make():
        codec = zstandard.ZstdCompressor(level=3)
        return lambda column: [pa.array([codec.compress(t.encode()) for t in texts_of(column)], pa.binary())]

    return with_arrow(df, [text], {"packed": "binary"}, make, drop=(text,))


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def tally(df: DataFrame, inputs: list[str], size: int, make: Callable, slice_bytes: int = 2_000_000) -> np.ndarray:
    """Two counts for each of `size` buckets over all rows: an array (2, size).

    `make()` returns a function from the input arrays to an array (2, size) to be
    added.  Tasks add up what they read, Spark adds the tasks' non-zero buckets,
    and the driver gets `size` rows at most, whatever the input."""
    importable(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches):
        total, add = np.zeros((2, size), np.int64), make()
        for batch in batches:
            for part in slices(batch, slice_bytes):
                total += add(*part.columns)
        found = np.flatnonzero(total.any(axis=0))
        for at in range(0, len(found), 1 << 16):
            k = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[0, k]), pa.array(total[1, k])], names=["k", "a", "b"])
        batch = part = total = found = add = None
        give_back()

    rows = df.select(*inputs).mapInArrow(run, "k long, a long, b long")
    summed = rows.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    out = np.zeros((2, size), np.int64)
    k = summed["k"].to_numpy()
    out[0, k], out[1, k] = summed["a"].to_numpy(), summed["b"].to_numpy()
    return out


def with_labels(docs: DataFrame, labels: DataFrame, key: str, columns: list[str], max_rows: int = 500_000) -> DataFrame:
    """`docs` with one label row per key (left join).  Up to `max_rows` labels are
    broadcast; more are joined by a shuffle with the same result."""
    return docs.join(broadcast_if_small(labels.select(key, *columns), max_rows), key, "left")

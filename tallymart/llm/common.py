"""What the operators of this subpackage share: tables, checkpoints, Arrow helpers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session in the one that the cluster names in spark.checkpoint.dir. A session without that setting must run on one machine (tests) and gets a folder there."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or f"/tmp/spark-{uuid.uuid4().hex}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from there, so that a lost executor costs no recomputation.

    The table is Parquet: later steps read only the columns they use, and Spark knows its size when it chooses a join.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing will read again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; it sizes buckets, so that one bucket's memory does not grow with the input."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def strings(column) -> list[bytes | None]:
    """An Arrow string column as bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


def blocks(batches, most: int):
    """Cut record batches into slices of about `most` bytes of text (one longer text makes a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        lengths = pc.binary_length(batch.column("text")).fill_null(0)
        sizes[:] = lengths.to_numpy(zero_copy_only=False)
        total, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            base = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def pack(values: np.ndarray) -> bytes:
    """Small binary form of whole numbers: byte planes under zstd."""
    import zstandard

    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if data else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of [start, start + length) for each pair, one after another."""
    lengths = np.asarray(lengths, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum(), dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, lengths)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) of any start."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.minimum(starts, n), 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge)[:n] > 0


def as_text(values: list[bytes]) -> pa.Array:
    """Bytes as an Arrow string column; what is not valid UTF-8 stays as it is."""
    return pc.cast(pa.array(values, pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))


def carried(extra: list[str] | None, schema: str) -> list[str]:
    """Columns to carry along: not doc_id, and none that a result column (of a DDL schema) is named like."""
    own = {"doc_id", *(n.lower() for n in T.StructType.fromDDL(schema).names)}
    return [c for c in extra or [] if c.lower() not in own]


def map_texts(docs: DataFrame, run, schema: str, extra: list[str] | None = None, also: list[str] | None = None) -> DataFrame:
    """mapInArrow over doc_id, text and the columns `also`, with columns that are handed on.

    run(batches) yields (slice of its input, record batch of as many rows);
    columns `extra` of the slice follow those of the batch, but for doc_id and those named like a column of the batch.
    """
    extra = carried(extra, schema)

    def carry(batches):
        for block, out in run(batches):
            yield pa.RecordBatch.from_arrays([*out.columns, *(block.column(c) for c in extra)], names=[*out.schema.names, *extra])

    chosen = dict.fromkeys(["doc_id", "text", *(also or []), *extra])
    kinds = [schema, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)]
    return docs.select(*chosen).mapInArrow(carry, ", ".join(kinds))

"""Helpers shared by the corpus operators: shared storage, Arrow kernels, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a batch that a kernel sees at a time: Spark's batches are cut to this, which bounds a worker's memory.
SLICE_BYTES = 4 << 20
#: Largest driver-side payload, in bytes, that an operator ships to every task.
BROADCAST_BYTES = 32 << 20


#: What a worker process keeps between tasks, by name: a function that drops it.
KEPT: dict[str, Callable[[], None]] = {}


def drop_kept(but: str | None = None) -> None:
    """Drop what other kernels keep in this process: Spark reuses its workers, and their tables needn't add up."""
    names = [n for n in KEPT if n != but]
    for n in names:
        KEPT.pop(n)()
    if names:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # give free memory back where the C library can
            ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and all run in one
    process, a local one. On a cluster an unset folder is an error, as executors would write to disks of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="schemaloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._schemaloom_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete what materialise() wrote, once nothing will read it again."""
    for df in frames:
        path = getattr(df, "_schemaloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, read from storage, to be sent to all tasks if it is counted to have so few (and short) rows; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def to_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes objects; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about SLICE_BYTES; a row is never cut."""
    for b in batches:
        step = max(1, b.num_rows * SLICE_BYTES // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def map_columns(
    df: DataFrame,
    make: Callable[[], Callable[..., list[pa.Array]]],
    inputs: list[str],
    keep: list[str],
    outputs: list[tuple[str, T.DataType]],
    keeps: str | None = None,
) -> DataFrame:
    """Append columns that an Arrow kernel computes; a kept column of the same name is replaced.

    make() runs once per task and returns the kernel, which takes the input columns of a batch and
    returns the output columns. Only kept and input columns are sent to Python. keeps names what the kernel keeps
    in its process between tasks, if anything.
    """
    names = {n for n, _ in outputs}
    keep = [c for c in keep if c not in names]
    sent = list(dict.fromkeys([*keep, *inputs]))
    fields = {f.name: f for f in df.select(*[f"`{c}`" for c in sent]).schema.fields}
    schema = T.StructType([fields[c] for c in keep] + [T.StructField(n, t) for n, t in outputs])
    out_names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        kernel = make()
        for b in slices(batches):
            made = kernel(*[b.column(sent.index(c)) for c in inputs])
            yield pa.RecordBatch.from_arrays([b.column(sent.index(c)) for c in keep] + list(made), names=out_names)

    return df.select(*[f"`{c}`" for c in sent]).mapInArrow(run, schema)


def flat_map(df: DataFrame, make: Callable[[], Callable[..., list[pa.Array] | None]], inputs: list[str], outputs: list[tuple[str, T.DataType]]) -> DataFrame:
    """Replace each batch by the rows that an Arrow kernel makes of it."""
    schema = T.StructType([T.StructField(n, t) for n, t in outputs])
    names = [n for n, _ in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        kernel = make()
        for b in slices(batches):
            made = kernel(*[b.column(i) for i in range(len(inputs))])
            if made is not None:
                yield pa.RecordBatch.from_arrays(list(made), names=names)

    return df.select(*[f"`{c}`" for c in inputs]).mapInArrow(run, schema)

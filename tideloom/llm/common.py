"""Small helpers that several of these operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but the six ASCII white-space characters. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SLOTS = 1 << 19  # 64-bit words of a filter: 4 MB, however many values are in it
BATCH_ROWS = 1000  # rows of an Arrow batch that goes to Python
ROWS_OUT = 2000  # rows of an Arrow batch that goes back to Spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), one beneath the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends at the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Remove what written() wrote, once no later plan reads it."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns ``needed`` first, all others under names that nothing else uses; and the name of each now.

    So an operator may add columns of its own beside them, whatever the user's columns are called.
    """
    now = {c: c if c in needed else f"aside_{i}" for i, c in enumerate(docs.columns)}
    order = [*needed, *[c for c in docs.columns if c not in needed]]
    return docs.select(*[docs[f"`{c}`"].alias(now[c]) for c in order]), now


def put_back(docs: DataFrame, now: dict[str, str], *more: str) -> DataFrame:
    """The columns that set_aside() renamed under their own names and in their own order, then those named in ``more``."""
    return docs.select(*[docs[n].alias(c) for c, n in now.items()], *more)


def once_per_worker(name: str, make: Callable):
    """What ``make`` returns, made once per Python worker and kept for its later tasks."""
    kept = sys.modules.setdefault("_tideloom_worker", types.ModuleType("_tideloom_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of few rows, so that JVM and workers hold little at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(column: pa.Array) -> list[str]:
    """The strings of a column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def slices(batches, rows: int = ROWS_OUT):
    """Record batches of at most ``rows`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def list_array(parts: list, kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def fixed_filter(values: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of fixed size over the hashes in a bigint column: two bits of each.

    At most SLOTS numbers come to the driver. A filter that is too full passes more, never less.
    """
    low, high = F.col(column).bitwiseAND(F.lit(SLOTS * 64 - 1)), F.shiftrightunsigned(F.col(column), 39)
    bit = lambda x: F.struct(F.shiftright(x, 6).alias("slot"), x.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    each = values.select(F.explode(F.array(bit(low), bit(high))).alias("p")).select("p.slot", F.expr("shiftleft(1L, p.bit)").alias("bits"))
    out = np.zeros(SLOTS, np.uint64)
    for slot, bits in each.groupBy("slot").agg(F.bit_or("bits")).collect():
        out[slot] = np.uint64(bits % (1 << 64))
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in the filter."""
    low, high, six, last, one = h & np.uint64(SLOTS * 64 - 1), h >> np.uint64(39), np.uint64(6), np.uint64(63), np.uint64(1)
    return (bits[low >> six] >> (low & last) & bits[high >> six] >> (high & last) & one).astype(bool)

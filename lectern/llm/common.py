"""What the operators share: tables, scratch tables, batching of texts, splits of the training rows."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Characters of text that a kernel works on at a time; bounds its temporary arrays.
SLICE_CHARS = 1_000_000
#: Bytes of a batch that Spark hands to Python at most, but for a single longer row; Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_held() -> dict:
    """A dict that lives as long as the Python worker, over all its tasks. (Functions travel by value, so a global of this
    package is made anew for each task.)"""
    return sys.__dict__.setdefault("_lectern_held", {})


def free_name(name: str, *taken: str) -> str:
    """name, or name with underscores behind it that no column in taken has; Spark does not tell case."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def schema_of(fields: list[StructField], ddl: str) -> StructType:
    """The fields, and those that ddl names."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables. Where the session names none, a temporary one in local mode; on a cluster that
    is an error, as executors would write where others can't read."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_made: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("_made", default=None)


def cut(df: DataFrame) -> DataFrame:
    """df written to a scratch table and read back: lineage ends here, and it survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


@contextlib.contextmanager
def tidy() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the scratch tables that were made within it, but for those given to the function that it yields;
    these are left to the next outer tidy(), if there is one, and else stay as long as the folder."""
    outer, made, kept = _made.get(), [], []
    token = _made.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _made.reset(token)
        for df in made:
            if not any(df is k for k in kept):
                drop_scratch(df)
            elif outer is not None:
                outer.append(df)


def small_side(df: DataFrame, rows: int = 1_000_000, lists: str | None = None) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows, and entries of the array column lists, if there is one; else as
    it is, for a shuffled join. df should be a scratch table of numbers, so that counting is cheap and rows are narrow."""
    n = df.agg(F.count("*") + (F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.lit(0))).first()[0]
    return F.broadcast(df) if n <= rows else df


def drop_scratch(df: DataFrame) -> None:
    """Deletes the scratch table behind a DataFrame that cut() made; nothing may read it any more."""
    spark, path = df.sparkSession, getattr(df, "scratch_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: str, divisor: int, remainder: int):
    """Whether crc32(doc_id as text) mod divisor is remainder; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor == remainder, F.lit(True))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about limit bytes of text; a longer single text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def release() -> None:
    """Gives freed memory back to the system, so that a worker at rest, or in another stage, does not hold on to it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def in_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow, in batches of at most BATCH_BYTES: of long texts, Spark's own bounds would let a task hold several times
    64 MB, on either side. The bound is the session's from then on, unless it has one that is not Spark's own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) == "67108864b":
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str, text: str = "text", limit: int = SLICE_CHARS) -> DataFrame:
    """fn over runs of rows of bounded text size, in Arrow."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit):
                if (out := fn(part)) is not None and out.num_rows:
                    yield out
            release()

    return in_arrow(df, run, schema)

"""What the training-data operators share: tables, the shared folder, words and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
words = re.compile(WORD).findall


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local session gets a folder of its own; on a cluster, whose
    machines share no local folder, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-checkpoints-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table of written() that nothing needs any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows of the held-out fold; false where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_array(text: Column) -> Column:
    """The words of a text, by built-in functions alone."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20, most_rows: int | None = None):
    """A batch in slices whose strings and binaries hold about most_bytes; a longer value is a slice of its own. most_rows: at most so many rows a slice."""
    held = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = held.cumsum(), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        to = min(to, at + (most_rows or batch.num_rows))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Gives the process's free memory back to the system, so that what the tasks before have freed doesn't add to a task's own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def each_batch(df: DataFrame, make, schema: str, **state) -> DataFrame:
    """each_arrow() for a function of columns as lists."""

    def of_lists(**state):
        f = make(**state)
        return lambda *columns: f(*(c.to_pylist() for c in columns))

    return each_arrow(df, of_lists, schema, **state)


def each_arrow(df: DataFrame, make, schema: str, most_rows: int | None = None, **state) -> DataFrame:
    """mapInArrow with make(**state), which returns a function from Arrow arrays to columns.

    A call gets a bounded number of bytes of text, or one text, and at most most_rows rows. state: values broadcast to the
    tasks; their size must not grow with the data. A Python worker keeps a broadcast value from
    task to task, and the function made from it along with it, so what the function remembers
    (within its own bounds) serves all tasks of the worker.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))
    held = df.sparkSession.sparkContext.broadcast({"state": state})

    def run(batches):
        release()
        here = held.value
        f = here.get("made") or here.setdefault("made", make(**here["state"]))
        for batch in batches:
            for part in slices(batch, most_rows=most_rows):
                out = f(*part.columns)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(out, types, strict=True)], schema=types)
        release()

    return df.mapInArrow(run, schema)

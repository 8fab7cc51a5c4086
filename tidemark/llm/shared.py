"""Helpers of the operators: scratch tables in the shared folder, and row-local Arrow passes in slices of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a row-local pass holds as Python objects at a time; a longer text is a slice of its own.
SLICE = 1_000_000
#: Rows in an Arrow batch: texts are long, and a batch is held whole.
BATCH_ROWS = 1000
#: Whether an execution's shuffle files are removed as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one below the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage is cut, and no lost executor takes it along.

    Shuffle files of the write are removed as it ends. Else they stay until the driver happens to collect its garbage, and
    an operator of several writes holds the files of all.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """df; the session's Arrow batches are held to BATCH_ROWS rows, as a batch of long texts is in memory whole."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column text holds about most bytes in each, or has their numbers add up to that."""
    for batch in batches:
        sizes = batch.column(text)
        if not pa.types.is_integer(sizes.type):
            sizes = pc.binary_length(sizes)
        sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def per_text(df: DataFrame, ddl: str, fn: Callable[[list], list[tuple]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep of df (all, if None) followed by those of ddl, which fn gives as one tuple for each text (None: null).

    A kept column whose name is also in ddl gives way to it. fn is called on each slice, or is a generator of such
    a function if it has an attribute per_task, called once a task.
    """
    new = T._parse_datatype_string(ddl)
    names = {f.name.lower() for f in new.fields}
    kept = [f.name for f in df.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]
    # the text may be among the columns that give way
    src = small_batches(df.select(F.col(text).cast("string").alias("_text_in"), *[F.col(f"`{c}`") for c in kept]))
    schema = T.StructType([*[df.schema[c] for c in kept], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new.fields]
        call = fn() if getattr(fn, "per_task", False) else fn
        for b in slices(batches, 0):
            rows = call(b.column(0).to_pylist())
            cols = zip(*rows, strict=True) if rows else [[] for _ in types]
            arrays = [pa.array(list(c), type=t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *arrays], names=schema.names)

    return src.mapInArrow(run, schema)

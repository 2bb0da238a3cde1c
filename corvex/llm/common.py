"""Shared pieces of the training-data operators: tables cut into the shared folder, batch slicing, text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or one made here where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dir[app]


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs no recomputation and the plan above starts from a scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvex-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sized(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """batch cut into runs of rows whose texts (or lists) have about `limit` bytes; one longer text stays whole."""
    values = batch.column(batch.schema.get_field_index(column))
    lists = pa.types.is_list(values.type)
    lengths = np.asarray((pc.list_value_length(values) if lists else pc.binary_length(values)).fill_null(0), np.int64) * (4 if lists else 1)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        total += n
        if total >= limit:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut as by `sized`, with the texts as UTF-8. At the end the memory that the task no longer uses goes back."""
    for batch in batches:
        for part in sized(batch, column, limit):
            yield part, part.column(part.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and another stage's worker may need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, **values) -> pa.RecordBatch:
    """batch with the named columns replaced or added, in the order of schema."""
    columns = []
    for field in schema:
        if field.name in values:
            columns.append(pa.array(values[field.name], type=field.type))
        else:
            column = batch.column(batch.schema.get_field_index(field.name))
            columns.append(column if column.type == field.type else column.cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)

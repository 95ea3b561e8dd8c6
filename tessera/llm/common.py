"""What the operators of this package share: the shared folder, stored tables, Arrow columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import shared_root

#: Bytes of text that one numpy step handles at once.
SLICE_BYTES = 1 << 20


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/tessera/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text (null: empty); rows without a key are left out."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes of the column; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def offsets(column: pa.Array) -> np.ndarray:
    """Where each string of the column starts in its data, and the end of the last."""
    wide = column.type in (pa.large_string(), pa.large_binary())
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or column.buffers()[1] is None:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes one after another, and the offsets of its strings in them (no nulls)."""
    ends = offsets(column)
    if ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)

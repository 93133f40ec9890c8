"""File sources, the Parquet sink with write statistics, sample data and inspection."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.errors import EngineError, ErrorCode
from quillon.sources.connector import WriteStats

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read_files(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options: Any) -> DataFrame:
    """Formats without a schema of their own need one, so that no pass over the data goes into guessing it."""
    if kind not in FORMATS:
        raise EngineError(ErrorCode.UNSUPPORTED, f"format {kind!r}; known: {', '.join(FORMATS)}")
    if kind in ("csv", "json") and schema is None:
        raise EngineError(ErrorCode.SCHEMA, f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def from_rows(spark: SparkSession, rows: Any, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> WriteStats:
    """Writes and counts in one pass; bytes are those of the files as the file system has them."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return WriteStats(seen.get["rows"], fs.getContentSummary(where).getLength())


def sample_table(spark: SparkSession, rows: int = 100_000) -> DataFrame:
    """id, name and amount by rule; as many rows as asked for, made on the executors."""
    return spark.range(rows).select(
        F.col("id"),
        F.format_string("name_%05d", F.col("id")).alias("name"),
        (F.col("id") * F.lit(1.5) + F.lit(0.01)).alias("amount"),
    )


def summary(df: DataFrame, rows: int = 3) -> dict:
    """Row count, schema and the first few rows."""
    return {"rows": df.count(), "schema": df.schema.simpleString(), "head": df.limit(rows).collect()}


def write_arrow_stream(df: DataFrame, sink: BinaryIO) -> int:
    """Writes the rows as one Arrow IPC stream, a partition at a time on the driver; returns their number."""
    import pyarrow as pa

    def packed(batches: Iterator) -> Iterator:
        for b in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_pydict({"part": [out.getvalue().to_pybytes()]})

    rows, writer = 0, None
    for row in df.mapInArrow(packed, "part binary").toLocalIterator():
        for b in pa.ipc.open_stream(bytes(row.part)):
            writer = writer or pa.ipc.new_stream(sink, b.schema)
            writer.write_batch(b)
            rows += b.num_rows
    if writer is None:
        writer = pa.ipc.new_stream(sink, df.limit(0).toArrow().schema)
    writer.close()
    return rows

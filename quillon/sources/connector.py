"""A connector on Spark's Python data source API: Arrow files in a folder, read by split and written atomically.

It shows the interface that further connectors implement: partitions and batches to read; append, commit and abort
with row and byte counts to write. Reading and writing go through a path that all executors see.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quillon.errors import EngineError, ErrorCode

SPI_VERSION = "0.2.0"
MANIFEST = "_committed.json"


@dataclass(frozen=True)
class WriteStats:
    rows: int
    bytes: int


@dataclass
class PartWritten(WriterCommitMessage):
    name: str
    rows: int
    bytes: int


#: Comparisons that a reader takes over, by the data source API's filter class.
COMPARED = {"EqualTo": "equal", "GreaterThan": "greater", "GreaterThanOrEqual": "greater_equal", "LessThan": "less", "LessThanOrEqual": "less_equal"}


def manifest(path: str) -> dict:
    """What is committed under a path."""
    where = os.path.join(path, MANIFEST)
    if not os.path.exists(where):
        raise EngineError(ErrorCode.NOT_FOUND, f"nothing committed in {path}")
    with open(where) as f:
        return json.load(f)


class PartReader(DataSourceReader):
    """Reads a split's batches: rows that fail a pushed filter and rows past the split's limit don't leave the reader."""

    def __init__(self, path: str, schema: StructType, limit: int | None = None) -> None:
        self.path, self.names, self.limit = path, schema.names, limit
        self.taken: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of top-level columns with values; the rest stays with Spark."""
        for f in filters:
            kind = COMPARED.get(type(f).__name__)
            if kind and len(f.attribute) == 1 and f.attribute[0] in self.names and isinstance(f.value, (int, float, str, bool)):
                self.taken.append((f.attribute[0], kind, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        # Spark reads at least one split; an empty name stands for none.
        return [InputPartition(p["name"]) for p in manifest(self.path)["parts"]] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not partition.value:
            return
        left = self.limit
        with pa.OSFile(os.path.join(self.path, partition.value)) as f:
            for batch in pa.ipc.open_stream(f):
                batch = batch.select(self.names)
                for column, kind, value in self.taken:
                    batch = batch.filter(getattr(pc, kind)(batch.column(column), value))
                batch = batch if left is None else batch.slice(0, left)
                if batch.num_rows:
                    yield batch
                left = left if left is None else left - batch.num_rows
                if left == 0:
                    return


class PartWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator) -> PartWritten:
        import pyarrow as pa

        os.makedirs(self.path, exist_ok=True)
        name, rows, out = f"part-{uuid.uuid4().hex}.arrow", 0, None
        full = os.path.join(self.path, name)
        with pa.OSFile(full, "wb") as f:
            for batch in batches:
                out = out or pa.ipc.new_stream(f, batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
            if out:
                out.close()
        return PartWritten(name, rows, os.path.getsize(full))

    def commit(self, messages: list[PartWritten | None]) -> None:
        """The new parts beside those already committed, or in their place. One writer at a time."""
        old = manifest(self.path)["parts"] if os.path.exists(os.path.join(self.path, MANIFEST)) else []
        kept = [] if self.overwrite else old
        parts = kept + [{"name": m.name, "rows": m.rows, "bytes": m.bytes} for m in messages if m and m.rows]
        temporary = os.path.join(self.path, f".{uuid.uuid4().hex}")
        os.makedirs(self.path, exist_ok=True)
        with open(temporary, "w") as f:
            json.dump({"parts": parts, "rows": sum(p["rows"] for p in parts), "bytes": sum(p["bytes"] for p in parts)}, f)
        os.replace(temporary, os.path.join(self.path, MANIFEST))
        self.sweep()

    def abort(self, messages: list[PartWritten | None]) -> None:
        self.sweep()

    def sweep(self) -> None:
        """Removes parts that aren't committed: empty or replaced ones, and those of attempts that failed or were killed."""
        found = os.listdir(self.path) if os.path.isdir(self.path) else []
        listed = {p["name"] for p in manifest(self.path)["parts"]} if MANIFEST in found else set()
        for name in found:
            if name.startswith("part-") and name not in listed:
                os.remove(os.path.join(self.path, name))


class PartFiles(DataSource):
    """Format ``partfiles``; options: path, for reading a schema, whose columns alone are read, and ``limit``, rows per split."""

    @classmethod
    def name(cls) -> str:
        return "partfiles"

    def schema(self) -> StructType:
        raise EngineError(ErrorCode.SCHEMA, "give the schema")

    def reader(self, schema: StructType) -> PartReader:
        limit = self.options.get("limit")
        return PartReader(self.options["path"], schema, None if limit is None else int(limit))

    def writer(self, schema: StructType, overwrite: bool) -> PartWriter:
        return PartWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known and lets Spark hand filters to readers written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PartFiles)


def stats(path: str) -> WriteStats:
    total = manifest(path)
    return WriteStats(total["rows"], total["bytes"])

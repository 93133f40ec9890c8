"""Flat namespace of tables over Parquet paths, backed by temporary views."""

from __future__ import annotations

import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillon.errors import EngineError, ErrorCode

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_VIEWS = threading.RLock()


class Catalog:
    """Maps table names to Parquet paths; nothing is read before a table is asked for."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: tuple[str, ...] = TABLES) -> None:
        self.spark = spark
        self._paths: dict[str, str] = {}
        self._frames: dict[str, DataFrame] = {}
        if root is not None:
            for name in tables:
                self.add(name, f"{root.rstrip('/')}/{name}.parquet")

    def add(self, name: str, path: str) -> Catalog:
        self._paths[name] = path
        self._frames.pop(name, None)
        return self

    def add_frame(self, name: str, frame: DataFrame) -> Catalog:
        self._frames[name] = frame
        self._paths.setdefault(name, "")
        return self

    def names(self) -> list[str]:
        return sorted(self._paths)

    def table(self, name: str) -> DataFrame:
        if name not in self._paths:
            raise EngineError(ErrorCode.NOT_FOUND, f"table not found: {name}")
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(self._paths[name])
        return self._frames[name]

    def schema(self, name: str) -> StructType:
        return self.table(name).schema

    def sql(self, text: str) -> DataFrame:
        """Runs one statement. Tables that it mentions are views while it is analysed, one statement at a time.

        So catalogs with equal table names don't disturb each other, and views that were there before come back.
        """
        with _VIEWS:
            mine, before = sorted(set(re.findall(r"[A-Za-z_]\w*", text)) & self._paths.keys()), {}
            try:
                for word in mine:
                    frame = self.table(word)
                    if any(t.isTemporary and t.name.lower() == word.lower() for t in self.spark.catalog.listTables(pattern=word)):
                        before[word] = self.spark.table(word)
                    frame.createOrReplaceTempView(word)
                return self.spark.sql(text)
            finally:
                for word in mine:
                    if word in before:
                        before[word].createOrReplaceTempView(word)
                    else:
                        self.spark.catalog.dropTempView(word)

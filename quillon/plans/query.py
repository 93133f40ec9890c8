"""Asynchronous query handles: state, row count, preview, error and cancellation."""

from __future__ import annotations

import enum
import itertools
import threading
import uuid

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillon.catalog import Catalog
from quillon.errors import EngineError, ErrorCode

_ids = itertools.count(1)


class QueryState(enum.Enum):
    PENDING = "pending"
    RUNNING = "running"
    DONE = "done"
    FAILED = "failed"
    CANCELLED = "cancelled"


class QueryHandle:
    """One submitted statement. Rows stay distributed: only a preview of bounded size comes to the driver.

    The statement runs once where its preview is the whole result, or where a shared folder (``results``) takes the
    rows, from which count and preview are read; else a second run counts.
    """

    def __init__(self, catalog: Catalog, text: str, preview: int, results: str | None) -> None:
        self.id = f"q-{next(_ids):08x}"
        self.text, self.preview_rows, self.results = text, preview, results
        self.state, self.error, self.rows_total, self.preview = QueryState.PENDING, None, None, []
        self._catalog, self._thread, self._lock = catalog, None, threading.Lock()

    def _move(self, to: QueryState, *where: QueryState) -> bool:
        """Changes the state if it is one of the given ones."""
        with self._lock:
            if self.state in where:
                self.state = to
                return True
            return False

    def _run(self) -> None:
        spark = self._catalog.spark
        spark.sparkContext.addJobTag(self.id)
        try:
            if not self._move(QueryState.RUNNING, QueryState.PENDING):
                return
            df: DataFrame = self._catalog.sql(self.text)
            if self.results and df.columns:
                seen = Observation(self.id)
                path = f"{self.results.rstrip('/')}/{self.id}-{uuid.uuid4().hex}"
                names = [f"c{i}" for i in range(len(df.columns))]  # a result may repeat names, files may not
                df.toDF(*names).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
                rows, found = seen.get["rows"], spark.read.parquet(path).toDF(*df.columns).limit(self.preview_rows).collect()
            else:
                found = df.limit(self.preview_rows + 1).collect()
                rows = len(found)
                if rows > self.preview_rows and self.state is QueryState.RUNNING:
                    rows, found = df.count(), found[: self.preview_rows]
            with self._lock:
                if self.state is QueryState.RUNNING:
                    self.rows_total, self.preview, self.state = rows, found, QueryState.DONE
        except Exception as e:
            self.error = str(e)
            self._move(QueryState.FAILED, QueryState.PENDING, QueryState.RUNNING)
        finally:
            spark.sparkContext.removeJobTag(self.id)

    def start(self) -> QueryHandle:
        self._thread = threading.Thread(target=inheritable_thread_target(self._catalog.spark)(self._run), daemon=True)
        self._thread.start()
        return self

    def wait(self, timeout: float | None = None) -> QueryHandle:
        self._thread.join(timeout)
        return self

    def cancel(self) -> None:
        """Stops the query's jobs; the state becomes CANCELLED unless it has ended."""
        if self._move(QueryState.CANCELLED, QueryState.PENDING, QueryState.RUNNING):
            self._catalog.spark.sparkContext.cancelJobsWithTag(self.id)

    def result(self) -> list:
        self.wait()
        if self.state is not QueryState.DONE:
            raise EngineError(ErrorCode.CANCELLED if self.state is QueryState.CANCELLED else ErrorCode.INTERNAL, self.error or self.state.value)
        return self.preview


def submit(catalog: Catalog, text: str, preview: int = 100, results: str | None = None) -> QueryHandle:
    return QueryHandle(catalog, text, preview, results).start()

"""Sources and sinks."""

from quillon.sources.connector import SPI_VERSION, PartFiles, WriteStats, register
from quillon.sources.files import from_rows, read_files, sample_table, summary, write_arrow_stream, write_parquet

__all__ = ["SPI_VERSION", "PartFiles", "WriteStats", "from_rows", "read_files", "register", "sample_table", "summary", "write_arrow_stream", "write_parquet"]

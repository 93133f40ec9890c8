"""One exception class with a code, for everything the engine rejects itself."""

from __future__ import annotations

import enum


class ErrorCode(enum.Enum):
    INTERNAL = "internal"
    NOT_FOUND = "not_found"
    UNSUPPORTED = "unsupported"
    INVALID_ARGUMENT = "invalid_argument"
    IO = "io"
    SCHEMA = "schema"
    CANCELLED = "cancelled"


class EngineError(Exception):
    def __init__(self, code: ErrorCode, message: str) -> None:
        super().__init__(f"[{code.value}] {message}")
        self.code = code

"""Errors with a code and facts, and the library's log."""

from __future__ import annotations

import logging

log = logging.getLogger("symweave")


class SymweaveError(Exception):
    """All errors of the library; code tells the sort, facts what it is about."""

    code = "ERROR"

    def __init__(self, message: str, **facts):
        super().__init__(message)
        self.facts = {k: v for k, v in facts.items() if v is not None}

    def as_row(self) -> dict:
        return {"message": str(self), "code": self.code} | self.facts


class FileError(SymweaveError):
    code = "FILE_ERROR"


class ParseError(SymweaveError):
    code = "PARSE_ERROR"


class StoreError(SymweaveError, RuntimeError):
    code = "STORE_ERROR"


class SearchError(SymweaveError):
    code = "SEARCH_ERROR"


class ConfigError(SymweaveError):
    code = "CONFIG_ERROR"


def quiet(on: bool = True) -> None:
    """Turns the library's log off or on."""
    log.disabled = on

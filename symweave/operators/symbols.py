"""From what a user writes for a symbol to the nodes that it means, by search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row

from symweave.operators.lookups import matches_symbol
from symweave.operators.search import search
from symweave.operators.textindex import TextIndex
from symweave.plans.staging import staged

SEPARATOR = re.compile(r"::|[./]")
FEW, MANY = 10, 50
# Words of a request for something new, of one about a fault, and of a question.
FEATURE = ("add", "create", "implement", "build", "enable", "allow", "new feature", "support for", "ability to", "want to", "should be able", "need to add", "swap", "edit", "modify")
FAULT = ("fix", "bug", "error", "broken", "crash", "issue", "problem", "not working", "fails", "undefined", "null")
QUESTION = ("how does", "where is", "what is", "find", "show me", "explain", "understand", "explore")


def _found(nodes: DataFrame, index: TextIndex, symbol: str, limit: int) -> DataFrame:
    """Search hits in order; where a qualified symbol finds none, those of its last part."""
    hits = staged(search(nodes, index, symbol, limit), "hits")
    tail = [p for p in SEPARATOR.split(symbol) if p][-1:]
    if SEPARATOR.search(symbol) and tail and tail[0] != symbol and hits.isEmpty():
        hits = staged(search(nodes, index, tail[0], limit), "hits")
    return hits


def _rows(found: DataFrame) -> list[Row]:
    return found.orderBy(found["score"].desc(), "id").select("id", "kind", "name", "file_path", "start_line").collect()  # at most the search limit


def find(nodes: DataFrame, index: TextIndex, symbol: str) -> tuple[Row | None, str]:
    """The node that a symbol means, and a note on others that it may mean.  A plain name falls back to the best hit, a qualified one to nothing."""
    qualified = bool(SEPARATOR.search(symbol))
    hits = _found(nodes, index, symbol, MANY if qualified else FEW)
    same = _rows(hits.filter(matches_symbol(symbol)))
    if same:
        others = ", ".join(f"{r['name']} ({r['kind']}) at {r['file_path']}:{r['start_line']}" for r in same[1:])
        return same[0], f'{len(same)} symbols are named "{symbol}"; others: {others}' if others else ""
    rows = [] if qualified else _rows(hits.limit(1))
    return (rows[0], "") if rows else (None, "")


def find_all(nodes: DataFrame, index: TextIndex, symbol: str) -> tuple[list[Row], str]:
    """All nodes that a symbol may mean, and a note where there are several; the best hit where none fits."""
    hits = _found(nodes, index, symbol, MANY)
    same = _rows(hits.filter(matches_symbol(symbol)))
    if len(same) > 1:
        places = ", ".join(f"{r['kind']} at {r['file_path']}:{r['start_line']}" for r in same)
        return same, f'results of {len(same)} symbols named "{symbol}": {places}'
    return same or _rows(hits.limit(1)), ""


def asks_for_something_new(task: str) -> bool:
    """Whether a task reads like a request for a feature, not like a fault or a question."""
    low = task.lower()
    return not any(w in low for w in (*FAULT, *QUESTION)) and any(w in low for w in FEATURE)

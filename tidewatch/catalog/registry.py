"""The query registry: one entry per operator, with SQL where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


_ENTRIES: dict[str, Entry] = {}

_TOPICS = [
    "reports", "profiles", "cleaning", "features", "quality", "tables", "learning", "streams",
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"query {name!r} is registered twice")
        _ENTRIES[name] = Entry(run, sql)
        return run

    return register


def entries() -> dict[str, Entry]:
    for topic in _TOPICS:
        importlib.import_module(f"tidewatch.catalog.{topic}")
    return dict(_ENTRIES)

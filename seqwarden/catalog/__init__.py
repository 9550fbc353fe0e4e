"""Registered queries over the sample tables, each with its check in ANSI SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def all_queries() -> list[Query]:
    from seqwarden.catalog import artifacts, flows, incidents, positions, quality, records, sequences, templates

    modules = (sequences, records, templates, incidents, quality, artifacts, flows, positions)
    return sorted((q for m in modules for q in m.QUERIES), key=lambda q: q.name)

"""Registered queries and the SQL both engines share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_TOKEN = re.compile(r"\{(\w+)\}")


class Inputs:
    """The driver tables, and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in VIEWS:
                self._known[name] = self.sql(VIEWS[name])
            else:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        names = sorted(set(_TOKEN.findall(text)))
        return self.spark.sql(text, **{name: getattr(self, name) for name in names})


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in _TOKEN.findall(text):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def full_sql(body: str) -> str:
    """The body with every view it uses spelled out as a common table expression."""
    recursive = "RECURSIVE " if "/*recursive*/" in body else ""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in _needed(body, [])]
    text = body.strip()
    if text.startswith("WITH "):
        parts.append(text[5:])
        joined = ", ".join(parts)
    else:
        joined = ", ".join(parts) + (" " if parts else "") + text
        if not parts:
            return _TOKEN.sub(r"\1", text)
    return _TOKEN.sub(r"\1", f"WITH {recursive}{joined}")


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` and its SQL twin."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            from sightline.session import tune

            return fn(Inputs(tune(spark), folder))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = full_sql(oracle)
        return fn

    return wrap

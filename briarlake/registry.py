"""Registry of queries over the driver tables and of their SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from briarlake.plans.bindings import FRAMES, TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Frames:
    """Domain frames and driver tables of one folder, by attribute; each is read once and lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in FRAMES:
                used = {n: getattr(self, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", FRAMES[name]))}
                self._made[name] = self.spark.sql(FRAMES[name], **used)
            else:
                raise AttributeError(name)
        return self._made[name]


def _with_frames(sql: str) -> str:
    """The SQL with the domain frames that it names as common table expressions before it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name, body in FRAMES.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\{{?{name}\b", text):
                add(body)
                needed.append(name)

    add(sql)
    if not needed:
        return sql
    made = ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', FRAMES[n])})" for n in needed)
    body = sql.strip()
    if re.match(r"WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {made}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {made}, {body[4:]}" if re.match(r"WITH\b", body) else f"WITH {made} {body}"


def query(name: str, sql: str | None = None):
    """Register `make(frames)` under `name`, with its DuckDB SQL if it can be said in SQL."""

    def register(make: Callable[[Frames], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: make(Frames(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = _with_frames(sql)
        return make

    return register

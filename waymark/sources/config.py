"""Settings, connections and queries with parameters."""

from __future__ import annotations

import os
import re
from contextlib import contextmanager
from time import perf_counter

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

LINE = re.compile(r"^\s*([A-Za-z_]\w*)\s*=\s*(.*?)\s*$")
#: What a settings file may have, and what holds where it does not.
DEFAULTS = {
    "ELEVATION_DIRECTORY": "./elevations",
    "USERNAME": ".",
    "PASSWORD": ".",
    "HOST": "localhost",
    "ELE_USERNAME": ".",
    "ELE_PASSWORD": ".",
}
PORT = 5432


def parse(text: str) -> tuple[dict[str, str], list[str]]:
    """All settings, by default those of `DEFAULTS`, and warnings about unknown keys or unreadable lines."""
    out, warnings = dict(DEFAULTS), []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = LINE.match(line)
        if m is None:
            warnings.append(f"cannot read {line!r}")
        elif m[1] not in DEFAULTS:
            warnings.append(f"unknown setting {m[1]}")
        else:
            out[m[1]] = m[2]
    return out, warnings


def parsed_columns(line: Column) -> dict[str, Column]:
    """Key and value of settings lines, null for comments and blanks."""
    pattern = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    ok = line.rlike(pattern)
    return {"key": F.when(ok, F.regexp_extract(line, pattern, 1)), "value": F.when(ok, F.regexp_extract(line, pattern, 2))}


def env(name: str, default: str) -> str:
    return os.environ.get(name, default)


def jdbc_url(host: str, database: str) -> str:
    """Address without credentials; those go into reader options."""
    return f"jdbc:postgresql://{host}:{PORT}/{database}"


def jdbc_options(settings: dict[str, str], database: str, name: str) -> dict[str, str]:
    return {"url": jdbc_url(settings["HOST"], database), "dbtable": name, "user": settings["USERNAME"], "password": settings["PASSWORD"]}


def jdbc(spark: SparkSession, settings: dict[str, str], database: str, name: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(settings, database, name)).load()


def execute(spark: SparkSession, query: str, **args) -> DataFrame:
    """A query with named parameters; arguments are bound, never put into the text."""
    return spark.sql(query, args=args)


def execute_one(spark: SparkSession, query: str, **args) -> Row:
    """The only row of a query."""
    rows = execute(spark, query, **args).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one row expected, {'none' if not rows else 'more'} found")
    return rows[0]


class Prepared:
    """A query that is kept for several executions."""

    def __init__(self, spark: SparkSession, query: str) -> None:
        self.spark, self.query = spark, query

    def execute(self, **args) -> DataFrame:
        return execute(self.spark, self.query, **args)

    def execute_one(self, **args) -> Row:
        return execute_one(self.spark, self.query, **args)


def stream_rows(df: DataFrame, columns: list[str]):
    """Rows one by one, a partition at a time in memory."""
    yield from df.select(*columns).toLocalIterator()


@contextmanager
def timed(report, name: str):
    """Calls `report(name, seconds)` at the end."""
    began = perf_counter()
    try:
        yield
    finally:
        report(name, perf_counter() - began)

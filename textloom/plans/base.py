"""Registration of queries, and literal tables that Spark and DuckDB read alike."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, tuple[Query, str | None]] = {}

SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<long>": "BIGINT[]", "timestamp": "TIMESTAMP"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under ``name`` with its SQL."""

    def add(function: Query) -> Query:
        if name in REGISTERED:
            raise ValueError(f"{name} is registered already")
        REGISTERED[name] = (function, sql)
        return function

    return add


@functools.lru_cache(maxsize=64)
def _schema_of(spark: SparkSession, path: str):
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return repr(value)


@dataclass(frozen=True)
class Literal:
    """Rows of a query that no driver table holds as they are: a few literal ones, as edge cases, and those of
    ``more``, a SELECT over driver tables (see ``derived``).  ``schema`` is Spark's simple form (name type, ...)."""

    schema: str
    rows: tuple[tuple, ...]
    more: str = ""

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(part.strip().split(" ", 1)) for part in self.schema.split(", ")]

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        few = spark.createDataFrame([tuple(r) for r in self.rows], self.schema)
        if not self.more:
            return few
        used = {name for _, name, _, _ in Formatter().parse(self.more) if name}
        rest = spark.sql(self.more.replace("LIST(", "array("), **{name: table(spark, sf_dir, name) for name in used})
        return few.unionByName(rest.select(*[F.col(n).cast(t).alias(n) for n, t in self.columns()]))

    def sql(self) -> str:
        """A parenthesised SELECT for a FROM or WITH clause."""
        names = [n for n, _ in self.columns()]
        casts = ", ".join(f"CAST({n} AS {SQL_TYPES[t]}) AS {n}" for n, t in self.columns())
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        few = f"SELECT {casts} FROM (VALUES {values}) AS v({', '.join(names)})"
        if not self.more:
            return f"({few})"
        used = {name for _, name, _, _ in Formatter().parse(self.more) if name}
        rest = self.more.replace("LIST(", "list_value(").format(**{name: name for name in used})
        return f"({few} UNION ALL SELECT {casts} FROM ({rest}) m)"

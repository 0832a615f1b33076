"""Registration of queries and of named SQL steps for the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, check: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return register


def step(name: str, sql: str, *needs: str) -> str:
    """A named WITH step; ``needs`` are steps it reads."""
    STEPS[name] = (needs, sql)
    return name


def with_steps(sql: str, *needs: str) -> str:
    """The SQL preceded by the steps it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for n in STEPS[name][0]:
            visit(n)
        ordered.append(name)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n][1]})" for n in ordered) + "\n" + sql


def text(value) -> str:
    """A SQL text literal (standard quoting)."""
    return "'" + str(value).replace("'", "''") + "'"


def texts(values) -> str:
    return ", ".join(text(v) for v in values)


def rows(values) -> str:
    """Rows of a VALUES list."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return text(v) if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in values)


def rounded(df: DataFrame, places: int = 4, *columns: str) -> DataFrame:
    """Double columns rounded: sums depend on the order of addition."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        wanted = (f.name in columns) if columns else isinstance(f.dataType, (T.DoubleType, T.FloatType))
        out.append(F.round(c, places).alias(f.name) if wanted else c)
    return df.select(*out)

"""Tables of external databases through JDBC (a driver jar must be on the class path)."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class DatabaseError(RuntimeError):
    """Reading failed; the message carries no credentials."""


# user:password before the host of a URL, and key=value pairs that name a secret.
_LOGIN = re.compile(r"(//[^\s/:@]*):[^\s@]*@")
_SECRET = re.compile(r"(?i)\b((?:[\w.-]*(?:pass(?:word)?|pwd|secret|token))\s*[=:]\s*)[^\s;&,]+")


def masked(message: str) -> str:
    """The whole message with passwords and tokens blotted out."""
    return _SECRET.sub(r"\1***", _LOGIN.sub(r"\1:***@", message))


# Fixed form: the database itself stops after so many rows of a query.
LIMITED = "SELECT * FROM ({query}) AS _sub LIMIT {rows:d}"
_END = re.compile(r"[\s;]+\Z")


def statement(query: str, rows: int | None = None) -> str:
    """The query without what ends a statement, as a derived table where ``rows`` are given."""
    plain = _END.sub("", query).lstrip()
    return plain if rows is None else LIMITED.format(query=plain, rows=rows)


def jdbc_options(url: str, *, table: str | None = None, query: str | None = None, row_limit: int | None = None,
                 properties: Mapping[str, str] | None = None) -> dict[str, str]:
    if not url:
        raise ValueError("a connection URL is required")
    if not query and not table:
        raise ValueError("provide either a query or a table")
    options = {"url": url, **(properties or {})}
    if query or row_limit:
        return {**options, "query": statement(query or f"SELECT * FROM {table}", row_limit)}
    return {**options, "dbtable": table or ""}


def read_sql(spark: SparkSession, url: str, *, table: str | None = None, query: str | None = None, row_limit: int | None = None,
             properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table or query of a database.

    For a large table pass ``partitionColumn``, ``lowerBound``, ``upperBound``
    and ``numPartitions`` in ``properties``: without them one task reads all.
    """
    options = jdbc_options(url, table=table, query=query, row_limit=row_limit, properties=properties)
    try:
        return spark.read.format("jdbc").options(**options).load()
    except Exception as e:  # noqa: BLE001 - drivers raise many kinds
        raise DatabaseError(masked(str(e))) from None

"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Column name or Column → Column."""
    return c if isinstance(c, Column) else F.col(c)


def q(name: str) -> str:
    """Back-quote a column name for ``F.col``/SQL (names may hold spaces or ``@``)."""
    return "`" + name.replace("`", "``") + "`"

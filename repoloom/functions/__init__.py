"""Column functions: paths, names, languages, text, regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    """A column from a name or a column."""
    return F.col(c) if isinstance(c, str) else c

"""Missing values: NaN and NULL are the same thing to every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(column: Column | str) -> Column:
    """The number itself, NULL for NaN."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(value.cast("double")), value)

"""Embedding columns: which vectors count, and their integer form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """True for a vector that is neither null nor empty and holds only finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(v) > 0) & fine, F.lit(False))


def integers(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each element, taken as double."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))

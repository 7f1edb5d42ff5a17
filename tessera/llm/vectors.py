"""Checks and samples of vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is not null or empty and each component is a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def hash_sample(df: DataFrame, ident: str, rows: int, n: int) -> DataFrame:
    """About ``n`` of the ``rows`` rows of ``df``, by a hash of ``ident``."""
    if rows <= n:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(ident), F.lit("sample")), F.lit(1 << 30)) < F.lit(int((1 << 30) * n / rows)))

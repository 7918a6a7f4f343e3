"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator, so that later filters aren't rewritten into copies of their expressions."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[x.alias(k) for k, x in columns.items()]))))

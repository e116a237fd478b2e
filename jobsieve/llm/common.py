"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.session import scratch_path

# Rows that a broadcast may hold; slim rows of up to about 100 bytes each.
BROADCAST_ROWS = 200_000


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the table does not have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def once(df: DataFrame, keep: Iterable[str | Column], **values: Column) -> DataFrame:
    """`keep` and the values, each value computed once however often later steps name it.

    The generator stands between two projections, which Catalyst would merge otherwise.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table for the small side of a join: broadcast when its counted rows are few.

    Above the limit Spark joins by shuffle (and splits hot keys); the result is the same.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df

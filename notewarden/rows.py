"""Arrays to rows, without computing the array twice.

For a plain ``explode`` the optimiser adds a filter "not empty" below it, and
pushing that filter down computes the array expression again - for arrays built
from regular expressions that doubles the work.  ``explode_outer`` has no such
filter; the empty row it gives is dropped afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_rows(df: DataFrame, keep: list, items: Column | str, name: str = "item") -> DataFrame:
    """``keep`` columns plus one row per array item."""
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, keep: list, items: Column | str, name: str = "item", pos: str = "pos") -> DataFrame:
    return df.select(*keep, F.posexplode_outer(items).alias(pos, name)).filter(F.col(pos).isNotNull())


def explode_structs(df: DataFrame, keep: list[str], items: Column | str) -> DataFrame:
    """``keep`` columns (by name) plus the fields of each struct item."""
    return explode_rows(df, keep, items, "__item").select(*keep, "__item.*")


def explode_map(df: DataFrame, keep: list, entries: Column | str, key: str = "key", value: str = "n") -> DataFrame:
    return df.select(*keep, F.explode_outer(entries).alias(key, value)).filter(F.col(key).isNotNull())

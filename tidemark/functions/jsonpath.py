"""Predicates over JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scalar(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def length(json: Column, path: str) -> Column:
    """Elements of the array at a path; null if there is none."""
    return F.json_array_length(F.get_json_object(json, path))


def holds(json: Column, path: str, value) -> Column:
    """True where the array of strings at a path has the value."""
    items = F.from_json(F.get_json_object(json, path), "array<string>")
    return F.coalesce(F.exists(items, lambda x: x == value), F.lit(False))

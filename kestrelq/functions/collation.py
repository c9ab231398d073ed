"""Collations as sort keys: two texts are equal, or in order, as their keys are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lenient import lower

COLLATIONS: dict[str, Callable[[Column], Column]] = {
    "binary": lambda x: x,
    "nocase": lower,  # ASCII letters only
    "rtrim": lambda x: F.rtrim(x),  # spaces at the end
}


def register(name: str, key: Callable[[Column], Column]) -> None:
    """A collation of the user's own, by its key."""
    COLLATIONS[name.lower()] = key


def collated(x: Column, collation: str) -> Column:
    if collation.lower() not in COLLATIONS:
        raise ValueError(f"no such collation: {collation}")
    return COLLATIONS[collation.lower()](x)

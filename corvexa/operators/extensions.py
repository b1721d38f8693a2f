"""Operations that callers add by name: column functions, rule conditions, aggregates and table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from .match import Rule


class Extensions:
    """A table of named operations. A name is given once; a call of an unknown name is an error."""

    def __init__(self) -> None:
        self._made: dict[str, Callable] = {}

    def register(self, name: str, f: Callable) -> Callable:
        if name in self._made:
            raise ValueError(f"there is an operation of this name: {name}")
        self._made[name] = f
        return f

    def _get(self, name: str) -> Callable:
        if name not in self._made:
            raise KeyError(f"no such operation: {name}")
        return self._made[name]

    def call(self, name: str, *arguments: Column) -> Column:
        """A column operation of any number of operands, or an aggregate."""
        return self._get(name)(*arguments)

    def condition(self, name: str, *arguments: Column) -> Rule:
        """A rule condition, to be combined with others by &, | and ~."""
        return Rule(self._get(name)(*arguments))

    def apply(self, name: str, df: DataFrame, **options) -> DataFrame:
        """A table operation."""
        return self._get(name)(df, **options)

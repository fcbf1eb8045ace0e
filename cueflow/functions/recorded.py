"""Column expressions that are made once.

Making an expression takes a call to the JVM for each of its parts, and a parser has a thousand of them. Steps that
add columns by expressions over names alone are the same for every DataFrame, so they are recorded at their first use and replayed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame


class _Recorder:
    """Takes the part of a DataFrame while its steps are recorded; ``columns`` are those that were added."""

    def __init__(self):
        self.steps: list[Callable[[DataFrame], DataFrame]] = []
        self.columns: list[str] = []

    def withColumns(self, made: dict[str, Column]) -> _Recorder:
        self.steps.append(lambda df: df.withColumns(made))
        self.columns += [c for c in made if c not in self.columns]
        return self

    def withColumn(self, name: str, made: Column) -> _Recorder:
        return self.withColumns({name: made})

    def drop(self, *names: str) -> _Recorder:
        self.steps.append(lambda df: df.drop(*names))
        self.columns = [c for c in self.columns if c not in names]
        return self


def recorded(f: Callable) -> Callable:
    """For functions of a DataFrame and hashable arguments that only add columns and drop them again."""
    known: dict = {}

    @wraps(f)
    def run(df, *args):
        # Expressions live in the JVM, and functions in Python belong to a context.
        key = (SparkContext._active_spark_context, args)
        if key not in known:
            known[key] = f(_Recorder(), *args)
        made = known[key]
        if isinstance(df, _Recorder):
            df.steps += made.steps
            df.columns += [c for c in made.columns if c not in df.columns]
            return df
        for step in made.steps:
            df = step(df)
        return df

    return run

"""Helpers on frames that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(df: DataFrame, name: str) -> Column:
    """Column `name`, by exact letter case where names differ in case only."""
    at = [i for i, c in enumerate(df.columns) if c == name] or [
        i for i, c in enumerate(df.columns) if c.lower() == name.lower()
    ]
    if not at:
        raise ValueError(f"no column {name} among {df.columns}")
    if len(set(c.lower() for c in df.columns)) == len(df.columns):
        return F.col(f"`{df.columns[at[0]]}`")
    return df[f"`{df.columns[at[0]]}`"] if len(at) == 1 else F.col(f"`{name}`")


def with_results(
    df: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame], results: dict[str, Column]
) -> DataFrame:
    """`df` with columns computed from its text, which the function sees as `__text`.

    Extra columns pass through inside one struct, so their names cannot
    clash with those of the computation; a column of the same name as a
    result is replaced by it. The results leave through a generator of one
    row: a filter on them stays above it, and is not pushed into the
    computation, where its expressions would be evaluated many times over.
    """
    kept = [c for c in df.columns if c.lower() not in {r.lower() for r in results}]
    rows = df.select(column(df, text).alias("__text"), F.struct(*[column(df, c) for c in kept]).alias("__row"))
    done = compute(rows).select("__row", F.inline(F.array(F.struct(*[e.alias(name) for name, e in results.items()]))))
    return done.select("__row.*", *results)


def only(df: DataFrame, **names: str) -> DataFrame:
    """Just the named columns: `only(df, id="doc_id")` selects doc_id as id."""
    return df.select(*[column(df, c).alias(alias) for alias, c in names.items()])

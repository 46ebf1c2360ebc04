"""Predicates of the retrieval and browsing requests, as columns that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_in(name: str, values: Sequence) -> Column:
    return F.col(name) == values[0] if len(values) == 1 else F.col(name).isin(list(values))


def scope(notebooks: Sequence[str] = (), sources: Sequence[str] = ()) -> Column:
    """Rows of any of the notebooks or any of the sources; one of both is needed."""
    parts = [field_in(n, v) for n, v in (("notebook_id", notebooks), ("source_id", sources)) if v]
    if not parts:
        raise ValueError("a notebook or a source is needed")
    return reduce(lambda a, b: a | b, parts)


def matching(notebook: str | None = None, source: str | None = None, contains: str | None = None, scoped: Column | None = None) -> Column:
    """All given conditions together; ``contains`` is a case-sensitive part of the content. Without any, every row."""
    parts = [F.col("notebook_id") == notebook] if notebook else []
    parts += [F.col("source_id") == source] if source else []
    parts += [F.col("content").contains(contains)] if contains else []
    parts += [scoped] if scoped is not None else []
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def without(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that don't fulfil a condition, those for which it is null among them."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def tenant_of(collection: Column, live: Sequence[tuple[str, str]]) -> Column:
    """The tenant that may use a collection: its live name or its ``<live>__`` namespace; the longest namespace wins."""
    out = F.lit(None).cast("string")
    for tenant, name in sorted(live, key=lambda x: len(x[1])):
        out = F.when((collection == name) | collection.startswith(name + "__"), tenant).otherwise(out)
    return out

"""Joining per-key values back to rows when some keys hold very many rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one of so many rows; there are fewer such keys than this.
HOT_SHARE = 1000


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def attach(rows: DataFrame, values: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values`` on ``keys`` (null equals null); ``how`` is inner or left.

    ``values`` holds one row a key and, in ``n``, how many of the rows have it (``n`` is
    dropped). Keys of more than one in ``HOT_SHARE`` of all those rows are fewer than
    ``HOT_SHARE`` by arithmetic: they are broadcast, so their rows stay where they are.
    All other keys meet in a shuffle, in which none can fill a task. ``values`` and ``rows``
    are read twice each; give them checkpointed or cheap.
    """
    total = values.agg(F.sum(n)).first()[0] or 0
    names = {k: f"_at_{k}" for k in keys}
    values = values.select(*[F.col(k).alias(names.get(k, k)) for k in values.columns])
    extra = [c for c in values.columns if c not in names.values() and c != n]
    limit = total // HOT_SHARE
    match = lambda v: reduce(lambda a, b: a & b, (rows[k].eqNullSafe(v[names[k]]) for k in keys))
    hot, cold = values.where(F.col(n) > limit), values.where(F.col(n) <= limit)
    hot_keys = F.broadcast(hot.limit(HOT_SHARE))
    few = rows.join(hot_keys, match(hot_keys)).select(*rows.columns, *extra)
    rest = rows.join(F.broadcast(hot.select(*names.values()).limit(HOT_SHARE)), match(hot), "left_anti")
    on = reduce(lambda a, b: a & b, (rest[k].eqNullSafe(cold[names[k]]) for k in keys))
    return few.unionByName(rest.join(cold, on, how).select(*rest.columns, *extra))

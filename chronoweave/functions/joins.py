"""Joining per-key tables back to their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_on_keys(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``keys``; the result has the columns of ``big``, then the others of ``small``.

    Grouping keeps a NULL key as a group, so its per-key result must find its
    rows again.  ``small`` is one row per key; AQE broadcasts it once its
    runtime size is known.
    """
    names = [f"__jk{i}" for i in range(len(keys))]
    rest = [F.col(f"`{c}`") for c in small.columns if c not in keys]
    s = small.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], *rest)
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    return big.join(s, on=same, how=how).drop(*names)

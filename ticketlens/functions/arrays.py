"""Exploding computed arrays without re-evaluating them.

For ``explode(expr)`` Spark infers ``size(expr) > 0`` and pushes that filter
below the projections that compute ``expr``, so an expensive array (cleaning,
scoring) is evaluated twice. The ``_outer`` generators infer nothing; dropping
the NULL element they emit for an empty or NULL array afterwards gives the
same rows as ``explode`` whenever the array holds no NULL elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_computed(df: DataFrame, keep: list, array: Column, alias: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(array).alias(alias)).where(F.col(alias).isNotNull())


def posexplode_computed(df: DataFrame, keep: list, array: Column, pos: str, alias: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, alias)).where(F.col(alias).isNotNull())

"""Strict JSON type tests on VARIANT values (presence, not coercion).

``variant_get(v, path, 'string')`` casts numbers to text, so type tests look
at the stored type instead: scalars via ``schema_of_variant`` (cheap for a
scalar), objects by extracting a one-field struct, which succeeds for every
object and nothing else without building the schema of the whole object.
A missing path is SQL NULL; JSON null is a VOID value, so both stay distinct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sub(v: Column, path: str) -> Column:
    return F.variant_get(v, path, "variant")


def kind(v: Column, path: str = "$") -> Column:
    """Type name of a scalar (``STRING``, ``BIGINT``, ``VOID`` ...); NULL when missing."""
    return F.schema_of_variant(sub(v, path))


def is_object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "struct<__probe:int>").isNotNull()


def is_string(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path) == "STRING", F.lit(False))


def typed(v: Column, path: str, type_name: str, dtype: str) -> Column:
    """The value at ``path`` as ``dtype`` when its JSON type is ``type_name``, else NULL."""
    return F.when(kind(v, path) == type_name, F.variant_get(v, path, dtype))

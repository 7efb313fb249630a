"""Unicode NFKC normalisation, the one cleaning step Spark has no built-in for.

It runs as an Arrow UDF without pandas, one text at a time, so a worker holds
little more than a batch. ASCII text is NFKC-stable, so the UDF
is fed NULL for pure-ASCII values (one bit per row over Arrow) and the value
is kept as is; only non-ASCII text crosses to Python.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NON_ASCII = r"[^\x00-\x7F]"


@F.arrow_udf(StringType())
def _nfkc_batch(values: pa.Array) -> pa.Array:
    return pa.array((unicodedata.normalize("NFKC", v.as_py()) if v.is_valid else None for v in values), pa.string())


def nfkc(text: Column) -> Column:
    """NFKC of ``text``; NULL stays NULL."""
    only_non_ascii = F.when(text.rlike(NON_ASCII), text)
    return F.coalesce(_nfkc_batch(only_non_ascii), text)

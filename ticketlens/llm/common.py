"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.session import scratch_path

# The white space that separates words: space and the controls 0x09 to 0x0D.
WORD_SPACE = " \t\n\x0b\f\r"
WORD_SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from wherever the path points."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, lost executors lose nothing."""
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table made by ``written`` that no later step reads."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now, not when the driver next collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the worker process.

    Functions travel to workers by value, so a global of this folder would be
    new in every task.
    """
    import sys
    import types

    holder = sys.modules.setdefault("_ticketlens_process_cache", types.ModuleType("_ticketlens_process_cache"))
    return vars(holder).setdefault(f"cache_{name}", {})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once per row.

    A plain reference inside a lambda may be inlined by the optimizer and then
    runs once per element; a lambda variable is always an evaluated value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text: its maximal runs without white space."""
    return F.filter(F.split(text, WORD_SPACE_CLASS + "+"), lambda w: w != "")


def exactly(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns, in order (extra columns of the input are left out)."""
    return df.select(*[F.col(f"`{c}`") for c in columns])

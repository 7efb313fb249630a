"""Token-array operators: head+tail truncation, special tokens, batch padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.fixed_values import HEAD_FRACTION, MIN_MAX_LENGTH, PAD_MULTIPLE


def head_tail_sizes(max_length: int, n_special: int) -> tuple[int, int, int]:
    """(budget, head, tail) for a model input length and number of special tokens."""
    if max_length < MIN_MAX_LENGTH:
        raise ValueError(f"max_length must be at least {MIN_MAX_LENGTH}")
    budget = max_length - n_special
    head = max(1, int(budget * HEAD_FRACTION))
    tail = budget - head
    if tail < 1:
        raise ValueError("token budget too small for a head and a tail")
    return budget, head, tail


def head_tail(tokens: Column, max_length: int, n_special: int = 2) -> Column:  # A5
    """Keep sequences within budget; otherwise the first ``head`` and last ``tail``."""
    budget, head, tail = head_tail_sizes(max_length, n_special)
    cut = F.concat(F.slice(tokens, 1, head), F.slice(tokens, -tail, tail))
    return F.when(F.size(tokens) > budget, cut).otherwise(tokens)


def with_specials(tokens: Column, first, last) -> Column:  # A6
    return F.concat(F.array(F.lit(first)), tokens, F.array(F.lit(last)))


def attention_mask(tokens: Column) -> Column:  # A6
    return F.array_repeat(F.lit(1), F.size(tokens))


def pad_batches(df: DataFrame, batch_col: str, ids_col: str, pad_value, multiple: int = PAD_MULTIPLE) -> DataFrame:  # A7
    """Pad every row to its batch's longest length rounded up to ``multiple``.

    Batches are small bounded groups (the scorer's batch size), so a window
    partitioned by batch id is cheap; no batch is ever collected.
    """
    longest = F.max(F.size(ids_col)).over(Window.partitionBy(batch_col))
    target = (F.ceil(longest / F.lit(multiple)) * F.lit(multiple)).cast("int")
    n_pad = target - F.size(ids_col)
    return (
        df.withColumn("padded_length", target)
        .withColumn("n_pad", n_pad)
        .withColumn("input_ids", F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_value), n_pad)))
        .withColumn(
            "attention_mask",
            F.concat(F.array_repeat(F.lit(1), F.size(ids_col)), F.array_repeat(F.lit(0), n_pad)),
        )
    )

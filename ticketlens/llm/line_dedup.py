"""Line deduplication across sites (operator 4).

A line is boilerplate when it stands on at least ``min_sites`` different sites.
The spread of every line is estimated by a HyperLogLog sketch of its sites;
sketches are built and merged by aggregation, so a line found in a third of all
rows costs one sketch per task. Lines whose estimate lies near the threshold
(within three standard errors and one site) get an exact distinct count, so the
verdict is that of exact counting. Every occurrence of a boilerplate line is
removed but the very first (smallest doc_id, then text, then position), so no
content leaves the corpus altogether.

While the boilerplate lines number at most ``BROADCAST_LINES``, they and their
first places are sent to the tasks as sorted numbers and every document is cut
where it is: no text is shuffled. Beyond that the removed positions are joined
to the documents by a shuffle.

Lines are compared without white space at their ends; blank lines are never
removed. Cases: a null text stays null, an empty one empty; a null site counts
as one site; a null doc_id sorts first; repeated rows (same id and text) are
treated alike, and if they hold the first occurrence both keep it; an empty
table gives an empty table; extra columns are passed through.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import WORD_SPACE, written

MIN_SITES = 5
#: log2 of the sketch's registers; standard error 1.04 / sqrt(2 ** LG_REGISTERS).
LG_REGISTERS = 8
#: Boilerplate lines (20 bytes each) are broadcast up to this count, else joined by shuffle.
BROADCAST_LINES = 1_000_000


def _without():
    """A UDF: the text without the lines at the removed positions."""

    def one(text, positions):
        if text is None or positions is None:
            return None
        gone = set(positions)
        return "\n".join([line for i, line in enumerate(text.split("\n")) if i not in gone])

    @F.pandas_udf("string")
    def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([one(t, p) for t, p in zip(texts, removed)], dtype=object)

    return without


def _hits(shared):
    """A UDF: which lines of a row are boilerplate but not first in the corpus, null if none (no text passes through)."""

    @F.pandas_udf("array<boolean>")
    def hits(lines: pd.Series, keys: pd.Series) -> pd.Series:
        import numpy as np

        bad, first_row, first_pos = shared.value
        out = []
        for hashes, key in zip(lines, keys):
            found = None
            if hashes is not None and len(hashes) and len(bad):
                slot = np.minimum(np.searchsorted(bad, hashes), len(bad) - 1)
                at = np.flatnonzero(bad[slot] == hashes)
                at = at[(first_row[slot[at]] != key) | (first_pos[slot[at]] != at)]
                if len(at):
                    found = np.zeros(len(hashes), dtype=bool)
                    found[at] = True
            out.append(found)
        return pd.Series(out, dtype=object)

    return hits


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def line_table(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """One row per non-blank line: doc, row key, position, site, line hash."""
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    lines = docs.select(
        d.alias("doc"), _row_key(d, t).alias("row_key"),
        F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(t, "\n")).alias("pos", "line"),
    ).withColumn("line", F.btrim("line", F.lit(WORD_SPACE)))
    return lines.filter("line <> ''").select("doc", "row_key", "pos", "site", F.xxhash64("line").alias("h"))


def _line_hashes(text: Column) -> Column:
    """Hash of every line as in ``line_table``; 0 for a blank one."""
    def hashed(line: Column) -> Column:
        core = F.btrim(line, F.lit(WORD_SPACE))
        return F.when(core != "", F.xxhash64(core)).otherwise(F.lit(0).cast("long"))

    return F.transform(F.split(text, "\n"), hashed)


def _places(firsts: DataFrame):
    """The boilerplate lines as sorted hashes with the row key and position of their first occurrence, broadcast."""
    import numpy as np

    rows = firsts.select("h", "first.row_key", "first.pos").toPandas().sort_values("h")
    arrays = (rows["h"].to_numpy(np.int64), rows["row_key"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64))
    return firsts.sparkSession.sparkContext.broadcast(arrays)


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """Hashes (h) of the lines on at least ``min_sites`` sites."""
    error = 1.04 / math.sqrt(1 << lg_registers)
    margin = 1 + math.ceil(3 * error * min_sites)
    spread = written(
        lines.sparkSession,
        lines.groupBy("h").agg(F.hll_sketch_agg("site", lg_registers).alias("sketch"))
        .select("h", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= min_sites - margin),
        "line-spread",
    )
    near = spread.filter(F.col("sites") <= min_sites + margin).select("h")
    exact = (
        lines.select("h", "site").join(near, "h", "left_semi").distinct()
        .groupBy("h").count().filter(F.col("count") >= min_sites).select("h")
    )
    return spread.filter(F.col("sites") > min_sites + margin).select("h").unionByName(exact)


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
) -> tuple[DataFrame, str]:
    """``docs`` with the boilerplate taken out of ``text``, plus a column (its name is returned)
    with the positions of the removed lines, null where nothing was removed."""
    spark = docs.sparkSession
    lines = written(spark, line_table(docs, doc_id, text, site), "lines")
    bad = written(spark, boilerplate(lines, min_sites), "boilerplate")
    # Boilerplate lines are looked up where the lines are while their count allows; a join on the
    # line would bring all rows of a very common line to one place.
    few = bad.count() <= BROADCAST_LINES
    found = lines.join(F.broadcast(bad) if few else bad, "h", "left_semi").select("h", F.struct("doc", "row_key", "pos").alias("at"))
    firsts = written(spark, found.groupBy("h").agg(F.min("at").alias("first")), "boilerplate-firsts")
    tag = uuid.uuid4().hex[:8]  # names no column of the input has
    doc, key, name = f"doc_{tag}", f"key_{tag}", f"removed_{tag}"
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    if few:
        out = docs.withColumn(key, _hits(_places(firsts))(_line_hashes(t), _row_key(d, t)))
        gone = F.col(key)
        rest = F.array_join(F.filter(F.split(t, "\n"), lambda _, i: ~F.get(gone, i)), "\n")
        cut = F.when(gone.isNull(), t).otherwise(rest).alias(text)
        places = F.filter(F.sequence(F.lit(0), F.size(gone) - 1), lambda i: F.get(gone, i))
        places = F.when(gone.isNotNull(), places).alias(name)
        return out.select(*[cut if c == text else F.col(f"`{c}`") for c in docs.columns], places), name
    removed = (
        found.join(firsts, "h").filter(~F.col("at").eqNullSafe(F.col("first")))
        .groupBy(F.col("at.doc").alias(doc), F.col("at.row_key").alias(key))
        .agg(F.array_sort(F.collect_set("at.pos")).alias(name))
    )
    removed = written(spark, removed, "removed-lines")
    joined = docs.join(removed, d.eqNullSafe(F.col(doc)) & (_row_key(d, t) == F.col(key)), "left")
    cut = _without()(F.when(F.col(name).isNotNull(), t), F.col(name))
    out = joined.select(
        *[F.coalesce(cut, t).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.col(name)
    )
    return out, name


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per document: lines, removed lines, and size and SHA-256 of the text that remains."""
    slim = docs.select("doc_id", "text", "source", F.size(F.split("text", "\n")).alias("n"))
    out, name = dedup(slim, min_sites=min_sites)
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(
        "doc_id",
        F.when(F.col("n") < 0, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_lines"),
        F.coalesce(F.size(name), F.lit(0)).cast("long").alias("n_removed"),
        F.octet_length(kept).cast("long").alias("n_bytes_kept"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )

"""SimHash near-duplicates (operator 7).

Fingerprints: words lower-cased (A-Z), shingles of 3 words, XXH64 with seed 42
of each; a bit is set if it is set in more than half of the hashes.

Links (at most 2 differing bits): each distinct fingerprint is mapped to its
per-segment bit counts, 16 segments of 4 bits. The Manhattan distance of two
such vectors is a lower bound of the bit distance, so only points within
Manhattan distance 2 can link. Such points differ in at most two coordinates;
with the coordinates in 8 blocks of two, at least six blocks agree. Each point
is put into the 28 grids that leave two blocks free and joined with the points
of its cell; the range condition on the Manhattan distance and then the exact
bit distance decide.

A cell is joined pairwise only while it has few points. All points of a fuller
cell go a second, equally exact way: two fingerprints are within 2 bits exactly
when they share a value within 1 bit of both, so each point lists its 65 such
values and is linked to the smallest point listing the same one - linear in the
points, no pairs. Nothing is capped or dropped.

Cases: a null, empty or blank text has no words and fingerprint 0, linked like
any other; one or two words are one shingle; equal texts and repeated rows
share a fingerprint; documents with null ids take part, but a component's id is
its smallest non-null doc_id; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import let, written
from ticketlens.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
SEGMENTS = 16
BLOCKS = 8
#: Cells with more points are linked through shared values instead of pairs.
PAIR_CELL_POINTS = 32
#: Ids (8 bytes) of the documents to leave out are broadcast up to this count, so that texts stay where they are.
BROADCAST_IDS = 1_000_000
#: Cells of more than two points are broadcast up to this count, else joined by shuffle.
BROADCAST_CELLS = 100_000
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint_of(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text (bounded memory for any length)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know only ASCII: A-Z, and the six white-space bytes.
    ws = text.encode("utf-8").lower().split() if text else []
    if not ws:
        return 0
    total = max(1, len(ws) - shingle_words + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, total, _SHINGLES_AT_ONCE):
        part = ws[at : at + _SHINGLES_AT_ONCE + shingle_words - 1]
        if len(ws) < shingle_words:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*[part[i:] for i in range(shingle_words)]))
        hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a (signed) long column."""

    @F.pandas_udf("long")
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for texts in parts:
            prints = [fingerprint_of(t, shingle_words) for t in texts]
            yield pd.Series(np.array(prints, dtype=np.uint64).view(np.int64))

    return simhash(text)


def bit_counts(fp: Column, segments: int = SEGMENTS) -> list[Column]:
    """Set bits per segment: the coordinates of the embedding."""
    width = 64 // segments
    return [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))) for i in range(segments)]


def manhattan(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x + y, [F.abs(p - q) for p, q in zip(bit_counts(a), bit_counts(b))])


def grid_cells(fp: Column) -> Column:
    """The 28 cells of a fingerprint: its coordinates with two blocks left free."""
    coords = bit_counts(fp)
    per = SEGMENTS // BLOCKS
    base = 64 // SEGMENTS + 1
    vector = F.lit(0).cast("long")
    for b in range(BLOCKS):
        code = reduce(lambda acc, c: acc * base + c, coords[b * per : (b + 1) * per], F.lit(0))
        vector = vector.bitwiseOR(F.shiftleft(code.cast("long"), 5 * b))
    # 31 is no code of a block (they end at 24), so a free block also names the grid.
    frees = [sum(31 << (5 * b) for b in free) for free in combinations(range(BLOCKS), MAX_BITS)]
    masks = F.lit(frees).cast("array<long>")
    return let(vector, lambda v: F.transform(masks, lambda mask: v.bitwiseOR(mask)))


def _verified(pairs: DataFrame) -> DataFrame:
    near = pairs.filter(manhattan(F.col("a"), F.col("b")) <= MAX_BITS)
    return near.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")


def links(prints: DataFrame, pair_cell_points: int = PAIR_CELL_POINTS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within 2 bits.

    Inside full cells not every close pair is listed, but each is connected by
    links of the list.

    Spark reckons an exploded table as if it had the rows of the one it is made
    of, so it would broadcast 28 or 65 rows a point: joins of such tables say
    what is broadcast, a counted table or none.
    """
    spark = prints.sparkSession
    placed = prints.select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell"))
    cells = written(
        spark,
        placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"),
        "simhash-cells",
    )
    twos = cells.filter("n = 2").select("a", "b")
    fuller = cells.filter("n > 2").select("cell", "n")
    fuller = F.broadcast(fuller) if fuller.count() <= BROADCAST_CELLS else fuller.hint("merge")
    shared = written(spark, placed.join(fuller, "cell").select("cell", "fp", "n"), "simhash-shared")
    few = shared.filter(F.col("n") <= pair_cell_points)
    pairs = few.select("cell", F.col("fp").alias("a")).join(few.select("cell", F.col("fp").alias("b")).hint("merge"), "cell").filter("a < b")
    full = shared.filter(F.col("n") > pair_cell_points).select("fp").distinct()
    near_values = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    listed = full.select("fp", F.explode(near_values).alias("value"))
    lowest = listed.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = listed.join(lowest.select("value", "a").hint("merge"), "value").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return _verified(twos.unionByName(pairs.select("a", "b")).unionByName(stars)).distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, root): component_id is the smallest doc_id reachable over links, root names the component."""
    spark = docs.sparkSession
    printed = written(
        spark,
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint(F.col(f"`{text}`")).alias("fp")),
        "simhash-prints",
    )
    owners = written(spark, printed.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-owners")
    roots = components(links(owners.select("fp")))
    linked = roots.join(owners, roots["node"] == owners["fp"]).select("fp", "root", "first_doc")
    lowest = linked.groupBy("root").agg(F.min("first_doc").alias("lowest"))
    merged = linked.join(lowest, "root").select("fp", "root", "lowest")
    classes = owners.join(merged, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("lowest", "first_doc").alias("component_id")
    )
    return printed.join(classes, "fp").select("doc_id", "fp", "component_id", "root")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest doc_id, with the columns it came with.

    A group without any id keeps one of its rows; rows that repeat an id and a
    fingerprint count as one document, of which one row stays.
    """
    spark = docs.sparkSession
    found = written(spark, near_duplicates(docs, doc_id, text), "simhash-groups")
    ids = found.agg(F.count("doc_id").alias("with_id"), F.count("*").alias("rows")).first()
    unique = ids["with_id"] == ids["rows"] and found.groupBy("doc_id").count().filter("count > 1").limit(1).count() == 0
    if unique:
        gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        if gone.count() <= BROADCAST_IDS:
            gone = F.broadcast(gone)
        return docs.join(gone, docs[f"`{doc_id}`"] == gone["_gone"], "left_anti")
    # Ids repeat or are missing: a document is an id with a fingerprint.
    first = (
        found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("k"))
        .select(F.col("k.doc_id").alias("_id"), F.col("k.fp").alias("_fp"))
    )
    name = f"fp_{uuid.uuid4().hex[:8]}"
    with_print = docs.withColumn(name, fingerprint(F.col(f"`{text}`")))
    kept = with_print.join(
        first, with_print[f"`{doc_id}`"].eqNullSafe(first["_id"]) & (with_print[name] == first["_fp"]), "left_semi"
    )
    return kept.dropDuplicates([doc_id, name]).drop(name)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id per document."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

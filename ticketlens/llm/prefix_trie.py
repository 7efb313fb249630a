"""Conversation prefix trie (operator 11): range minima over sorted LCPs.

A conversation is the sequence of its turns, each told by a 128-bit digest of
role and text. Equal sequences become one row. The distinct sequences are range
partitioned into sorted blocks; inside a block the longest common prefixes (in
turns) of neighbours get a sparse table of range minima, and every prefix of
every sequence searches its left and right extent independently by halving
steps over that table: the rows between share the prefix, so (left, right,
depth) is a node and its members are an interval. No stack and no recursion.

Blocks are contiguous in the order, so a node reaches over a block's edge only
if the LCP across that edge is at least its depth. Those few nodes (at most two
times the depth per block) are summed by a hash of their prefix; all others are
final where they are. Children, leaves and saved lengths of a subtree are sums
over the interval, so partial sums of blocks add up.

Only digests and lengths are moved, never texts. The ids of one sequence are
hashed in order from joined pieces, so a sequence shared by a third of all rows
is a stream, not a group in memory. A conversation's own turns meet in one row
(16 bytes per turn).

Cases: rows without conv_id belong to no conversation and are left out; a null
role or text is empty; turns go by turn (null first), ties by role and then by
digest; repeated rows are repeated turns; an empty table has no node, not even
the root; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import written

#: Every conversation is rebuilt on the first turns of the one that opens its hundred.
HEAD_EVERY = 100
HEAD_TURNS = 6
#: Turns of a sorted block, on average.
BLOCK_TURNS = 250_000
#: Nodes over block edges are broadcast up to this count (about 100 bytes each), else joined by shuffle.
BROADCAST_NODES = 500_000
_DIGEST_BYTES = 16


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 of role and text (the length of the role keeps them apart)."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, _DIGEST_BYTES)


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        text.alias("text"), turn_digest(role, text).alias("digest"), F.length(text).alias("chars"),
    )


def head_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD_TURNS).cast("int")


def _head_of(conv_id: Column) -> Column:
    return conv_id - conv_id % HEAD_EVERY


def rebuild(conversations: DataFrame) -> DataFrame:
    """(id, digests, chars, n_head): every conversation on the first turns of its hundred's first one."""
    own = (
        _turns(conversations)
        .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "chars"))).alias("ts"))
        .select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("ts"))
    )
    own = written(conversations.sparkSession, own, "trie-turns")
    heads = own.filter(F.col("conv_id") % HEAD_EVERY == 0).select(
        F.col("conv_id").alias("head"), F.slice("ts", 1, HEAD_TURNS - 1).alias("hs")
    )
    h = head_turns(F.col("conv_id"))
    first = F.coalesce(F.slice("hs", F.lit(1), h), F.slice("ts", 1, 0))
    joined = own.join(heads, _head_of(F.col("conv_id")) == F.col("head"), "left").select(
        F.col("conv_id").alias("id"), first.alias("first"), F.slice("ts", h + 1, F.size("ts")).alias("rest")
    )
    whole = F.concat("first", "rest")
    return joined.select("id", whole["digest"].alias("digests"), whole["chars"].alias("chars"), F.size("first").alias("n_head"))


def _joined_ids(parts: Iterator) -> Iterator:
    """Rows sorted by (seq, id) -> one piece per run of a batch: seq, first id, count, ids joined by commas."""
    import numpy as np
    import pyarrow as pa

    for batch in parts:
        if not batch.num_rows:
            continue
        seqs = batch.column(0).to_pylist()
        ids = batch.column(1).to_pylist()
        cuts = [0] + [i for i in range(1, len(seqs)) if seqs[i] != seqs[i - 1]] + [len(seqs)]
        at = pa.array(np.array(cuts[:-1], dtype=np.int64))
        pieces = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, cuts[1:])]
        sizes = [b - a for a, b in zip(cuts, cuts[1:])]
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes, pa.int64()), pa.array(pieces, pa.string()),
                   batch.column(2).take(at), batch.column(3).take(at)]
        yield pa.RecordBatch.from_arrays(columns, names=["seq", "first_id", "n", "ids", "digests", "chars"])


def _hashed_ids(parts: Iterator) -> Iterator:
    """Pieces sorted by (seq, first id) -> one row per sequence with the SHA-256 of all its ids, read as a stream."""
    import hashlib

    import pyarrow as pa

    schema = pa.schema([
        ("first_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string()),
        ("digests", pa.list_(pa.binary())), ("chars", pa.list_(pa.int32())),
    ])
    seq, state, row = None, None, None
    for batch in parts:
        done = []
        for piece in batch.to_pylist():
            if piece["seq"] != seq:
                if row:
                    done.append(row | {"ends": state.hexdigest()})
                seq, state = piece["seq"], hashlib.sha256()
                row = {"first_id": piece["first_id"], "n": 0, "digests": piece["digests"], "chars": piece["chars"]}
            else:
                state.update(b",")
            state.update(piece["ids"].encode())
            row["n"] += piece["n"]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if row:
        yield pa.RecordBatch.from_pylist([row | {"ends": state.hexdigest()}], schema=schema)


def sequences(members: DataFrame) -> DataFrame:
    """Distinct sequences of (id, digests, chars): smallest id, count, SHA-256 of the sorted ids joined by commas."""
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seq = F.sha2(F.array_join(F.transform("digests", F.hex), "").cast("binary"), 256)
    keyed = members.select(seq.alias("seq"), "id", "digests", "chars")
    pieces = (
        keyed.repartitionByRange(parts, "seq", "id").sortWithinPartitions("seq", "id")
        .mapInArrow(_joined_ids, "seq string, first_id long, n long, ids string, digests array<binary>, chars array<int>")
    )
    return (
        pieces.repartition(parts, "seq").sortWithinPartitions("seq", "first_id")
        .mapInArrow(_hashed_ids, "first_id long, n long, ends string, digests array<binary>, chars array<int>")
    )


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays; -1 beside nothing."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(b.isNull(), -1).otherwise(F.when(stop == 0, F.size(same)).otherwise(stop - 1)).cast("int")


class RangeMinima:
    """Sparse table of an integer array: minima of all stretches whose length is a power of two."""

    def __init__(self, values):
        import numpy as np

        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def minimum(self, first, last):
        """Minima of values[first..last], for arrays of bounds."""
        import numpy as np

        out = np.empty(len(first), dtype=self.levels[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for j, table in enumerate(self.levels):
            at = np.flatnonzero(level == j)
            if len(at):
                out[at] = np.minimum(table[first[at]], table[last[at] - (1 << j) + 1])
        return out

    def left(self, row, depth):
        """For gaps as values: the smallest row reached from ``row`` over gaps of at least ``depth``."""
        import numpy as np

        row = row.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            step = 1 << j
            to = np.maximum(row - step, 0)
            row = np.where((row >= step) & (self.levels[j][np.minimum(to, len(self.levels[j]) - 1)] >= depth), to, row) if len(self.levels[j]) else row
        return row

    def right(self, row, depth):
        """The largest row reached from ``row`` over gaps of at least ``depth``."""
        import numpy as np

        row = row.copy()
        n = len(self.levels[0])
        for j in range(len(self.levels) - 1, -1, -1):
            step, table = 1 << j, self.levels[j]
            if len(table):
                row = np.where((row + step <= n) & (table[np.minimum(row, len(table) - 1)] >= depth), row + step, row)
        return row


NODES = (
    "key string, depth long, before long, n_convs long, first_id long, n_children long, n_leaves long, weighted long, "
    "fresh long, ends string, parent_first long, parent_key string"
)
#: Prefixes searched at once.
_CANDIDATES = 1 << 21


def _block_nodes(table):
    """Nodes of one sorted block; ``key`` only where the node goes on beyond an edge of the block."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    table = table.sort_by("at")
    m = table.num_rows
    flat = b"".join(d for row in table["digests"].to_pylist() for d in row)
    lens = np.array([len(c) for c in table["chars"].to_pylist()], dtype=np.int64)
    off = np.concatenate([[0], np.cumsum(lens)])
    chars = np.array([c for row in table["chars"].to_pylist() for c in row], dtype=np.int64)
    cum = np.concatenate([[0], np.cumsum(chars)])
    n, ids = table["n"].to_numpy(), table["first_id"].to_numpy()
    before, after = int(table["lcp_before"][0].as_py()), int(table["lcp_after"][0].as_py())

    # LCPs of neighbours: compare every turn with the turn at the same depth of the row above.
    code = np.frombuffer(flat, dtype=np.uint64).reshape(-1, 2)
    row_of = np.repeat(np.arange(m), lens)
    depth_of = np.arange(len(row_of)) - off[row_of]
    above = np.maximum(row_of - 1, 0)
    there = (row_of > 0) & (depth_of < lens[above])
    other = np.where(there, off[above] + depth_of, 0)
    differs = ~(there & (code[other] == code).all(axis=1)) if len(code) else np.zeros(0, dtype=bool)
    lcp = lens.copy()
    np.minimum.at(lcp, row_of[differs], depth_of[differs])
    lcp[0] = before
    following = np.append(lcp[1:], after)

    gaps = RangeMinima(lcp[1:])
    wide = int(lens.max()) + 1
    found = []
    starts = np.concatenate([[0], np.cumsum(lens + 1)])  # candidates: depths 0 to the length of each row
    for a in range(0, int(starts[-1]), _CANDIDATES):
        number = np.arange(a, min(int(starts[-1]), a + _CANDIDATES))
        row = np.searchsorted(starts, number, side="right") - 1
        depth = number - starts[row]
        node, at = np.unique(gaps.left(row, depth) * wide + depth, return_index=True)
        found.append(np.stack([node, gaps.right(row[at], depth[at])]))
    node, at = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
    right = np.concatenate([f[1] for f in found])[at]
    left, depth = node // wide, node % wide
    up = np.maximum(depth - 1, 0)
    up_left, up_right = gaps.left(left, up), gaps.right(left, up)

    def beyond(first, last, d):
        return ((first == 0) & (before >= d)), ((last == m - 1) & (after >= d))

    goes_on, stays_open = beyond(left, right, depth)
    up_on, up_open = beyond(up_left, up_right, up)

    def keys(row, most):
        state, out = hashlib.sha256(), []
        for d in range(most + 1):
            if d:
                state.update(flat[_DIGEST_BYTES * int(off[row] + d - 1) : _DIGEST_BYTES * int(off[row] + d)])
            out.append(state.hexdigest())
        return out

    first_keys, last_keys = keys(0, before), keys(m - 1, after)

    def key_of(on, open_, d):
        return [first_keys[k] if a else last_keys[k] if b else None for a, b, k in zip(on.tolist(), open_.tolist(), d.tolist())]

    def sums(values):
        total = np.concatenate([[0], np.cumsum(values)])
        return lambda first, last: total[last + 1] - total[first]

    total_chars = cum[off[1:]] - cum[off[:-1]]
    new_chars = total_chars - (cum[off[:-1] + np.maximum(lcp, 0)] - cum[off[:-1]])
    cum_before = cum[off[left] + up] - cum[off[left]]
    inside = sums(new_chars)(left, right) - new_chars[left]
    fresh = inside + np.where(goes_on, new_chars[left], total_chars[left] - cum_before)
    order = np.sort(lcp[1:] * (m + 1) + np.arange(1, m))
    branches = np.searchsorted(order, depth * (m + 1) + right, side="right") - np.searchsorted(order, depth * (m + 1) + left, side="right")
    children = branches + np.where(goes_on, lcp[left] == depth, lens[left] > depth)
    smallest = RangeMinima(ids)
    ends_here = ~goes_on & (lens[left] == depth)
    ends = table["ends"].to_pylist()
    up_whole = ~(up_on | up_open) & (depth > 0)
    return pa.table({
        "key": pa.array(key_of(goes_on, stays_open, depth), pa.string()),
        "depth": depth, "before": cum_before, "n_convs": sums(n)(left, right), "first_id": smallest.minimum(left, right),
        "n_children": children.astype(np.int64), "n_leaves": sums(following < lens)(left, right).astype(np.int64),
        "weighted": sums(n * total_chars)(left, right), "fresh": fresh,
        "ends": pa.array([ends[i] if e else None for i, e in zip(left.tolist(), ends_here.tolist())], pa.string()),
        "parent_first": pa.array(smallest.minimum(up_left, up_right), pa.int64(), mask=~up_whole),
        "parent_key": pa.array([k if d else None for k, d in zip(key_of(up_on, up_open, up), depth.tolist())], pa.string()),
    })


def build(members: DataFrame, block_turns: int = BLOCK_TURNS, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """The trie of (id long, digests array<binary>, chars array<int>), one row per node.

    first_id and parent_first (null at the root) name a node and its parent by
    their smallest member; ends is the SHA-256 of the ids that end at the node.
    """
    spark = members.sparkSession
    distinct = written(spark, sequences(members), "trie-sequences")
    turns = distinct.agg(F.sum(F.size("digests") + 1).alias("n")).first()["n"] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns / block_turns))
    placed = (
        distinct.repartitionByRange(blocks, "digests").sortWithinPartitions("digests")
        .withColumn("at", F.monotonically_increasing_id())
    )
    placed = written(spark, placed, "trie-blocks").withColumn("block", F.shiftright("at", 33))
    in_order = Window.orderBy("block")  # one row per block
    edges = placed.groupBy("block").agg(F.min_by("digests", "at").alias("a"), F.max_by("digests", "at").alias("z"))
    lcps = edges.select(
        "block", _common(F.col("a"), F.lag("z").over(in_order)).alias("lcp_before"),
        _common(F.col("z"), F.lead("a").over(in_order)).alias("lcp_after"),
    )
    nodes = placed.join(F.broadcast(lcps), "block").groupBy("block").applyInArrow(_block_nodes, NODES)
    nodes = written(spark, nodes, "trie-nodes")
    merged = written(
        spark,
        nodes.filter("key IS NOT NULL").groupBy("key").agg(
            F.max("depth").alias("depth"), F.max("before").alias("before"), F.sum("n_convs").alias("n_convs"),
            F.min("first_id").alias("first_id"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("weighted").alias("weighted"), F.sum("fresh").alias("fresh"), F.max("ends").alias("ends"),
            F.max("parent_first").alias("parent_first"), F.max("parent_key").alias("parent_key"),
        ),
        "trie-edge-nodes",
    )
    parents = merged.select(F.col("key").alias("parent_key"), F.col("first_id").alias("edge_first"))
    if merged.count() <= broadcast_nodes:
        parents = F.broadcast(parents)
    whole = nodes.filter("key IS NULL").unionByName(merged)
    return whole.join(parents, "parent_key", "left").select(
        "first_id", "depth", F.coalesce("parent_first", "edge_first").alias("parent_first"), "n_convs", "n_children",
        "n_leaves", (F.col("weighted") - F.col("n_convs") * F.col("before") - F.col("fresh")).alias("saved"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends"),
    )


def node_turns(conversations: DataFrame, nodes: DataFrame) -> DataFrame:
    """The last turn (role, text) of every node but the root, found in the rebuilt conversation of its smallest member."""
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "digest")
    turns = _turns(conversations).select("conv_id", F.row_number().over(in_order).alias("pos"), "role", "text")
    heads = rebuild(conversations).select(F.col("id").alias("first_id"), "n_head")
    at = nodes.filter("depth > 0").select("first_id", "depth").join(heads, "first_id")
    c, d = F.col("first_id"), F.col("depth")
    from_head = d <= F.col("n_head")
    at = at.select(
        "first_id", "depth", F.when(from_head, _head_of(c)).otherwise(c).alias("conv_id"),
        F.when(from_head, d).otherwise(head_turns(c) + d - F.col("n_head")).cast("int").alias("pos"),
    )
    return at.join(turns, ["conv_id", "pos"]).select("first_id", "depth", "role", "text")


def report(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return build(rebuild(conversations)).select(
        F.col("first_id").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )

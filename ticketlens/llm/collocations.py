"""Phrase collocation mining (operator 13): best-first branch and bound over prefixes.

Candidates are phrases of 2 to 5 words with at least ``MIN_COUNT`` occurrences
inside pieces. A cut after k words scores floor(1000 a n / (l r)); the lowest
cut counts. For every phrase that starts with w, r of the cut after w is at
least a, so its score is at most floor(1000 n / f(w)): the count of the prefix
is an admissible bound of all that grows from it.

Words are the first frontier, the rarest (highest bound) first, in slices. A
prefix is expanded by counting its one-word extensions in one scan of the coded
corpus; those with enough occurrences are candidates and join the frontier.
After a slice has grown, its candidates are scored and the score of each
language's 2000th survivor becomes the threshold: words whose bound is below
it are never expanded. When the best open bound of a language is lower than its
2000th score, ties included, its list is settled; a language with fewer
survivors is expanded completely.

A phrase is dropped if a longer candidate around it occurs as often. One word
more on one side is enough to look at (anything longer lies between), so it is
dropped exactly if all its occurrences have the same left or the same right
neighbour - minimum and maximum of the neighbours, counted along.

Words that occur less than ``MIN_COUNT`` times can be in no candidate; they and
the ends of pieces are coded as 0. Prefixes to expand are sent to the tasks as a
trie of at most ``PREFIXES`` phrases at a time, the vocabulary in blocks of
``VOCABULARY`` words; more of either takes more scans. Most partial counts are of
phrases met once or twice, so they are shuffled as packed runs of sorted keys, one
per bucket of phrases, and added up per bucket. All counts cover all documents,
and products are decimals of 38 digits, so arithmetic is exact.

Cases: a null or empty text has no words; a null language is ``und``; repeated
rows count each; fewer than 2000 survivors are all returned; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import discard, release, written
from ticketlens.session import bounded_batches

MIN_COUNT = 100
MAX_WORDS = 5
BEST = 2000
NO_LANG = "und"
#: Shares of a language's frequent words, rarest first, that the slices of the frontier end at.
SLICES = (0.0625, 0.25, 1.0)
#: Phrases sent to the tasks at once.
PREFIXES = 200_000
#: Words sent to the tasks at once.
VOCABULARY = 500_000
#: Word counts a task holds before it passes them on.
_HELD = 300_000
#: Partial counts of phrases a task holds before it merges them (and passes them on if that leaves more than half).
_HELD_PHRASES = 400_000
#: A row of the coded corpus ends at the first barrier after so many codes.
_SEGMENT = 1024
#: Rows of the coded corpus walked at once.
_ROWS = 128
#: Partial counts are dealt by phrase to one bucket for so many rows of the coded corpus; a task merges one at a time.
_BUCKET_ROWS = 2048

#: Fixed value: the bytes that end a piece; space and tab separate words.
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Stands for the end of a piece in a list of words; no word holds it.
_END = b"."


def _words(text: str | None) -> list[bytes]:
    """The words of a whole text, lower-cased (A-Z), with ``_END`` where pieces end."""
    if not text:
        return []
    raw = text.encode("utf-8").lower().translate(bytes.maketrans(_PIECE_ENDS, _END * len(_PIECE_ENDS)))
    return raw.replace(_END, b" " + _END + b" ").split()


def _counted(parts: Iterator) -> Iterator:
    """(lang, text) -> partial counts (lang, word, n)."""
    from collections import Counter, defaultdict

    import pyarrow as pa

    counts = defaultdict(Counter)

    def rows():
        for c in counts.values():
            c.pop(_END, None)
        names = pa.array(list(counts), pa.string()).take(pa.array([i for i, c in enumerate(counts.values()) for _ in c], pa.int64()))
        words = pa.array((w for c in counts.values() for w in c), pa.binary()).cast(pa.string())
        many = pa.array((n for c in counts.values() for n in c.values()), pa.int64())
        return pa.RecordBatch.from_arrays([names, words, many], names=["lang", "word", "n"])

    for batch in parts:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[lang].update(_words(text.as_py()))
            if sum(map(len, counts.values())) > _HELD:
                yield rows()
                counts.clear()
    yield rows()


def vocabulary(docs: DataFrame, min_count: int) -> DataFrame:
    """(id, lang, word, f, n, slice) of all words with enough occurrences; ids are dense from 1, n counts the language's words."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = docs.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = written(spark, words, "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"), F.count_if(F.col("f") >= min_count).alias("frequent"))
    placed = written(
        spark,
        words.filter(F.col("f") >= min_count).repartitionByRange(parts, "lang", "f", "word")
        .sortWithinPartitions("lang", "f", "word").withColumn("at", F.monotonically_increasing_id()),
        "phrase-frequent",
    )
    # Dense numbers: the rows before a range-partition (one count per partition) plus the place in it.
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    numbered = placed.join(F.broadcast(before), part == F.col("part")).select(
        (F.col("before") + place + 1).cast("int").alias("id"), "lang", "word", "f"
    )
    firsts = numbered.groupBy("lang").agg(F.min("id").alias("first_id"))
    share = (F.col("id") - F.col("first_id")) / F.col("frequent")
    number = F.lit(len(SLICES) - 1)
    for i in range(len(SLICES) - 2, -1, -1):
        number = F.when(share < SLICES[i], i).otherwise(number)
    langs = F.broadcast(totals.join(firsts, "lang"))  # one row per language
    return written(spark, numbered.join(langs, "lang").select("id", "lang", "word", "f", "n", number.alias("slice")), "phrase-vocabulary")


def encode(docs: DataFrame, words: DataFrame, block: int = VOCABULARY) -> DataFrame:
    """The corpus as rows (codes array<int>), each ending with a barrier (0)."""
    spark = docs.sparkSession
    many = words.count()
    coded = docs.withColumn("codes", F.lit(None).cast("array<int>"))
    for first in range(1, max(many, 1) + 1, block):
        here: dict[str, dict[bytes, int]] = {}
        for r in words.filter(F.col("id").between(first, first + block - 1)).select("lang", "word", "id").toLocalIterator():
            here.setdefault(r["lang"], {})[r["word"].encode("utf-8")] = r["id"]
        shared, last = spark.sparkContext.broadcast(here), first + block > many

        def run(parts: Iterator, shared=shared, last=last) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in parts:
                texts, known, rows = batch.column(1), batch.column(2), []
                for i, lang in enumerate(batch.column(0).to_pylist()):
                    get = shared.value.get(lang, {}).get
                    codes = np.array([*[get(w, 0) for w in _words(texts[i].as_py())], 0], dtype=np.int32)
                    if known[i].is_valid:
                        codes = np.maximum(codes, known[i].values.to_numpy())
                    rows.append(codes)
                if last:
                    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
                    ends = np.flatnonzero(flat == 0) + 1
                    # The first barrier of every further segment length ends a row.
                    cuts = ends[np.concatenate([ends[1:] // _SEGMENT != ends[:-1] // _SEGMENT, [True]])] if len(ends) else ends
                    offsets = np.concatenate([[0], cuts]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["codes"])
                else:
                    offsets = np.cumsum([0] + [len(r) for r in rows], dtype=np.int32)
                    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["lang", "text", "codes"])

        schema = "codes array<int>" if last else "lang string, text string, codes array<int>"
        coded = written(spark, coded.mapInArrow(run, schema), "phrase-codes")
    return coded


class _Trie:
    """Phrases as arrays a task can walk: edges (node, word) -> node, sorted; what to do at a node."""

    def __init__(self, grow: list[tuple[int, ...]], tally: list[tuple[int, ...]], words: int):
        import numpy as np

        self.width = words + 1
        nodes: dict[tuple[int, ...], int] = {(): 0}
        keys: list[int] = []
        for phrase in [*grow, *tally]:
            for m in range(1, len(phrase) + 1):
                if phrase[:m] not in nodes:
                    nodes[phrase[:m]] = len(nodes)
                    keys.append(nodes[phrase[: m - 1]] * self.width + phrase[m - 1])
        self.phrases = list(nodes)
        flags = np.zeros((2, len(nodes)), dtype=bool)
        flags[0, [nodes[p] for p in grow]] = True
        flags[1, [nodes[p] for p in tally]] = True
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        # Plain arrays: what a task needs, and nothing of this class.
        self.arrays = (self.width, np.array(keys, dtype=np.int64)[order], (order + 1).astype(np.int64), flags[0], flags[1])


FOUND = "node int, word int, cnt long, l_min int, l_max int, r_min int, r_max int"


def _grouped(parts):
    """One row per key, in their order, of several (keys, counts, smallest and largest neighbours)."""
    import numpy as np

    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.argsort(columns[0], kind="stable")
    keys = columns[0][order]
    if not len(keys):
        return tuple(columns)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    folds = (np.add, np.minimum, np.maximum, np.minimum, np.maximum)
    return (keys[at], *[f.reduceat(c[order], at) for f, c in zip(folds, columns[1:])])


def _pack(found) -> bytes:
    """Grouped partial counts as compressed bytes: steps between keys, ranges as width, small numbers beside each other."""
    import numpy as np
    import pyarrow as pa

    keys, counts, l_min, l_max, r_min, r_max = found
    rows = np.stack([np.diff(keys, prepend=0), counts - 1, l_min, l_max - l_min, r_min, r_max - r_min]).astype("<i8")
    planes = rows.view(np.uint8).reshape(6, len(keys), 8).transpose(0, 2, 1)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(many: int, packed):
    import numpy as np
    import pyarrow as pa

    planes = np.frombuffer(pa.decompress(packed, 48 * many, codec="zstd"), dtype=np.uint8).reshape(6, 8, many)
    steps, more, l_min, l_wide, r_min, r_wide = np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(6, -1).view("<i8")
    sides = (l_min, l_min + l_wide, r_min, r_min + r_wide)
    return (np.cumsum(steps), more + 1, *[x.astype(np.int32) for x in sides])


def _walked(shared, buckets: int) -> object:
    """Rows (codes) -> packed partial counts of the extensions and phrases of a broadcast trie, dealt by key."""

    def run(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        width, edges, to, grows, tallies = shared.value
        held: list[tuple] = []  # (keys, counts, smallest and largest neighbours) not passed on yet

        def hold(keys, left, right):
            left, right = left.astype(np.int32), right.astype(np.int32)
            held.append(_grouped([(keys, np.ones(len(keys), dtype=np.int64), left, left, right, right)]))

        def batch_of(found):
            place = (found[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(place, kind="stable")
            bucket, first = np.unique(place[order], return_index=True)
            groups = np.split(order, first[1:]) if len(order) else []
            packed = [_pack([c[g] for c in found]) for g in groups]
            arrays = [pa.array(bucket.astype(np.int32)), pa.array([len(g) for g in groups], pa.int32()), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["bucket", "many", "packed"])

        for batch in (b.slice(at, _ROWS) for b in parts for at in range(0, b.num_rows, _ROWS)):
            flat = np.concatenate([[0], batch.column(0).flatten().to_numpy(), [0] * (MAX_WORDS + 2)]).astype(np.int64)
            pos, node = np.arange(1, len(flat) - MAX_WORDS - 1), np.zeros(len(flat) - MAX_WORDS - 2, dtype=np.int64)
            for depth in range(MAX_WORDS):
                here = tallies[node]
                if here.any():
                    zero = np.zeros(int(here.sum()), dtype=np.int64)
                    hold(node[here] * width, zero, zero)
                word = flat[pos + depth]
                go = word > 0
                pos, node, word = pos[go], node[go], word[go]
                here = grows[node]
                if here.any():
                    at = pos[here]
                    hold(node[here] * width + word[here], flat[at - 1], flat[at + depth + 1])
                if depth == MAX_WORDS - 1 or not len(edges) or not len(pos):
                    break
                key = node * width + word
                slot = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
                go = edges[slot] == key
                pos, node = pos[go], to[slot[go]]
            if sum(len(h[0]) for h in held) > _HELD_PHRASES:
                held[:] = [_grouped(held)]
                if len(held[0][0]) > _HELD_PHRASES // 2:
                    yield batch_of(held.pop())
        if held:
            yield batch_of(_grouped(held))

    return run


def _merged(width: int, min_count: int) -> object:
    """Packed partial counts, sorted by bucket -> counts of the phrases, and of the extensions that are frequent."""

    def run(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, bucket = [], None

        def counted():
            keys, counts, *sides = _grouped(held)
            kept = (keys % width == 0) | (counts >= min_count)
            keys = keys[kept]
            arrays = [(keys // width).astype(np.int32), (keys % width).astype(np.int32), counts[kept], *[s[kept] for s in sides]]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["node", "word", "cnt", "l_min", "l_max", "r_min", "r_max"])

        for batch in parts:
            for here, many, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if held and here != bucket:
                    yield counted()
                    held.clear()
                bucket = here
                held.append(_unpack(many, packed.as_buffer()))
                if len(held) > 1 and sum(len(h[0]) for h in held) > len(held[0][0]) + _HELD_PHRASES:
                    held[:] = [_grouped(held)]
        if held:
            yield counted()

    return run


def _exact_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) of named columns, exact."""
    wide = lambda c: f"cast({c} AS decimal(19,0))"
    return F.expr(f"(cast(1000 * {wide(a)} * {wide(n)} AS decimal(38,0))) div (cast({wide(left)} * {wide(right)} AS decimal(38,0)))")


class _Miner:
    def __init__(self, docs: DataFrame, min_count: int, best: int, prefixes: int, block: int):
        self.spark, self.min_count, self.best, self.prefixes = docs.sparkSession, min_count, best, prefixes
        self.words = vocabulary(docs, min_count)
        self.many = self.words.count()
        self.codes = encode(docs, self.words, block)
        self.segments = self.codes.count()
        release(self.spark)
        #: Counted phrases (ids, f), words included, and scored survivors.
        self.known = self.words.select(F.array("id").alias("ids"), "f")
        self.scored: DataFrame | None = None

    def scan(self, grow: DataFrame | None, tally: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(extensions of ``grow``, counts of ``tally``): ids, f and the range of neighbours; blocks of bounded size."""
        jobs = [p.select("ids", F.lit(kind).alias("kind")) for p, kind in ((grow, 0), (tally, 1)) if p is not None]
        wanted = jobs[0] if len(jobs) == 1 else jobs[0].unionByName(jobs[1])
        out, block = [], []

        def count():
            trie = _Trie([p for p, kind in block if kind == 0], [p for p, kind in block if kind == 1], self.many)
            shared = self.spark.sparkContext.broadcast(trie.arrays)
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            buckets = max(4 * parts, self.segments // _BUCKET_ROWS)
            found = (
                self.codes.mapInArrow(_walked(shared, buckets), "bucket int, many int, packed binary")
                .repartition(parts, "bucket").sortWithinPartitions("bucket")
                .mapInArrow(_merged(self.many + 1, self.min_count), FOUND).withColumnRenamed("cnt", "f")
            )
            path = self.spark.createDataFrame(list(enumerate(map(list, trie.phrases))), "node int, path array<int>")
            found = found.join(F.broadcast(path), "node").select(
                F.when(F.col("word") == 0, F.col("path")).otherwise(F.concat("path", F.array("word"))).alias("ids"),
                "word", "f", "l_min", "l_max", "r_min", "r_max",
            )
            out.append(written(self.spark, found, "phrase-found"))
            shared.destroy()

        for r in wanted.toLocalIterator():
            block.append((tuple(r["ids"]), r["kind"]))
            if len(block) == self.prefixes:
                count()
                block = []
        if block or not out:
            count()
        found = out[0]
        for more in out[1:]:
            found = found.unionByName(more)
        return found.filter("word > 0"), found.filter("word = 0").select("ids", "f")

    def thresholds(self) -> dict[str, int]:
        """Score of the last of the best survivors, for the languages that have so many."""
        if self.scored is None:
            return {}
        last = self.scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"))))
        return {r["lang"]: r["score"] for r in last.filter(F.col("rank") == self.best).select("lang", "score").collect()}

    def above(self, score: Column, thresholds: dict[str, int]) -> Column:
        """Whether a score or bound can still matter in its language."""
        ok = F.lit(True)
        for lang, least in thresholds.items():
            ok = F.when(F.col("lang") == lang, score >= least).otherwise(ok)
        return ok

    def grow(self, number: int) -> None:
        """Expand the words of a slice with all that grows from them; score the candidates."""
        thresholds = self.thresholds()
        bound = F.expr("1000 * n div f")
        front = self.words.filter((F.col("slice") == number) & self.above(bound, thresholds)).select(F.array("id").alias("ids"))
        levels = []
        while len(levels) < MAX_WORDS - 1 and not front.isEmpty():
            found, _ = self.scan(front, None)
            levels.append(found)
            self.known = self.known.unionByName(found.select("ids", "f"))
            front = found.select("ids")
        if not levels:
            return
        found = levels[0]
        for more in levels[1:]:
            found = found.unionByName(more)
        inside = (F.size("ids") < MAX_WORDS) & (
            ((F.col("l_min") == F.col("l_max")) & (F.col("l_min") > 0)) | ((F.col("r_min") == F.col("r_max")) & (F.col("r_min") > 0))
        )
        langs = self.words.select(F.col("id").alias("last"), "lang", "n", F.col("f").alias("last_f"))
        alive = (
            found.filter(~inside).withColumn("last", F.element_at("ids", -1)).join(langs, "last")
            .select("ids", F.col("f").alias("a"), "lang", "n", "last_f")
        )
        # The last cut needs counts that are there: most candidates below the threshold end here.
        head = self.known.select(F.col("ids").alias("head"), F.col("f").alias("head_f"))
        alive = alive.join(head, F.slice("ids", F.lit(1), F.size("ids") - 1) == F.col("head")).withColumn(
            "most", _exact_score("a", "n", "head_f", "last_f")
        )
        alive = written(self.spark, alive.filter(self.above(F.col("most"), thresholds)).select("ids", "a", "lang", "n"), "phrase-alive")
        cuts = alive.select("ids", "a", "lang", "n", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")).select(
            "ids", "a", "lang", "n", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
            F.slice("ids", F.col("k") + 1, F.size("ids")).alias("right"),
        )
        missing = cuts.select(F.col("right").alias("ids")).distinct().join(self.known.select("ids"), "ids", "left_anti")
        missing = written(self.spark, missing, "phrase-missing")
        if not missing.isEmpty():
            _, counted = self.scan(None, missing)
            self.known = self.known.unionByName(counted)
        left = self.known.select(F.col("ids").alias("left"), F.col("f").alias("l"))
        right = self.known.select(F.col("ids").alias("right"), F.col("f").alias("r"))
        scored = (
            cuts.join(left, "left").join(right, "right")
            .withColumn("score", _exact_score("a", "n", "l", "r"))
            .groupBy("ids", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "ids", "a", "cut.l", "cut.r", "n", "cut.score")
        )
        scored = written(self.spark, scored, "phrase-scored")
        self.scored = scored if self.scored is None else self.scored.unionByName(scored)
        # A phrase counted here may have been tallied before: one row each.
        self.known = written(self.spark, self.known.groupBy("ids").agg(F.max("f").alias("f")), "phrase-known")

    def result(self) -> DataFrame:
        schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        if self.scored is None:
            return self.spark.createDataFrame([], schema)
        kept = self.scored.filter(self.above(F.col("score"), self.thresholds()))
        parts = kept.select("*", F.posexplode("ids").alias("pos", "id")).join(self.words.select("id", "word"), "id")
        named = parts.groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(
            F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("ws")
        ).withColumn("phrase", F.array_join("ws.word", " "))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= self.best)
        return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, best: int = BEST,
    prefixes: int = PREFIXES, block: int = VOCABULARY,
) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    bounded_batches(docs.sparkSession)  # texts and codes cross to the workers, and lie in the executor, a megabyte at a time
    slim = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("text"))
    miner = _Miner(slim, min_count, best, prefixes, block)
    for number in range(len(SLICES)):
        miner.grow(number)
    out = written(docs.sparkSession, miner.result(), "phrase-best")
    discard(miner.codes)
    return out


def report(docs: DataFrame) -> DataFrame:
    return mine(docs)

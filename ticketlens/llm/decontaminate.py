"""Benchmark decontamination (operator 9): one Aho-Corasick automaton over the test items.

Texts are lower-cased (A-Z) and reduced to words. A window is 13 consecutive
words of an item (all words of a shorter item). Each benchmark word gets one
code point, so a window is a short string of code points and a document becomes
a string with one code point per word (a reserved one for words no item uses):
the automaton of all windows runs over it once and reports every occurrence.
Lower-casing A-Z keeps lengths, so word spans are spans of the original text.

The benchmark is cut into blocks of at most ``block_bytes`` of UTF-8 text and
``block_words`` words; only one block at a time is sent to the executors, so the
broadcast, the code points and the automaton are bounded whatever the
benchmark's size. An item longer than a block is cut into parts that overlap by
all but one word of a window, so the parts hold the item's windows, no more and
no less. More than one block means one pass per block with the finds written to
the shared folder in between. A worker builds the automaton of a block once.

Cases: a null or empty document has no words and is clean; a null or empty item
has no windows; a null item id is listed as an empty string; repeated items or
documents are judged one by one (an item id counts once per document); empty
tables give empty results or clean documents; extra columns are kept by
``clean`` and never read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import process_cache, written

WINDOW = 13
#: A document is contaminated when at least one word in this many is hit.
CONTAMINATED_ONE_IN = 20
#: Benchmark text broadcast at once, in bytes and in words (a code point per different word, so far fewer than 0x10F7FF).
BLOCK_BYTES = 8 << 20
BLOCK_WORDS = 250_000

#: Fixed value: a word, over lower-cased UTF-8 bytes (all non-ASCII characters belong to words).
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "n_words long, hits array<struct<first: long, last: long>>, items array<string>, spans array<struct<start: long, end: long>>"


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8").lower()) if text else []


def _symbol(i: int) -> str:
    """The i-th usable code point (0 is kept for foreign words; no surrogates)."""
    return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)


def build_automaton(items: list[tuple[str, str | None]], window: int = WINDOW):
    """(vocabulary, automaton) of (item id, text) pairs; automaton None without windows."""
    import ahocorasick

    vocabulary: dict[bytes, str] = {}
    owners: dict[str, set[str]] = {}
    for item, text in items:
        ws = words_of(text)
        for w in ws:
            if w not in vocabulary:
                vocabulary[w] = _symbol(len(vocabulary))
        coded = "".join(map(vocabulary.__getitem__, ws))
        for i in range(max(1, len(coded) - window + 1) if coded else 0):
            owners.setdefault(coded[i : i + window], set()).add(item)
    if not owners:
        return vocabulary, None
    automaton = ahocorasick.Automaton()
    for pattern, who in owners.items():
        automaton.add_word(pattern, (len(pattern), tuple(sorted(who))))
    automaton.make_automaton()
    return vocabulary, automaton


def find(text: str | None, vocabulary: dict[bytes, str], automaton) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, maximal hit runs (first and last word), sorted item ids."""
    ws = words_of(text)
    if automaton is None or not ws:
        return len(ws), [], []
    code = vocabulary.get
    runs: list[tuple[int, int]] = []
    who: set[str] = set()
    for last, (size, items) in automaton.iter("".join([code(w, "\0") for w in ws])):
        who.update(items)
        runs.append((last - size + 1, last))
    return len(ws), merged(runs), sorted(who)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of runs as maximal runs (touching runs become one)."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def spans_of(text: str | None, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Start and end, in code points of the original text, of runs of words."""
    if not runs:
        return []
    raw = text.encode("utf-8")
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    out, done, chars = [], 0, 0
    for first, last in runs:
        edge = []
        for byte in (at[first][0], at[last][1]):
            chars += len(raw[done:byte].decode("utf-8"))
            done = byte
            edge.append(chars)
        out.append((edge[0], edge[1]))
    return out


def _scanner(shared, window: int) -> object:
    """A pandas UDF (text, hits so far, items so far) -> found, for one broadcast block."""
    block_id = uuid.uuid4().hex

    @F.pandas_udf(FOUND)
    def scan(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        built = process_cache("automaton")
        if block_id not in built:
            built.clear()  # one block at a time
            built[block_id] = build_automaton(shared.value, window)
        vocabulary, automaton = built[block_id]
        for texts, before, known in parts:
            rows = []
            for text, runs, items in zip(texts, before, known):
                n, new, who = find(text, vocabulary, automaton)
                if runs is not None and len(runs):
                    new = merged(new + [(r["first"], r["last"]) for r in runs])
                if items is not None and len(items):
                    who = sorted({*who, *items})
                rows.append((n, new, who, spans_of(text, new)))
            yield pd.DataFrame(
                {
                    "n_words": [r[0] for r in rows],
                    "hits": [[{"first": a, "last": b} for a, b in r[1]] for r in rows],
                    "items": [r[2] for r in rows],
                    "spans": [[{"start": a, "end": b} for a, b in r[3]] for r in rows],
                }
            )

    return scan


def _parts(text: str | None, window: int, most_bytes: int, most_words: int) -> Iterator[tuple[str | None, int, int]]:
    """(text, bytes, words) of an item, or of its overlapping parts: together they hold its windows, each at least once."""
    ws = words_of(text)
    # An item within a block stays as it is; its text is what is broadcast.
    size = len(text.encode("utf-8")) if text else 0
    if len(ws) <= max(most_words, window) and size <= most_bytes:
        yield text, size, len(ws)
        return
    first = 0
    while True:
        # At least one whole window, then as many words as the block takes.
        stop, used = first, 0
        while stop < len(ws) and (stop - first < window or (stop - first < most_words and used + len(ws[stop]) + 1 <= most_bytes)):
            used += len(ws[stop]) + 1
            stop += 1
        # Words are whole runs of bytes between ASCII ones, so they decode.
        yield b" ".join(ws[first:stop]).decode("utf-8"), used, stop - first
        if stop >= len(ws):
            return
        first = stop - window + 1


def _blocks(
    benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int, block_words: int
) -> Iterator[list[tuple[str, str | None]]]:
    """The items, or parts of them, in blocks within both bounds (a single window may exceed them alone)."""
    rows = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").alias("t")
    )
    block, size, count = [], 0, 0
    for r in rows.toLocalIterator():
        for part, weight, n in _parts(r["t"], window, block_bytes, block_words):
            if block and (size + weight > block_bytes or count + n > block_words):
                yield block
                block, size, count = [], 0, 0
            block.append((r["i"], part))
            size, count = size + weight, count + n
    yield block


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, str]:
    """``docs`` plus one struct column of finds (its name is returned): n_words, hits, items, spans."""
    spark, name = docs.sparkSession, f"found_{uuid.uuid4().hex[:8]}"
    out = docs
    for i, block in enumerate(_blocks(benchmark, item_id, item_text, window, block_bytes, block_words)):
        udf = _scanner(spark.sparkContext.broadcast(block), window)
        if i == 0:
            hits = F.lit(None).cast("array<struct<first: long, last: long>>")
            items = F.lit(None).cast("array<string>")
        else:
            out = written(spark, out, "decontaminate")
            hits, items = F.col(f"{name}.hits"), F.col(f"{name}.items")
        found = udf(F.col(f"`{text}`"), hits, items)
        out = out.select(*[F.col(f"`{c}`") for c in docs.columns], found.alias(name))
    return out, name


def n_hit(found: Column) -> Column:
    """Hit words of a find."""
    return F.aggregate(found["hits"], F.lit(0).cast("long"), lambda acc, r: acc + r["last"] - r["first"] + 1)


def contaminated(found: Column) -> Column:
    hit = n_hit(found)
    return (hit > 0) & (hit * CONTAMINATED_ONE_IN >= found["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    found, name = scan(docs, benchmark, text)
    return found.filter(~contaminated(F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, hit words, items found, verdict."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found, name = scan(slim, benchmark)
    f = F.col(name)
    return found.select(
        "doc_id",
        f["n_words"].alias("n_words"),
        n_hit(f).alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(f["items"]), ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(f).alias("contaminated"),
    )

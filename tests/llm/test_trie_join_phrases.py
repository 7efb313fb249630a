"""Operators 11 to 13 against brute force, on hostile rows, hot groups and small blocks."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import collocations, jaccard_join, prefix_trie

# --- 11: prefix trie ------------------------------------------------------------------------


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(node))))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
            sum(len(x) == len(node) + 1 for x in under), len(leaves),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(5)
    rows = []
    for c in range(260):
        same = c % 3 == 0  # a third of the conversations is the same
        for t in range(4 if same else rng.randint(1, 5)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"same {t}" if same else rng.choice("abc") * rng.randint(0, 3)))
    rows += [
        (None, 0, "user", "of nobody"), (300, None, "user", "first"), (300, 1, None, None), (300, 1, "user", "tie"), (300, 1, "user", "tie 2"),
        (301, 0, "user", "😀é"), (301, 0, "user", "😀é"), (-5, 0, "user", "same 0"), (-5, 1, "assistant", "x" * 5000), (512, 0, "user", ""),
        (1711, 3, "user", "no head"), (10**15 + 1, 0, "a", "b:c"), (10**15 + 2, 0, "a:b", "c"),
    ]
    return rows


@pytest.mark.parametrize("block_turns,broadcast_nodes", [(250_000, 500_000), (20, 0)])
def test_trie_equals_brute_force(spark, block_turns, broadcast_nodes):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "'x' AS id", "'x' AS n", "1 AS digest", "2 AS chars", "3 AS key", "4 AS depth", "5 AS at")
    got = prefix_trie.build(prefix_trie.rebuild(df), block_turns, broadcast_nodes).collect()
    cols = ("first_id", "depth", "parent_first", "n_convs", "n_children", "n_leaves", "saved", "ends")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == trie_by_hand(rows)


def test_trie_node_turns_and_empty_table(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    nodes = prefix_trie.build(prefix_trie.rebuild(df))
    turns = prefix_trie.node_turns(df, nodes).collect()
    assert len(turns) == nodes.count() - 1
    # Conversation -5 begins like the common one.
    common = {(r["first_id"], r["depth"]): r["text"] for r in turns if r["text"].startswith("same")}
    assert common.items() >= {(-5 if t == 0 else 0, t + 1): f"same {t}" for t in range(4)}.items()
    empty = prefix_trie.report(df.limit(0))
    assert empty.count() == 0 and empty.columns[0] == "conv_id"


def test_range_minima_search():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 64, 300):
        gaps = rng.integers(0, 5, n)
        table = prefix_trie.RangeMinima(gaps)
        row = np.repeat(np.arange(n + 1), 6)
        depth = np.tile(np.arange(6), n + 1)
        left, right = table.left(row, depth), table.right(row, depth)
        for i, d, a, b in zip(row, depth, left, right):
            while i - 1 >= a:
                i -= 1
                assert gaps[i] >= d
            assert a == 0 or gaps[a - 1] < d
            assert b == n or gaps[b] < d


# --- 12: Jaccard join -----------------------------------------------------------------------


def classes_by_hand(rows, words=5, percent=80):
    sets = []
    for _, text in rows:
        ws = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set())
    boss = list(range(len(rows)))

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            boss[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[find(i)] = min(d, lowest.get(find(i), d))
    return sorted(((d, len(s), lowest.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(rng, words, share):
    return [f"n{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words]


def near_rows():
    """Exact and near copies, a crowd of mutually unlike edits of one text, a passage in a third of all rows, tiny texts."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage, base, crowd = fresh(60), fresh(150), fresh(200)
    texts = [fresh(rng.randint(1, 300)) for _ in range(60)]
    texts += [fresh(20) + passage + fresh(rng.randint(5, 60)) for _ in range(50)]
    texts += [edited(rng, base, 0.01) for _ in range(25)] + [base] * 5
    texts += [edited(rng, crowd, rng.choice((0.02, 0.06))) for _ in range(40)]
    texts += [["a"], ["a"], ["a", "b"], ["A", "B"], fresh(4), passage, passage[:-5]]
    texts += [t + ["tail"] for t in texts[:20]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("pair_sets,broadcast_rows", [(24, 200_000), (2, 0)])
def test_join_equals_brute_force(spark, make_docs, hostile_rows, pair_sets, broadcast_rows):
    rows = near_rows() + [(1000 + d if d is not None else None, t) for d, t in hostile_rows]
    found, links = jaccard_join.near_duplicates(make_docs(rows), pair_sets=pair_sets, broadcast_rows=broadcast_rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == classes_by_hand(rows)
    assert links.count() > 30


def test_join_other_thresholds_and_empty(spark, make_docs, empty_docs):
    rows = near_rows()[:120]
    found, _ = jaccard_join.near_duplicates(make_docs(rows), words=2, percent=50)
    assert sorted((tuple(r) for r in found.collect()), key=str) == classes_by_hand(rows, 2, 50)
    assert jaccard_join.report(empty_docs).count() == 0


def test_similar_sets_share_a_signature_and_pass_the_cells():
    rng = np.random.default_rng(1)
    for size in [*range(1, 140), 200, 333, 800, 3000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            other = int(rng.integers(-(-80 * size // 100), size * 5 // 4 + 1))
            common = -(-4 * (size + other) // 9)
            if common > min(size, other):
                continue
            b = np.unique(np.concatenate([rng.choice(a, common, replace=False), rng.integers(0, 2**63, other - common, dtype=np.uint64)]))
            for whole in (False, True):
                assert len(np.intersect1d(jaccard_join.signatures(a, whole=whole)[0], jaccard_join.signatures(b, whole=whole)[0]))
            assert jaccard_join._apart(jaccard_join._cells(a), jaccard_join._cells(b)) <= size + other - 2 * common


def test_similar_sets_share_a_signature_of_groups_of_three():
    rng = np.random.default_rng(2)
    for size in [*range(20, 140, 3), 200, 800, 3000, 9000]:
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        common = -(-8 * size // 9)
        b = np.concatenate([a[:common], rng.integers(0, 2**63, size - common, dtype=np.uint64)])
        for whole in (False, True):
            assert len(np.intersect1d(*(jaccard_join.signatures(x, whole=whole, subsets_from=16)[0] for x in (a, b))))


def test_unlike_edits_of_one_text_share_few_signatures():
    """A signature speaks for several elements: sets with half of their elements in common share hardly any."""
    rng = np.random.default_rng(3)
    base, met = rng.integers(0, 2**63, 400, dtype=np.uint64), 0
    edits = [np.concatenate([rng.choice(base, 270, replace=False), rng.integers(0, 2**63, 130, dtype=np.uint64)]) for _ in range(30)]
    signed = [jaccard_join.signatures(e)[0] for e in edits]
    for x, y in itertools.combinations(signed, 2):
        met += len(np.intersect1d(x, y))
    assert met < 8 * 435  # eight a pair; three partitions of about one element gave 13
    assert len(signed[0]) < 400


def test_signatures_of_the_same_sets_are_kept_once(spark, make_docs):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, "other words only here you see")]
    docs = make_docs(rows).select(F.col("doc_id").alias("doc"), "text")
    join = jaccard_join._Join(docs, 5, 80, 24, 200_000)
    assert join.rows.count() == 2 and join.rows.select("sign").distinct().count() == 1


def test_crowd_of_unlike_edits_is_not_expanded(spark, make_docs, monkeypatch):
    """Edits of one text, most of them unlike one another: far fewer pairs are compared than there are."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.choice((0.01, 0.03, 0.06, 0.1))))) for i in range(160)]
    kept, run = [], jaccard_join._Join.run
    monkeypatch.setattr(jaccard_join._Join, "run", lambda join: (kept.append(join), run(join)))
    found, _ = jaccard_join.near_duplicates(make_docs(rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == classes_by_hand(rows)
    assert kept[0].tested.count() < 160 * 159 // 2 // 4


# --- 13: collocations -----------------------------------------------------------------------


def phrases_by_hand(rows, least, best):
    grams, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            for m in range(1, 6):
                grams[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in grams.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q[i:j] for q, a in cands.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
                  if j - i < len(q) and a >= f[q[i:j]]}
        scored = []
        for p, a in cands.items():
            if p not in inside:
                s, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["É", "ß", "😀", "\x1c", "X-Y"]
    fixed = ["new york city", "a a a a a", "to be or not to", "W1 w2"]
    rows = []
    for i in range(400):
        pieces = []
        for _ in range(rng.randint(0, 6)):
            ws = rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 9))
            if rng.random() < 0.5:
                ws.insert(rng.randint(0, len(ws)), rng.choice(fixed))
            pieces.append(rng.choice([" ", "  ", "\t"]).join(ws))
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice([".", ", ", "\n", "\r\n", "!?"]).join(pieces)))
    return rows + [("en", None), ("en", ""), (None, " \t\n"), ("fr", "once only"), ("de", "new york " * 3000)] + rows[:30]


@pytest.mark.parametrize("least,best,prefixes,block", [(8, 2000, 200_000, 500_000), (8, 15, 40, 17), (30, 3, 200_000, 500_000)])
def test_phrases_equal_brute_force(spark, least, best, prefixes, block):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "'x' AS n", "1 AS id", "2 AS f", "'y' AS word")
    got = collocations.mine(df, min_count=least, best=best, prefixes=prefixes, block=block)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, least, best)


def test_phrases_of_nothing(spark):
    schema = "lang string, text string"
    assert collocations.mine(spark.createDataFrame([], schema)).count() == 0
    assert collocations.mine(spark.createDataFrame([("en", "too few words")], schema)).count() == 0


def test_phrases_cross_to_the_workers_in_small_batches(spark, make_docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (key, "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set(key, str(64 << 20))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        collocations.mine(make_docs([(1, "a b. a b")]), min_count=2)
        assert int(spark.conf.get(key)) <= 1 << 20 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_partial_counts_travel_packed():
    """Counts of phrases met once need less than half of the 32 bytes of a plain row, and come back as they were."""
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 10**9, 5000))
    left, right = (rng.integers(0, 60_000, len(keys)).astype(np.int32) for _ in range(2))
    counts = np.ones(len(keys), dtype=np.int64)
    counts[::50] = 10**12
    wide = np.maximum(left, 59_999).astype(np.int32)
    found = (keys, counts, left, np.where(counts > 1, wide, left).astype(np.int32), right, right)
    packed = collocations._pack(found)
    assert len(packed) < 14 * len(keys)
    for was, now in zip(found, collocations._unpack(len(keys), packed)):
        assert was.dtype == now.dtype and (was == now).all()

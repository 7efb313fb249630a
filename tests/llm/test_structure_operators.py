"""Suffix dedup, sharding, SimHash, chat format, extraction, pipeline: brute force and defined edge cases."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from ticketlens.llm import chat_format, components, sharding, simhash, suffix_dedup, wrapper

from test_text_operators import contamination_brute, counts_of, lines_brute

SF = "/root/testdata/sf0.001"


def given(table, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{table}.parquet'").fetchall()


# --- 3 ------------------------------------------------------------------------------


def removed_brute(rows):
    """Per row: bytes, removed, spans, digest; null ids are larger than all."""
    least = {}
    texts = [(suffix_dedup.NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    for d, raw in texts:
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, raw in texts:
        spans = []
        for i in range(len(raw) - 49):
            if least[raw[i : i + 50]] < d:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 50
                else:
                    spans.append([i, i + 50])
        gone = {k for a, b in spans for k in range(a, b)}
        kept = bytes(c for k, c in enumerate(raw) if k not in gone)
        out.append((None if d == suffix_dedup.NO_ID else d, len(raw), len(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def test_index_reads_the_smallest_document():
    rnd = random.Random(2)
    for _ in range(25):
        base = bytes(rnd.choice(b"ab") for _ in range(200))
        strings, ids = [], []
        for _ in range(rnd.randint(1, 40)):
            at = rnd.randint(0, 120)
            s = bytearray(base[at : at + rnd.randint(50, 80)])
            if rnd.random() < 0.5:
                s[rnd.randrange(len(s))] = rnd.choice(b"abc\x00\xff")
            strings.append(bytes(s))
            ids.append(rnd.randint(0, 9))
        least = {}
        for s, d in zip(strings, ids):
            for i in range(len(s) - 49):
                least[s[i : i + 50]] = min(least.get(s[i : i + 50], d), d)
        got = suffix_dedup.RunLengthIndex(strings, ids).smallest(strings)
        assert [g.tolist() for g in got] == [[least[s[i : i + 50]] for i in range(len(s) - 49)] for s in strings]


def suffix_rows():
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    rows = [(1, passage), (2, passage), (3, passage[:49]), (4, passage[3:53]), (5, None), (6, ""), (7, "x" * 500), (8, "x" * 60)]
    rows += [(None, passage), (9, passage + "!"), (9, passage + "!"), (10, "xy" * 300), (11, "yx" * 300)]
    for i in range(20, 60):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 90))]
        if rnd.random() < 0.6:
            text[2:2] = passage.split()[rnd.randint(0, 10) : rnd.randint(15, 40)]
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("setting", ["usual", "small blocks", "windows grouped", "shuffled", "sliced"])
def test_suffix_dedup_equals_brute_force(make_docs, monkeypatch, setting):
    if setting == "small blocks":
        monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", 2_000)
    if setting == "windows grouped":
        monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", 100)
    if setting == "shuffled":
        monkeypatch.setattr(suffix_dedup, "BROADCAST_GRAMS", -1)
    if setting == "sliced":
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 64)
        monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 300)
    rows = suffix_rows()
    got = sorted(map(tuple, suffix_dedup.report(make_docs(rows)).collect()), key=repr)
    assert got == sorted(removed_brute(rows), key=repr)


def test_suffix_dedup_answers_hot_grams_where_they_are(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_COPIES", 2)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 200)
    rows = suffix_rows()
    got = sorted(map(tuple, suffix_dedup.report(make_docs(rows)).collect()), key=repr)
    assert got == sorted(removed_brute(rows), key=repr)


def test_suffix_dedup_ranges_grow_with_the_text_and_hot_grams_do_not(make_docs, monkeypatch):
    import numpy as np
    import pandas as pd

    docs = suffix_dedup.keyed(make_docs([(i, "é" * 500) for i in range(100)]))
    assert suffix_dedup._ranges(docs) == suffix_dedup.LEAST_RANGES
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 1000)
    assert suffix_dedup._ranges(docs) == 100
    passage = "a line that stands in every document of this table, word for word"
    ids = list(range(500))
    texts = pd.DataFrame({"did": ids[::-1], "th": [0] * 500, "text": [f"{passage} {i * 7919 ** 9} {i}" for i in ids]})
    sent = pd.concat(suffix_dedup._send_grams(list(range(24)))([texts]))
    counts = Counter(g for part in sent[~sent["known"]]["grams"] for g in np.frombuffer(part, dtype=np.uint64).tolist())
    assert max(counts.values()) <= suffix_dedup.HOT_COPIES
    answered = pd.concat(suffix_dedup._answer_grams([sent]))
    assert set(answered["did"]) == set(ids)


def test_suffix_dedup_answers_are_a_row_per_bucket_and_then_a_row_per_document(monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 4_000)  # several packs, and documents that lie in two
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 700)
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    shared = [" ".join(rnd.choice(words) for _ in range(30)) for _ in range(20)]
    rows = [(rnd.choice([-1, 1]) * i * 10**15, i % 2, f"{rnd.choice(shared)} {i * 7919 ** 9} {rnd.choice(shared)}") for i in range(200)]
    texts = pd.DataFrame(rows, columns=["did", "th", "text"])
    owners = defaultdict(set)
    for did, th, text in rows:
        for part in suffix_dedup.slices([text]):
            for g in suffix_dedup.stretches_of([part])[3].tolist():
                owners[g].add((did, th))
    want = defaultdict(set)
    for g, docs in owners.items():
        for key in docs if len({d for d, _ in docs}) > 1 else ():
            want[key].add(g)
    sent = pd.concat(suffix_dedup._send_grams(list(range(24)))([texts.iloc[:90], texts.iloc[90:]]))
    assert len(sent) > 2 * 24
    answers = pd.concat(frame for _, some in sent.groupby("range") for frame in suffix_dedup._send_answers(list(range(3)))([some]))
    assert len(answers) <= 24 * 3
    found = [(r.did, r.th, r.grams) for _, some in answers.groupby("bucket") for f in suffix_dedup._gather_answers([some]) for r in f.itertuples()]
    assert len(found) == len(want)
    assert {(d, t): set(np.frombuffer(g, dtype=np.uint64).tolist()) for d, t, g in found} == want


def test_suffix_dedup_stretches_equal_a_window_by_window_search():
    import numpy as np

    rnd = random.Random(3)
    parts = [(i, 7 * i, bytes(rnd.choice(b"ab ") for _ in range(rnd.randint(50, 200)))) for i in range(40)]
    doc, offset, count, gram, place, start, blob = suffix_dedup.stretches_of(parts)
    hashes = suffix_dedup._gram_hashes(np.frombuffer(blob, dtype=np.uint8)).tolist()
    want, at = [], 0
    for i, before, raw in parts:
        named = [min(range(at + w, at + w + 31), key=lambda p: (hashes[p] >> 26, p)) for w in range(len(raw) - 49)]
        first = [w for w in range(len(named)) if not w or named[w] != named[w - 1]]
        want += [(i, before + w, n - w, named[w] - at - w, at + w) for w, n in zip(first, first[1:] + [len(named)])]
        at += len(raw)
    assert list(zip(doc.tolist(), offset.tolist(), count.tolist(), place.tolist(), start.tolist())) == want
    assert int(gram.max()) < 1 << 48


def test_suffix_dedup_given_documents_and_edges(spark, make_docs, hostile_rows, empty_docs):
    got = sorted(map(tuple, entry.queries()["op3_suffix_array_dedup"](spark, SF).collect()))
    assert got == sorted(removed_brute(given("documents", "doc_id, text")))
    assert suffix_dedup.report(make_docs(hostile_rows)).count() == len(hostile_rows)
    assert suffix_dedup.report(empty_docs).count() == 0
    spans = {r["doc_id"]: r for r in suffix_dedup.dedup(make_docs([(1, "q" * 80), (2, "é" + "q" * 80 + "z")])).collect()}
    assert [tuple(s) for s in spans[2]["spans"]] == [(2, 82)] and bytes(spans[2]["kept"]) == "éz".encode()


# --- 6 ------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_are_contiguous_balanced_and_gapless(make_docs, hostile_rows, shards):
    rows = [r[:2] for r in hostile_rows if r[0] not in (9, 12)] + [(1000 + i, "y" * (i % 37)) for i in range(400)]
    out = sharding.shard_by_bytes(sharding.sized(make_docs(rows)), shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows
    )
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["shard"], r["slot"])):
        by[r["shard"]].append(r)
    assert all([r["slot"] for r in rs] == list(range(len(rs))) for rs in by.values())
    order = [(-1 if r["doc_id"] is None else r["doc_id"]) for s in sorted(by) for r in by[s]]
    assert order == sorted(order)
    sizes = [sum(r["size"] for r in by[s]) for s in range(shards)]
    largest = max(r["size"] for r in out)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_sharding_edges(make_docs, hostile_rows, empty_docs):
    assert sharding.shard_by_bytes(sharding.sized(make_docs(hostile_rows)), 24).count() == len(hostile_rows)
    assert sharding.shard_by_bytes(sharding.sized(empty_docs), 24).count() == 0
    named = sharding.sized(make_docs([(i, "z" * i) for i in range(30)])).selectExpr("*", "doc_id AS part", "doc_id AS total", "1 AS shard")
    out = sharding.shard_by_bytes(named, 3).collect()
    assert all(r["part"] == r["total"] == r["doc_id"] for r in out) and {r["shard"] for r in out} == {0, 1, 2}


def test_sharding_query(spark):
    out = entry.queries()["op6_sharding"](spark, SF)
    assert out.count() == len(given("documents", "doc_id"))
    assert {r["law"] for r in out.collect()} == {"bytes"} and dict(out.dtypes)["grown_shard"] == "int"


# --- 7 ------------------------------------------------------------------------------


def fingerprint_brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes_brute(prints):
    values = sorted(set(prints))
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    return {v: root(v) for v in values}


def near_brute(rows):
    prints = [fingerprint_brute(t) for _, t in rows]
    group = classes_brute(prints)
    lowest = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            lowest[group[p]] = min(lowest.get(group[p], d), d)
    return [(d, format(p, "016x"), lowest.get(group[p])) for (d, _), p in zip(rows, prints)]


def test_simhash_query_equals_brute_force(spark):
    rows = given("documents", "doc_id, text")
    got = entry.queries()["op7_simhash_near_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(near_brute(rows))


@pytest.mark.parametrize("pair_cell_points", [0, 3, 1000])
def test_links_connect_what_is_near(spark, pair_cell_points):
    rnd = random.Random(9)
    prints = {0, 2**64 - 1, 1 << 63}
    for _ in range(12):
        p = rnd.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            if rnd.random() < 0.7:
                p ^= 1 << rnd.randrange(64)
            else:
                p ^= 7 << rnd.randrange(60)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = components.components(simhash.links(df, pair_cell_points)).collect()
    got = defaultdict(set)
    for r in found:
        got[r["root"]].add(r["node"] % 2**64)
    want = defaultdict(set)
    for v, g in classes_brute(prints).items():
        want[g].add(v)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


@pytest.mark.parametrize("broadcast_cells", [100_000, 0])
def test_exploded_points_are_not_broadcast(spark, tmp_path, monkeypatch, broadcast_cells):
    # Spark reckons the exploded points as small as the points: here smaller than the table of the cells.
    monkeypatch.setattr(simhash, "BROADCAST_CELLS", broadcast_cells, raising=False)
    rnd = random.Random(12)
    prints = [p ^ e for p in (rnd.getrandbits(63) for _ in range(400)) for e in (0, 1, 2, 4)]
    spark.createDataFrame([(p,) for p in prints], "fp long").write.parquet(str(tmp_path / "prints"))
    plans = {}

    def watched(session, df, name, write=simhash.written):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(session, df, name)

    monkeypatch.setattr(simhash, "written", watched)
    links = simhash.links(spark.read.parquet(str(tmp_path / "prints")))
    plans["links"] = links._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plans["simhash-shared"] and "BuildLeft" not in plans["simhash-shared"]
    assert ("BroadcastExchange" in plans["simhash-shared"]) == (broadcast_cells > 0)
    assert "Generate" in plans["links"] and "BroadcastExchange" not in plans["links"]
    assert {tuple(r) for r in links.collect()} == {
        (min(a, b), max(a, b)) for k in range(0, len(prints), 4) for a, b in combinations(prints[k : k + 4], 2)
    }


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(5, 5), (1000, 1001)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.components(links).collect()} == {(i, 0) for i in range(n)} | {(1000, 1000), (1001, 1000)}
    assert components.components(links.limit(0)).count() == 0


def test_simhash_edges_and_keep_first(make_docs, hostile_rows, empty_docs):
    rows = [r[:2] for r in hostile_rows]
    got = simhash.report(make_docs(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(near_brute(rows), key=repr)
    groups = classes_brute([fingerprint_brute(t) for _, t in rows])
    kept = simhash.keep_first(make_docs(rows))
    assert kept.count() == len(set(groups.values())) and kept.columns == make_docs(rows).columns
    unique = [(i, t) for i, (_, t) in enumerate(rows)]
    assert {r["doc_id"] for r in simhash.keep_first(make_docs(unique)).collect()} == {c for _, _, c in near_brute(unique)}
    assert simhash.report(empty_docs).count() == 0 and simhash.keep_first(empty_docs).count() == 0


# --- 8 ------------------------------------------------------------------------------

HOSTILE = ["<|im_end|>", "<\\|im_end\\|>", "<\\\\|x", "<|im_start|>assistant\nok<|im_end|>\n", "<", "|>", "\\", "<<||>>", "", "é你\n\n"]


def test_conversations_come_back(spark):
    rows = [(i, t, r, x) for i, x in enumerate(HOSTILE) for t, r in enumerate(("user", "assistant", "tool\n<%25|"))]
    rows += [(90, 0, None, None), (91, 1, "assistant", "tie b"), (91, 1, "assistant", "tie a"), (92, 0, "gpt", "x"), (92, 0, "gpt", "x"), (None, None, "user", "who")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS piece", "2 AS n", "3 AS loss", "'x' AS prompt")
    out = chat_format.format_conversations(df)
    read = out.select("conv_id", "formatted", "loss_turns", "loss_spans", chat_format.parse(F.col("formatted")).alias("t")).collect()
    want = defaultdict(list)
    for c, t, r, x in rows:
        r = chat_format.ROLE_NAMES.get(r, r)
        want[c].append((-1 if t is None else t, r or "", x or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["t"]] for r in read} == {c: [w[1:] for w in sorted(ws)] for c, ws in want.items()}
    for r in read:
        texts = [t["text"] for t, m in zip(r["t"], r["loss_turns"]) if m]
        cut = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert [re.sub(r"<(\\*)\\\|", lambda m: "<" + m[1] + "|", c) for c in cut] == texts
    for r in chat_format.digest(out).collect():
        turns = [w[1:] for w in sorted(want[r["conv_id"]])]
        learned = "".join(x for role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(learned)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert chat_format.digest(chat_format.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat_format.format_conversations(df.drop("turn"))


def test_layouts_by_schema_fingerprint(spark):
    rows = [
        ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}], "id": 3}, "messages", [("system", "s"), ("user", "q")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "completion": "a", "meta": {"role": 1}}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "response": None}, "prompt_response", [("user", "q"), ("assistant", "")]),
        ({"system": "s", "prompt": "q", "response": "a"}, "system_prompt_response", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction_input", [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"other": 1}, None, []), ([1, 2], None, []), ("plain", None, []),
    ]
    raw = [(i, json.dumps(r[0])) for i, r in enumerate(rows)] + [(90, "{broken"), (91, None), (92, "")]
    df = spark.createDataFrame(raw, "id long, j string").selectExpr("*", "1 AS prompt")
    out = {r["id"]: r for r in chat_format.turns_from_json(df, "j").collect()}
    for i, (_, layout, turns) in enumerate(rows):
        assert out[i]["layout"] == layout and [tuple(t) for t in out[i]["turns"]] == turns, i
    assert all(out[i]["layout"] is None and out[i]["turns"] == [] for i in (90, 91, 92))
    tables = [
        ("messages array<struct<role: string, content: string>>", [[("human", "q"), (None, "a")]], [("user", "q"), ("", "a")]),
        ("conversations array<struct<value: string, from: string>>", [[("q", "human"), (None, "gpt")]], [("user", "q"), ("assistant", "")]),
        ("prompt string, completion string, extra int", ["q", "a", 1], [("user", "q"), ("assistant", "a")]),
        ("output string, instruction string, input string", ["done", "do", None], [("user", "do"), ("assistant", "done")]),
        ("messages array<struct<role: string, content: string>>", [None], None),
        ("role string, content string, position int", ["bot", "a", 7], [("assistant", "a")]),
        ("speaker string, utterance string, index long", ["human", "q", None], [("user", "q")]),
        ("role string, text string, turn long", ["tool", "t", 1], [("tool", "t")]),
        ("role string, text string, turn long, prompt string, content int", ["tool", "t", 1, "p", 2], [("tool", "t")]),
    ]
    made = [spark.createDataFrame([(i, *row)], f"conv_id long, {schema}") for i, (schema, row, _) in enumerate(tables)]
    formatted = chat_format.format_conversations(*made).select("conv_id", chat_format.parse(F.col("formatted")).alias("t"))
    read = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in formatted.collect()}
    assert read == {i: turns for i, (_, _, turns) in enumerate(tables) if turns is not None}
    for schema in ("other int", "role string, text string", "prompt string"):
        with pytest.raises(ValueError):
            chat_format.format_conversations(spark.createDataFrame([], f"conv_id long, {schema}"))
    typed = spark.createDataFrame([], "prompt string, completion string, zzz int").schema
    assert chat_format.FINGERPRINTS[chat_format.table_fingerprint(typed)].name == "prompt_completion"


# --- 10 -----------------------------------------------------------------------------


def page(body, notice="Subscribe now, readers!"):
    return (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><a>x</a></nav>"
        f'<div class="ad">buy</div><article><h2>Head &amp; tail</h2><div><p>{notice}</p></div>{body}<div class="comments"><p>first!</p></div></article>'
        f"<aside>side</aside><form>f<input></form><footer>&copy; me</footer><script>var a='</p>'</script></body></html>"
    )


def test_template_of_a_host_is_left_out(spark):
    rows = [(i, f"http://a.example/{i}", page(f"<p>Text {i} with <b>bo</b>ld\n and&nbsp;space<br>end<p>More {i * 7}")) for i in range(8)]
    rows += [(100, "http://lone.example/1", page("<p>alone</p>")), (101, None, None), (102, "", ""), (103, "http://b.example", "<p>no <i>main")]
    rows += [(200 + i, "http://copies.example/", page("<p>same</p>")) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "'r' AS reference", "1 AS blocks")
    got = {r["page_id"]: r for r in wrapper.extract(df).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i]["text"] == f"Text {i} with bold and space end More {i * 7}"
    assert got[100]["text"] == "Head & tail Subscribe now, readers! alone"
    assert got[200]["text"] == "Head & tail Subscribe now, readers! same"
    assert got[101]["text"] == got[102]["text"] == "" and got[101]["n_chars"] == 0
    assert got[103]["text"] == "no main"
    assert wrapper.extract(df.limit(0)).count() == 0


def test_pages_without_html_are_no_reference(spark):
    rows = [(i, "http://a.example/", page(f"<p>Text {i}</p>")) for i in range(8)]
    rows += [(-1, "http://a.example/", None), (-2, "http://a.example/", "")]
    rows += [(i, "http://b.example/", "") for i in range(20, 60)]
    rows += [(None if i == 13 else i, "http://b.example/", page(f"<p>Text {i}{'x' * (i == 15)}</p>")) for i in range(10, 16)]
    got = sorted(wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r["text"])
    want = [f"Text {i}" for i in range(15)] + ["Text 15x"]
    assert [r["text"] for r in got if r["text"]] == sorted(w for w in want if w not in ("Text 8", "Text 9"))
    assert len(got) == len(rows)


def test_each_layout_of_a_host_has_its_template(spark):
    def other(i):
        return f'<html><body class="b"><main><section class="s"><p>Read our offers</p></section><p>Other {i}</p></main></body></html>'

    rows = [(i, "http://a.example/", page(f"<p>Text {i}</p>") if i % 2 else other(i)) for i in range(20)]
    rows += [(30 + i, "http://few.example/", page(f"<p>Text {i}</p>") if i < 6 else other(i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"Text {i}" if i % 2 else f"Other {i}") for i in range(20))
    # A layout on fewer pages than MIN_PAGES proves no template.
    assert [got[30 + i] for i in range(8)] == [f"Text {i}" if i < 6 else f"Read our offers Other {i}" for i in range(8)]


def test_extraction_query_keeps_whole_articles(spark):
    import html

    got = {r["page_id"]: r for r in entry.queries()["op10_html_extraction"](spark, SF).collect()}
    for i, url, source in given("pages", "page_id, url, html"):
        article = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want) and got[i]["url"] == url


@pytest.mark.parametrize("source", ['<a "' * 20_000, "<p>" * 20_000, "<b><div>" * 3_000, "<!--" * 20_000, "<script>x" * 9_000, "<" * 50_000, "</p>" * 20_000])
def test_hostile_markup_is_read_in_linear_time(source):
    import time

    reference, _, _ = wrapper.parse(page("<p>x</p>"))
    t = time.perf_counter()
    wrapper.blocks(source, reference)
    assert time.perf_counter() - t < 5


@pytest.mark.parametrize(
    "middle, kept",
    [
        ('<svg class="icon"/>', ""), ("<svg/><svg><title>t</title></svg>", ""), ("<math/>", ""), ("<svg><g><svg/></g><text>t</text></svg>", ""),
        ("<svg><svg>a</svg>b</svg>", ""), ("<SVG a='>'>x</SVG >", ""), ("<noscript>n</noscript>", ""), ("<svg>", ""), ("<object>", ""),
        ("<noscript>seen ", "seen "), ("<select>", ""), ("<svg>in <svg>out</svg>", "in "), ("<svgs>in</svgs>", "in"),
    ],
)
def test_raw_elements_take_only_themselves(middle, kept):
    texts = [t for t, _ in wrapper.blocks(f"<article><p>One {middle}two</p><p>three</p></article>", None)]
    assert " ".join(texts) == f"One {kept}two three"


@pytest.mark.parametrize("source", ["<svg>" * 20_000, "<svg " * 20_000, "<svg/>" * 20_000, "<object><noscript>" * 9_000, "<svg>" * 9_000 + "</svg>" * 9_000])
def test_hostile_raw_elements_are_read_in_linear_time(source):
    test_hostile_markup_is_read_in_linear_time(source)


@pytest.mark.parametrize(
    "wrapped",
    [
        '<div class="content with-sidebar">{}</div>', '<div class="no-sidebar"><div id="site-menu-on">{}</div></div>',
        '<div class="site navbar-fixed">{}<div class="sidebar">x</div></div>', '<div class="has-ads">{}<div class="ad">x</div></div>',
        '<main><h1></h1><div class="content with-sidebar">{}</div></main>', '<div class="widget">{}</div>',
        '{}<div class="related"><article>x</article></div>', '<div class="site no-sidebar">{}<div id="comments"><article>x</article></div></div>',
        '{}<nav><article>x</article></nav>', '<div role="main" class="with-sidebar">{}</div>',
    ],
)
def test_names_around_an_article_do_not_take_it_out(wrapped):
    source = wrapped.format("<article><p>Text</p><div class='share-bar'>y</div></article>")
    assert wrapper.blocks(f"<body>{source}</body>", None) == [("Text", -1)]


def test_unclosed_scripts_swallow_the_rest():
    assert wrapper.blocks("<p>One</p><script>x<p>two", None) == [("One", -1)]


def test_tree_matching_is_the_best_order_keeping_match():
    a = wrapper.parse("<div><p>1</p><p>2</p><ul><li>x</li></ul><p>4</p></div>")[0]
    b = wrapper.parse("<div><p>2</p><ul><li>y</li><li>x</li></ul><p>3</p><p>4</p></div>")[0]
    pairs = wrapper.match(a, b)
    equal = sorted((i, j) for i, (j, same) in pairs.items() if same and i)
    texts = lambda root: {n.index: n.text for n in walk(root)}
    ta, tb = texts(a), texts(b)
    assert [(ta[i], tb[j]) for i, j in equal if ta[i]] == [("2", "2"), ("x", "x"), ("4", "4")]


def best_weight(a, b):
    """Simple tree matching by its definition, over all pairs of nodes."""
    if a.label != b.label:
        return 0
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            w = best_weight(x, y)
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + w if w else 0)
    return (2 if a.text == b.text else 1) + table[-1][-1]


@pytest.mark.parametrize("cells", [1_000_000, 0])
def test_tree_matching_on_random_trees(monkeypatch, cells):
    import random

    monkeypatch.setattr(wrapper, "EXACT_CELLS", cells)
    rnd = random.Random(5)

    def tree(depth):
        inner = "".join(tree(depth - 1) for _ in range(rnd.randint(0, 4))) if depth else ""
        tag = rnd.choice(["div", "b", "ul"])
        return f"<{tag}>{rnd.choice(['', 'x', 'y', str(rnd.random())])}{inner}</{tag}>"

    for _ in range(300):
        a, b = (wrapper.parse(f"<div>{tree(3)}{tree(3)}</div>")[0] for _ in range(2))
        pairs = wrapper.match(a, b)
        na, nb = ({n.index: n for n in walk(r)} for r in (a, b))
        assert len({j for j, _ in pairs.values()}) == len(pairs)
        for i, (j, same) in pairs.items():  # labels agree, parents are matched too, order is kept
            assert na[i].label == nb[j].label and same == (na[i].text == nb[j].text)
            assert i == 0 or pairs[na[i].parent.index][0] == nb[j].parent.index
        for n in na.values():
            places = [pairs[c.index][0] for c in n.children if c.index in pairs]
            assert places == sorted(places)
        weight = sum(1 + same for _, same in pairs.values())
        assert weight == best_weight(a, b) if cells else weight <= best_weight(a, b)


def test_tree_matching_does_not_depend_on_the_size(monkeypatch):
    import random

    rnd = random.Random(11)

    def item(i):
        inner = rnd.choice(["", "<b>more</b>", f"<i>t{rnd.randint(0, 30)}</i>", f"<ul><li>t{rnd.randint(0, 30)}</li><li>x</li></ul>"])
        tag = rnd.choice(["div", "ol"])
        return f"<{tag}>{rnd.choice(['', 'x', f's{rnd.randint(0, 60)}', str(rnd.random())])}{inner}</{tag}>"

    for n in (3, 20, 60, 60):
        a, b = (wrapper.parse("<body>" + "".join(item(i) for i in range(n + rnd.randint(0, 9))))[0] for _ in range(2))
        found = []
        for cells in (10**9, 0):
            monkeypatch.setattr(wrapper, "EXACT_CELLS", cells)
            found.append(wrapper.match(a, b))
        assert found[0] == found[1]
        assert sum(1 + same for _, same in found[1].values()) == best_weight(a, b)


@pytest.mark.parametrize(
    "left,right",
    [
        (["<p>a{i}</p>"], ["<p>b{i}</p>"]), (["<li><a>t{i}</a>x</li>"], ["<li><a>t{j}</a>y</li>"]), (["<p>a{i}</p>"], ["<p>a{i}</p>"]),
        (["<div><i>{i}</i><b>q</b></div>", "<p>{i}</p>"], ["<p>{j}</p>", "<div><i>{j}</i></div>"]), (["<div>{i}"], ["<div>{j}"]),
    ],
)
def test_wide_pages_are_matched_in_near_linear_time(left, right):
    import time

    n = 50_000 if "</" in left[0] else 10_000  # the last pair of pages is deep instead of wide
    a, b = (
        wrapper.parse("<body>" + "".join(form[i % len(form)].format(i=i, j=i * 7919 % n) for i in range(n)))[0] for form in (left, right)
    )
    t = time.perf_counter()
    pairs = wrapper.match(a, b)
    assert time.perf_counter() - t < 15 and len(pairs) > 2
    if left == right:
        assert len(pairs) == n + 2 and all(same and i == j for i, (j, same) in pairs.items())


def walk(node):
    yield node
    for c in node.children:
        yield from walk(c)


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark):
    rows = given("documents", "doc_id, text, source")
    clean = {r["doc_id"] for r in entry.queries()["op2_quality_rules"](spark, SF).filter("kept").collect()}
    rows = [r for r in rows if r[0] in clean]
    assert all(counts_of(t)[0] >= 20 for _, t, _ in rows)
    texts = lines_brute(rows, 5)
    first = {d for d, _, c in near_brute(sorted(texts.items())) if d == c}
    bad = {r[0] for r in contamination_brute(sorted(texts.items()), given("benchmark", "item_id, text")) if r[5]}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == first - bad
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER_MODEL)
    assert all(r["token_ids"] == sp.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"]) for r in out)


def test_pipeline_stages_keep_their_contract(spark, make_docs, hostile_rows, empty_docs):
    for docs in (make_docs(hostile_rows), empty_docs):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count(), name
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == list(corpus_pipeline.COLUMNS), name
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5

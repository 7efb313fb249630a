"""SentencePiece, quality rules, line dedup, classifier, decontamination: brute force and defined edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
import sentencepiece

import __spark_entry__ as entry
from ticketlens import verify
from ticketlens.llm import classifier, decontaminate, line_dedup, quality_rules, sentencepieces
from ticketlens.llm.oracles import oracle_sql
from ticketlens.llm.queries import TOKENIZER_MODEL

SF = "/root/testdata/sf0.001"


def given(table, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{table}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_their_sql(spark, name):
    got = verify.run_spark(entry.queries()[name](spark, SF))
    want = verify.run_duck(verify.duck_connection(SF), oracle_sql()[name])
    res = verify.compare(got, want)
    assert res["schema_match"] and res["rows_match"]
    assert res["hash_match"], verify.diff_rows(got, want, 3)


# --- 1 ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.load(TOKENIZER_MODEL)


def test_encoder_equals_the_library(vocabulary):
    reference = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER_MODEL)
    rnd = random.Random(7)
    letters = "ab   \n\t▁éß你😀-=*#thing<>0x0A\x00\x7f"
    texts = [t for (t,) in given("documents", "text")]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["-" * 300, " " * 77, "a" * 3000, "<s></s><unk>", "includegraphics" * 9, "", " ", "\n"]
    encoder, decode = sentencepieces.Encoder(vocabulary), sentencepieces.decoder(vocabulary)
    got = encoder.encode(texts)
    assert [g.tolist() for g in got] == reference.encode(texts)
    assert [decode(g.tolist()) for g in got] == [reference.decode(g.tolist()) for g in got]


@pytest.mark.parametrize("few", [0, 10**9])
def test_batches_and_single_words_agree(vocabulary, monkeypatch, few):
    monkeypatch.setattr(sentencepieces, "FEW_WORDS", few)
    reference = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER_MODEL)
    texts = [t for (t,) in given("documents", "text")][:60] + ["=" * 700, "ab" * 333, "你" * 50]
    assert [g.tolist() for g in sentencepieces.Encoder(vocabulary).encode(texts)] == reference.encode(texts)


def test_a_long_run_is_encoded_in_linear_time(vocabulary):
    import time

    encoder = sentencepieces.Encoder(vocabulary)
    t = time.perf_counter()
    assert len(encoder.encode(["a" * 200_000])[0]) > 10_000
    assert time.perf_counter() - t < 20


def test_memory_starts_anew_without_changing_results(vocabulary, monkeypatch):
    texts = [t for (t,) in given("documents", "text")][:40]
    want = [g.tolist() for g in sentencepieces.Encoder(vocabulary).encode(texts)]
    monkeypatch.setattr(sentencepieces, "REMEMBERED_WORDS", 10)
    encoder = sentencepieces.Encoder(vocabulary)
    assert [encoder.encode([t])[0].tolist() for t in texts] == want


@pytest.mark.parametrize("few", [0, 10**9])
def test_unigram_viterbi_is_the_best_path(monkeypatch, few):
    monkeypatch.setattr(sentencepieces, "FEW_WORDS", few)
    pieces = ("<unk>", "▁", "a", "b", "▁a", "ab", "ba", "▁ab", "bab")
    scores = (0.0, -3.1, -2.5, -2.7, -2.2, -3.3, -2.9, -4.4, -4.1)
    v = sentencepieces.Vocabulary("unigram", pieces, scores, (False,) + (True,) * 8, (), 0)

    def best(word):
        found = {0: (0.0, ())}
        for j in range(1, len(word) + 1):
            options = [
                (found[i][0] + scores[k], found[i][1] + (k,))
                for i in range(j) if i in found for k, p in enumerate(pieces) if k and word[i:j] == p
            ]
            if options:
                found[j] = max(options)
        return found[len(word)]

    encoder, rnd = sentencepieces.Encoder(v), random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 12)))
        ids = encoder.encode([text])[0].tolist()
        marked = "▁" + text.replace(" ", "▁")
        assert "".join(pieces[i] for i in ids) == marked
        total = sum(best(w)[0] for w in sentencepieces._WORD.findall(marked))
        assert sum(scores[i] for i in ids) == pytest.approx(total)


def test_encode_edges(spark, make_docs, hostile_rows, empty_docs, vocabulary):
    out = sentencepieces.encode(make_docs(hostile_rows), vocabulary, round_trip="ok")
    assert {"fp", "token", "token_ids", "ok"} <= set(out.columns)
    back = sentencepieces.decode(out, vocabulary).select("text", "token_ids", "ok", "decoded").collect()
    assert len(back) == len(hostile_rows)
    for r in back:
        if r["text"] is None:
            assert r["token_ids"] is None and r["decoded"] is None and r["ok"] is None
        else:
            assert r["ok"] == (r["decoded"] == r["text"]) == ("▁" not in r["text"])
    assert sentencepieces.encode(empty_docs, vocabulary).count() == 0


# --- 2 ------------------------------------------------------------------------------


def counts_of(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    seen = defaultdict(int)
    for w in windows:
        seen[w] += 1
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [ln for ln in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", ln)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdict(make_docs, hostile_rows, empty_docs):
    rnd = random.Random(5)
    rows = hostile_rows + [(100 + i, " ".join(rnd.choice("ab the of") for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    rows += [(200, "a b\n\na b\n a b \na b"), (201, "spam $$$ %%% " * 30)]
    got = quality_rules.report(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(counts_of(r[1]))
    for r in got:
        c = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert c in want[r["doc_id"]]
        assert r["base_failed"] == (c[0] < 20 or 100 * c[4] > 30 * c[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {6, 7, 8} <= kept and not kept & {1, 2, 3, 4, 5, 12, 201}
    assert quality_rules.report(empty_docs).count() == 0
    assert quality_rules.filter_documents(make_docs(rows)).columns == make_docs(rows).columns


# --- 4 ------------------------------------------------------------------------------


def lines_brute(rows, min_sites):
    sites = defaultdict(set)
    first = {}
    for d, t, s in rows:
        for i, ln in enumerate((t or "").split("\n")):
            k = ln.strip(" \t\n\x0b\f\r")
            if t is not None and k:
                sites[k].add(s or "")
                at = (d is not None, d or 0, i)
                first[k] = min(first.get(k, at), at)
    out = {}
    for d, t, s in rows:
        if t is None:
            out[d] = None
            continue
        out[d] = "\n".join(
            ln for i, ln in enumerate(t.split("\n"))
            if len(sites[ln.strip(" \t\n\x0b\f\r")]) < min_sites or first[ln.strip(" \t\n\x0b\f\r")] == (d is not None, d or 0, i)
        )
    return out


@pytest.mark.parametrize("broadcast_lines", [0, 1_000_000])
def test_line_dedup_equals_exact_counting(make_docs, empty_docs, monkeypatch, broadcast_lines):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast_lines)
    rnd = random.Random(3)
    pool = [f"line number {i}" for i in range(12)] + ["", "  ", " line number 1 "]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 8))), f"site{rnd.randint(0, 11)}") for i in range(80)]
    rows += [(900, None, "site1"), (901, "", None), (None, "line number 1\nmine alone", None)]
    for min_sites in (2, 5, 9, 12):
        out, name = line_dedup.dedup(make_docs(rows), min_sites=min_sites)
        assert {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()} == lines_brute(rows, min_sites)
        assert out.columns == make_docs(rows).columns + [name]
    assert line_dedup.dedup(empty_docs)[0].count() == 0


def test_line_dedup_query_on_given_documents(spark):
    rows = given("documents", "doc_id, text, source")
    want = lines_brute(rows, line_dedup.MIN_SITES)
    got = entry.queries()["op4_line_dedup"](spark, SF).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == {
        d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in want.items()
    }
    assert any(r["n_removed"] for r in got)


def test_line_dedup_repeated_rows(make_docs, hostile_rows):
    out, _ = line_dedup.dedup(make_docs(hostile_rows))
    assert out.count() == len(hostile_rows)


# --- 5 ------------------------------------------------------------------------------


def test_classifier_ranks_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scored = classifier.report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "id")
    rows = scored.join(labels, scored["doc_id"] == labels["id"]).filter("held_out").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert len(good) > 40 and len(bad) >= 5
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9
    again = classifier.report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(scored.collect()) == sorted(again.collect())


def test_classifier_edges(spark, make_docs, hostile_rows, empty_docs):
    labels = spark.createDataFrame([(6, 1), (7, 1), (4, 0), (None, 1), (8, None)], "doc_id long, quality int")
    out = classifier.report(make_docs(hostile_rows), labels).collect()
    assert len(out) == len(hostile_rows)
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert classifier.report(empty_docs, labels).count() == 0
    unknown = classifier.report(make_docs(hostile_rows), labels.limit(0)).collect()
    assert {r["score"] for r in unknown} == {0.5}


def test_risk_estimator_stays_non_negative():
    import numpy as np

    rnd = np.random.default_rng(0)
    width = classifier._SHAPE + classifier.BIGRAM_BINS
    p, n = rnd.normal(1.0, 1.0, (300, width)), rnd.normal(-1.0, 1.0, (300, width))
    m = classifier.fit(p, np.vstack([rnd.normal(1.0, 1.0, (300, width)), n]), prior=0.5)
    w = np.array(m.weights) / np.array(m.scale)
    z = lambda x: (x - np.array(m.mean)) @ w + m.bias
    assert (z(rnd.normal(1.0, 1.0, (200, width))) > 0).mean() > 0.9 and (z(n) < 0).mean() > 0.9


# --- 9 ------------------------------------------------------------------------------


def contamination_brute(docs, items):
    def ws(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = defaultdict(set)
    for item, text in items:
        w = ws(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, who = ws(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    who |= windows[k]
        digest = hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(who), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_query_equals_brute_force(spark):
    got = entry.queries()["op9_benchmark_decontamination"](spark, SF)
    want = contamination_brute(given("documents", "doc_id, text"), given("benchmark", "item_id, text"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(r[5] for r in want)


def test_items_longer_than_a_block_keep_their_windows(spark):
    words = [f"w{i}" for i in range(1_200_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short one"), (3, None)], "item_id long, text string")
    blocks = list(decontaminate._blocks(bench, "item_id", "text", 13, decontaminate.BLOCK_BYTES, decontaminate.BLOCK_WORDS))
    whole, seen = [], 0
    for block in blocks:
        assert sum(len(decontaminate.words_of(t)) for _, t in block) <= decontaminate.BLOCK_WORDS
        assert sum(len(t or "") for _, t in block) <= decontaminate.BLOCK_BYTES
        for item, text in block:
            ws = text.split() if item == "1" else []
            assert not ws or seen == 0 or whole[-12:] == ws[:12]  # twelve words in common: no window is lost or made up
            whole += ws[12:] if seen else ws
            seen += len(ws)
    assert whole == words and len(blocks) == 5


@pytest.mark.parametrize("block_bytes,block_words", [(1 << 20, 1 << 20), (60, 1 << 20), (1 << 20, 15), (1 << 20, 1)])
def test_decontamination_edges(spark, make_docs, hostile_rows, empty_docs, block_bytes, block_words):
    items = [(1, "One"), (1, "one"), (2, None), (3, ""), (4, "the river of the valley was wide and it ran to the sea by a town"),
             (None, "of nobody"), (5, "Était là 你")]
    rows = [r[:2] for r in hostile_rows] + [(50, "Voilà: était-LÀ, Était là! 你; one"), (51, "one " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS hits", "2 AS found")
    found, name = decontaminate.scan(make_docs(rows), bench, block_bytes=block_bytes, block_words=block_words)
    got = sorted(
        ((r["doc_id"], r[name]["n_words"], sum(h["last"] - h["first"] + 1 for h in r[name]["hits"]), len(r[name]["items"])) for r in found.collect()),
        key=repr,
    )
    assert got == sorted(((d, n, h, k) for d, n, h, k, _, _ in contamination_brute(rows, items)), key=repr)
    spans = found.filter("doc_id = 50").first()
    text, hit = spans["text"], [spans["text"][s["start"] : s["end"]] for s in spans[name]["spans"]]
    assert hit and all(h in text for h in hit) and hit[-1].endswith("one")
    assert decontaminate.clean(empty_docs, bench).count() == 0
    assert decontaminate.clean(make_docs(rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.clean(make_docs(rows), bench).columns == make_docs(rows).columns

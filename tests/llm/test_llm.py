"""Operators against brute force, and the defined cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallgrass.llm import chaining, decontaminate, langid, lm, minhash, packing, queries, rollups, secrets, substrings, suffixes, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
W = re.compile(r"[^\x20\x09-\x0D]+")
A = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(x):
    return (x or "").translate({c: c + 32 for c in range(65, 91)})


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "bêta", "gamma", "delta", "eps", "zeta", "Eta", "theta"]) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(25)]
    out = [None, "", " \n", "x", "Ünï 12"]
    for _ in range(60):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append(" ".join(words) + rng.choice(["", " " + rng.choice(base)]))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_decontamination(spark, docs, texts, none):
    items = [(1, " ".join(low(texts[10]).split()[:20])), (1, "zz yy"), (2, "x"), (3, None), (None, "12")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = A.findall(low(t))
        n = min(8, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    for block in (1_000_000, 3):
        got = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, block_windows=block).collect()}
        for d, t in enumerate(texts):
            w, hit, ids = A.findall(low(t)), set(), set()
            for k, win in itertools.product(range(len(w)), windows):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= windows[win]
            assert got[d].n_words == len(w) and got[d].item_ids == sorted(ids)
            assert sum(s.last - s.first for s in got[d].hit_words) == len(hit)
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("size(item_ids) > 0").isEmpty()
    assert decontaminate.find_contamination(none, bench).isEmpty()
    clash = docs.withColumn("n_words", F.lit("own"))
    kept = decontaminate.remove_contaminated(clash, bench)
    assert kept.columns == clash.columns and {r.n_words for r in kept.collect()} == {"own"}
    assert decontaminate.cut_spans("a B, c d", [{"first": 1, "last": 3}]) == "a  d"


def test_substring_dedup(docs, texts, none):
    seen, want = set(), []
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone])
        want.append((d, len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r)[:5] for r in substrings.find_repeats(docs).collect()) == want
    assert sum(w[2] for w in want) and substrings.find_repeats(none).isEmpty()
    twice = docs.unionByName(docs.where("doc_id = 20"))
    assert sorted(tuple(r)[:5] for r in substrings.find_repeats(twice).collect()) == sorted([*want, want[20]])
    with_null = docs.where("doc_id > 20").withColumn("doc_id", F.when(F.col("doc_id") != 40, F.col("doc_id")))
    assert substrings.find_repeats(with_null).where("doc_id is null").first().n_removed == substrings.find_repeats(docs.where("doc_id = 40")).first().n_removed


def test_maximal_repeats_by_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 40)))
        data = np.frombuffer(text, dtype=np.uint8)
        starts = np.arange(len(text))
        order, lcp = suffixes.enhanced_suffix_array(data, starts, len(text) - starts)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        left = np.concatenate(([-1], data[:-1].astype(int)))
        found = suffixes.maximal_repeats(order, lcp, left, 2)
        got = {(text[order[a] : order[a] + n], tuple(sorted(order[a : b + 1].tolist()))) for a, b, n in zip(found.first, found.last, found.lengths, strict=True)}
        want = set()
        for i, j in itertools.combinations(range(len(text) + 1), 2):
            s = text[i:j]
            at = [k for k in range(len(text)) if text.startswith(s, k)]
            if len(s) >= 2 and len(at) > 1 and len({text[k - 1] if k else -1 for k in at}) > 1 and len({text[k + len(s)] if k + len(s) < len(text) else -1 for k in at}) > 1:
                want.add((s, tuple(at)))
        assert got == want


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)]) for i in range(230)]
    rows += [(230, None), (231, [1.0, None] * 4), (232, [float("nan")] * 8), (None, [1.0] * 8), (233, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    fine = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = sorted((q, r + 1, i, s) for q, x in fine if q % 50 == 0 for r, (s, i) in enumerate(sorted(((int(x @ y), i) for i, y in fine if i != q), key=lambda p: (-p[0], p[1]))[:5]))
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), block_queries=2).collect())) == want
    assert topk.top_k(df.limit(0), df.limit(0)).isEmpty()


def test_top_k_of_equal_vectors(spark):
    for rows in ([(i, [1.0, -2.0]) for i in range(12)], [(i, [float(i % 3), 1.0]) for i in range(9)] + [(9, [2.0, 1.0])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        want = sorted((q, r + 1, i, s) for q, x in rows for r, (s, i) in enumerate(sorted(((int(65536 * np.dot(x, y)), i) for i, y in rows if i != q), key=lambda p: (-p[0], p[1]))[:5]))
        for parts in (1, len(rows)):  # the latter leaves partitions of one row
            assert sorted(map(tuple, topk.top_k(df.repartitionByRange(parts, "vec_id"), df).collect())) == want


def test_top_k_of_large_scores(spark):
    """Scores that floats do not hold, up to 64 bits, and beyond them."""
    for top, width in ((2.0**31, 2), (2.0**44, 3), (3.0, 2)):
        rows = [(1, [top] * width), (2, [top + 1.0] + [top] * (width - 1)), (3, [-top] * width), (4, [top - 1.0] * width), (5, [top, top - 3] + [0.0] * (width - 2)), (6, [top + 1.0] + [top] * (width - 1)), (6, [0.0] * width)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        fit = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
        ask = sorted(rows)
        ask = [r for i, r in enumerate(ask) if not i or ask[i - 1][0] != r[0]]
        want = sorted((q, r + 1, i, s) for q, x in ask for r, (s, i) in enumerate(sorted(((fit(sum(int(256 * a) * int(256 * b) for a, b in zip(x, y, strict=True))), i) for i, y in rows if i != q), key=lambda p: (-p[0], p[1]))[:5]))
        for parts in (1, 4):
            assert sorted(map(tuple, topk.top_k(df.repartition(parts, "vec_id"), df, block_queries=2).collect())) == want


def test_near_duplicates(docs, texts, none):
    sets = []
    for t in texts:
        w = W.findall(low(t))
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = sorted(map(tuple, minhash.near_duplicates(docs, n=3, percent=85).collect()))
    assert got == [(d, len(s), root[d], d == root[d]) for d, s in enumerate(sets)]
    assert minhash.near_duplicates(none).isEmpty()
    twice = docs.unionByName(docs).withColumn("shingles", F.lit(1))
    kept = minhash.keep_one_of_each(twice, n=3, percent=85)
    assert kept.columns == twice.columns and sorted(r.doc_id for r in kept.collect()) == [d for d in range(len(texts)) if d == root[d]]


def test_near_duplicates_in_blocks(spark, docs, monkeypatch):
    """Buckets beyond a block, low thresholds, rows that share an id and null ids."""
    want = sorted(map(tuple, minhash.near_duplicates(docs, n=2, percent=50).collect()))
    monkeypatch.setattr(minhash, "BLOCK", 3)
    assert sorted(map(tuple, minhash.near_duplicates(docs, n=2, percent=50).collect())) == want
    assert [minhash.bands_for(p) for p in (85, 80, 40)] == [(32, 4), (32, 4), (128, 1)]
    rng = random.Random(15)
    base = [prose(rng, 1) for _ in range(60)]
    rows = [(d, " ".join(prose(rng, 1) if rng.random() < 0.2 else x for x in base)) for d in range(40)]
    sets = [set(W.findall(low(t))) for _, t in rows]
    root = list(range(40))
    for _ in range(40):
        for a, b in itertools.combinations(range(40), 2):
            if 100 * len(sets[a] & sets[b]) >= 66 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, n=1, percent=66).collect() if r.doc_id is not None) == list(enumerate(root))
    odd = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "quite another text", 3), (None, None, 4), (None, None, 4)], "doc_id long, text string, Kept int")
    assert sorted((r.doc_id or 0, r.text or "") for r in minhash.keep_one_of_each(odd).collect()) == [(0, ""), (0, ""), (1, "a b c d e f"), (1, "quite another text")]


def test_fuzzy_passages(spark, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(70)]
    rows = []
    for d in range(30):
        own = [word() for _ in range(100)]
        if d % 3 == 0:
            edited = [word() if rng.random() < 0.02 else x for x in passage]
            own[50:50] = edited
        rows.append((d, " ".join(own)))
    rows += [(30, None), (31, ""), (None, rows[0][1])]
    got = {r.doc_id: r for r in chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for d in range(30):
        assert (got[d].n_passages > 0) == (d % 3 == 0 and d > 0) and got[d].class_id == (0 if d % 3 == 0 else d)
        assert got[d].n_repeated == 0 or abs(got[d].n_repeated - 70) <= 8
    assert got[30].n_words == got[31].n_words == 0
    assert chaining.repeated_passages(none).isEmpty()
    assert chaining.common_length([1, 2, 3, 4], [2, 9, 4]) == 2
    assert chaining.chain([0, 10, 5], [0, 10, 30], [5, 5, 5])[0] == [0, 1]


def test_fuzzy_passages_apart(spark):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    rows = []
    for d, (gap, other_gap) in enumerate([(0, 31), (0, 200), (0, 500), (60, 60)]):
        a, b = words(60), words(60)
        rows += [(2 * d, " ".join(words(20) + a + words(gap) + b + words(20))), (2 * d + 1, " ".join(words(40) + a + words(other_gap) + b + words(9)))]
    got = {r.doc_id: r for r in chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, gap in enumerate([31, 200, 500, 60]):
        r = got[2 * d + 1]
        assert (r.class_id, r.n_links) == (2 * d, 1)
        assert [(p.first, p.last) for p in r.passages] == [(40, 100), (100 + gap, 160 + gap)]
    assert chaining.parts([1, 2, 3, 9, 9, 4, 5, 6], [1, 2, 3, 4, 5, 6], [(0, 0, 3), (5, 3, 3)], 0.8, 3) == [(0, 3, 0, 3), (5, 8, 3, 6)]


def test_fuzzy_passages_first_seen_apart(spark):
    rng = random.Random(10)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    rows, want = [], {}
    for case, (holders, edits) in enumerate([(1, 0), (6, 0), (1, 2)]):
        passage, d = words(60 if edits else 75), 100 * case
        for k in range(holders):  # halves of the passage, which alone are too short
            rows += [(d + 2 * k, " ".join(words(30) + passage[:30] + words(30))), (d + 2 * k + 1, " ".join(words(30) + passage[30:] + words(30)))]
        copy = list(passage)
        for k in range(edits):
            copy[20 * k + 15] = words(1)[0]
        rows += [(d + 50, " ".join(words(40) + passage + words(20))), (d + 51, " ".join(words(10) + copy + words(50)))]
        want |= {d + 50: d + 50, d + 51: d + 50}
    for parts in (1, 3):
        got = {r.doc_id: r.class_id for r in chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")).collect()}
        assert got == {d: want.get(d, d) for d, _ in rows}


def passage_rows(spark, rows, parts=1, batch=10_000):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        return sorted((r.doc_id, r.class_id, r.n_repeated, r.n_links, [tuple(p) for p in r.passages]) for r in chaining.repeated_passages(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fuzzy_passages_recall_and_batches(spark):
    """Copies of 60 to 100 words with up to a fifth of them replaced, twelve copies of one passage, and copies among documents that hold parts of the same passage: brute force knows them all; neither batches nor partitions change a row."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    rows, want = [], {}
    for case, (size, edits) in enumerate([(60, 12), (60, 9), (60, 6), (80, 14), (100, 20)] * 20):
        passage = words(size)
        copy = list(passage)
        for k in rng.sample(range(1, size - 1), edits):
            copy[k] = words(1)[0]
        rows += [(2 * case, " ".join(words(30) + passage + words(30))), (2 * case + 1, " ".join(words(50) + copy + words(10)))]
        want[2 * case + 1] = 2 * case
    passage = words(70)
    rows += [(1000 + k, " ".join(words(20) + passage + words(20))) for k in range(12)]
    passage = words(80)
    for k in range(8):
        rows.append((2000 + k, " ".join(words(40) + passage[9 * k : 9 * k + 14] + words(40))))
    rows += [(2100, " ".join(words(40) + passage + words(20))), (2150, " ".join(words(40) + passage[20:60] + words(20))), (2200, " ".join(words(10) + passage + words(30)))]
    got = passage_rows(spark, rows)
    of = {r[0]: r[1] for r in got}
    assert sum(of[d] == c for d, c in want.items()) >= 0.9 * len(want)
    assert all(of[2 * k] == 2 * k for k in range(100)) and all(of[1000 + k] == 1000 for k in range(12))
    assert all(of[2000 + k] == 2000 + k for k in range(8)) and of[2200] == 2100 and [r for r in got if r[0] == 2200][0][2] >= 80
    assert got == passage_rows(spark, rows, 8, 4) == passage_rows(spark, rows, 2, 1)


def test_fuzzy_passages_hot_seeds(spark, monkeypatch):
    """A passage that more documents hold than one task should take: parts by document, joined by their firsts."""
    monkeypatch.setattr(chaining, "SAMPLE", 1)
    monkeypatch.setattr(chaining, "HOT", 5)
    monkeypatch.setattr(chaining, "HOT_PARTS", 4)
    monkeypatch.setattr(chaining, "CHAINS_A_ROW", 2)
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage = words(60)
    rows = [(k, " ".join(words(k % 7) + passage + words(20))) for k in range(60)]
    rows += [(60, rows[3][1]), (60, rows[3][1]), (61, " ".join(words(100)) * 3)]
    got = passage_rows(spark, rows, 3)
    assert [r[1] for r in got] == [0] * 62 + [61] and all(r[2] >= 60 for r in got[1:62])


def test_fuzzy_passages_all_links(spark):
    """Seventy edited copies of a passage, more than a seed's occurrences are compared in all pairs, and exact copies of a text: n_links counts every pair that brute force finds."""
    rng = random.Random(13)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage, copies, rows = words(64), [], []
    for k in range(70):
        copy = list(passage)
        for p in rng.sample(range(64), k % 9):
            copy[p] = words(1)[0]
        copies.append(copy)
        rows.append((k, " ".join(words(20) + copy + words(20))))
    links = [0] * 70
    for a, b in itertools.combinations(range(70), 2):
        equal = list(itertools.accumulate((x == y for x, y in zip(copies[a], copies[b], strict=True)), initial=0))
        linked = any(10 * (equal[i + n] - equal[i]) >= 8 * n for n in range(50, 65) for i in range(65 - n) if equal[i] < equal[i + 1] and equal[i + n - 1] < equal[i + n])
        links[a] += linked
        links[b] += linked
    text = " ".join(words(60))
    rows += [(100 + k, text) for k in range(50)]
    got = {r[0]: r for r in passage_rows(spark, rows, 3)}
    assert [got[k][3] for k in range(70)] == links
    assert all(got[k][2] >= 50 for k in range(1, 70))
    a, b = np.arange(80, dtype=np.int32), np.arange(20, 90, dtype=np.int32)
    own, other = np.arange(100), np.concatenate((np.arange(-30, 0), np.arange(30, 72), np.arange(-60, -32)))  # 42 equal words are too few
    assert chaining._agree(own, other, np.arange(30, 69), np.arange(30, 69), 50, 0.8) == []
    other[30:90] = np.arange(30, 90)
    assert chaining._agree(own, other, np.arange(30, 87), np.arange(30, 87), 50, 0.8) == [(30, 90)]
    assert chaining._repeats([b, a], [7, 3], [5, 0], 50) == {(7, 5, 65, 3)}
    assert all(got[100 + k][1:4] == (100, 60 if k else 0, 49) for k in range(50))


def test_fuzzy_passages_family_work(monkeypatch):
    """Pieces that repeat one common word up to 49 times, and edited copies of a passage: the links of all pairs compared one by one, with few pairs aligned."""
    rng = random.Random(14)
    fresh = itertools.count(100)
    pieces = []
    for k in range(60):
        runs = [[w] * rng.randint(11, 49) for w in (next(fresh), 7, next(fresh))]
        pieces.append(np.array([*runs[0], *runs[1], *runs[2], *([7] * (k % 3 * 15))], dtype=np.int32))
    pieces += [np.array([7] * 100, dtype=np.int32), np.array([7] * 48 + [3] * 48 + [7] * 48, dtype=np.int32)]
    passage = [next(fresh) for _ in range(70)]
    for k in range(40):
        copy = list(passage)
        for p in rng.sample(range(70), k % 15):
            copy[p] = next(fresh)
        if k % 4 == 0:
            copy[30:30] = [next(fresh)] * (k % 5)
        pieces.append(np.array([next(fresh) for _ in range(k)] + copy, dtype=np.int32))
    n, want = len(pieces), set()
    for a, b in itertools.combinations(range(n), 2):
        one, two = chaining._Piece(pieces[b], 4), chaining._Piece(pieces[a], 4)
        pos, other_pos = one.matches(two)
        rows = {tuple(pieces[b][i : i + 50]) for i in range(len(pieces[b]) - 49)} & {tuple(pieces[a][i : i + 50]) for i in range(len(pieces[a]) - 49)}
        if rows or len(pos) and (chaining._agree(pieces[b], pieces[a], pos, other_pos, 50, 0.8) or chaining._pair_passages(pieces[b], pieces[a], pos, other_pos, 4, 50, 0.8, 0.1)):
            want.add((b, a))
    aligned, real = [], chaining._pair_passages
    monkeypatch.setattr(chaining, "_pair_passages", lambda *a: aligned.append(1) or real(*a))
    batch = pa.RecordBatch.from_pydict({"family": [1] * n, "i": [0] * n, "j": [0] * n, "block": [0] * n, "doc": list(range(n)), "low": [0] * n, "words": [p.tobytes() for p in pieces]})
    got = [r for out in chaining._family_rows(4, 50, 0.8, 0.1)([batch]) for r in out.to_pylist()]
    assert {(r["doc"], r["source"]) for r in got} == want and len(want) > 300
    assert len(aligned) < 0.1 * n * (n - 1) / 2
    for r in got:
        assert r["first"] is None or r["last"] - r["first"] >= 50 and pieces[r["doc"]][r["first"]] in pieces[r["source"]]


def test_secrets(spark, docs, none):
    a = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    rng = random.Random(1)
    bits = ["token", "secret", "=", ":", " ", '"', "a", "F", "0", "é", "AKIA", "ApIkEy", "abcdef0123456789abcdef01", "Z" * 16, ".", "passwd", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["0" * 100_000, None, ""]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[1]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        names = [r.kind for r in secrets.BASE]
        assert [(s.start, names.index(s.kind), s.end) for s in got[d].secrets if s.kind in names] == sorted(want)
    assert secrets.redact("ab12cd", [{"start": 2, "end": 4}], "#") == "ab#cd"
    clash = docs.withColumn("secrets", F.lit(1))
    out = secrets.redact_secrets(clash)
    assert out.columns == clash.columns and out.count() == clash.count() and secrets.redact_secrets(none).isEmpty()


def test_language_id(spark, none):
    rng = random.Random(3)
    make = {"aa": "abc", "bb": "def", "cc": "éèê"}
    rows = [(i, "".join(rng.choice(make[k] + " ") for _ in range(40)), k) for i in range(300) for k in [rng.choice(list(make))]]
    rows += [(300, None, "aa"), (301, "123 !", "aa"), (302, "abc abc", None), (303, "abc " * 200_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where(langid.remainder("doc_id", 4) != 2))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and sum(got[i].lang_pred == k for i, _, k in held) / len(held) > 0.95
    assert (got[300].lang_pred, got[301].lang_pred, got[302].lang_pred, got[303].lang_pred) == ("und", "und", "aa", "aa")
    assert all(0 <= r.score <= 1 for r in got.values())
    none_learned = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(none_learned).count() == 302 and {r.lang_pred for r in langid.predict(none_learned, langid.train(none_learned)).collect()} == {"und"}
    assert langid.train(docs, max_languages=2).languages == sorted(sorted(make, key=lambda k: (-sum(r[2] == k and r[1] is not None for r in rows), k))[:2])
    few = [(i, t, k) for i, t, k in rows[:40]]
    counts, total = {k: Counter() for k in make}, Counter(k for _, _, k in few)
    grams = lambda t: [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]
    for _, t, k in few:
        counts[k].update(grams(t))
    small = spark.createDataFrame(few, "doc_id long, text string, lang string")
    for r in langid.predict(small, langid.train(small, bits=20)).collect():  # no two of these n-grams share a bucket
        logs = {k: np.log(total[k] / 40) + sum(np.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * 2**20)) for g in grams(r.text)) for k in make}
        best = max(logs, key=logs.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(np.exp(x - logs[best]) for x in logs.values())) < 1e-3
    assert langid.keep_identified(docs).count() == 302 and langid.keep_identified(none).isEmpty()


def test_lm(docs, texts, none):
    out = langid.remainder("doc_id", 7) == 2
    for frequent in (1 << 19, 5):
        model = lm.train(docs.where(~out), max_frequent=frequent)
        got = {r.doc_id: r for r in lm.score(docs, model, held_out=out).collect()}
        counts = Counter()
        tokens = {d: [*W.findall(low(t)), None] for d, t in enumerate(texts)}
        for d in tokens:
            if zlib.crc32(str(d).encode()) % 7 != 2:
                counts.update(tokens[d])
        n, v = sum(counts.values()), len(counts)
        for d in tokens:
            r = got[d]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[d]), sum(counts[x] > 0 for x in tokens[d]), n)
            assert abs(r.base_score - sum(log10((counts[x] + 1) / (n + v + 1)) for x in tokens[d])) < 1e-6 and r.score <= 0
    full = lm.score(docs, lm.train(docs.where(~out)), held_out=out).where("n_tokens > 20").agg(F.sum("score"), F.sum("base_score")).first()
    assert full[0] > full[1]
    assert lm.score(none, lm.train(none)).isEmpty()


def lm_level(count):
    return 1.5 * 2 ** (count.bit_length() - 1) - 0.5 if count else 0.0


def lm_brute(train, text, prior=2.0, level=lm_level):
    """log10 of the chance of each token of a text, from counters of quantised counts."""
    grams = [Counter() for _ in range(3)]
    for t in train:
        tokens = [None, *W.findall(low(t)), None]
        for i in range(1, len(tokens)):
            for n in range(1, 4):
                if n < 3 or i > 1:
                    grams[n - 1][tuple(tokens[i - n + 1 : i + 1])] += 1
    one, two, three = ({k: level(c) for k, c in g.items()} for g in grams)
    total, tokens, out = sum(grams[0].values()) + len(grams[0]) + 1, [None, *W.findall(low(text)), None], []
    for i in range(1, len(tokens)):
        u, w = tokens[i - 1], tokens[i]
        c = one.get((u,), 0)
        p = (min(two.get((u, w), 0), c) + prior * (one.get((w,), 0) + 1) / total) / (c + prior)
        if i > 1:
            c = min(two.get((tokens[i - 2], u), 0), one.get((tokens[i - 2],), 0))
            p = (min(three.get((tokens[i - 2], u, w), 0), c, two.get((u, w), 0)) + prior * p) / (c + prior)
        out.append(log10(p))
    return out


def test_lm_scores_by_brute_force(spark, docs, texts):
    """Wide filters, which give no false positives, are equal to counters; turns and exact counts by join change nothing."""
    train = [t for d, t in enumerate(texts) if zlib.crc32(str(d).encode()) % 7 != 2]
    rows = docs.where(langid.remainder("doc_id", 7) != 2)
    want = {d: sum(lm_brute(train, t)) for d, t in enumerate(texts)}
    for kw in ({}, {"max_frequent": 5}, {"max_bits": 1 << 16}):
        model = lm.train(rows, bits_a_key=400, **kw)
        assert (len(model.turns) > 1) == ("max_bits" in kw)
        got = {r.doc_id: r.score for r in lm.score(docs.unionByName(docs.where("doc_id = 9")), model).collect()}
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)
    same = [sorted(map(tuple, lm.score(docs, lm.train(rows, max_bits=bits)).select("doc_id", "score").collect())) for bits in (lm.MAX_BITS, 1 << 12)]
    assert all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(*same, strict=True))
    off = sum(abs(got - want[d]) for d, got in same[0]) / -sum(want.values())
    assert off < 0.05  # false positives of the narrow filter


def test_lm_sums_to_one():
    """With exact counts the chances of all known words, an unknown one and the end sum to 1 after any words."""
    train = ["a b a c", "b a", "c c a b"]
    for before in ("", "a ", "a b ", "x a ", "c c "):
        chances = [lm_brute(train, before + w, level=float)[-2] for w in ("a", "b", "c", "unknown")]
        assert abs(sum(10**x for x in [*chances, lm_brute(train, before, level=float)[-1]]) - 1) < 1e-9


def test_lm_tells_documents_that_occur_twice_apart(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{int(4000 ** rng.random())}" for _ in range(120)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:30])), "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(df, lm.train(df)).collect()}
    bound = sorted(got[i] for i in range(30, 300))[243]
    assert sum(got[i] > bound for i in range(30)) == 30


def test_packing(docs, none):
    rng = random.Random(4)
    for _ in range(20):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        placed = packing.pack_lengths(lengths, (16, 32, 64))
        bins = {}
        for (b, cap, offset), n in zip(placed, lengths, strict=True):
            bins.setdefault(b, (cap, []))[1].append((offset, n))
        for cap, inside in bins.values():
            inside.sort()
            assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(inside)) and inside[0][0] == 0
            used = sum(n for _, n in inside)
            assert cap == min(c for c in (16, 32, 64) if c >= used)
        if len(lengths) > 40:
            assert sum(lengths) / sum(c for c, _ in bins.values()) > 0.85
    rows = packing.pack(docs, capacities=(16, 32)).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
        assert (r.bin_id is None) == (r.n_tokens == 0)
    assert total == {r.doc_id: len(W.findall(r.text or "")) for r in docs.collect()}
    assert packing.pack(none).isEmpty()
    odd = docs.unionByName(docs.where("doc_id > 50").withColumn("doc_id", F.lit(None).cast("long"))).withColumn("Bin_Id", F.lit(1))
    same = [sorted(map(str, packing.pack(odd.repartition(n), capacities=(16, 32), window_rows=20).collect())) for n in (1, 8)]
    assert same[0] == same[1] and "1.0.0" in str(same[0])
    long = docs.limit(0).unionByName(docs.where("doc_id = 9").withColumn("text", F.repeat(F.lit("wörd "), 100_000)))
    assert [(r.piece, r.n_tokens) for r in packing.pack(long).orderBy("piece").collect()] == [(i, 4096) for i in range(24)] + [(24, 100_000 - 24 * 4096)]


def test_packing_by_brute_force():
    """Each piece goes to the fullest open bin that holds it; a bin is opened at the least price for what it can be expected to hold."""
    rng = random.Random(14)
    for _ in range(30):
        capacities = (16, 32, 64)
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 60))]
        order, bins, want = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)), [], {}
        for step, i in enumerate(order):
            fitting = [b for b in bins if b[0] - b[1] >= lengths[i]]
            if fitting:
                room = min(b[0] - b[1] for b in fitting)
                chosen = [b for b in fitting if b[0] - b[1] == room]
            else:
                best = None
                for c in capacities:
                    if c >= lengths[i]:
                        room = c - lengths[i]
                        for x in sorted((lengths[k] for k in order[step + 1 :]), reverse=True):
                            room -= x if x <= room else 0
                        best = min(best or (2.0, 0), (c / (c - room), -c))
                bins.append([-best[1], 0, len(bins)])
                chosen = [bins[-1]]
            want[i] = {b[2] for b in chosen}
            got = packing.pack_lengths(lengths, capacities)
            mine = got[i][0]
            assert mine in want[i] and got[i][2] == bins[mine][1]
            bins[mine][1] += lengths[i]
        assert all(got[i][1] == min(c for c in capacities if c >= bins[got[i][0]][1]) for i in order)


def test_rollups(spark, tmp_path):
    store = rollups.RollupStore(spark, f"file://{tmp_path}/store")
    schema = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long"
    load = spark.createDataFrame([("insert", "a", None, "1", 5, None), ("insert", "a", None, "1", 7, None), ("insert", "b", "x", "1", None, None)], schema)
    assert store.totals().isEmpty() and store.commit("one/1", load) and not store.commit("one/1", load)
    assert store.commit("two", spark.createDataFrame([("revise", "a", None, "1", 9, 7), ("delete", "b", "x", "1", 0, None)], schema))
    assert [tuple(r) for r in store.totals().collect()] == [("a", None, "1", 2, 14)]


def test_pipeline_stages(spark, docs, texts):
    bench = spark.createDataFrame([(1, texts[30])], "item_id long, text string")
    left = corpus_pipeline.identify_language(spark, docs, "")
    assert left.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()} == {0, 1, 2}
    left = corpus_pipeline.drop_near_duplicates(spark, left, "")
    left = decontaminate.remove_contaminated(left, bench)
    left = corpus_pipeline.mask_secrets(spark, left, "")
    packed = corpus_pipeline.pack_sequences(spark, left, "")
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in left.collect()}
    assert [len(corpus_pipeline.STAGES), set(queries.SQL) <= set(queries.QUERIES)] == [5, True]


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() over nulls, repeated rows, clashing names and planted cases; and over empty tables."""
    rng = random.Random(21)
    line = lambda n: [prose(rng, 1) for _ in range(n)]
    item = line(12)
    rows = [(i, " ".join(line(40)), "en") for i in range(40)]
    rows += [(40, None, "en"), (41, "", None), (42, "12 34", "en"), (None, " ".join(line(30)), None)]
    rows += [(50 + k, rows[3][1] + " " + prose(rng, 1), "en") for k in range(3)] + [rows[5], rows[5]]
    rows += [(60, " ".join(line(20) + item[2:11] + line(20)), "en"), (61, " ".join(line(20) + item[2:9] + line(20)), "en"), (62, " ".join(line(20)) + " password = hunter22x " + " ".join(line(9)), None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, Kept boolean, secrets string, Score double"
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), None, "own", 0.5) for r in rows], schema)
    docs.write.parquet(f"{folder}/a/documents.parquet")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string")
    bench.write.parquet(f"{folder}/a/benchmark.parquet")
    before = spark.conf.get(corpus_pipeline.BATCHES)
    got = Counter()
    for r in corpus_pipeline.run(spark, f"{folder}/a").collect():
        got[r.doc_id] += r.n_tokens
    assert spark.conf.get(corpus_pipeline.BATCHES) == before
    letter = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    sets = lambda t: {tuple(W.findall(low(t))[i : i + 5]) for i in range(len(W.findall(t)) - 4)}
    windows = {tuple(A.findall(low(" ".join(item)))[i : i + 8]) for i in range(5)}
    want = {}
    for i, (d, t, _) in enumerate(letter):
        own = sets(t)
        if any(e is not None and d is not None and (e < d or e == d and j < i) and 100 * len(own & sets(u)) >= 80 * len(own | sets(u)) for j, (e, u, _) in enumerate(letter)):
            continue
        words = A.findall(low(t))
        if any(tuple(words[k : k + 8]) in windows for k in range(len(words))):
            continue
        want[d] = len(W.findall(re.sub(r"password = \w+", "[REDACTED]", t)))
    assert got == want and {51, 5, 3, 60, 40} - want.keys() == {51, 60, 40} and 61 in want and None in want
    docs.limit(0).write.parquet(f"{folder}/b/documents.parquet")
    bench.limit(0).write.parquet(f"{folder}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/b").isEmpty()


def test_chains_are_aligned_in_pieces():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(2_000)) for _ in range(60)]
    runs = [{"doc": 1_000 + i, "first": 0, "last": 200, "other": i, "other_first": 0, "other_last": 200, "runs": [0, 0, 200], "before": 0} for i in range(60)]
    words = {i: w.tolist() for i, w in chaining._doc_words(pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["key", "text"]))}
    chains = [[{**r, "words": words[i][:200]}] * 200 for i, r in enumerate(runs)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts), pa.array(chains)], names=["key", "text", "chains"])
    out = list(chaining._align_rows(50, 0.8, 8)([batch]))
    assert max(len(b) for b in out) < 4_000
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(1_000 + i, 0, 200, i, 0, 200, 1.0) for i in range(60) for _ in range(200)]


def test_common_length_by_brute_force():
    rng = random.Random(10)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(12))]
        b = [x if rng.random() < 0.8 else rng.randrange(4) for x in a] + [rng.randrange(4)] * rng.randrange(3)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert chaining.common_length(a, b) == best[-1][-1]

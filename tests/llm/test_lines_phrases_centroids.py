"""op11 (line dedup), op12 (collocations) and op13 (centroid clustering) against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from epiframe.llm import centroids, collocations, line_dedup, perfect_hash
from tests.llm.test_operators import documents, prose

# --- the minimal perfect hash ---------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_places_are_a_permutation(n):
    rng = np.random.default_rng(n)
    high, low = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
    high[: n // 2] = high[:1] if n else 0  # halves may repeat as long as keys differ
    values = np.arange(n, dtype=np.int64)
    index = perfect_hash.Index(perfect_hash.build(0, high, low, values).to_pylist(), 1, np.int64)
    assert sorted(index.place(high, low).tolist()) == list(range(n))
    rows, found = index.find(high, low)
    assert rows.tolist() == list(range(n)) and found.tolist() == values.tolist()
    other = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    assert len(index.find(other, other)[0]) == 0
    if n == 5000:
        assert 8 * len(index.bits) * 8 / n < 4  # bits a key


def test_shards_answer_as_one():
    rng = np.random.default_rng(3)
    high, low = (rng.integers(0, 2**64, 3000, dtype=np.uint64) for _ in range(2))
    of, values = perfect_hash.shard_of(high, 7), np.arange(3000, dtype=np.int64)
    rows = [r for s in range(6) for r in perfect_hash.build(s, high[of == s], low[of == s], values[of == s]).to_pylist()]  # shard 6 has no row
    found, got = perfect_hash.Index(rows, 7, np.int64).find(high, low)
    assert found.tolist() == np.flatnonzero(of < 6).tolist() and got.tolist() == found.tolist()


# --- op11 ------------------------------------------------------------------


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(rows, min_docs=5, min_chars=40):
    holders, last = Counter(), {}
    order = lambda d: -(1 << 70) if d is None else d
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    for doc, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k] += 1
                last[k] = max(last.get(k, order(None)), order(doc))
    out = []
    for doc, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not (holders[key(x)] >= min_docs and order(doc) < last[key(x)])]
        out.append((doc, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows(spark, rows, **how):
    out = line_dedup.drop_repeated_lines(documents(spark, rows), digest=True, **how)
    return sorted((tuple(r) for r in out.select("doc_id", "_lines", "_dropped", "_kept").collect()), key=str)


def line_cases():
    rng = random.Random(11)
    hot, edge, wide = prose(rng, 12), "x" * 40, "é" * 40
    rows = [(0, None), (1, ""), (2, "\n"), (3, "a\n\nb\n"), (4, " \t\r\n\x0b"), (None, hot), (None, hot.upper())]
    rows += [(10 + i, f"{prose(rng, 3)}\n  {hot.upper() if i % 2 else hot}\r\n{hot}\n{prose(rng, 20)}") for i in range(30)]
    rows += [(50 + i, f"{edge}\n{edge[:-1]}\n{wide}\n{wide[:-1]}\n" + "tail " * 30) for i in range(5)]
    rows += [(60 + i, "four holders have this line, no more than that, so it stays") for i in range(4)]
    rows += [(70, hot), (70, hot), (71, "\x1c" + "y" * 50), (72, "y" * 50)]
    rows += [(80 + i, f"only this one line stands in the whole text of five documents") for i in range(5)]
    rows += [(90, "\n".join([hot] * 500 + [prose(rng, 2000)]))]
    return rows


@pytest.mark.parametrize("how", [{}, {"sent_bytes": 0}], ids=["sent", "dealt"])
def test_line_dedup_equals_brute_force(spark, how):
    rows = line_cases()
    assert line_rows(spark, rows, **how) == brute_lines(rows)


def test_line_dedup_of_heavy_lines_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY", 4)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    rows = line_cases()
    for how in ({}, {"sent_bytes": 0}):
        assert line_rows(spark, rows, **how) == brute_lines(rows)


@pytest.mark.parametrize("how", [{}, {"sent_bytes": -1}], ids=["sent", "dealt"])
def test_line_dedup_of_empty_tables_and_null_ids(spark, how):
    same = "a line that only documents without an id have, and they all keep it"
    assert line_rows(spark, [], **how) == []
    assert line_rows(spark, [(None, same)] * 6, **how) == brute_lines([(None, same)] * 6)


def test_line_dedup_keeps_texts_and_other_columns(spark):
    line = "this line of more than forty code points stands in five documents"
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(documents(spark, [(i, f"a \n{line}\n b") for i in range(5)])).collect()}
    assert (out[0]._kept, out[0]._dropped, out[0].extra, out[0].size) == ("a \n b", 1, 1, 3)
    assert (out[4]._kept, out[4]._dropped) == (f"a \n{line}\n b", 0)


# --- op12 ------------------------------------------------------------------


def brute_phrases(rows, longest=3, least=10, top=2000, share=50):
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", low(t or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        kept = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * b >= share * a for q, b in counts.items() if len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(kept[:top])]
    return sorted(out)


def phrase_rows(spark, rows, **how):
    df = spark.createDataFrame([(i, lang, t, "x", 1, 2) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, f long, rank int")
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


def phrase_cases():
    rng = random.Random(12)
    rows = [(None, None), ("en", ""), ("en", " \t"), (None, "a a a a a a a a a a a a"), ("und", "B b. b b"), ("xx", "..;!")]
    rows += [(rng.choice(["en", "fr", None]), ", ".join(prose(rng, rng.randrange(1, 9), 6).upper() if rng.random() < 0.2 else prose(rng, rng.randrange(1, 9), 6) for _ in range(8))) for _ in range(60)]
    rows += [("fr", "New\x0bYork City \t é É\x1c"), ("fr", "new york city " * 20), ("fr", "new york city")] * 2
    return rows


@pytest.mark.parametrize("size", [1, 300, 8 << 20])
def test_collocations_equal_brute_force(spark, size):
    rows = phrase_cases()
    assert phrase_rows(spark, rows, shard_bytes=size) == brute_phrases(rows)


def test_collocations_of_four_words_and_a_few_ranks(spark):
    rows = phrase_cases()
    assert phrase_rows(spark, rows, longest=4, top=7, least=4) == brute_phrases(rows, longest=4, top=7, least=4)
    assert phrase_rows(spark, rows, longest=2) == brute_phrases(rows, longest=2)
    assert phrase_rows(spark, rows, filter_bits=8) == phrase_rows(spark, rows, filter_bits=1 << 16) == brute_phrases(rows)


def test_collocations_of_empty_tables(spark):
    assert phrase_rows(spark, []) == []
    assert phrase_rows(spark, [(None, None), ("en", "")]) == []


def test_the_filter_leaves_out_rare_phrases_only(spark):
    df = spark.createDataFrame(phrase_cases(), "lang string, text string")
    every = {tuple(r) for r in collocations.phrase_counts(df, least=1).collect()}
    assert {tuple(r) for r in collocations.phrase_counts(df, least=10).collect()} == {r for r in every if r[2] >= 10}


def test_scores_beyond_64_bits(spark):
    a, l, r = 3_000_000_007, 9_000_000_011, 4_000_000_003
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(f"{collocations.SCORE} as s").first().s
    assert got == 1000000 * a * a // (l * r)


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_suffix_array_and_common_prefixes(longest):
    rng = np.random.default_rng(longest)
    word = rng.integers(0, 3, 200)
    ends = np.append(np.flatnonzero(rng.random(200) < 0.2), 199)
    left = ends[np.searchsorted(ends, np.arange(200))] - np.arange(200) + 1
    order, common = collocations.suffix_array(word, left, longest)
    key = lambda i: tuple(word[i : i + min(longest, left[i])])
    assert [key(i) for i in order] == sorted(key(i) for i in range(200))
    for i in range(1, 200):
        a, b = key(order[i - 1]), key(order[i])
        assert common[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


# --- op13 ------------------------------------------------------------------


def brute_clusters(rows, k, rounds, width):
    kept = [(i, [int(np.floor(256.0 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in named[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((gap(v, c), j) for j, c in enumerate(now))
    for _ in range(rounds if now else 0):
        held = defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        now = [[sum(x) // len(held[j]) for x in zip(*held[j])] if held[j] else c for j, c in enumerate(now)]
    out = [(i, *near(v)[::-1]) for i, v in kept] if now else []
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, c, d in out), key=str)


def cluster_rows(spark, table, k, rounds, width, **how):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in table], "vec_id long, embedding array<double>, cluster int, id int, v string")
    got = centroids.with_inertia(*centroids.clusters(df, k=k, rounds=rounds, width=width, **how))
    return sorted((tuple(r) for r in got.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def vectors(rng, n, width, spread):
    middles = rng.normal(0, 20, (9, width))
    return [(i, (middles[i % 9] + rng.normal(0, spread, width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.01, 5.0])
def test_clusters_equal_brute_force(spark, spread):
    rng = np.random.default_rng(13)
    rows = vectors(rng, 700, 4, spread)
    rows += [(900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("-inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5]), (905, [])]
    rows += [(906, [-0.001, 0.0, 1.0, -1.0])] * 3 + [(907, [40000.0, -40000.0, 0.25, 0.0]), (5, rows[5][1]), (5, rows[6][1])] + [(1000 + i, [3.0] * 4) for i in range(200)]
    assert cluster_rows(spark, rows, 12, 3, 4, rows=128) == brute_clusters(rows, 12, 3, 4)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 5.0])]
    assert cluster_rows(spark, rows, 40, 5, 2) == brute_clusters(rows, 40, 5, 2)
    assert cluster_rows(spark, [], 40, 5, 2) == [] and cluster_rows(spark, [(None, [1.0, 2.0])], 40, 5, 2) == []


def test_whole_balls_are_assigned_without_their_vectors():
    rng = np.random.default_rng(5)
    points = np.array([v for _, v in vectors(rng, 4000, 8, 0.1)]) * 256
    points = np.floor(points).astype(np.int64)
    t = centroids.Tree(points)
    tree = {name: np.array(getattr(t, name)) for name in ("sums", "radius", "low", "high", "left", "right")}
    found = list(centroids.balls(tree, points[:9]))
    whole = sum(tree["high"][at] - tree["low"][at] for at, near in found if len(near) == 1)
    assert whole > 3500 and len(found) < 200
    assert sum(tree["high"][at] - tree["low"][at] for at, _ in found) == 4000
    best, _ = centroids.nearest(t.vectors, points[:9])
    for at, near in found:
        assert set(best[tree["low"][at] : tree["high"][at]]) <= set(near.tolist())


def test_ties_go_to_the_smaller_centroid_and_large_numbers_are_exact():
    c = np.array([[2, 0], [0, 2], [-2, 0]])
    assert [x.tolist() for x in centroids.nearest(np.array([[0, 0], [-1, 0], [1, 1]]), c)] == [[0, 2, 0], [4, 1, 2]]
    big = np.array([[1 << 30, 0], [(1 << 30) + 1, 0]])
    assert [x.tolist() for x in centroids.nearest(big, np.array([[0, 0], [(1 << 30) + 2, 0]]))] == [[1, 1], [4, 1]]

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epiframe.llm import chat_format, decontaminate, html_text, language_id, license_digest, near_dedup, packing, quality, queries, substring_dedup, textscan, top_k
from epiframe.llm.components import components
from epiframe.llm.sampling import held_out, per_label
from tests.oracle import check, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, extra int, _text string, id long, size int"


def words(text):
    return WORD.findall(text or "")


def documents(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, 1, "x", 7, 3) for i, t in rows], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, sf, name):
    check(spark, connect(sf), queries.QUERIES[name], queries.ORACLES[name], sf)


@pytest.mark.parametrize("lower", [False, True])
def test_word_scan_equals_regex(lower):
    texts = ["", "  ", "a", "Ab  aB\tab\n\nÉté ÉTÉ\x0b\x0c x\x1cy\xa0z", None, "end"]
    seen = defaultdict(set)
    for lo, hi, raw, at in textscan.chunks(pa.array(texts), 8):
        w = textscan.Words(raw, at, lower)
        for i in range(lo, hi):
            found = words(texts[i])
            a, b = w.first[i - lo], w.first[i - lo + 1]
            assert [bytes(raw[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b])] == found
            for x, h in zip(found, w.hash[a:b]):
                seen["".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in x)].add(int(h))
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)


# --- op8 -------------------------------------------------------------------


def brute_windows(rows, width):
    counts = Counter(tuple(w[i : i + width]) for _, t in rows for w in [words(t)] for i in range(len(w) - width + 1))
    out = []
    for doc, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def window_rows_of(spark, rows):
    out = substring_dedup.remove_repeats(documents(spark, rows), digest=True)
    return sorted(((r.doc_id, r._words, r._removed, r._kept) for r in out.select("doc_id", "_words", "_removed", "_kept").collect()), key=str)


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    passage, hot = prose(rng, 60), prose(rng, 36)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "the " * 80), (4, "a b c " * 30), (5, prose(rng, 34)), (6, prose(rng, 35)), (7, passage), (None, passage)]
    rows += [(100 + i, f"{prose(rng, 20)} {hot} {prose(rng, 20)}") for i in range(20)]
    rows += [(200 + i, f"{prose(rng, rng.randrange(40))} {passage[: rng.randrange(80, 250)]} {prose(rng, 5)}") for i in range(20)]
    rows += [(300, rows[-1][1]), (300, rows[-1][1]), (301, "é " * 10 + prose(rng, 3000, 3))]
    assert window_rows_of(spark, rows) == brute_windows(rows, 35)


def test_substring_dedup_of_an_empty_table(spark):
    assert window_rows_of(spark, []) == []


def test_substring_dedup_keeps_texts_without_repeats(spark):
    out = substring_dedup.remove_repeats(documents(spark, [(1, "a  b\nc")])).first()
    assert (out._kept, out._removed, out.extra, out.size) == ("a  b\nc", 0, 1, 3)


# --- op4 -------------------------------------------------------------------


def brute_components(rows):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    sets = {}
    for doc, t in rows:
        w = words(low(t or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets.items())


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**9)}"
    return " ".join(w)


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "one two three")]
    hot = prose(rng, 120, 5000)
    for g in range(8):
        base = prose(rng, 150, 5000)
        rows += [(100 * g + 10 + i, edited(rng, base, i % 7)) for i in range(12)]
    rows += [(2000 + i, f"{hot} {prose(rng, rng.randrange(10, 90), 5000)}") for i in range(80)]
    base = prose(rng, 200, 5000)
    rows += [(3000 + i, edited(rng, base, rng.randrange(4))) for i in range(60)]
    out = near_dedup.near_duplicates(documents(spark, rows))
    assert sorted(tuple(r) for r in out.collect()) == brute_components(rows)


def test_near_dedup_of_rows_without_ids_repeated_rows_and_no_rows(spark):
    text = "a b c d e f g"
    out = near_dedup.near_duplicates(documents(spark, [(5, text), (5, text), (None, text), (9, text.upper())])).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(5, 3, 5), (5, 3, 5), (None, 3, None), (9, 3, 5)]))
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_near_dedup_of_texts_that_share_an_id(spark):
    rng = random.Random(22)
    a, b, c = (prose(rng, 80, 5000) for _ in range(3))
    rows = [(5, a), (5, b), (3, a), (9, b + " z1"), (9, b), (20, c), (21, c + " end"), (20, prose(rng, 40, 5000)), (30, ""), (30, None), (31, "")]
    out = near_dedup.near_duplicates(documents(spark, rows)).collect()
    got = defaultdict(set)
    for r in out:
        got[r.id].add(r.component)
    assert got == {5: {3}, 3: {3}, 9: {3}, 20: {20}, 21: {20}, 30: {30}, 31: {31}} and len(out) == len(rows)


def test_near_dedup_of_very_long_texts(spark):
    rng = random.Random(23)
    long = prose(rng, 120_000, 50_000)
    rows = [(1, long), (2, long + " one more"), (3, prose(rng, 60_000, 50_000)), (4, "x" * 1_000_000), (5, "x" * 1_000_000)]
    assert {r.id: r.component for r in near_dedup.near_duplicates(documents(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_staged_tables_go(spark):
    from pathlib import Path

    from epiframe.llm import staging

    folder = Path(staging.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    near_dedup.near_duplicates(documents(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "z")])).collect()
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert {"epiframe-described", "epiframe-components"} <= left and not left & {"epiframe-sets", "epiframe-regions", "epiframe-links"}
    with staging.scratch(spark):
        near_dedup.near_duplicates(documents(spark, [(1, "a b c")])).collect()
        inside = set(folder.iterdir())
    assert inside > set(folder.iterdir())


def test_prefix_join_finds_every_link(spark):
    rng = random.Random(3)
    sets = {i: frozenset(rng.sample(range(60), rng.randrange(15, 40))) for i in range(120)}
    for i in range(0, 120, 3):
        sets[i + 1] = frozenset(list(sets[i])[1:]) | {1000 + i}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, set array<long>")
    crowd = df.select("id", F.col("id").alias("component"))
    pairs = {tuple(r) for r in near_dedup._prefix_pairs(crowd, df, 75).collect()}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                assert (a, b) in pairs


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(25)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            for x in (a, b):
                root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op2 -------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randrange(15, 60), 3000)) for i in range(30)] + [(30, None), (31, ""), (32, "a b"), (None, "x " * 20)]
    rows, want = [(0, None), (1, ""), (2, prose(rng, 500, 3000))], set()
    for i, t in items[:30]:
        rows.append((10 + i, f"{prose(rng, 30, 3000)} {t.upper().replace(' ', ', ')} {prose(rng, 30, 3000)}"))
        rows.append((100 + i, f"{prose(rng, 7, 3000)} {edited(rng, t, int(0.1 * len(t.split())))}"))
        rows.append((200 + i, f"{prose(rng, 50, 3000)} {edited(rng, t, len(t.split()))}"))
        want |= {(10 + i, i), (100 + i, i)}
    rows.append((10, rows[3][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(documents(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(got) == len(want)
    assert all(r.edits == 0 and r.start_word == 30 for r in got if 10 <= r.doc_id < 100)
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0
    assert decontaminate.contaminated(documents(spark, rows), bench.limit(0)).count() == 0


def test_short_items_match_exactly(spark):
    items = [(1, "Paris"), (2, "forty two"), (3, "the red planet"), (4, "two plus two four"), (5, "a b c d e f"), (6, "PARIS!"), (7, "?"), (8, "one two three four five six seven")]
    rows = [(10, "In Paris, paris"), (11, "It is forty-two."), (12, "forty"), (13, "two"), (14, "It is the RED planet"), (15, "the red big planet"), (16, "two plus two: four"), (17, "x a b c d e f"), (18, "a b c d e"), (19, "Parisian"), (20, "zero one two three 4 five six seven"), (None, "Paris")]
    got = decontaminate.contaminated(documents(spark, rows).coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(10, 1, 0, 1), (10, 6, 0, 1), (11, 2, 0, 2), (14, 3, 0, 2), (16, 4, 0, 0), (17, 5, 0, 1), (20, 8, 1, 1), (None, 1, 0, 0), (None, 6, 0, 0)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def brute_matches(items, rows):
    """Every (document, item) with a span within the bound, by the exact edit distance of each item to each whole text."""
    code = defaultdict(lambda: len(code))
    fold = lambda t: np.array([code[w] for w in re.findall("[^\\W_]+", (t or "").lower())], np.int64)
    out = {}
    for d, t in rows:
        for i, item in items:
            a, b = fold(item), fold(t)
            if len(a) and len(b):
                edits, _ = decontaminate.best_span(a, b)
                if edits <= decontaminate.bound(len(a)):
                    out[d, i] = edits
    return out


def test_decontamination_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PORTION", 50)
    rng = random.Random(51)
    stock = prose(rng, 12, 500)
    items = [(i, f"{stock} {prose(rng, n, 500)}") for i, n in enumerate([3, 5, 8, 13, 21, 34, 55, 90, 140] * 3)] + [(40 + n, prose(rng, n, 500)) for n in range(1, 15)]
    items += [(90, items[4][1]), (91, items[4][1].upper())]
    rows = [(i, prose(rng, rng.randrange(60, 400), 500)) for i in range(20)] + [(50 + i, " ".join([stock] * 6)) for i in range(3)]
    for j, (i, t) in enumerate(items):
        w = t.split()
        for share in (0, 0.05, 0.1, 0.15):
            rows.append((1000 + 10 * j + int(100 * share), f"{prose(rng, 30, 500)} {' '.join(within_the_bound(rng, w, share))} {prose(rng, 30, 500)}"))
    rows.append((9000, prose(rng, 30_000, 500) + " " + items[8][1]))
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_matches(items, rows)
    assert got.keys() <= want.keys() and all(got[k] >= want[k] for k in got)
    assert all(got[k] == 0 for k, e in want.items() if e == 0)
    assert len(got) >= 0.97 * len(want) and sum(got[k] == want[k] for k in got) >= 0.98 * len(got)


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    items = [(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(5)]
    got = decontaminate.contaminated(documents(spark, items), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(i, i, 0) for i in range(5)]


def test_cgk_recall_at_the_bound():
    rng = random.Random(6)
    items = [[f"v{rng.randrange(3000)}" for _ in range(rng.randrange(15, 60))] for _ in range(150)]
    block = decontaminate.Block(list(range(150)), [" ".join(i) for i in items], decontaminate.EDITS, decontaminate.TABLES, decontaminate.SAMPLE)
    hits = 0
    for i, w in enumerate(items):
        w = list(w)
        for _ in range(decontaminate.bound(len(w))):
            kind, at = rng.randrange(3), rng.randrange(len(w))
            w[at : at + (kind < 2)] = [f"z{rng.randrange(10**9)}"] if kind else []
        raw = np.frombuffer(" ".join(["a"] * 40 + w + ["b"] * 40).encode(), np.uint8)
        gathered = {}
        block.gather(raw, np.array([0, len(raw)]), 0, gathered)
        hits += i in {m[1] for m in block.decide(gathered)}
    assert hits >= 0.95 * 150


def within_the_bound(rng, w, share=decontaminate.EDITS):
    w = list(w)
    for _ in range(decontaminate.bound(len(w), share)):
        kind, at = rng.randrange(3), rng.randrange(len(w))
        w[at : at + (kind < 2)] = [f"z{rng.randrange(10**9)}"] if kind else []
    return w


@pytest.mark.parametrize("n", [60, 120, 250, 400, 800])
def test_cgk_recall_of_long_items_at_the_bound(n):
    rng, count = random.Random(61), 60
    items = [[f"v{rng.randrange(3000)}" for _ in range(n)] for _ in range(count)]
    block = decontaminate.Block(list(range(count)), [" ".join(i) for i in items], decontaminate.EDITS, decontaminate.TABLES, decontaminate.SAMPLE)
    text = " ".join(f"{' '.join(within_the_bound(rng, w))}{' b' * 3 * n}" for w in items)
    raw, gathered = np.frombuffer(text.encode(), np.uint8), {}
    block.gather(raw, np.array([0, len(raw)]), 0, gathered)
    hits = {i: (edits, start) for _, i, edits, start in block.decide(gathered)}
    assert len(hits) >= 0.95 * count
    assert all(edits <= decontaminate.bound(n) for edits, _ in hits.values())


@pytest.mark.parametrize("n", range(1, 400))
def test_pieces_make_the_item(n):
    c = decontaminate.cuts(n)
    sizes = [b - a for a, b in zip(c, c[1:])]
    assert c[0] == 0 and c[-1] == n and all(0 < s <= decontaminate.LONGEST for s in sizes)
    assert n <= decontaminate.LONGEST or min(sizes) > decontaminate.LONGEST // 2


def test_best_span_equals_dynamic_programme():
    rng = np.random.default_rng(7)
    for _ in range(40):
        item, text = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 12))
        d = np.zeros((len(item) + 1, len(text) + 1), int)
        d[:, 0] = np.arange(len(item) + 1)
        for i in range(1, len(item) + 1):
            for j in range(1, len(text) + 1):
                d[i, j] = min(d[i - 1, j - 1] + (item[i - 1] != text[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
        assert decontaminate.best_span(item, text) == (d[-1].min(), int(np.argmin(d[-1])))


# --- op3 -------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("open_windows", [1024, 3])
def test_packing_is_an_exact_partition(spark, tokenizer, open_windows):
    rng = random.Random(8)
    odd = [None, "", "  ", "don't THEM's %%% a<|endoftext|>b <|ENDOFTEXT|>", "x\x1cy \x85z a\u00a0b\u3000c", "ÉCOLE e\u0301 ŒUVRE ß 日本語", "word " * 20000]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, prose(rng, rng.randrange(1, 900))) for i in range(150)] + [(None, "no id")]
    out = packing.pack(documents(spark, rows).repartition(2), public_tokenizers.path("word_bpe_49k.json"), window=512, open_windows=open_windows).collect()
    ids = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert list(part) == r.ids and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 512
        padding += 0 if at & (at - 1) == 0 else 512 - at
    assert padding == 0


def test_sum_of_squares_choice():
    p = packing.Packer(10, 100, 0)
    one = lambda n: b"\0" * 4 * n
    for doc, n in enumerate((6, 6, 3, 3)):
        p.add(doc, one(n))
    # Two windows at 6 score 4; a third document of 3 lowers the sum by splitting them.
    assert dict(Counter({h: int(c) for h, c in enumerate(p.levels) if c})) in ({6: 1, 9: 1, 3: 1}, {9: 2})
    p.add(9, one(4))
    p.join()
    assert sum(len(r[2]) // 4 for r in p.done) == 22


def test_one_window_closes_when_too_many_are_open():
    p = packing.Packer(10, 4, 0)
    for doc in range(9):
        p.add(doc, bytes([doc]) * 4 * 7)
        assert p.count <= 4 and p.count == sum(map(len, p.open.values())) == int(p.levels.sum())
    assert p.done
    sizes = Counter()
    for _, _, ids, _, sequence, _ in p.done:
        sizes[sequence] += len(ids) // 4
    assert set(sizes.values()) == {10}
    p.join()
    pieces = defaultdict(list)
    for doc, start, ids, total, _, _ in p.done:
        assert set(ids) == {doc} and total == 7
        pieces[doc] += range(start, start + len(ids) // 4)
    assert all(sorted(v) == list(range(7)) for v in pieces.values()) and len(pieces) == 9


def test_other_tokenizers_encode_whole_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, texts = Tokenizer.from_file(path), ["Two Words, here.\n\n And  MORE", None, "", "a" * 5000]
    got = {r.doc_id: r for r in packing.pack(documents(spark, list(enumerate(texts))), path, window=8192, end_id=7).collect()}
    want = {i: other.encode(t or "", add_special_tokens=False).ids + [7] for i, t in enumerate(texts)}
    joined = defaultdict(list)
    for r in sorted(packing.pack(documents(spark, list(enumerate(texts))), path, window=8192, end_id=7).collect(), key=lambda r: (r.doc_id, r.start)):
        joined[r.doc_id] += r.ids
    assert joined == want and got.keys() == want.keys()


def test_token_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    cache = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"w{i}x{j}" for j in range(50)).encode() for i in range(20)] + [b"y" * 5000, b"w0x1 w19x3"]
    plain = packing.WholeTexts(public_tokenizers.path("word_bpe_49k.json"))
    assert cache.encode(texts) == plain.encode(texts)
    size = sum(packing.ENTRY_BYTES + len(k) + len(v) for k, v in cache.items())
    assert size == cache.held <= 20_000 and max(map(len, cache)) <= packing.LONG_WORD


def test_packing_packs_repeated_rows_again(spark):
    out = packing.pack(documents(spark, [(1, "same text")] * 3), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in out) == 3 * out[0].doc_tokens


def test_packing_of_an_empty_table(spark):
    assert packing.pack(documents(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# --- op1 -------------------------------------------------------------------

PARAGRAPH = "Some words of a paragraph, with a comma, that go on for a while. And another sentence follows here."
PAGES = {
    "article": f'<html><head><title>T</title><style>x</style></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy!</div><article><h1>Head &amp; line</h1><p>{PARAGRAPH}</p><p>Short.</p><ul><li>An item.</li></ul></article><footer>&copy; me</footer></body></html>',
    "soup": f'<body><div id="top-menu"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class=main><div class=post><h2>Head &amp; line<h2></h2><p>{PARAGRAPH}<p>Short.<ul><li>An item.</ul></div><div class="comment-list"><p>{PARAGRAPH} I disagree, with that, wholly.</p></div></div><div class="sidebar"><p>Related, things. To read, now.</p></div><form>Name: <input> <button>Go</button></form><div class="cookie-notice">We use cookies, to track. Accept?</div>',
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of_templates(name):
    assert html_text.main_text(PAGES[name]) == f"Head & line {PARAGRAPH} Short. An item."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain a &lt; b", "plain a < b"),
        ("<p>bo<b>ld</b> te<!-- x -->xt</p>", "bold text"),
        ("<p>one<br>two</p", "one two"),
        ("<nav>only menu</nav>", ""),
        ("<script>if (a < b) { x = '</p>' }</script>", ""),
        ("<p>a &#233;&nbsp;\n b</p>", "a é b"),
        ("<div hidden>secret words, here.</div><div>Seen words, here.</div>", "Seen words, here."),
    ],
)
def test_main_text_edges(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("wrapper", ['class="content-sidebar-wrap"', 'class="site has-sidebar"', 'class="no-sidebar"', 'class="page-with-nav"', 'class="comments-open"', 'id="content-with-ads"', 'class="widget"'])
@pytest.mark.parametrize("inner", ["article", "main", 'div class="post"'])
def test_layout_wrappers_keep_their_article(wrapper, inner):
    if "widget" in wrapper and "div" in inner:
        pytest.skip("an element that is named a widget and has no article is one")
    side = f'<div class="sidebar"><p>Related, things. To read, now.</p></div><div class="comments-area"><article class="comment-body"><p>I disagree, wholly.</p></article></div>' if inner == "article" else '<div class="sidebar"><p>Related, things. To read, now.</p></div>'
    page = f'<body><div id="top-menu"><ul><li><a href=a>One</a></ul></div><div {wrapper}><{inner}><h1>Head</h1><p>{PARAGRAPH}</p><div class="ad-slot"><p>Buy, now.</p></div><p>{PARAGRAPH}</p></{inner.split()[0]}>{side}</div></body>'
    assert html_text.main_text(page) == f"Head {PARAGRAPH} {PARAGRAPH}"


SECOND = "Another paragraph, longer than the first, tells of other things, at length. It ends here, after some more words."
MENU = '<div><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></div>'
LYING = [
    (f'<body>{MENU}<div class="share-price"><p>{PARAGRAPH}</p><p>{SECOND}</p></div></body>', f"{PARAGRAPH} {SECOND}"),
    (f'<body>{MENU}<article><p>{PARAGRAPH}</p><div class="notice-board"><p>{SECOND}</p></div></article></body>', f"{PARAGRAPH} {SECOND}"),
    (f'<body><form action="/"><div class="page">{MENU}<div><p>{PARAGRAPH}</p><p>{SECOND}</p></div></div></form></body>', f"{PARAGRAPH} {SECOND}"),
    (f'<body>{MENU}<div class="widget"><p>{PARAGRAPH}</p><p>{SECOND}</p></div></body>', f"{PARAGRAPH} {SECOND}"),
]
PLAIN = [
    (f"<body>{MENU}<div><h1>Head</h1><p>{PARAGRAPH}</p><ul><li>An item</li></ul><p>{SECOND}</p></div><div>Buy now</div></body>", f"Head {PARAGRAPH} An item {SECOND}"),
    (f"<body>{MENU}<h1>Head</h1><p>{PARAGRAPH}</p><ul><li>An item</li></ul><p>{SECOND}</p><div>Buy now</div></body>", f"Head {PARAGRAPH} An item {SECOND}"),
    (f"<head><title>T</title><div class=x>{MENU}<div><p>{PARAGRAPH}<p>{SECOND}</div><div><a href=/>A link, in a box.</a></div></div>", f"{PARAGRAPH} {SECOND}"),
    (f'<body>{MENU}<article><p>{PARAGRAPH}</p><ul><li><a href="/s">A source</a></li></ul></article></body>', f"{PARAGRAPH} A source"),
]


@pytest.mark.parametrize("page,text", LYING + PLAIN)
def test_names_only_weigh_and_ratios_choose(page, text):
    assert html_text.main_text(page) == text


def test_without_ratios_the_text_is_not_found(monkeypatch, spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()] + [p for p, _ in PLAIN[:3]] + list(PAGES.values())
    right = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "content_paths", lambda page: {b[0] for b in page.blocks})
    assert sum(html_text.main_text(p) == t for p, t in zip(pages, right)) <= 0.1 * len(pages)


def test_deep_nesting_takes_linear_memory():
    import tracemalloc

    peaks = []
    for n in (8_000, 32_000):
        tracemalloc.start()
        assert html_text.main_text("<div>ab, c. " * n) == " ".join(["ab, c."] * n)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] < 6 * 40e6


def test_extract_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "<p>Hi.</p>", "y"), (2, "<p>Hi.</p>", "y")], "page_id long, html string, _text2 string")
    assert sorted((r.page_id, r._text, r._text2) for r in html_text.extract(df).collect()) == [(1, "", "x"), (2, "Hi.", "y"), (2, "Hi.", "y")]
    assert html_text.extract(df.limit(0)).count() == 0
    assert html_text.main_text("<p>" + "word, " * 100_000).count("word") == 100_000


def test_pages_give_their_articles(spark, sf):
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        assert html_text.main_text(r.html) == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


# --- op5 -------------------------------------------------------------------


def test_license_spellings(spark):
    mit = dict(license_digest.LICENSES)["MIT"]
    same = ["MIT\n"[:0] + mit, f"Copyright (c) 2020 Some One\n\n{mit}", "© 1999 X\n(c) 2001 Y\n" + mit.upper(), mit.replace("sublicense", "sub-licence").replace(" ", "\r\n").replace('"', "“")]
    same += [f"Copyright (c) 2020 Some One. {mit}", f"Copyright 2019 A\nCopyright 2020 B, C <c@d.org> All rights reserved. {mit}", mit]
    other = [None, "", mit + " more", mit[: len(mit) // 2], "The above copyright notice"]
    out = license_digest.scan(documents(spark, list(enumerate(same + other)))).select("doc_id", "_license").collect()
    assert [r._license for r in sorted(out, key=lambda r: r.doc_id)] == ["MIT"] * len(same) + [None] * len(other)
    assert license_digest.scan(documents(spark, [])).count() == 0


def test_license_of_very_long_texts_repeated_rows_and_its_sql(spark, tmp_path):
    import duckdb

    mit, isc = dict(license_digest.LICENSES)["MIT"], dict(license_digest.LICENSES)["ISC"]
    rows = [(1, mit), (1, mit), (2, f"(c) 2001 X {isc}"), (3, "word " * 400_000 + mit), (4, "copyright " * 100_000), (5, isc + " not"), (None, mit), (6, f"Copyright 2020 a\n© b\n{isc}")]
    df = documents(spark, rows)
    got = license_digest.scan(df).select("doc_id", F.col("_digest").alias("digest"), F.col("_license").alias("license_id")).collect()
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(license_digest.ORACLE).fetchall()))
    assert Counter(r.license_id for r in got) == {"MIT": 3, "ISC": 2, None: 3}


def test_license_digests_are_distinct(spark):
    assert license_digest.catalogue(spark).select("license_digest").distinct().count() == len(license_digest.LICENSES)


def test_license_files_are_known(spark):
    from pathlib import Path

    short = dict(license_digest.LICENSES)
    bullets = short["BSD-3-Clause"].replace(" 1. ", "\n\n* ").replace(" 2. ", "\n\n* ").replace(" 3. ", "\n\n* ")
    rows = [("MIT", f"MIT License\n\nCopyright (c) 2020 X\n\n{short['MIT']}\n"), ("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2015 X\n\n{short['MIT']}"), ("ISC", f"ISC License\n\nCopyright (c) 2020, X\n\n{short['ISC']}")]
    rows += [("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n{t}") for t in (short["BSD-3-Clause"], bullets)]
    full = sorted((Path(license_digest.__file__).parent / "licenses").glob("*.txt"))
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSL-1.0"} <= {f.stem for f in full}
    rows += [(f.stem, f.read_text()) for f in full] + [(None, full[0].read_text() + " more"), (None, "MIT License")]
    out = license_digest.scan(documents(spark, [(i, t) for i, (_, t) in enumerate(rows)])).select("doc_id", "_license").collect()
    assert [r._license for r in sorted(out, key=lambda r: r.doc_id)] == [i for i, _ in rows]


def test_license_table_is_that_of_the_texts(spark):
    from epiframe.llm import license_variants

    known = license_digest.known_forms(spark).collect()
    assert sorted(map(tuple, known)) == license_variants.digests(spark)
    assert {tuple(r) for r in license_digest.catalogue(spark).collect()} <= set(map(tuple, known))


def test_license_plan_is_native(spark, sf):
    plan = queries.op5_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- op6, op9 --------------------------------------------------------------


def test_language_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    model = language_id.train(spark.createDataFrame([(i, "en" if i % 2 else "de", "the of and" if i % 2 else "der die und") for i in range(40)], "doc_id long, lang string, text string"))
    out = {r.doc_id: r for r in language_id.predict(documents(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "the und of and the"), (5, "der " * 50000)]), model).collect()}
    assert [out[i]._lang for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    odd = [(1, "²"), (2, "½ 3"), (3, "_"), (4, "ª"), (5, "日本"), (5, "日本")]
    assert [r._lang == "und" for r in sorted(language_id.predict(documents(spark, odd), model).collect(), key=lambda r: r.doc_id)] == [True, True, True, False, False, False]
    assert language_id.predict(documents(spark, []), model).count() == 0
    none = language_id.train(spark.createDataFrame([], "doc_id long, lang string, text string"))
    assert language_id.predict(documents(spark, [(1, "word")]), none).first()._lang == "und"


def test_quality_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op9_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    clean = [r.predicted for r in out if r.quality == 1]
    junk = [r.predicted for r in out if r.quality == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.2 * len(junk)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    model = quality.train(documents(spark, [(1, "a"), (2, "b")]), labels)
    out = {r.doc_id: r._score for r in quality.score(documents(spark, [(1, None), (2, "")]), model).collect()}
    assert out == {1: 0.5, 2: 0.5}


def test_quality_of_very_long_texts_repeated_rows_and_no_rows(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, 50, 300) if i % 2 else "!!! 111 " * 20) for i in range(200)] + [(300, "x" * 200_000), (301, prose(rng, 30_000, 300)), (302, prose(rng, 50, 300))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(300, 1), (7, 0)], "doc_id long, quality int")
    model = quality.train(documents(spark, rows), labels)
    out = defaultdict(set)
    for r in quality.score(documents(spark, [*rows, rows[302 - 100]]), model).collect():
        out[r.doc_id].add(r._score)
    assert all(len(s) == 1 for s in out.values()) and all(0 <= min(s) <= 1 for s in out.values())
    assert min(out[301] | out[302]) > 0.5 > max(out[0])
    assert quality.score(documents(spark, []), model).count() == 0


def test_context_vectors_equal_brute_force():
    rng = np.random.default_rng(32)
    texts = [rng.integers(8, 40, n) for n in (0, 1, 2, 30, 200)]
    place, sign = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        for i, x in enumerate(t):
            for j in range(max(0, i - quality.NEAR), min(len(t), i + quality.NEAR + 1)):
                if i != j:
                    np.add.at(want[x], place[t[j]], sign[t[j]])
    own = np.zeros_like(want)
    np.add.at(own, (np.arange(quality.BUCKETS)[:, None], place), sign)
    norm = np.sqrt((want**2).sum(axis=1, keepdims=True))
    got, held = quality.word_vectors(texts)
    assert np.allclose(got, (own + 2 * want / np.maximum(norm, 1)) / 2, atol=1e-6)
    assert held[texts[3][0]] == sum(texts[3][0] in t for t in texts)


def test_quality_tokens():
    raw = np.frombuffer("The cat CAT 12!! cat cat".encode(), np.uint8)
    ids, first = quality.tokens(raw, np.array([0, len(raw)]))
    assert first.tolist() == [0, len(ids)]
    assert [int(i) for i in ids if i < 8] == [quality._TITLE, quality._AGAIN, quality._AGAIN]


def test_held_out_rule(spark):
    out = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    assert per_label(rows, "label", 160).count() == 320


# --- op7 -------------------------------------------------------------------


@pytest.mark.parametrize("block", [16_384, 1])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]
    rows += [(500, None), (501, [float("nan")] * 6), (502, [None] + [1.0] * 5), (503, []), (504, [1.0, 2.0]), (520, [3.0, 1.0]), (None, [1.0] * 6), (400, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in top_k.top_k(df.where("vec_id % 20 = 0"), df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ok = [(i, np.floor(64 * np.array(v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for q, v in {i: (i, v) for i, v in ok}.values():
        if q % 20 == 0:
            best = sorted((-(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:20]
            assert sorted(got.pop(q))[: len(best)] == [(k + 1, i, -int(s)) for k, (s, i) in enumerate(best)]
    assert not got


def test_top_k_of_no_rows_and_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_BYTES", 64)
    df = spark.createDataFrame([(i, [float(i), 1.0], 1, 2, 3) for i in range(41)], "vec_id long, embedding array<double>, id int, score int, rank int")
    got = top_k.top_k(df.where("vec_id % 20 = 0"), df, k=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (20, 1, 40), (20, 2, 39), (40, 1, 39), (40, 2, 38)]
    assert top_k.top_k(df.limit(0), df).count() == 0 == top_k.top_k(df, df.limit(0)).count()


def test_ball_tree_prunes():
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(20, 8)) * 1000
    vectors = np.floor(np.concatenate([c + rng.normal(size=(200, 8)) for c in centres]))
    t = top_k.TopK(np.array([-1]), np.floor(centres[:1]), 5)
    made = t.search(np.arange(len(vectors)), vectors, 64)
    assert made < len(vectors) / 2
    s = vectors @ np.floor(centres[0])
    assert t.found[0].tolist() == np.lexsort((np.arange(len(s)), -s))[:5].tolist()


# --- op10 ------------------------------------------------------------------


def test_chat_roundtrip(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\", "\\\\</s>\\[INST]<s", "", None, "<s>[ROLE]assistant[/ROLE]", "<<SYS>>\\"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)]
    rows += [(2, 0, "user", "only"), (3, None, None, None), (4, 0, "system", "s"), (4, 1, "assistant", "x"), (4, 1, "assistant", "x"), (None, 0, "user", "u"), (None, 1, "assistant", "v")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat_format.expand(df)
    assert examples.where("loss_start is not null").count() == sum(r[2] == "assistant" for r in rows)
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        reply = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(reply), hashlib.sha256(reply.encode()).hexdigest())
    assert chat_format.read_back(chat_format.expand(df.limit(0))).count() == 0


def test_only_the_reply_is_trainable(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat_format.expand(df).collect(), key=lambda r: r.example)
    assert [r.formatted[r.loss_start : r.loss_end] for r in rows] == ["a1", "a2"]
    assert rows[1].formatted.startswith(rows[0].formatted)


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "</s>", "\\</s>", "[INST][/INST]", "a\\[ROLE]\\\\b"])
def test_escape_roundtrip(text):
    assert chat_format.unescape(chat_format.escape(text)) == text

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as p
from epiframe.llm import decontaminate, quality
from tests.llm.test_operators import brute_components, words

SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, table.limit(50), SF).schema.fieldNames() == table.schema.fieldNames()


@pytest.mark.parametrize("k", range(5))
def test_stage_on_no_rows(spark, k):
    assert p.STAGES[k][1](spark, docs(spark, []), SF).count() == 0


def test_near_stage_keeps_one_of_each_group(spark):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(3)]
    rows = [(1, base[0]), (2, base[0] + " end"), (3, base[1]), (3, base[1]), (4, None), (5, ""), (None, base[2])]
    out = p.near_stage(spark, docs(spark, rows), SF)
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3, 4, 5]


def test_near_stage_loses_no_distinct_text(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, b), (1, a), (2, b + " end"), (7, c), (7, c + " end"), (None, d), (None, d), (None, a), (None, "one"), (None, "two"), (9, "one")]
    out = sorted(((r.doc_id, r.text) for r in p.near_stage(spark, docs(spark, rows), SF).collect()), key=str)
    either = [x for x in out if x[0] == 7]
    assert len(either) == 1 and either[0][1].startswith(c)
    assert [x for x in out if x[0] != 7] == sorted([(1, a), (1, b), (None, d), (None, "two"), (9, "one")], key=str)


def test_substring_stage_cuts_passages(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    out = {r.doc_id: r for r in p.substring_stage(spark, docs(spark, [(1, f"a  {passage} b"), (2, f"{passage}\nc"), (3, "d  e"), (4, None)]), SF).collect()}
    assert [(out[i].text, out[i].n_chars) for i in (1, 2, 3, 4)] == [("a b", 3), ("c", 1), ("d  e", 4), ("", 0)]


def test_benchmark_stage_drops_documents_with_items(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    out = p.benchmark_stage(spark, docs(spark, [(1, f"before {item.text} after"), (2, "clean words only"), (3, None)]), SF)
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]


def test_benchmark_stage_judges_rows_without_an_id_and_rows_that_share_one(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    out = p.benchmark_stage(spark, docs(spark, [(None, f"before {item.text}"), (None, "no item"), (1, f"{item.text} after"), (1, "clean words only")]), SF)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "no item"), (1, "clean words only")]


def test_quality_stage_keeps_clean_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.quality_stage(spark, table, SF).select("doc_id", F.lit(1).alias("kept"))
    rows = spark.read.parquet(f"{SF}/labels.parquet").join(kept, "doc_id", "left").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    assert sum(x or 0 for x in clean) >= 0.98 * len(clean)
    assert sum(r.kept or 0 for r in rows if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in rows)


def test_run(spark):
    out = p.run(spark, "/root/testdata/sf0.001")
    n = out.select("doc_id").distinct().count()
    assert 100 < n < 200
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def brute_quality(spark, docs, sf):
    """Rows of a score of at least the threshold, each text scored alone by the model that the stage trains."""
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    alone = lambda t: model.scores(*quality.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))[0]
    return [r for r in docs.collect() if alone(r.text or "") >= quality.REJECT]


def brute_near(rows):
    first = {d: c for d, _, c in brute_components([(r.doc_id, r.text) for r in rows])}
    return [r for r in rows if first[r.doc_id] == r.doc_id]


def brute_substrings(rows, width=35):
    split = {r.doc_id: words(r.text) for r in rows}
    seen = Counter(tuple(w[i : i + width]) for w in split.values() for i in range(len(w) - width + 1))
    out = {}
    for r in rows:
        w, gone = split[r.doc_id], set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out[r.doc_id] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r.text or ""
    return out


def brute_contaminated(rows, items):
    """Ids of the rows of which some span is within an item's bound, by the edit distance to every span."""
    folded = lambda t: decontaminate.fold_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    wanted = [w for w in (folded(t or "") for t in items) if len(w)]
    return {r.doc_id for r in rows for text in [folded(r.text or "")] for w in wanted if len(text) and decontaminate.best_span(w, text)[0] <= decontaminate.bound(len(w))}


def test_run_equals_brute_force_stage_by_stage(spark, sf):
    """Every stage of the pipeline over the whole small tables, on what the stage before kept."""
    now = {name: stage for name, stage in p.STAGES}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda rows: sorted(r.doc_id for r in rows)
    step = lambda name, df: spark.createDataFrame(now[name](spark, df, sf).collect(), docs.schema)

    kept = step("quality_classifier", docs)
    assert ids(kept.collect()) == ids(brute_quality(spark, docs, sf))
    alone = step("near_dedup", kept)
    assert ids(alone.collect()) == ids(brute_near(kept.collect())) and alone.count() < kept.count()
    cut = step("substring_dedup", alone)
    assert {r.doc_id: r.text for r in cut.collect()} == brute_substrings(alone.collect())
    clean = step("benchmark_decontamination", cut)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = brute_contaminated(cut.collect(), items)
    gone = set(ids(cut.collect())) - set(ids(clean.collect()))
    assert gone <= found and len(gone) >= 0.95 * len(found)

    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in now["packing"](spark, clean, sf).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    rows = clean.collect()
    assert set(pieces) == set(ids(rows))
    for r in rows:
        of = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for start, length, crc in sorted(pieces[r.doc_id]):
            assert start == at and zlib.crc32(of[start : start + length].tobytes()) == crc
            at += length
        assert at == len(of)
    for s in sequences.values():
        ends = [o + n for o, n in sorted(s)]
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 4096

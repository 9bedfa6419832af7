"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

A window is repeated when its word sequence also starts anywhere else, in the
same document or another.  Every window's hash is computed, but consecutive
windows are counted together: the windows that share their smallest
``GRAM``-word hash (their anchor) form a run, and equal windows always have
equal anchors.  So

1. runs (anchor, digest of all window hashes in the run) are counted; a run
   seen twice has only repeated windows, an anchor seen once only unique ones;
2. where one anchor has several digests, the windows themselves are counted,
   one run standing for each digest that was seen more than once; so are
   those of runs that may repeat their own windows (periodic text).

Both counts combine on the map side, so a passage held by a third of all
documents costs each task one row.  Text moves twice, by document, and never
by window.  Hash comparisons are on 128 bits (anchor and window hash).

Null text has no words.  Documents with fewer than ``width`` words keep all.
Repeated rows count as separate documents.  A null id is kept as it is.
Memory per task: see :mod:`epiframe.llm.textscan`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiframe.llm.staging import Carried, map_arrow, staged
from epiframe.llm.textscan import Words, chunks, mix, rolling, signed, window_rows

WIDTH = 35
GRAM = 8
_KEY = ("_k1", "_k2")


def _runs(raw: np.ndarray, at: np.ndarray, width: int, gram: int):
    """Per run: document, first window's word position in the document, number of windows, anchor, digest, whether it may repeat its own windows; and window hashes and run starts."""
    words = Words(raw, at)
    rows, doc = window_rows(words.first, width)
    if not len(rows):
        return None
    window = rolling(words.hash, width)[rows]
    grams = low = rolling(words.hash, gram)
    span, step = width - gram + 1, 1
    near = np.zeros(len(grams), dtype=bool)  # equal windows in one run: their anchors are at most span apart
    for gap in range(1, min(span, len(grams) - 1) + 1):
        near[:-gap] |= grams[:-gap] == grams[gap:]
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
    low = low[rows]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(rows)))
    place = np.arange(len(rows)) - np.repeat(start, length)
    digest = mix(np.add.reduceat(mix(window + np.uint64(0x9E3779B97F4A7C15) * place.astype(np.uint64)), start) + length.astype(np.uint64))
    inner = np.isin(low[start], np.unique(grams[near])) & (length > 1)
    return doc[start], rows[start] - words.first[doc[start]], length, low[start], digest, inner, window, start


def _run_batches(width: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, raw, at in chunks(batch.column(2)):
                if (found := _runs(raw, at, width, gram)) is None:
                    continue
                doc, begin, length, anchor, digest, inner, _, _ = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[lo:hi][doc]), pa.array(k2[lo:hi][doc]), pa.array(begin.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(signed(anchor)), pa.array(signed(digest)), pa.array(inner.astype(np.int32))],
                    names=["_k1", "_k2", "begin", "length", "anchor", "digest", "inner"],
                )

    return scan


def _window_batches(width: int, gram: int):
    """Rows of (document key, text, runs to open) -> one row for each window of those runs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            asked = batch.column(3).to_pylist()
            for lo, hi, raw, at in chunks(batch.column(2)):
                if (found := _runs(raw, at, width, gram)) is None:
                    continue
                doc, begin, length, anchor, _, _, window, start = found
                weight = np.zeros(len(doc), dtype=np.int32)
                for i in range(lo, hi):
                    a, b = np.searchsorted(doc, [i - lo, i - lo + 1])
                    for r in asked[i]:
                        weight[a + np.searchsorted(begin[a:b], r["begin"])] = r["weight"]
                of = np.repeat(np.arange(len(doc)), length)
                at_run = np.arange(len(of)) - start[of]
                keep = weight[of] > 0
                of, at_run = of[keep], at_run[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[lo:hi][doc[of]]), pa.array(k2[lo:hi][doc[of]]), pa.array((begin[of] + at_run).astype(np.int32)), pa.array(weight[of]), pa.array(signed(anchor[of])), pa.array(signed(window[keep]))],
                    names=["_k1", "_k2", "begin", "weight", "anchor", "window"],
                )

    return scan


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Rows with the same id and text share a key, and so their result."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_k1"), F.xxhash64(F.col(text_col), F.col(id_col).isNull()).alias("_k2")]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(_k1, _k2, spans): the word ranges [begin, end) of each document that repeated windows cover; spans may overlap."""
    gram = min(GRAM, width)
    text = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("_text"))
    runs = staged(map_arrow(text, _run_batches(width, gram), "_k1 long, _k2 long, begin int, length int, anchor long, digest long, inner int"), "runs")
    place = F.xxhash64("_k1", "_k2", "begin")
    kinds = runs.groupBy("anchor", "digest").agg(F.count("*").alias("seen"), F.min(place).alias("first"), F.max("inner").alias("inner"))
    # Grouped tables are written before they are joined: a join of two fresh exchanges lets Spark split a hot key.
    kinds = staged(kinds, "kinds")
    several = staged(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("seen").alias("all"), F.max("inner").alias("own")).where("all > 1 or own > 0").select("anchor", ((F.col("kinds") > 1) | (F.col("own") > 0)).alias("mixed")), "several")
    kinds = staged(kinds.drop("inner").join(several, "anchor"), "kinds")
    marked = staged(
        runs.join(kinds, ["anchor", "digest"])
        .withColumn("whole", F.col("seen") > 1)
        .withColumn("open", F.col("mixed") & (~F.col("whole") | (place == F.col("first"))))
        .where("whole or open")
        .select("_k1", "_k2", "begin", "length", "whole", "open"),
        "marked",
    )
    opened = marked.where("open").select("_k1", "_k2", F.struct("begin", F.when(F.col("whole"), 2).otherwise(1).alias("weight")).alias("run")).groupBy("_k1", "_k2").agg(F.collect_set("run").alias("asked"))
    windows = staged(map_arrow(text.dropDuplicates(["_k1", "_k2"]).join(opened, ["_k1", "_k2"]), _window_batches(width, gram), "_k1 long, _k2 long, begin int, weight int, anchor long, window long"), "windows")
    twice = staged(windows.groupBy("anchor", "window").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor", "window"), "twice")
    single = windows.where("weight = 1").join(twice, ["anchor", "window"]).select("_k1", "_k2", "begin", (F.col("begin") + width).alias("end"))
    whole = marked.where("whole").select("_k1", "_k2", "begin", (F.col("begin") + F.col("length") + (width - 1)).alias("end"))
    return whole.union(single).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def _cut(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text, spans = batch.column(names.index("_text")), batch.column(names.index("_spans"))
            offsets = spans.offsets.to_numpy()
            begins, ends = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            empty = spans.is_null().to_numpy(zero_copy_only=False)
            total, removed, kept = [], [], []
            for lo, hi, raw, at in chunks(text):
                words = Words(raw, at)
                for i in range(lo, hi):
                    a, b = words.first[i - lo], words.first[i - lo + 1]
                    keep = np.ones(b - a, dtype=bool)
                    if not empty[i] and offsets[i + 1] > offsets[i]:
                        level = np.zeros(b - a + 1, dtype=np.int32)
                        np.add.at(level, begins[offsets[i] : offsets[i + 1]], 1)
                        np.add.at(level, ends[offsets[i] : offsets[i + 1]], -1)
                        keep = np.cumsum(level[:-1]) == 0
                    total.append(b - a)
                    removed.append(b - a - int(keep.sum()))
                    data = bytes(raw[at[i - lo] : at[i - lo + 1]])
                    base = at[i - lo]
                    if with_text and keep.all():
                        kept.append(data.decode())
                        continue
                    out = b" ".join(data[s:e] for s, e in zip((words.start[a:b][keep] - base).tolist(), (words.end[a:b][keep] - base).tolist()))
                    kept.append(out.decode() if with_text else hashlib.sha256(out).hexdigest())
            rest = [(n, batch.column(i)) for i, n in enumerate(names) if n not in ("_text", "_spans")]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[n for n, _ in rest] + ["_words", "_removed", "_kept"])

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, digest: bool = False) -> DataFrame:
    """All rows of ``docs`` and its columns but the text, with ``_words``, ``_removed`` and ``_kept``: the words kept, joined by one space, or with ``digest`` their SHA-256; a text that loses no word stays as it is."""
    carried = Carried(docs, text_col, "_words", "_removed", "_kept")
    spans = repeated_spans(docs, id_col, text_col, width).withColumnRenamed("spans", "_spans")
    keyed = docs.select(carried.column, *_keys(id_col, text_col), F.col(text_col).alias("_text"))
    joined = keyed.join(spans, list(_KEY), "left").select("_row", "_text", "_spans")
    cut = map_arrow(joined, _cut(not digest), carried.schema("_words long, _removed long, _kept string"))
    return cut.select(*carried.restored(), "_words", "_removed", "_kept")

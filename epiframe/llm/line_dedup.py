"""Line dedup: counts of lines in a sharded minimal perfect hash that documents probe.

Texts are split at ``\\n``.  A line's key is the line without spaces, tabs and
the controls 0x09-0x0D at both ends, A-Z lower-cased.  Keys of at least
``min_chars`` code points found in at least ``min_docs`` documents lose all
their lines, but for those in the largest id that holds the key.

1. Each document gives each of its keys once, as a 128-bit hash; Spark counts
   them and takes the largest id (both combine on the map side, so a line held
   by a third of all documents is one row for each task).
2. Keys of at least two documents (others cannot repeat) are dealt to shards;
   a task builds a shard's minimal perfect hash, with a 64-bit fingerprint, the
   count and the largest id for each place: about 21 bytes a key.
3. Documents probe the arrays, and no table of lines is joined.  Arrays of at
   most ``SENT_BYTES`` in all go to every task, and texts are read once more
   and moved nowhere.  Beyond that probes go to the shards: keys that hold more
   than 1/HEAVY of all lines (there are at most HEAVY of them) are answered
   where the text is, so that no shard gets a hot key, and only the numbers of
   lines to drop come back to their documents.

Both ways give the same rows.  Null and empty texts are one empty line.  Every
row is a document of its own: repeated rows count each, and all rows of the
largest id keep the line.  A null id is smaller than all others; where only
null ids hold a key all keep it.  Memory: see :mod:`epiframe.llm.textscan`; a
group is a shard of about ``SHARD_KEYS`` keys and ``SHARD_LINES`` probes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.llm import perfect_hash
from epiframe.llm.staging import Carried, map_arrow, staged
from epiframe.llm.textscan import _SEP, chunks, signed

MIN_DOCS = 5
MIN_CHARS = 40
SENT_BYTES = 32 << 20
#: Bytes of the arrays for each key, rounded up.
KEY_BYTES = 24
SHARD_KEYS = 1 << 16
SHARD_LINES = 1 << 20
HEAVY = 1 << 18
#: The id that stands for null: the smallest long.
NO_ID = -(1 << 63)
_VALUE = np.dtype([("count", "<u4"), ("last", "<i8")])
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


class Lines:
    """Lines of a chunk of texts: byte spans, each document's range ``first[i]:first[i+1]``, and the long ones' numbers and 128-bit hashes."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, min_chars: int):
        breaks = np.flatnonzero(raw == 0x0A)
        self.start = np.sort(np.concatenate([at[:-1], breaks + 1]))
        self.end = np.sort(np.concatenate([at[1:], breaks]))
        self.first = np.searchsorted(breaks, at) + np.arange(len(at))
        inside = np.flatnonzero(~_SEP[raw])
        lo, hi = np.searchsorted(inside, self.start), np.searchsorted(inside, self.end)
        chars = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
        self.long = np.flatnonzero(lo < hi)
        begin, finish = inside[lo[self.long]], inside[hi[self.long] - 1] + 1
        enough = chars[finish] - chars[begin] >= min_chars
        self.long = self.long[enough]
        low = _ASCII_LOWER[raw].tobytes()
        digests = b"".join(xxhash.xxh3_128_digest(low[a:b]) for a, b in zip(begin[enough].tolist(), finish[enough].tolist()))
        both = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2)
        self.high, self.low = both[:, 0].copy(), both[:, 1].copy()
        self.doc = np.searchsorted(self.first, self.long, side="right") - 1


def _ids(column) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _keys_of_documents(min_chars: int):
    """(id, text) -> (high, low, id), each key of a document once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch.column(0))
            for lo, hi, raw, at in chunks(batch.column(1)):
                lines = Lines(raw, at, min_chars)
                order = np.lexsort((lines.low, lines.high, lines.doc))
                doc, high, low = lines.doc[order], lines.high[order], lines.low[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(high[new])), pa.array(signed(low[new])), pa.array(ids[lo:hi][doc[new]])], names=["high", "low", "last"])

    return scan


def _values(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Halves and values of the rows (high, low, count, last) of an Arrow table; a count is kept up to 2**32 - 1."""
    column = lambda name: table.column(name).to_numpy()
    values = np.empty(table.num_rows, dtype=_VALUE)
    values["count"], values["last"] = np.minimum(column("count"), 2**32 - 1), column("last")
    return column("high").view(np.uint64), column("low").view(np.uint64), values


def _shard(table: pa.Table) -> pa.Table:
    return perfect_hash.build(table.column("shard")[0].as_py(), *_values(table))


def _gone(index: perfect_hash.Index, lines: Lines, ids: np.ndarray, min_docs: int) -> np.ndarray:
    """Numbers of the lines to drop; ``ids`` has one for each long line."""
    rows, value = index.find(lines.high, lines.low)
    return lines.long[rows[(value["count"] >= min_docs) & (ids[rows] < value["last"])]]


def _probes(heavy, min_chars: int, shards: int):
    """(key of the document, id, text) -> a row for each long line that is not heavy: shard, hashes, id, document and line number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = perfect_hash.Index(heavy.value, 1, _VALUE)
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ids = _ids(batch.column(2))
            for lo, hi, raw, at in chunks(batch.column(3)):
                lines = Lines(raw, at, min_chars)
                rest = np.ones(len(lines.long), dtype=bool)
                rest[index.find(lines.high, lines.low)[0]] = False
                doc, high, low = lines.doc[rest], lines.high[rest], lines.low[rest]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(perfect_hash.shard_of(high, shards)), pa.array(signed(high)), pa.array(signed(low)), pa.array(ids[lo:hi][doc]), pa.array(k1[lo:hi][doc]), pa.array(k2[lo:hi][doc]), pa.array((lines.long[rest] - lines.first[doc]).astype(np.int32))],
                    names=["shard", "high", "low", "id", "_k1", "_k2", "line"],
                )

    return scan


def _answer(min_docs: int):
    """Probes of one shard and its arrays -> the lines to drop."""

    def answer(probes: pa.Table, arrays: pa.Table) -> pa.Table:
        column = lambda name: probes.column(name).to_numpy()
        found, value = perfect_hash.Index(arrays.to_pylist(), 1, _VALUE).find(column("high").view(np.uint64), column("low").view(np.uint64))
        found = found[(value["count"] >= min_docs) & (column("id")[found] < value["last"])]
        return probes.select(["_k1", "_k2", "line"]).take(pa.array(found))

    return answer


def _cut(sent, shards: int, min_docs: int, min_chars: int, digest: bool):
    """Carries ``_row``; drops the lines that the index that was sent, and the numbers ``_asked``, name."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = perfect_hash.Index(sent.value, shards, _VALUE)
        for batch in batches:
            names = batch.schema.names
            ids, asked = _ids(batch.column(names.index("_id"))), batch.column(names.index("_asked")).to_pylist()
            total, dropped, kept = [], [], []
            for lo, hi, raw, at in chunks(batch.column(names.index("_text"))):
                lines = Lines(raw, at, min_chars)
                keep = np.ones(len(lines.start), dtype=bool)
                keep[_gone(index, lines, ids[lo:hi][lines.doc], min_docs)] = False
                for i in range(lo, hi):
                    a, b = lines.first[i - lo], lines.first[i - lo + 1]
                    if asked[i]:
                        keep[a + np.asarray(asked[i])] = False
                    stays = keep[a:b]
                    total.append(b - a)
                    dropped.append(b - a - int(stays.sum()))
                    base = at[i - lo]
                    out = bytes(raw[base : at[i - lo + 1]])
                    if dropped[-1]:
                        out = b"\n".join(out[s:e] for s, e in zip((lines.start[a:b][stays] - base).tolist(), (lines.end[a:b][stays] - base).tolist()))
                    kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode())
            yield pa.RecordBatch.from_arrays([batch.column(names.index("_row")), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["_row", "_lines", "_dropped", "_kept"])

    return cut


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, digest: bool = False, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """All rows of ``docs`` and its columns but the text, with ``_lines`` (before dropping), ``_dropped`` and ``_kept``: the lines that stay, joined by ``\\n``, or with ``digest`` their SHA-256."""
    spark = docs.sparkSession
    carried = Carried(docs, text_col, "_lines", "_dropped", "_kept")
    key, text = F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")
    counted = map_arrow(docs.select(key, text), _keys_of_documents(min_chars), "high long, low long, last long").groupBy("high", "low").agg(F.count("*").alias("count"), F.max("last").alias("last"))
    repeated = staged(counted.where("count > 1"), "lines")
    keys, held = repeated.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    small = keys * KEY_BYTES <= sent_bytes
    probes = 0 if small else (docs.agg(F.sum(F.length(text_col))).first()[0] or 0) // max(1, min_chars)
    shards = max(1, -(-keys // SHARD_KEYS), -(-probes // SHARD_LINES))
    arrays = staged(repeated.withColumn("shard", F.pmod("high", F.lit(shards))).groupBy("shard").applyInArrow(_shard, perfect_hash.SCHEMA), "line-arrays")
    row = docs.select(carried.column, key, text)
    schema = carried.schema("_lines long, _dropped long, _kept string")
    if small:
        sent = spark.sparkContext.broadcast([r.asDict() for r in arrays.collect()])
        asked = row.withColumn("_asked", F.lit(None).cast("array<int>"))
        cut = map_arrow(asked, _cut(sent, shards, min_docs, min_chars, digest), schema)
    else:
        heavy = repeated.where(F.col("count") > held // HEAVY).toArrow()
        sent = spark.sparkContext.broadcast(perfect_hash.build(0, *_values(heavy)).to_pylist())
        row = row.withColumns({"_k1": F.coalesce("_id", F.lit(0).cast("long")), "_k2": F.xxhash64("_text", F.col("_id").isNull())})
        probed = map_arrow(row.select("_k1", "_k2", "_id", "_text"), _probes(sent, min_chars, shards), "shard long, high long, low long, id long, _k1 long, _k2 long, line int")
        gone = probed.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(_answer(min_docs), "_k1 long, _k2 long, line int")
        gone = gone.groupBy("_k1", "_k2").agg(F.collect_set("line").alias("_asked"))
        asked = row.join(gone, ["_k1", "_k2"], "left").select("_row", "_id", "_text", "_asked")
        cut = map_arrow(asked, _cut(sent, 1, min_docs, min_chars, digest), schema)
    return cut.select(*carried.restored(), "_lines", "_dropped", "_kept")

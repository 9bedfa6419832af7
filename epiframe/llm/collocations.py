"""Phrase collocation mining: counts of word n-grams from suffix arrays.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and the
controls 0x0A-0x0D, and pieces into words at spaces and tabs.  A shard is a run
of documents inside a task, of about ``SHARD_BYTES``.  Its words become
numbers, and prefix doubling sorts its suffixes by as many words as the longest
phrase has: ranks by one word give ranks by two, those ranks by three.  In
that order equal phrases of n words are the intervals whose common prefixes
(LCP) have at least n words, so an interval is a phrase and its length the
count.  Spark adds the counts of all shards by language and phrase, and keeps
phrases of at least ``least`` occurrences; nothing else is needed, as a part of a
phrase occurs at least as often as the phrase.

Most phrases are rare, so a first pass over the texts adds counts by a 64-bit
hash only, of phrases shorter than the longest.  Those of at least ``least``
set a bit of a map of ``FILTER_BITS`` bits, whose size does not depend on the
data, and the pass that counts texts leaves out phrases whose bit, or for the
longest phrases the bit of one of their two parts, is not set: they are too
rare for certain.  Hashes that clash, and a map that is full, cost time and
change no count.

A candidate phrase of 2 words or more has a = f(phrase).  Cutting it after k
words gives l, r, the counts of its two parts, and a score
floor(1000000 * a * a / (l * r)), in decimals; the lowest cut counts, then the
smallest k.  Candidates that lie inside a longer one with at least half their
count go; the best ``top`` of each language stay (Spark keeps the best ``top``
of each task before it ranks).

Null language counts as ``und``, null and empty texts have no words, repeated
rows count each.  A document is never cut, so one longer than a shard is a
shard of its own; memory is about 60 bytes a byte of a shard.  Counts may reach
10**15, beyond which 1000000 * a * a leaves 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epiframe.llm.staging import map_arrow, shuffles_dropped, staged
from epiframe.llm.textscan import mix, signed, text_buffers

LONGEST = 3
LEAST = 10
TOP = 2000
SHARE = 50
SHARD_BYTES = 4 << 20
FILTER_BITS = 1 << 27
#: Groups of tasks whose best phrases are put together before a language's are.
PARTS = 64
#: Bits of a row of the map, as Spark's bitmap functions have them.
_ROW_BITS = 1 << 15
#: floor(1000000 * a * a / (l * r)), exact: a has at most 16 digits, l and r 19.
SCORE = "(1000000 * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Shard:
    """Words of a shard: their texts and numbers, documents, and how many words are left in the piece from each on."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        inside = ~(_BREAK[raw] | _SPACE[raw])
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[at] = True
        before = np.zeros(len(raw), dtype=bool)
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[: len(raw)]))
        after = np.zeros(len(raw), dtype=bool)
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        texts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]]))
        coded = texts.dictionary_encode()
        self.word = coded.indices.to_numpy().astype(np.int64)
        self.texts = coded.dictionary
        self.doc = np.searchsorted(at, start, side="right") - 1
        piece = np.searchsorted(np.flatnonzero(_BREAK[raw]), start)
        n = len(start)
        ends = np.ones(n, dtype=bool)
        ends[:-1] = (piece[1:] != piece[:-1]) | (self.doc[1:] != self.doc[:-1])
        last = np.flatnonzero(ends)
        self.left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1


def suffix_array(symbol: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``longest`` symbols (those of ``left`` where fewer), and the words that each has in common with the one before, up to ``longest``."""
    n, rank, width = len(symbol), symbol, 1
    order = np.argsort(symbol) if longest == 1 else None
    while width < longest:
        step = min(width, longest - width)
        more = np.zeros(n, dtype=np.int64)
        far = np.flatnonzero(left > step)
        more[far] = rank[far + step] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + more
        order = np.argsort(key)
        new = np.ones(n, dtype=np.int64)
        new[1:] = np.diff(key[order]) != 0
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        width += step
    common = np.zeros(n, dtype=np.int8)
    alike = np.ones(max(n - 1, 0), dtype=bool)
    for k in range(longest):
        a, b = order[:-1], order[1:]
        alike &= (left[a] > k) & (left[b] > k)
        alike[alike] = symbol[a[alike] + k] == symbol[b[alike] + k]
        common[1:] += alike
    return order, common


class Phrases:
    """Intervals of a shard of (language, text) columns, and hashes of its phrases."""

    def __init__(self, batches: list[tuple[pa.Array, pa.Array]], longest: int):
        langs = pa.chunked_array([x for x, _ in batches], pa.string()).combine_chunks().dictionary_encode()
        raw, at = text_buffers(pa.chunked_array([x for _, x in batches], pa.string()))
        self.shard, self.langs = Shard(raw[at[0] : at[-1]], at - at[0]), langs.dictionary
        self.lang = langs.indices.to_numpy()[self.shard.doc].astype(np.int64)
        self.order, self.common = suffix_array(self.lang * len(self.shard.texts) + self.shard.word, self.shard.left, longest)

    def intervals(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(a place, count) of each phrase of n words."""
        first = np.flatnonzero(self.common < n)
        f, where = np.diff(np.append(first, len(self.order))), self.order[first]
        whole = self.shard.left[where] >= n
        return where[whole], f[whole]

    def hashes(self, longest: int) -> list[np.ndarray]:
        """For n = 1, 2, ... the hash of the n words from each place on (of fewer where the piece ends), the language included."""
        of = lambda texts: np.array([xxhash.xxh3_64_intdigest(t) for t in texts.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
        word = mix(of(self.shard.texts)[self.shard.word] + mix(of(self.langs))[self.lang])
        out = [word]
        for n in range(1, longest):
            ahead = np.zeros(len(word), dtype=np.uint64)
            ahead[: len(word) - n] = word[n:]
            out.append(np.where(self.shard.left > n, mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + ahead), out[-1]))
        return out

    def texts(self, where: np.ndarray, n: int) -> pa.Array:
        parts = [self.shard.texts.take(pa.array(self.shard.word[where + k])) for k in range(n)]
        return (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]).cast(pa.string())


_ROWS = 1 << 16


def _hashed(phrases: Phrases, longest: int) -> Iterator[pa.RecordBatch]:
    """(key, f) of the phrases shorter than the longest."""
    hashes = phrases.hashes(longest - 1)
    for n in range(1, longest):
        where, f = phrases.intervals(n)
        for lo in range(0, len(where), _ROWS):
            cut = slice(lo, lo + _ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[n - 1][where[cut]])), pa.array(f[cut])], names=["key", "f"])


def _spelled(phrases: Phrases, longest: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of the phrases that may be frequent; the empty phrase counts all words."""
    words = np.bincount(phrases.lang, minlength=len(phrases.langs))
    yield pa.RecordBatch.from_arrays([phrases.langs, pa.array([""] * len(words), pa.string()), pa.array(words, pa.int64())], names=["lang", "phrase", "f"])
    if bits is not None:
        at = [(signed(h) & (8 * len(bits) - 1)) for h in phrases.hashes(longest - 1)]
        known = [bits[x >> 3] >> (x & 7).astype(np.uint8) & 1 == 1 for x in at]
    for n in range(1, longest + 1):
        where, f = phrases.intervals(n)
        if bits is not None:
            kept = known[n - 1][where] if n < longest else known[n - 2][where] & known[n - 2][where + 1]
            where, f = where[kept], f[kept]
        for lo in range(0, len(where), _ROWS):
            part = where[lo : lo + _ROWS]
            yield pa.RecordBatch.from_arrays([phrases.langs.take(pa.array(phrases.lang[part])), phrases.texts(part, n), pa.array(f[lo : lo + _ROWS])], names=["lang", "phrase", "f"])


def _scan(longest: int, size: int, hashed: bool, bits: Broadcast | None = None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            phrases = Phrases(held, longest)
            return _hashed(phrases, longest) if hashed else _spelled(phrases, longest, None if bits is None else np.frombuffer(bits.value, dtype=np.uint8))

        for batch in batches:
            held.append((batch.column(0), batch.column(1)))
            n += batch.column(1).nbytes
            if n >= size:
                yield from out()
                held, n = [], 0
        if held:
            yield from out()

    return scan


def _filter(text: DataFrame, longest: int, least: int, shard_bytes: int, filter_bits: int) -> Broadcast:
    """The map of the hashes of phrases, shorter than the longest, that may have ``least`` occurrences."""
    with shuffles_dropped(text.sparkSession):
        rows = _bits(text, longest, least, shard_bytes, filter_bits).collect()
    bits = bytearray(max(filter_bits, _ROW_BITS) // 8)
    for r in rows:
        bits[r.row * _ROW_BITS // 8 : (r.row + 1) * _ROW_BITS // 8] = r.bits
    return text.sparkSession.sparkContext.broadcast(bytes(bits[: filter_bits // 8]))


def _bits(text: DataFrame, longest: int, least: int, shard_bytes: int, filter_bits: int) -> DataFrame:
    """(row, bits) of the rows of the map that have any."""
    counted = map_arrow(text, _scan(longest, shard_bytes, True), "key long, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    place = F.pmod("key", F.lit(filter_bits))
    return counted.groupBy(F.floor(place / _ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(place % _ROW_BITS).alias("bits"))


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = 1, shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, f): all phrases of up to ``longest`` words with at least ``least`` occurrences, words joined by one space, and the empty phrase with the number of words.

    ``filter_bits`` is a power of two, at least 8; where ``least`` is over 1 the first pass runs when this is called.
    """
    text = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    bits = _filter(text, longest, least, shard_bytes, filter_bits) if least > 1 and longest > 1 else None
    return map_arrow(text, _scan(longest, shard_bytes, False, bits), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SHARE, shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words."""
    counted = phrase_counts(docs, lang_col, text_col, longest, least, shard_bytes, filter_bits)
    with shuffles_dropped(docs.sparkSession):
        counts = staged(counted, "phrases")
    words = F.split("phrase", " ")
    of = counts.select("lang", F.col("phrase"), F.col("f").alias("a"), words.alias("w"), F.size(words).alias("m")).where("m > 1")
    part = lambda begin, length: F.array_join(F.slice("w", begin, length), " ")
    cuts = of.select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    f = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    scored = cuts.join(f("left", "l"), ["lang", "left"]).join(f("right", "r"), ["lang", "right"])
    best = scored.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best")).select("lang", "phrase", "best.*")
    if longest > 2:
        longer = of.where("m > 2").select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("n"))
        longer = longer.select("lang", "a", "w", "n", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("n") + 1)).alias("i"))
        most = longer.groupBy("lang", part(F.col("i"), F.col("n")).alias("phrase")).agg(F.max("a").alias("most"))
        best = best.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    # Each task keeps the best of its own, groups of tasks the best of these, and one task a language sees at most PARTS * top rows.
    few = first(best.withColumn("part", F.spark_partition_id() % PARTS), "lang", "part").drop("rank", "part")
    ranked = first(few, "lang")
    total = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

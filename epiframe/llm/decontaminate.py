"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

A document is contaminated by a benchmark item when some span of it is within
``floor(EDITS * n)`` word edits of the item's ``n`` words (words are lower-cased
runs of letters and digits).

* CGK random walk: a pointer runs along a word sequence for 3n steps, each step
  writes a bit of the word it is at and a random function of step and word says
  whether it moves on.  Sequences at small edit distance give bit strings at
  small Hamming distance.
* Bit sampling: each of ``TABLES`` embeddings keeps ``SAMPLE`` of its bits as
  a key; a window and a piece of an item with an equal key are candidates.
  ``TABLES`` is what recall (measured in tests) needs to reach 0.95 at the bound
  with up to ``LONGEST`` words; it would fall with length, as the walks drift
  apart with every edit.
* Longer items are therefore cut into pieces of ``LONGEST // 2 + 1`` to
  ``LONGEST`` words.  A span within the bound of the item is within the bound of
  at least one of its pieces (else all together had more edits than the bound),
  so recall at any length is at least that of one piece.
* Items of so few words that the bound is 0 (fewer than 7) are matched exactly,
  by their words, however short; one of a single common word is in most
  documents.
* Candidates are verified by the exact edit distance of the whole item to the
  best span around the window; of a longer item only for pieces within their own
  bound.

Windows are piece-sized.  By the pigeonhole principle a span within k edits of n
words keeps a run of ``(n - k) // (k + 1)`` of them whole, so only windows that
hold such a run of that piece in some place are embedded; this loses nothing.

The benchmark is used in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_WORDS`` words; only one block at a time is sent to the executors, so a
benchmark of any size has bounded driver and task memory (each block is a pass
over the documents).  Documents stay where they are: no row is shuffled but the
few results.  Null or empty texts and items without words match nothing; rows
without an id match under a null id; repeated rows give one result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.llm.staging import map_arrow, united
from epiframe.llm.textscan import chunks, rolling, span_hash

EDITS = 0.15
TABLES = 24
SAMPLE = 12
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 2_000_000
LONGEST = 59

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.random.default_rng(404).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD[65:91] = _FOLD[97:123]


def fold_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the case-folded words of a chunk, and each document's first word."""
    n = len(raw)
    inside = _WORD[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return span_hash(raw, start, end, _FOLD), np.searchsorted(start, at)


def bound(n: int, edits: float = EDITS) -> int:
    """The edits allowed for an item of n words."""
    return int(edits * n)


def seed_length(n: int, edits: float = EDITS) -> int:
    """Words of a run that any span within the bound keeps whole."""
    k = bound(n, edits)
    return max(1, (n - k) // (k + 1))


def cuts(n: int, edits: float = EDITS) -> list[int]:
    """First words of the pieces of an item of n words, and n: of the numbers of pieces that fit, that with the longest seeds."""
    if n <= LONGEST:
        return [0, n]

    def cut(m: int) -> list[int]:
        return [n * i // m for i in range(m + 1)]

    return max((cut(m) for m in range(-(-n // LONGEST), n // (LONGEST // 2 + 1) + 1)), key=lambda c: min(seed_length(b - a, edits) for a, b in zip(c, c[1:])))


def embed(windows: np.ndarray, table: int) -> np.ndarray:
    """CGK bits (rows, 3n) of word-hash windows (rows, n) with the random functions of one table."""
    rows, n = windows.shape
    steps = 3 * n
    walk = np.random.default_rng([913, table]).integers(1, 1 << 63, steps, dtype=np.uint64) | np.uint64(1)
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    at = np.zeros(rows, dtype=np.int64)
    line = np.arange(rows)
    bits = np.empty((rows, steps), dtype=bool)
    for j in range(steps):
        h = padded[line, at] * walk[j]
        bits[:, j] = (h >> np.uint64(63)).astype(bool)
        at = np.minimum(at + ((h >> np.uint64(62)) & np.uint64(1)).astype(np.int64), n)
    return bits


def keys(windows: np.ndarray, table: int, sample: int = SAMPLE) -> np.ndarray:
    """The sampled-bit key of each window for one table."""
    steps = 3 * windows.shape[1]
    pick = np.random.default_rng([914, table, steps]).choice(steps, min(sample, steps), replace=False)
    return embed(windows, table)[:, pick] @ (np.int64(1) << np.arange(len(pick), dtype=np.int64))


def best_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edit distance, end) of the span of ``text`` nearest to ``item``, its leftmost end on ties."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    ramp = np.arange(len(text) + 1)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[:-1] + (text != word), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(np.argmin(row))
    return int(row[end]), end


def distances(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The edit distance of each row of ``items`` to the nearest span of the same row of ``texts``."""
    row = np.zeros((len(texts), texts.shape[1] + 1), dtype=np.int16)
    ramp = np.arange(texts.shape[1] + 1, dtype=np.int16)
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (texts != items[:, i : i + 1]), row[:, 1:] + 1, out=new[:, 1:], casting="same_kind")
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row.min(axis=1)


#: Pairs of places and items that are held at once.
PORTION = 1_000_000


def _portions(many: np.ndarray) -> Iterator[slice]:
    """Slices of an array of counts that each add up to at most PORTION, or hold one count."""
    upto, lo = np.cumsum(many), 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PORTION, side="right")))
        yield slice(lo, hi)
        lo = hi


def _spread(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of many[0] numbers, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())


class Block:
    """Items of the benchmark with their seeds and LSH keys."""

    def __init__(self, ids: list[int], texts: list[str], edits: float, tables: int, sample: int):
        self.edits, self.tables, self.sample = edits, tables, sample
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        encoded = [(t or "").encode() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)
        hashes, first = fold_words(np.frombuffer(b"".join(encoded), np.uint8), at)
        for i, item in enumerate(ids):
            if first[i + 1] > first[i]:
                self.ids.append(item)
                self.words.append(hashes[first[i] : first[i + 1]])
        #: Items that must be whole, by length: hash of the words, item, words.
        self.exact: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in self.words if not bound(len(w), edits)}):
            same = np.array([i for i, w in enumerate(self.words) if len(w) == n])
            stack = np.stack([self.words[i] for i in same])
            run = np.concatenate([rolling(w, n) for w in stack])
            order = np.argsort(run, kind="stable")
            self.exact[n] = run[order], same[order], stack[order]
        #: Pieces of items: item, first word in it, words.
        self.pieces: list[tuple[int, int, np.ndarray]] = []
        for i, w in enumerate(self.words):
            if not bound(len(w), edits):
                continue
            c = cuts(len(w), edits)
            self.pieces += [(i, lo, w[lo:hi]) for lo, hi in zip(c, c[1:])]
        self.sizes = np.array([len(w) for _, _, w in self.pieces], dtype=np.int64)
        self.cut = np.array([len(w) < len(self.words[i]) for i, _, w in self.pieces], dtype=bool)
        seeds: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for p, (_, _, w) in enumerate(self.pieces):
            g = seed_length(len(w), edits)
            runs = rolling(w, g)
            seeds.setdefault(g, []).append((runs, np.full(len(runs), p), np.arange(len(runs))))
        self.seeds = {}
        for g, parts in seeds.items():
            run, piece, place = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(run, kind="stable")
            self.seeds[g] = run[order], piece[order], place[order]
        self.lengths: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n in np.unique(self.sizes).tolist():
            same = np.flatnonzero(self.sizes == n)
            stack = np.stack([self.pieces[p][2] for p in same])
            by_table = []
            for t in range(tables):
                k = keys(stack, t, sample)
                order = np.argsort(k, kind="stable")
                by_table.append((k[order], same[order]))
            self.lengths[n] = by_table

    def windows(self, hashes: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
        """Start words of the windows to embed, by piece length: those aligned with a seed or shifted by up to the bound."""
        found: dict[int, list[np.ndarray]] = {}
        for g, (run, piece, place) in self.seeds.items():
            grams = rolling(hashes, g)
            lo = np.searchsorted(run, grams, side="left")
            hit = np.flatnonzero((lo < len(run)) & (run[np.minimum(lo, len(run) - 1)] == grams))
            if not len(hit):
                continue
            lo = lo[hit]
            many = np.searchsorted(run, grams[hit], side="right") - lo
            for part in _portions(many):
                which = _spread(lo[part], many[part])
                begin, n = np.repeat(hit[part], many[part]) - place[which], self.sizes[piece[which]]
                for length in np.unique(n):
                    found.setdefault(int(length), []).append(np.unique(begin[n == length]))
        out = {}
        for n, parts in found.items():
            start = np.unique(np.concatenate(parts))
            shift = (bound(n, self.edits) + 1) // 2
            out[n] = np.unique((start[:, None] + np.arange(-shift, shift + 1)).ravel())
        return out

    def whole(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first word) of the items without edits, the leftmost place for each pair."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        for n, (run, item, stack) in self.exact.items():
            grams = rolling(hashes, n)
            lo = np.searchsorted(run, grams, side="left")
            hit = np.flatnonzero((lo < len(run)) & (run[np.minimum(lo, len(run) - 1)] == grams))
            doc = np.searchsorted(first, hit, side="right") - 1
            inside = hit + n <= first[doc + 1]
            hit, doc = hit[inside], doc[inside]
            # A document's first place of each run, before runs are spread over the items that share it.
            _, at = np.unique(np.stack([doc, lo[hit]], axis=1), axis=0, return_index=True)
            hit, doc = hit[at], doc[at]
            many = np.searchsorted(run, grams[hit], side="right") - lo[hit]
            for part in _portions(many):
                which = _spread(lo[hit[part]], many[part])
                at, holder = np.repeat(hit[part], many[part]), np.repeat(doc[part], many[part])
                same = (hashes[at[:, None] + np.arange(n)] == stack[which]).all(axis=1)
                found.append(np.stack([holder, item[which], at - first[holder]], axis=1)[same])
        return tuple(np.concatenate(found).T)

    def gather(self, raw: np.ndarray, at: np.ndarray, base: int, into: dict[int, list]) -> None:
        """Adds the stretches around the windows of a chunk to ``into``, by piece length: (document, start, words).

        A stretch begins ``k`` words before its window and ends ``3k`` after it; words beyond the document count as
        one that no item holds.  The words of documents that have windows are kept under 0: (documents, words), and
        items found whole under -1: (document, item, first word).
        """
        hashes, first = fold_words(raw, at)
        if self.exact and len((exact := self.whole(hashes, first))[0]):
            into.setdefault(-1, []).append((exact[0] + base, *exact[1:]))
        docs = [np.zeros(0, np.int64)]
        for n, start in self.windows(hashes, first).items():
            start = start[(start > -n) & (start < len(hashes))]
            doc = np.searchsorted(first, np.clip(start + n // 2, 0, len(hashes) - 1), side="right") - 1
            k = bound(n, self.edits)
            index = start[:, None] + np.arange(-k, n + 3 * k + 1)
            inside = (index >= first[doc][:, None]) & (index < first[doc + 1][:, None])
            words = np.where(inside, hashes[np.clip(index, 0, len(hashes) - 1)], np.uint64(1))
            into.setdefault(n, []).append((doc + base, start - first[doc], words))
            docs.append(doc)
        if len(held := np.unique(np.concatenate(docs))):
            into.setdefault(0, []).append((held + base, [hashes[first[d] : first[d + 1]].copy() for d in held]))

    def _candidates(self, window: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, piece) of the windows of n words and the pieces that have an equal key in some table, by portions of rows."""
        lows, counts = [], []
        for t, (sorted_keys, _) in enumerate(self.lengths[n]):
            key = keys(window, t, self.sample)
            lows.append(np.searchsorted(sorted_keys, key, "left"))
            counts.append(np.searchsorted(sorted_keys, key, "right") - lows[-1])
        for part in _portions(np.sum(counts, axis=0)):
            rows = np.arange(len(window))[part]
            found = [np.repeat(rows, many[part]) * len(self.pieces) + pieces[_spread(low[part], many[part])] for low, many, (_, pieces) in zip(lows, counts, self.lengths[n])]
            yield np.divmod(np.unique(np.concatenate(found)), len(self.pieces))

    def decide(self, gathered: dict[int, list]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, edit distance, start word) of every verified match, the best for each pair."""
        for doc, item, start in gathered.get(-1, []):
            yield from ((d, i, 0, at) for d, i, at in zip(doc.tolist(), item.tolist(), start.tolist()))
        texts = {int(d): w for docs, words in gathered.get(0, []) for d, w in zip(docs, words)}
        pairs: dict[tuple[int, int], set[int]] = {}  # where the item would begin in the document
        for n, parts in gathered.items():
            if n <= 0:
                continue
            doc, start, words = (np.concatenate(p) for p in zip(*parts))
            k = bound(n, self.edits)
            for lo in range(0, len(doc), 8192):
                window = words[lo : lo + 8192, k : k + n]
                for rows, which in self._candidates(window, n):
                    for at in range(0, len(rows), 1024):
                        r, ps = rows[at : at + 1024] + lo, which[at : at + 1024]
                        part = self.cut[ps]
                        if part.any():
                            part[part] = distances(np.stack([self.pieces[p][2] for p in ps[part]]), words[r[part]]) <= k
                        keep = part | ~self.cut[ps]
                        for j, p in zip(r[keep].tolist(), ps[keep].tolist()):
                            i, offset, _ = self.pieces[p]
                            pairs.setdefault((int(doc[j]), i), set()).add(int(start[j]) - offset)
        for (d, i), starts in pairs.items():
            n = len(self.words[i])
            k = bound(n, self.edits)
            # Words before a piece can be edited too: a piece may stand k words beside the item's begin.
            before, after = (k, 3 * k) if n <= LONGEST else (2 * k, 3 * k)
            best, done = None, None
            for at in sorted(starts):
                if done is not None and at <= done:
                    continue  # inside the stretch compared last
                done = at + k
                edits, end = best_span(self.words[i], _stretch(texts[d], at - before, at + n + after + 1))
                if edits <= k and (best is None or edits < best[0]):
                    best = edits, max(0, at - before + end - n)
            if best:
                yield d, i, *best


def _stretch(words: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Words ``lo`` to ``hi`` of a document; those beyond it count as one that no item holds."""
    out = np.full(hi - lo, 1, dtype=np.uint64)
    a, b = max(lo, 0), max(min(hi, len(words)), max(lo, 0))
    out[a - lo : b - lo] = words[a:b]
    return out


#: Windows, and words of documents that have any, that a task gathers before it embeds the windows together.
GATHER = 20_000
GATHER_WORDS = 4_000_000


def _scan(block):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        ids: list = []
        gathered: dict[int, list] = {}

        def decided() -> Iterator[pa.RecordBatch]:
            nonlocal ids, gathered
            if out := [(ids[d], b.ids[i], edits, start) for d, i, edits, start in b.decide(gathered)]:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=["doc_id", "item_id", "edits", "start_word"])
            ids, gathered = [], {}

        for batch in batches:
            for lo, _, raw, at in chunks(batch.column(1)):
                b.gather(raw, at, len(ids) + lo, gathered)
            ids += batch.column(0).to_pylist()
            if sum(len(part[0]) for n, parts in gathered.items() if n for part in parts) > GATHER or sum(len(w) for _, words in gathered.get(0, []) for w in words) > GATHER_WORDS:
                yield from decided()
        yield from decided()

    return scan


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in bounded blocks, streamed to the driver one partition at a time."""
    ids, texts, words = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        words += len(row.text) // 2
        if len(ids) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: float = EDITS, tables: int = TABLES, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, item_id, edits, start_word): for each document and item within the bound, the best match."""
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, edits long, start_word long"
    blocks = (spark.sparkContext.broadcast(Block(ids, texts, edits, tables, sample)) for ids, texts in _blocks(benchmark))
    passes = ((map_arrow(text, _scan(b), schema), b) for b in blocks)
    out = united(passes, spark.createDataFrame([], schema))
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start_word")).alias("m"))
    return best.select("doc_id", "item_id", "m.edits", "m.start_word")

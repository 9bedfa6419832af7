"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Random indexing: every word has a sparse random index vector (``ONES`` entries
of +1 or -1 among ``DIM``, from its hash bucket); its word vector is that plus
the scaled sum of the index vectors of words within ``NEAR`` places, over the
training texts, and counts by how many of those hold the word (a training text's
own words count as if it were not among them).  A document is the mean of its words' vectors and the mean of
their products with the next word's (how much neighbours agree).  Words are
runs of letters (case folded), of digits or of other signs; marker words tell of
capitals and of a word that repeats the last one.  A two-layer numpy network
gives a logit; a temperature fitted on a fifth of the sample calibrates it.

Training takes at most ``PER_LABEL`` labelled rows of each label, of at most
``SAMPLE_BYTES`` each and ``LABEL_BYTES`` together; tokens of those (2 bytes each) are all that reaches the driver.  Scoring reads every text whole,
where it lies, without a shuffle.  Null and empty texts are scored as texts
without words.  Without labelled rows of both labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epiframe.llm.sampling import held_out, per_label
from epiframe.llm.staging import Carried, map_arrow
from epiframe.llm.textscan import chunks, span_hash

BUCKETS = 32_768
DIM = 64
ONES = 4
NEAR = 2
PER_LABEL = 2_000
#: Labelled texts of more bytes are not trained on, so that the sample is bounded in bytes too.
SAMPLE_BYTES = 65_536
#: Bytes of all training texts of a label together.
LABEL_BYTES = 16 << 20
HIDDEN = 32
EPOCHS = 60
DECAY = 3e-3
RARE = 5
#: Words that are pooled at once, and of whose neighbours the context is counted at once.
POOLED = 32_768
PIECE = 262_144
REJECT = 0.3

_UPPER, _TITLE, _AGAIN = 0, 1, 2
_KIND = np.full(256, 3, dtype=np.int8)  # 0 white space, 1 letter, 2 digit, 3 other
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_FOLD = np.random.default_rng(606).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD[65:91] = _FOLD[97:123]
_CAPITAL = np.zeros(256, dtype=np.int32)
_CAPITAL[65:91] = 1


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and marker of a chunk, and each document's first."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kind = _KIND[raw]
    new = np.ones(n, dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[at[:-1][at[:-1] < n]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    word = kind[start] > 0
    start, end = start[word], end[word]
    bucket = (span_hash(raw, start, end, _FOLD) % np.uint64(BUCKETS - 8)).astype(np.int64) + 8
    capitals = np.concatenate([[0], np.cumsum(_CAPITAL[raw])])
    many = capitals[end] - capitals[start]
    mark = np.full(len(start), -1)
    mark[(many == 1) & (_CAPITAL[raw[start]] > 0)] = _TITLE
    mark[many > 1] = _UPPER
    if len(bucket) > 1:
        mark[1:][bucket[1:] == bucket[:-1]] = _AGAIN
    order = np.repeat(np.arange(len(bucket)), 1 + (mark >= 0))
    out = bucket[order]
    second = np.zeros(len(order), dtype=bool)
    second[1:] = order[1:] == order[:-1]
    marked = np.flatnonzero(second) - 1
    out[marked] = mark[order[marked]]
    count = np.concatenate([[0], np.cumsum(1 + (mark >= 0))])
    return out, count[np.searchsorted(start, at)]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (BUCKETS, ONES) of the index vectors."""
    rng = np.random.default_rng(607)
    return rng.integers(0, DIM, (BUCKETS, ONES)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, ONES))


def _weight(texts_with: np.ndarray) -> np.ndarray:
    """How far a word counts that so many other texts hold: nothing for none, all in the limit."""
    n = np.maximum(texts_with, 0)
    return (n / (n + RARE))[:, None].astype(np.float32)


def word_vectors(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index vector plus scaled context vector of every bucket, and the number of texts that hold it."""
    place, sign = index_vectors()
    own = np.zeros((BUCKETS, DIM))
    np.add.at(own, (np.arange(BUCKETS)[:, None], place), sign)
    context = np.zeros(BUCKETS * DIM)
    ids = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for lo in range(0, len(ids), PIECE):
        for gap in range(1, NEAR + 1):
            a, d = ids[lo : lo + PIECE + gap], doc[lo : lo + PIECE + gap]
            same = d[:-gap] == d[gap:]
            left, right = a[:-gap][same], a[gap:][same]
            for x, y in ((left, right), (right, left)):
                context += np.bincount((x[:, None] * DIM + place[y]).ravel(), weights=sign[y].ravel(), minlength=BUCKETS * DIM)
    context = context.reshape(BUCKETS, DIM)
    norm = np.sqrt((context**2).sum(axis=1, keepdims=True))
    held = np.zeros(BUCKETS)
    for t in texts:
        held[np.unique(t)] += 1
    return ((own + 2 * context / np.maximum(norm, 1)) / np.sqrt(ONES)).astype(np.float32), held


def pooled(vectors: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means of word vectors and of neighbour products by document, (documents, 2 * DIM)."""
    n = len(first) - 1
    total = np.zeros((n, 2 * DIM), dtype=np.float64)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    for lo in range(0, len(ids), POOLED):
        d = doc[lo : lo + POOLED]
        v = vectors[ids[lo : lo + POOLED + 1]]
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        total[d[cut], :DIM] += np.add.reduceat(v[: len(d)], cut, axis=0)
        pair = v[: len(v) - 1] * v[1:]
        if len(pair) < len(d):
            pair = np.concatenate([pair, np.zeros((len(d) - len(pair), DIM), np.float32)])
        pair[np.flatnonzero(np.r_[d[1:] != d[:-1], lo + len(d) >= len(doc) or doc[min(lo + len(d), len(doc) - 1)] != d[-1]])] = 0
        total[d[cut], DIM:] += np.add.reduceat(pair, cut, axis=0)
    return (total / np.maximum(count, 1)[:, None]).astype(np.float32)


class Model:
    """Word vectors, two-layer network and temperature."""

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray):
        self.ready = len(np.unique(labels)) == 2
        if not self.ready:
            return
        base, held_by = word_vectors(texts)
        self.vectors = base * _weight(held_by)
        ids = np.concatenate(texts)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        x = pooled(base * _weight(held_by - 1), ids, first).astype(np.float64)  # a training text's own words, as if it were new
        y = labels.astype(np.float64)
        rng = np.random.default_rng(608)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        if len(np.unique(y[held])) < 2 or len(np.unique(y[used])) < 2:
            held = used = order
        self.mean, self.std = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
        z = (x - self.mean) / self.std
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(EPOCHS):
            rng.shuffle(used)
            for lo in range(0, len(used), 128):
                i = used[lo : lo + 128]
                h = np.tanh(z[i] @ p[0] + p[1])
                prob = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40)))
                d = (prob - y[i]) / len(i)
                dh = d[:, None] * p[2] * (1 - h**2)
                step += 1
                for k, g in enumerate((z[i].T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()]))):
                    g = g + DECAY * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.layers = p
        self.temperature = 1.0
        logit = self._logit(z[held])
        loss = {t: np.mean(np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logit / t)) for t in np.geomspace(0.5, 8, 41)}
        self.temperature = float(min(loss, key=loss.get))

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(first) - 1, 0.5)
        z = (pooled(self.vectors, ids, first) - self.mean) / self.std
        return 1 / (1 + np.exp(-np.clip(self._logit(z) / self.temperature, -40, 40)))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, at in chunks(batch.column(1)):
            ids, first = tokens(raw, at)
            packed = [ids[first[i] : first[i + 1]].astype("<u2").tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["label", "ids"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", per_label_rows: int = PER_LABEL) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out; of several labels of one id the largest counts."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    short = docs.where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= SAMPLE_BYTES).select("doc_id", F.col(text_col).alias("text"))
    few = per_label(known, "label", per_label_rows)
    # At most per_label_rows rows a label, so the running sum is over a bounded group; it bounds the texts in sum.
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    sized = short.join(F.broadcast(few), "doc_id").withColumn("_upto", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(order))
    sample = sized.where(F.col("_upto") <= LABEL_BYTES).select("label", "text")
    rows = sorted((r.label, bytes(r.ids)) for r in map_arrow(sample, _tokens, "label int, ids binary").collect())
    return Model([np.frombuffer(b, "<u2").astype(np.int64) for _, b in rows], np.array([label for label, _ in rows]))


def _score(model, keep: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            names = batch.schema.names
            score = [m.scores(*tokens(raw, at)) for _, _, raw, at in chunks(batch.column(names.index("_text")))]
            rest = [(n, batch.column(i)) for i, n in enumerate(names) if keep or n != "_text"]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(np.concatenate(score) if score else np.zeros(0))], names=[n for n, _ in rest] + ["_score"])

    return scan


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All rows and other columns of ``docs`` with ``_score``, the probability of label 1, and with ``keep_text`` the text as ``_text``."""
    outputs = ["_text", "_score"] if keep_text else ["_score"]
    carried = Carried(docs, text_col, *outputs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = carried.schema("_text string, _score double" if keep_text else "_score double")
    out = map_arrow(docs.select(carried.column, F.col(text_col).alias("_text")), _score(sent, keep_text), schema)
    return out.select(*carried.restored(), *outputs)

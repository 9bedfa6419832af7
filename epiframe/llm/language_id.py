"""Language identification with string kernels.

A text's blended spectrum is the set of its byte n-grams of 1 to ``GRAMS``
bytes (A-Z in lower case, digits and white space unified), hashed to ``BUCKETS``;
the kernel of two texts is the share of n-grams present in both, normalised.
Training takes at most ``PER_LANGUAGE`` labelled rows of each language, of which
``LANDMARKS`` are Nystroem landmarks; one-versus-rest kernel ridge regression is
solved on the driver from packed presence bits (2 KB a row), unpacked ``BLOCK`` rows at
a time; of many languages each has at least ``FEWEST`` landmarks.  Scoring is two
matrix products per batch of texts: presence by landmarks, then by weights.

A null text, or one without a letter, is ``und`` with score 0; so is every text
if no row is labelled.  Texts are read whole.  Rows are scored where they lie,
without a shuffle; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.llm.sampling import per_label
from epiframe.llm.staging import Carried, map_arrow
from epiframe.llm.textscan import chunks

GRAMS = 3
BUCKETS = 16_384
PER_LANGUAGE = 400
LANDMARKS = 320
RIDGE = 1e-2
FEWEST = 4
BLOCK = 1_600
ROWS = 128
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32
_MUL = np.uint32(0x9E3779B1)
_BITS = BUCKETS.bit_length() - 1


def presence(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """0/1 matrix (documents, BUCKETS) of the n-grams present in each document of a chunk."""
    n = len(at) - 1
    out = np.zeros(n * BUCKETS, dtype=np.float32)
    if len(raw):
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(at)) * BUCKETS
        code = _FOLD[raw]
        for size in range(1, GRAMS + 1):
            if size > 1:
                code = code[:-1] * np.uint32(257) + _FOLD[raw[size - 1 :]] + np.uint32(size)
            bucket = (code * _MUL >> np.uint32(32 - _BITS)).astype(np.int64)
            if size > 1:
                same = doc[: len(code)] == doc[size - 1 :]
                out[(doc[: len(code)] + bucket)[same]] = 1
            else:
                out[doc + bucket] = 1
    return out.reshape(n, BUCKETS)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            for a, b, raw, at in chunks(part.column(1)):
                bits = np.packbits(presence(raw, at).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array([x.tobytes() for x in bits], pa.binary())], names=["lang", "bits"])


class Model:
    """Landmarks and one-versus-rest weights."""

    def __init__(self, langs: list[str], bits: list[bytes]):
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)

        def unpacked(rows) -> np.ndarray:
            x = np.unpackbits(packed[rows], axis=1).astype(np.float32)
            return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

        names = np.array(langs)
        y = (names[:, None] == np.array(self.langs)[None, :]).astype(np.float64)
        each = max(FEWEST, LANDMARKS // len(self.langs))
        pick = np.concatenate([np.flatnonzero(names == lang)[:each] for lang in self.langs])
        self.landmarks = unpacked(pick).T.copy()
        kernel = np.concatenate([unpacked(slice(lo, lo + BLOCK)) @ self.landmarks for lo in range(0, len(names), BLOCK)]).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel[pick])
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        phi = np.c_[kernel @ root, np.ones(len(kernel))]
        weight = 1 / y.sum(axis=0)[y.argmax(axis=1)]
        gram = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1]) * weight.sum() / len(kernel)
        solved = np.linalg.solve(gram, phi.T @ (y * weight[:, None]))
        self.weights = (root @ solved[:-1]).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        kernel = x @ self.landmarks / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return kernel @ self.weights + self.bias


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of ``docs`` (the caller keeps held-out rows away); needs doc_id for the sample's order."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select("doc_id", F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    few = per_label(usable.select("doc_id", "_lang", F.xxhash64("_text").alias("_hash")), "_lang", per_language, tie="_hash")
    # At most per_language rows a language (rounded up to whole hash classes), so this side is bounded; texts come in by the join.
    sample = usable.withColumn("_hash", F.xxhash64("_text")).join(F.broadcast(few), ["doc_id", "_lang", "_hash"]).dropDuplicates(["doc_id", "_lang", "_hash"])
    rows = sorted((r.lang, bytes(r.bits)) for r in map_arrow(sample.select("_lang", "_text"), _packed, "lang string, bits binary").collect())
    order = np.random.default_rng(5).permutation(len(rows))
    return Model([rows[i][0] for i in order], [rows[i][1] for i in order])


def _score(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            names = batch.schema.names
            text = batch.column(names.index("_text"))
            lang, best = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            lettered = np.array([t is not None and _LETTER.search(t) is not None for t in text.to_pylist()], dtype=bool)
            for lo in range(0, batch.num_rows if m.langs else 0, ROWS):
                for a, b, raw, at in chunks(text.slice(lo, ROWS)):
                    s = m.scores(presence(raw, at))
                    top = s.argmax(axis=1)
                    for i in np.flatnonzero(lettered[lo + a : lo + b]):
                        lang[lo + a + i], best[lo + a + i] = m.langs[top[i]], min(1.0, max(0.0, float(s[i, top[i]])))
            rest = [(n, batch.column(i)) for i, n in enumerate(names) if n != "_text"]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(lang), pa.array(best)], names=[n for n, _ in rest] + ["_lang", "_score"])

    return scan


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and other columns of ``docs`` with ``_lang`` and ``_score``."""
    carried = Carried(docs, text_col, "_lang", "_score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = map_arrow(docs.select(carried.column, F.col(text_col).alias("_text")), _score(sent), carried.schema("_lang string, _score double"))
    return out.select(*carried.restored(), "_lang", "_score")

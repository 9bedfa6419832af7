"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each document becomes its token ids and an end id.  Parts of a full window fill
windows of their own; the rest, shorter than a window, goes where it makes the
sum over fill levels of (number of partly filled windows at that level)**2
smallest, an empty window included.  ``levels[h]`` counts the open windows
filled to ``h``, so a placement is one vector expression over the level array.

Every input partition packs its own documents, in their order, so a lost task
gives the same result again and no row moves.  Memory: at most ``open_windows``
open windows; when one more would be open, the fullest is filled up from the
emptiest and leaves, or takes all of it, and the others stay as they are.  At the
end the open ones are joined and cut into full windows; the tokens left then (less
than one window a partition) are cut into powers of two, which need no padding.

Null and empty text: the end id alone.  Repeated rows are packed again.  A null
id is carried along.  Any other column is ignored.

Any tokenizers file can be used.  One that normalises and cuts texts as
``WORDWISE`` says is applied word by word, with a cache of bounded size; of any
other the whole text is encoded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.llm.staging import map_arrow
from epiframe.llm.textscan import text_buffers

WINDOW = 4096
END_ID = 2
OPEN_WINDOWS = 1024
#: Bytes of a worker's token cache, in each of its two generations; longer words than LONG_WORD bytes are not kept.
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 200
LONG_WORD = 1_024
#: The normaliser and the pre-tokenizer under which the ids of a text are those of its words.
WORDWISE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_SIGNED = re.compile(rb"([A-Za-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


def _byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies have for each byte: itself if printable Latin-1, else the next character from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WholeTexts:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


class TokenCache(dict):
    """Token ids of white-space separated words, as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, never joins characters across ASCII white space,
    and cuts where letters meet other signs than an apostrophe; so the ids of a
    text are those of its words, and words recur.  Words of plain letters go to
    the tokenizer's model directly, in its byte letters.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        low = text.lower()
        if _PLAIN(low) and len(low) == len(text):
            ids = [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.letters))]
        elif (m := _SIGNED(word)) and b"<|" not in word and _PLAIN(m[1].decode("utf-8", "replace").lower()):
            return self[m[1]] + self[m[2]]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.pop(word, None)
        if ids is None:
            ids = self._ids(word)
        if len(word) <= LONG_WORD:
            size = ENTRY_BYTES + len(word) + len(ids)
            if self.held + size > CACHE_BYTES:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[word] = ids
            self.held += size
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        take = self.__getitem__
        return [b"".join(map(take, (t if b"<|" in t else t.lower()).split())) for t in texts]


def encoder(path: str) -> TokenCache | WholeTexts:
    """The encoder that gives a tokenizer file's ids."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in parts["added_tokens"])
    suffixed = parts["model"]["type"] == "BPE" and parts["model"].get("end_of_word_suffix") == "</w>"
    wordwise = special and suffixed and (parts["normalizer"], parts["pre_tokenizer"]) == WORDWISE
    return TokenCache(path) if wordwise else WholeTexts(path)


_encoders: dict[str, TokenCache | WholeTexts] = {}


def worker_encoder(path: str) -> TokenCache | WholeTexts:
    """The worker's encoder for a tokenizer file; it outlives tasks."""
    if path not in _encoders:
        _encoders[path] = encoder(path)
    return _encoders[path]


class Packer:
    """Places pieces online; ``done`` gathers (document, start, ids, document's tokens, sequence, offset)."""

    def __init__(self, window: int, open_windows: int, first_sequence: int):
        self.window, self.limit, self.next = window, open_windows, first_sequence
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.count = 0
        self.done: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids, total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, width = len(ids) // 4, 4 * self.window
        full = len(ids) // width * width
        for i in range(0, full, width):
            self._emit([(doc, i // 4, ids[i : i + width], total)])
        if full < len(ids):
            self._place((doc, full // 4, ids[full:], total))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        fits = self.levels[: self.window - size + 1]
        after = 2 * self.levels[size:] + 1
        after[-1] = 0  # a full window is no longer partly filled
        change = after - 2 * fits + 1
        change[fits == 0] = np.iinfo(np.int64).max
        change[0] = after[0]
        level = int(np.argmin(change))
        pieces = []
        if level:
            pieces = self._take(level)
        pieces.append(piece)
        if level + size == self.window:
            self._emit(pieces)
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.levels[level + size] += 1
        self.count += 1
        if self.count > self.limit:
            self._close_one()

    def _take(self, level: int) -> list[tuple]:
        self.levels[level] -= 1
        self.count -= 1
        return self.open[level].pop()

    def _close_one(self) -> None:
        """The fullest open window takes tokens from the emptiest until it is full or the other is gone."""
        used = np.flatnonzero(self.levels)
        high = int(used[-1])
        pieces = self._take(high)
        low = int(np.flatnonzero(self.levels)[0])
        other = self._take(low)
        room = self.window - high
        while other and room:
            doc, start, ids, total = other.pop()
            if len(ids) // 4 > room:
                other.append((doc, start, ids[: -4 * room], total))
                start, ids = start + len(ids) // 4 - room, ids[-4 * room :]
            pieces.append((doc, start, ids, total))
            room -= len(ids) // 4
        for rest in (pieces, other):
            level = sum(len(p[2]) // 4 for p in rest)
            if level == self.window:
                self._emit(rest)
            elif rest:
                self.open.setdefault(level, []).append(rest)
                self.levels[level] += 1
                self.count += 1

    def join(self) -> None:
        """Join the open windows and cut them into full ones, the rest into powers of two."""
        queue = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        self.open, self.count = {}, 0
        self.levels[:] = 0
        left = sum(len(p[2]) // 4 for p in queue)
        target, now, filled = self._target(left), [], 0
        queue.reverse()
        while queue and target:
            doc, start, ids, total = queue.pop()
            room = 4 * (target - filled)
            now.append((doc, start, ids[:room], total))
            filled += min(room, len(ids)) // 4
            if len(ids) > room:
                queue.append((doc, start + room // 4, ids[room:], total))
            if filled == target:
                self._emit(now)
                left -= target
                target, now, filled = self._target(left), [], 0

    def _target(self, left: int) -> int:
        if left >= self.window:
            return self.window
        return 1 << (left.bit_length() - 1) if left else 0


def _pack(path: str, window: int, end_id: int, open_windows: int, with_ids: bool):
    tail = np.array([end_id], dtype="<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_encoder(path)
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << 33)

        def out() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            columns = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([len(r[2]) // 4 for r in rows], pa.int64()),
                pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
                pa.array([r[5] for r in rows], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[2], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw, at = text_buffers(part.column(1))
                data = memoryview(raw)
                texts = [bytes(data[at[i] : at[i + 1]]) for i in range(part.num_rows)]
                for doc, ids in zip(part.column(0).to_pylist(), cache.encode(texts)):
                    packer.add(doc, ids + tail)
                if packer.done:
                    yield out()
        packer.join()
        if packer.done:
            yield out()

    return scan


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS, with_ids: bool = True) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, a checksum of its ids, and with ``with_ids`` the ids.

    ``tokenizer`` is the path of a tokenizers JSON file that every executor has.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), _pack(tokenizer, window, end_id, open_windows, with_ids), schema)

"""A sharded minimal perfect hash over 128-bit keys, with arrays of fingerprints and values in the order of its places.

A shard holds a sequence of bit levels.  On a level each key left takes one
bit; bits that exactly one key took are kept and those keys are done, the rest
go to the next, smaller level.  A key's place is the number of kept bits before
its own, so places of n keys are 0 .. n-1, at about 3.3 bits a key and 1.7 for
the counts of bits.  A key that is not in the shard may get a place as well;
the 64-bit fingerprint there tells it apart.

Shards are Arrow rows, so that Spark builds one in a task, writes them as a
table and sends them on; :class:`Index` reads any number of them as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from epiframe.llm.textscan import mix, signed

#: Bits for each key left on a level.
ROOM = 2.0
_STEP = 0x9E3779B97F4A7C15
SCHEMA = "shard long, levels array<long>, bits binary, fingerprint binary, value binary"
_ARROW = pa.schema([("shard", pa.int64()), ("levels", pa.list_(pa.int64())), ("bits", pa.binary()), ("fingerprint", pa.binary()), ("value", pa.binary())])


def _place(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """The key's hash on a level; both halves take part."""
    return mix(high ^ mix(low + np.uint64(_STEP * (level + 1) % 2**64)))


def build(shard: int, high: np.ndarray, low: np.ndarray, values: np.ndarray) -> pa.Table:
    """One shard of distinct keys (two uint64 halves each); ``values`` has a row of a fixed dtype for each."""
    left, levels, bits = np.arange(len(high)), [], []
    while len(left):
        size = max(64, -int(-ROOM * len(left) // 64) * 64)
        at = _place(high[left], low[left], len(levels)) % np.uint64(size)
        once = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(size)
        bits.append(np.packbits(once, bitorder="little"))
        left = left[~once[at]]
    row = {"shard": shard, "levels": levels, "bits": b"".join(b.tobytes() for b in bits), "fingerprint": b"", "value": b""}
    place = Index([row], 1, values.dtype).place(high, low)
    order = np.empty(len(high), dtype=np.int64)
    order[place] = np.arange(len(high))
    row |= {"fingerprint": low[order].tobytes(), "value": values[order].tobytes()}
    return pa.Table.from_pylist([row], schema=_ARROW)


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key: pmod(high, shards) of the signed half, as Spark computes it."""
    return np.mod(signed(high), shards)


class Index:
    """Shards put end to end; lookups of a batch of keys run over all of them at once."""

    def __init__(self, rows: list[dict], shards: int, dtype):
        rows = sorted(rows, key=lambda r: r["shard"])
        deep = max([0, *(len(r["levels"]) for r in rows)])
        self.shards = shards
        self.size = np.zeros((shards, deep), dtype=np.uint64)
        self.offset = np.zeros((shards, deep), dtype=np.uint64)
        at = 0
        for r in rows:
            number = r["shard"] if shards > 1 else 0
            for i, size in enumerate(r["levels"]):
                self.size[number, i], self.offset[number, i] = size, at
                at += size
        joined = lambda name: b"".join(r[name] for r in rows)
        self.bits = np.frombuffer(joined("bits"), dtype=np.uint64)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.fingerprint = np.frombuffer(joined("fingerprint"), dtype=np.uint64)
        self.value = np.frombuffer(joined("value"), dtype=dtype)

    def place(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """A place for each key, or -1; a key that was not built in may get the place of another."""
        out = np.full(len(high), -1, dtype=np.int64)
        todo = np.arange(len(high))
        shard = shard_of(high, self.shards)
        for level in range(self.size.shape[1]):
            todo = todo[self.size[shard[todo], level] > 0]
            if not len(todo):
                break
            own = shard[todo]
            bit = self.offset[own, level] + _place(high[todo], low[todo], level) % self.size[own, level]
            word, rest = self.bits[(bit >> np.uint64(6)).astype(np.int64)], bit & np.uint64(63)
            hit = (word >> rest) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << rest[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[(bit[hit] >> np.uint64(6)).astype(np.int64)] + np.bitwise_count(below)
            todo = todo[~hit]
        return out

    def find(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the keys that were built in, and their values."""
        place = self.place(high, low)
        rows = np.flatnonzero(place >= 0)
        rows = rows[self.fingerprint[place[rows]] == low[rows]]
        return rows, self.value[place[rows]]

"""Numbers to tokens and back: bins, cosine transform, finite scalar and vector quantisation, constrained bit sequences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_unit(x: Column, bins: int = 256) -> Column:
    """Bin of [-1, 1): -1 below it and the last bin above."""
    return F.greatest(F.lit(-1), F.least(F.floor((x + 1) * (bins / 2)), F.lit(bins - 1))).cast("long")


def bin_centre(b: Column, bins: int = 256) -> Column:
    return -1 + (b + 0.5) * (2.0 / bins)


def dct_basis(n: int) -> list[list[float]]:
    """Rows of the orthonormal DCT-II."""
    return [[(math.sqrt(1 / n) if k == 0 else math.sqrt(2 / n)) * math.cos(math.pi * (i + 0.5) * k / n) for i in range(n)] for k in range(n)]


def _matrix_product(block: Column, rows: Sequence[Sequence[float]]) -> Column:
    dots = [F.aggregate(F.zip_with(block, F.array(*(F.lit(float(v)) for v in row)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for row in rows]
    return F.array(*dots)


def block_dct(values: Column, block: int) -> Column:
    """DCT-II of each block of a vector, the last one filled with zeros."""
    from epiframe.functions.arrays import fixed_chunks

    return F.transform(fixed_chunks(values, block), lambda b: _matrix_product(b, dct_basis(block)))


def block_idct(coefficients: Column, block: int) -> Column:
    basis = dct_basis(block)
    return F.flatten(F.transform(coefficients, lambda b: _matrix_product(b, [list(r) for r in zip(*basis)])))


def fsq_level(x: Column, levels: int) -> Column:
    """Level 0..levels-1 of one component: half width times tanh, shifted for even counts, rounded half to even."""
    half = (levels - 1) / 2
    shift = 0.5 if levels % 2 == 0 else 0.0
    z = half * F.tanh(x + (math.atanh(shift / half) if shift else 0.0)) - shift
    return (F.bround(z) + levels // 2).cast("long")


def fsq_code(levels_of: Sequence[Column], levels: Sequence[int]) -> Column:
    """Mixed-radix code, the first component least."""
    code, base = F.lit(0).cast("long"), 1
    for c, n in zip(levels_of, levels):
        code = code + c * base
        base *= n
    return code


def fsq_decode(code: Column, levels: Sequence[int]) -> list[Column]:
    """Components in [-1, 1] of a code."""
    out, base = [], 1
    for n in levels:
        out.append((F.floor(code / base) % n - n // 2) / F.lit(float(max(1, n // 2))))
        base *= n
    return out


def nearest_code(rows: DataFrame, vector: str, book: Sequence[tuple[int, Sequence[float]]], out: str = "code", distance: str | None = None) -> DataFrame:
    """The nearest entry of a codebook by squared distance, ties to the smaller code.

    A codebook is a model parameter of fixed size (tens to thousands of
    entries): it travels in the plan as a literal, and each row is compared in
    place, without a join.
    """
    entries = F.array(*(F.struct(F.lit(int(k)).cast("long").alias("k"), F.array(*(F.lit(float(x)) for x in v)).alias("v")) for k, v in book))
    gap = lambda v: F.aggregate(F.zip_with(F.col(vector), v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform(entries, lambda x: F.struct(gap(x["v"]).alias("d"), x["k"].alias("k"), x["v"].alias("v"))))
    got = rows.withColumn("_best", best).withColumn(out, F.col("_best.k"))
    got = got.withColumn("_v", F.col("_best.v"))
    return (got.withColumn(distance, F.col("_best.d")) if distance else got).drop("_best")


def residual_codes(rows: DataFrame, vector: str, books: Sequence[Sequence[tuple[int, Sequence[float]]]]) -> DataFrame:
    """code0, code1, ...: each level codes what the levels before left over."""
    rows = rows.withColumn("_rest", F.col(vector))
    for i, book in enumerate(books):
        rows = nearest_code(rows, "_rest", book, f"code{i}").withColumn("_rest", F.zip_with("_rest", "_v", lambda a, b: a - b)).drop("_v")
    return rows.drop("_rest")


def kmeans(rows: DataFrame, vector: str, centres: Sequence[Sequence[float]], rounds: int = 10) -> list[list[float]]:
    """Lloyd's iterations from given centres; an empty cluster keeps its centre.  Each round brings one row per cluster to the driver."""
    now = [list(map(float, c)) for c in centres]
    for _ in range(rounds):
        near = nearest_code(rows.select(vector), vector, list(enumerate(now)))
        means = near.groupBy("code").agg(F.array(*(F.avg(F.element_at(vector, i + 1)) for i in range(len(now[0])))).alias("m"))
        for r in means.collect():
            now[r.code] = list(r.m)
    return now


def token_of_code(code: Column, base: int, size: int, descending: bool = False) -> Column:
    """Token id of a code from a base upward or, descending, from a vocabulary's end; codes are clamped to the book."""
    c = F.greatest(F.lit(0), F.least(code, F.lit(size - 1)))
    return F.lit(base) - c if descending else F.lit(base) + c


#: The eight db4 scaling coefficients.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)


def _filters() -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Low and high pass: the high pass is the low pass backwards with alternating signs."""
    return DB4, tuple(x * (-1) ** k for k, x in enumerate(reversed(DB4)))


def wavelet_split(signal: Column) -> tuple[Column, Column]:
    """(approximation, detail) of one level of the periodised db4 filter bank; a signal of odd length repeats its last value."""
    even = F.when(F.size(signal) % 2 == 1, F.concat(signal, F.slice(signal, -1, 1))).otherwise(signal)

    def band(taps: Sequence[float]) -> Column:
        weighed = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(taps)))
        of = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / 2).cast("int") - 1), lambda i: F.aggregate(weighed, F.lit(0.0), lambda t, f: t + f["w"] * F.get(x, (2 * i + f["k"]) % F.size(x))))
        return F.when(F.size(signal) > 0, F.get(F.transform(F.array(even), of), F.lit(0))).otherwise(F.array().cast("array<double>"))

    low, high = _filters()
    return band(low), band(high)


def wavelet_join(approximation: Column, detail: Column, length: Column | int | None = None) -> Column:
    """The inverse of :func:`wavelet_split`, cut to ``length`` values."""
    both = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(l).alias("l"), F.lit(h).alias("h")) for k, (l, h) in enumerate(zip(*_filters()))))
    bands = F.struct(approximation.alias("a"), detail.alias("d"))

    def whole(b: Column) -> Column:
        n = F.size(b["a"])
        at = lambda j, k: F.pmod(F.floor((j - k) / 2).cast("int"), n)
        value = lambda j: F.aggregate(F.filter(both, lambda f: F.pmod(j - f["k"], F.lit(2)) == 0), F.lit(0.0), lambda t, f: t + f["l"] * F.get(b["a"], at(j, f["k"])) + f["h"] * F.get(b["d"], at(j, f["k"])))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), 2 * n - 1), value)).otherwise(F.array().cast("array<double>"))

    out = F.get(F.transform(F.array(bands), whole), F.lit(0))
    return out if length is None else F.slice(out, 1, length)


def wavelet_bands(rows: DataFrame, signal: str, levels: int = 3, out: str = "band") -> DataFrame:
    """Adds ``band0`` (the approximation) and ``band1`` .. (details from coarse to fine) of a filter bank; each level is a projection of the one before."""
    now, details = rows.withColumn("_now", F.col(signal).cast("array<double>")), []
    for n in range(levels):
        low, high = wavelet_split(F.col("_now"))
        now = now.withColumns({"_low": low, f"_high{n}": high}).drop("_now").withColumnRenamed("_low", "_now")
        details.append(f"_high{n}")
    names = ["_now", *reversed(details)]
    return now.withColumnsRenamed({c: f"{out}{i}" for i, c in enumerate(names)})


def wavelet_energy(band: Column) -> Column:
    """Sum of squares, a feature of a part."""
    return F.aggregate(band, F.lit(0.0), lambda t, x: t + x * x)


class RunCodec:
    """Bit sequences of fixed length whose inner runs are longer than ``shortest``, as numbers and as base-``base`` digits."""

    def __init__(self, length: int, shortest: int, base: int):
        self.length, self.shortest, self.base = length, shortest, base
        self._counts: dict[tuple[int, int, bool], int] = {}
        total = 2 * self._count(length - 1, 1, True) if length else 1
        self.total, self.digits = total, 1
        while base**self.digits < total:
            self.digits += 1

    def _count(self, left: int, run: int, first: bool) -> int:
        """Ways to go on for ``left`` bits from a run of ``run``; the first and the last run may be short."""
        run = min(run, self.shortest + 1)
        key = (left, run, first)
        if key not in self._counts:
            if left == 0:
                n = 1
            else:
                n = self._count(left - 1, run + 1, first)
                if first or run > self.shortest:
                    n += self._count(left - 1, 1, False)
            self._counts[key] = n
        return self._counts[key]

    def valid(self, bits: Sequence[int]) -> bool:
        runs = self._runs(bits)
        return all(n > self.shortest for _, n in runs[1:-1])

    @staticmethod
    def _runs(bits: Sequence[int]) -> list[list[int]]:
        out: list[list[int]] = []
        for b in bits:
            if out and out[-1][0] == b:
                out[-1][1] += 1
            else:
                out.append([int(b), 1])
        return out

    def repair(self, bits: Sequence[int]) -> list[int]:
        """Inner runs that are too short take the value of the run on their left, until none is."""
        runs = self._runs(bits)
        while (at := next((i for i in range(1, len(runs) - 1) if runs[i][1] <= self.shortest), None)) is not None:
            runs[at][0] = runs[at - 1][0]
            runs = self._runs([b for b, n in runs for _ in range(n)])
        return [b for b, n in runs for _ in range(n)]

    def encode(self, bits: Sequence[int]) -> list[int]:
        """Digits of the repaired sequence's rank, most significant first."""
        bits = self.repair(bits)
        rank, run, first = 0, 0, True
        for i, b in enumerate(bits):
            left = self.length - i - 1
            if i == 0:
                rank += self._count(left, 1, True) if b else 0
                run = 1
            elif b == bits[i - 1]:
                if b:
                    rank += self._count(left, 1, False) if first or run > self.shortest else 0
                run += 1
            else:
                if b:
                    rank += self._count(left, run + 1, first)
                run, first = 1, False
        digits = []
        for _ in range(self.digits):
            rank, d = divmod(rank, self.base)
            digits.append(d)
        return digits[::-1]

    def decode(self, digits: Sequence[int]) -> list[int]:
        """The sequence of a rank given in digits; ranks past the last count as the last."""
        rank = 0
        for d in digits:
            rank = rank * self.base + int(d)
        rank = min(rank, self.total - 1)
        bits: list[int] = []
        run, first = 0, True
        for i in range(self.length):
            left = self.length - i - 1
            if i == 0:
                zero = self._count(left, 1, True)
                stay = None
            else:
                stay = self._count(left, run + 1, first)
                turn = self._count(left, 1, False) if first or run > self.shortest else 0
                zero = stay if bits[-1] == 0 else turn
            b = int(rank >= zero)
            rank -= zero if b else 0
            if i == 0 or b != bits[-1]:
                first = i == 0
                run = 1
            else:
                run += 1
            bits.append(b)
        return bits

"""Codecs, serialisers and block layouts over columns against plain Python."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epiframe.functions import codec as K
from epiframe.functions import kernels
from epiframe.functions import tokens as T


def column(spark, values, kind, made):
    """``made`` of each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")
    return [r.x for r in df.select("i", made(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(("length", "shortest", "base"), [(1, 1, 4), (6, 1, 3), (9, 2, 5), (7, 0, 2), (5, 9, 4)])
def test_bit_codec_over_all_sequences(spark, length, shortest, base):
    c = T.RunColumns(length, shortest, base)
    every = [list(b) for b in itertools.product((0, 1), repeat=length)]
    assert column(spark, every, "array<int>", c.valid) == [c.codec.valid(b) for b in every]
    assert column(spark, every, "array<int>", c.repair) == [c.codec.repair(b) for b in every]
    tokens = [c.codec.encode(b) for b in every]
    assert column(spark, every, "array<int>", c.encode) == tokens
    digits = [list(t) for t in itertools.product(range(-1, base + 1), repeat=c.digits)][:3000]
    clamped = [[min(max(x, 0), base - 1) for x in t] for t in digits]
    assert column(spark, digits, "array<long>", c.decode) == [c.codec.decode(t) for t in clamped]


@pytest.mark.parametrize(("length", "shortest", "base", "kind"), [(64, 1, 16, "long"), (120, 1, 256, "decimal(38,0)"), (128, 4, 2, "long")])
def test_bit_codec_of_long_sequences(spark, length, shortest, base, kind):
    c = T.RunColumns(length, shortest, base)
    assert c.kind == kind
    rng = random.Random(length)
    bits = [[rng.randrange(2) for _ in range(length)] for _ in range(20)] + [[0] * length, [1] * length]
    bits += [list(itertools.chain.from_iterable([rng.randrange(2)] * rng.randrange(1, 9) for _ in range(length)))[:length] for _ in range(20)]
    tokens = [c.codec.encode(b) for b in bits]
    assert column(spark, bits, "array<int>", c.encode) == tokens
    assert column(spark, tokens, "array<long>", c.decode) == [c.codec.repair(b) for b in bits]


def test_ranks_beyond_38_digits_are_refused():
    with pytest.raises(ValueError):
        T.RunColumns(400, 1, 256)


GROUPS = T.marked_groups(["a", "b"], ["r"], 2, 2, 3, 50)


def plain_parse(tokens):
    out, i, known = [None] * len(GROUPS), 0, {g.marker: n for n, g in enumerate(GROUPS)}
    while i < len(tokens):
        n = known.get(tokens[i])
        if n is None:
            i += 1
            continue
        w = GROUPS[n].width
        out[n] = (tokens[i + 1 : i + 1 + w] + [0] * w)[:w]
        i += 1 + w
    return out


def test_parsing_equals_plain_python(spark):
    rng = random.Random(3)
    rows = [[], [50], [54, 1], [50, 51, 50, 52], [1, 2, 3]] + [[rng.choice([1, 2, 50, 51, 52, 53, 54, 99]) for _ in range(rng.randrange(25))] for _ in range(200)]
    assert column(spark, rows, "array<long>", lambda v: T.parse_marked(v, GROUPS)) == [plain_parse(r) for r in rows]


def test_missing_levels_and_keys(spark):
    parsed = lambda v: T.learned_levels(T.parse_marked(v, GROUPS), GROUPS, "a")
    assert column(spark, [[52, 7, 8], [50, 1, 2, 52, 3, 4], [51, 1, 1], []], "array<long>", parsed) == [[[0, 0], [7, 8]], [[1, 2], [3, 4]], None, None]
    assert column(spark, [[52, 7, 54, 8, 51]], "array<long>", lambda v: T.without_markers(v, GROUPS)) == [[7, 8]]


def test_order_settings(spark):
    codes = [F.array(F.lit(i), F.lit(i)) for i in range(4)] + [F.array(*[F.lit(9)] * 3)]
    df = spark.range(40).select("id", T.serialize_marked(GROUPS, codes).alias("fixed"), T.serialize_marked(GROUPS, codes, shuffle=F.col("id")).alias("own")).collect()
    assert {tuple(r.fixed) for r in df} == {(50, 0, 0, 51, 1, 1, 52, 2, 2, 53, 3, 3, 54, 9, 9, 9)}
    assert {tuple(r.own) for r in df} == {(50, 0, 0, 51, 1, 1, 52, 2, 2, 53, 3, 3, 54, 9, 9, 9), (51, 1, 1, 50, 0, 0, 53, 3, 3, 52, 2, 2, 54, 9, 9, 9)}


def plain_blocks(ids, block, begin, end, pad, direct, blocks):
    n = -(-len(ids) // block) if blocks is None else blocks
    cut = [(ids[i * block : (i + 1) * block] + [pad] * block)[:block] for i in range(n)]
    head, rest = sum(cut[:direct], []), cut[direct:]
    a, b, t = list(head), list(head), [3.0] * len(head)
    if rest:
        a += [begin] * block + sum(rest, []) + [end]
        b += [begin] + sum(rest, []) + [end] * block
        t += [3.01] * block + [3.0 + 0.01 * (i + 2) for i, r in enumerate(rest) for _ in r] + [3.0]
    return a, b, t


@pytest.mark.parametrize(("block", "direct", "blocks"), [(1, 0, None), (3, 0, None), (2, 1, None), (2, 9, None), (2, 0, 3), (2, 1, 0)])
def test_block_layout(spark, block, direct, blocks):
    rows = [list(range(10, 10 + n)) for n in range(8)]
    got = column(spark, rows, "array<long>", lambda v: T.block_piece(v, block, 8, 9, 0, direct, blocks))
    for r, x in zip(rows, got):
        a, b, t = plain_blocks(r, block, 8, 9, 0, direct, blocks)
        assert (x.ids, x.labels) == (a, b) and x.tags == pytest.approx(t)


def test_framed_block(spark):
    x = column(spark, [[1]], "array<long>", lambda v: T.framed(T.block_piece(v, 1, 8, 9, 0), [5], [6, 7]))[0]
    assert (x.ids, x.labels) == ([5, 8, 1, 9, 6, 7], [5, 8, 1, 9, 6, 7]) and len(x.tags) == 6


def test_dropped_state_and_masked_bins(spark):
    assert column(spark, [True, False], "boolean", lambda v: T.state_piece(F.lit(2), 4, v)["ids"]) == [[], [4, 4]]
    assert column(spark, [True, False], "boolean", lambda v: T.bins_piece(F.array(F.lit(7)), v)["labels"]) == [[T.IGNORED], [7]]


def test_codec_keys_chunks_and_absent_parts(spark):
    assert K.parted(["left_arm", "left_gripper", "right_arm"], "gripper$") == (["left_arm", "right_arm"], ["left_gripper"])
    book = [[[0.0, 0.0], [1.0, 1.0]], [[0.0, 0.0], [0.5, -0.5]]]
    c = K.ActionCodec({"arm": 3, "grip": 1}, "grip", 2, 1, 2, book, shortest=1)
    assert c.chunk_names("arm") == ["arm__chunk_0", "arm__chunk_1", "arm__chunk_2"] and len(c.groups()) == 7
    rows = spark.createDataFrame([([[1.5, 0.0, 1.0], [0.5, 0.0, 1.0]], [[1.0], [-1.0]])], "arm array<array<double>>, grip array<array<double>>")
    coded = rows.withColumn("t", c.encode({"arm": F.col("arm"), "grip": F.col("grip")}))
    back = coded.withColumn("p", T.parse_marked(F.col("t"), c.groups())).select(*(v.alias(k) for k, v in c.decode(F.col("p")).items())).first()
    assert back.arm == [[1.5, 0.0, 1.0], [0.5, 0.0, 1.0]] and back.grip == [[1.0], [-1.0]]
    idle = rows.withColumn("t", c.encode({"arm": F.col("arm"), "grip": F.col("grip")}, skip=F.array(F.lit("grip"))))
    assert idle.withColumn("p", T.parse_marked(F.col("t"), c.groups())).select(c.decode(F.col("p"))["grip"].alias("g")).first().g is None


def test_codes_equal_plain_python_for_any_chunk(spark):
    """Ties go to the smaller code, NaN and null are equally far from every entry, null chunks leave their groups out."""
    rng = random.Random(8)
    books = [[[rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] for _ in range(5)] for _ in range(2)]
    c = K.ActionCodec({"arm": 3}, "grip", 5, 2, 2, books)
    rows = [[[rng.choice([0.0, 0.25, -0.75, 1.0]) for _ in range(3)] for _ in range(5)] for _ in range(60)]
    rows += [[[float("nan"), 0.25, 1.0]] * 5, [[None, 0.25, 1.0]] * 5, None]

    def plain(chunk):
        out = []
        for level in range(2):
            for piece in range(2):
                out.append(4 * 0 + 5 + len(out) // 3)  # the marker
                for segment in range(2):
                    rest = [(row + [0.0])[piece * 2 + j] for row in chunk[segment * 2 : segment * 2 + 2] for j in range(2)]
                    for book in books[: level + 1]:
                        lost = any(x is None or x != x for x in rest)
                        code = 0 if lost else min(range(5), key=lambda k: (sum((x - y) * (x - y) for x, y in zip(rest, book[k])), k))
                        rest = rest if lost else [x - y for x, y in zip(rest, book[code])]
                    out.append(code)
        return out

    got = column(spark, rows, "array<array<double>>", lambda v: c.encode({"arm": v}))
    assert got == [plain(r) for r in rows[:-1]] + [[]]


def test_chunks_of_full_width_are_not_gathered_value_by_value(monkeypatch):
    values = np.arange(2.0 * 3 * 2).reshape(2, 3, 2)
    monkeypatch.setattr(kernels, "_placed", None)
    whole = pa.array([[[9.0, 9.0]] * 3, *values.tolist()], pa.list_(pa.list_(pa.float64())))
    assert np.array_equal(kernels._dense(whole[1:], (3, 2), np.nan), values)
    monkeypatch.undo()
    ragged = pa.array([[[1.0, 2.0, 3.0], [], [4.0]], [[None, 5.0]] * 4, None], whole.type)
    want = [[[1, 2], [0, 0], [4, 0]], [[0, 5]] * 3, [[0, 0]] * 3]
    assert kernels._dense(ragged, (3, 2), 0.0).tolist() == want


def test_null_bits_count_as_zero_and_null_sequences_stay_null(spark):
    c = T.RunColumns(6, 1, 3)
    rows = [[1, None, 0, 1, 1, 1], [None] * 6, None]
    assert column(spark, rows, "array<int>", c.encode) == [c.codec.encode([1, 0, 0, 1, 1, 1]), c.codec.encode([0] * 6), None]


def test_null_tokens_are_kept_inside_a_group(spark):
    assert column(spark, [[50, None, 3, None, 51, 4], None], "array<long>", lambda v: T.parse_marked(v, GROUPS)) == [[[None, 3], [4, 0], None, None, None], None]


@pytest.mark.parametrize("name", ["codec_reconstruction", "action_tokens", "signed_round_trip", "marked_round_trip", "bit_codec"])
def test_tokens_are_coded_and_parsed_once_and_not_by_folds(spark, sf, name, capsys):
    from epiframe.plans.registry import QUERIES

    QUERIES[name](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "aggregate(array" not in plan and "aggregate(transform" not in plan and "aggregate(concat" not in plan
    assert plan.count("[parse(") + plan.count(", parse(") == (name in ("codec_reconstruction", "signed_round_trip", "marked_round_trip"))

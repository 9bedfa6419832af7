"""Action chunks of ``events`` as tokens and back, serialisers, block layouts and wavelet bands."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from epiframe.functions import codec as K
from epiframe.functions import codes as C
from epiframe.functions import tokens as T
from epiframe.plans.registry import query, table
from epiframe.plans.windows import FRAMES_SQL, STEPS, frames

#: Two books of four entries for segments of four steps of two components.
_BOOKS = [[[round(math.cos(0.7 * (k + 1) * (j + 1) + n) * (1.0 if n == 0 else 0.4), 3) for j in range(8)] for k in range(4)] for n in range(2)]
_CODEC = K.ActionCodec({"arm": 3, "gripper": 1}, "gripper", STEPS, 2, 4, _BOOKS, shortest=1, threshold=20.0)


def _chunks(spark, d):
    """Chunks of arm (three components) and gripper (one)."""
    e = frames(spark, d)
    c = e.select("event_id", e.chunk("value", STEPS).alias("c"))
    arm = F.transform("c", lambda v: F.array(v / 50 - 1, (v - 7 * F.floor(v / 7)) / 7, v / 100))
    return c.select("event_id", arm.alias("arm"), F.transform("c", lambda v: F.array(v)).alias("gripper"))


#: The bits of a chunk, the sequence with runs repaired, and all valid sequences of eight bits in order.
_BITS_SQL = f"""{FRAMES_SQL}, bits AS (SELECT event_id, list(CASE WHEN value > 20 THEN '1' ELSE '0' END ORDER BY step) AS b FROM c GROUP BY event_id),
repaired AS (SELECT event_id, array_to_string(b, '') AS raw, list_reduce(list_concat([b[1]], list_transform(range(2, 9), lambda i: b[i] || coalesce(b[i + 1], ''))),
  lambda s, x: s || CASE WHEN length(x) = 2 AND x[1] <> right(s, 1) AND x[2] <> x[1] THEN right(s, 1) ELSE x[1] END) AS bits FROM bits),
valid AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS place FROM (SELECT lpad(bin(i), 8, '0') AS s FROM range(256) t(i)) WHERE NOT regexp_matches(s, '010|101')),
ranked AS (SELECT event_id, raw, bits, place, [place // 64 % 4, place // 16 % 4, place // 4 % 4, place % 4] AS digits FROM repaired JOIN valid ON s = bits)"""


@query(f"WITH {_BITS_SQL} SELECT event_id, raw, raw NOT LIKE '%010%' AND raw NOT LIKE '%101%' AS valid, array_to_string(digits, ',') AS tokens, bits AS decoded FROM ranked")
def bit_codec(spark, d):
    codec = _CODEC.bits
    b = _chunks(spark, d).select("event_id", F.transform("gripper", lambda v: (F.get(v, F.lit(0)) > 20).cast("int")).alias("b"))
    coded = b.select("event_id", "b", codec.encode(F.col("b")).alias("t"))
    joined = lambda c, by: F.array_join(F.transform(c, lambda x: x.cast("string")), by)
    return coded.select("event_id", joined("b", "").alias("raw"), codec.valid(F.col("b")).alias("valid"), joined("t", ",").alias("tokens"), joined(codec.decode(F.col("t")), "").alias("decoded"))


def _book_sql(n: int) -> str:
    return f"book{n}(k, v) AS (VALUES {', '.join(f'({k}, {v}::DOUBLE[])' for k, v in enumerate(_BOOKS[n]))})"


_GAP = "list_sum(list_transform(range(1, 9), lambda j: ({v}[j] - b.v[j]) * ({v}[j] - b.v[j])))"
#: Codes of both books for each chunk of two components and segment of four steps, and what they stand for.
_CODES_SQL = f"""{_BITS_SQL}, {_book_sql(0)}, {_book_sql(1)},
arm AS (SELECT event_id, list([value / 50 - 1, (value - 7 * floor(value / 7)) / 7, value / 100] ORDER BY step) AS a FROM c GROUP BY event_id),
cut AS (SELECT event_id, ch, sg, list_transform(range(0, 8), lambda j: coalesce(a[sg * 4 + j // 2 + 1][ch * 2 + j % 2 + 1], 0.0)) AS v
  FROM arm, (SELECT unnest(range(0, 2)) AS ch), (SELECT unnest(range(0, 2)) AS sg)),
one AS (SELECT x.event_id, x.ch, x.sg, x.v, b.k AS k0, b.v AS v0, list_transform(range(1, 9), lambda j: x.v[j] - b.v[j]) AS rest FROM cut x, book0 b
  QUALIFY row_number() OVER (PARTITION BY x.event_id, x.ch, x.sg ORDER BY {_GAP.format(v='x.v')}, b.k) = 1),
two AS (SELECT x.event_id, x.ch, x.sg, x.v, k0, v0, b.k AS k1, b.v AS v1 FROM one x, book1 b
  QUALIFY row_number() OVER (PARTITION BY x.event_id, x.ch, x.sg ORDER BY {_GAP.format(v='x.rest')}, b.k) = 1)"""


@query(f"""WITH {_CODES_SQL}
SELECT event_id, CAST(ch * 3 AS BIGINT) AS position, CAST(4 + ch AS BIGINT) AS token FROM two WHERE sg = 0
UNION ALL SELECT event_id, ch * 3 + 1 + sg, k0 FROM two UNION ALL SELECT event_id, 6 + ch * 3, 6 + ch FROM two WHERE sg = 0
UNION ALL SELECT event_id, 6 + ch * 3 + 1 + sg, k1 FROM two UNION ALL SELECT event_id, 12, 8 FROM ranked
UNION ALL SELECT event_id, 13 + i, digits[i + 1] FROM ranked, (SELECT unnest(range(0, 4)) AS i)""")
def action_tokens(spark, d):
    tokens = _CODEC.encode({k: F.col(k) for k in _CODEC.dims})
    out = _chunks(spark, d).select("event_id", F.posexplode(tokens).alias("position", "token"))
    return out.withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {_CODES_SQL},
e AS (SELECT 'arm' AS part, (v[j + 1] - v0[j + 1] - v1[j + 1]) AS gap FROM two, (SELECT unnest(range(0, 8)) AS j) WHERE ch * 2 + j % 2 < 3
  UNION ALL SELECT 'gripper', CASE WHEN raw[j + 1] = bits[j + 1] THEN 0.0 ELSE 2.0 END FROM ranked, (SELECT unnest(range(0, 8)) AS j))
SELECT part, round(avg(gap * gap), 6) AS mse, count(*) AS n FROM e GROUP BY part""")
def codec_reconstruction(spark, d):
    chunks = _chunks(spark, d).withColumn("tokens", _CODEC.encode({k: F.col(k) for k in _CODEC.dims}))
    back = chunks.withColumn("parsed", T.parse_marked(F.col("tokens"), _CODEC.groups()))
    back = back.withColumns({f"{k}_back": v for k, v in _CODEC.decode(F.col("parsed")).items()})
    binary = F.transform("gripper", lambda row: F.transform(row, lambda x: F.when(x > 20, 1.0).otherwise(-1.0)))
    gaps = lambda a, b: F.flatten(F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))
    both = F.array(F.struct(F.lit("arm").alias("part"), gaps("arm", "arm_back").alias("g")), F.struct(F.lit("gripper").alias("part"), gaps(binary, "gripper_back").alias("g")))
    return back.select(F.inline(both)).select("part", F.explode("g").alias("g")).groupBy("part").agg(F.round(F.avg("g"), 6).alias("mse"), F.count("*").alias("n"))


_GROUPS = T.marked_groups(["arm", "hand"], ["gripper"], 2, 2, 3, 100)


def _marked(spark, d):
    """Line items with the codes of each group: two of a learned key's level, three of the rule key."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    code = lambda i, j: (F.pmod(F.col("l_partkey") * (i + 3) + F.col("l_suppkey") * (j + 1), F.lit(100))).cast("long")
    return l, [F.array(*(code(i, j) for j in range(g.width))) for i, g in enumerate(_GROUPS)]


_MARKED_SQL = " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{g.name}' AS part, "
    + " || ',' || ".join(f"CAST((l_partkey * {i + 3} + l_suppkey * {j + 1}) % 100 AS VARCHAR)" for j in range(g.width))
    + f" AS codes FROM lineitem WHERE NOT ('{g.key}' = 'hand' AND l_suppkey % 3 = 0)"
    for i, g in enumerate(_GROUPS)
)


@query(_MARKED_SQL)
def marked_round_trip(spark, d):
    """Serialised in an order of the row's own, without idle parts and between tokens of no part, then parsed."""
    l, codes = _marked(spark, d)
    idle = F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("hand")))
    tokens = T.serialize_marked(_GROUPS, codes, idle, F.col("l_orderkey"))
    noisy = F.concat(F.array(F.lit(7).cast("long"), F.lit(999).cast("long")), tokens, F.array(F.lit(998).cast("long")))
    parsed = l.withColumn("t", noisy).select("l_orderkey", "l_linenumber", T.parse_marked(F.col("t"), _GROUPS).alias("p"))
    rows = F.array(*(F.struct(F.lit(g.name).alias("part"), F.array_join(F.transform(F.get("p", F.lit(i)), lambda x: x.cast("string")), ",").alias("codes")) for i, g in enumerate(_GROUPS)))
    return parsed.select("l_orderkey", "l_linenumber", F.inline(rows)).where("codes is not null")


_BODY = [T.SignedPart("left", (201, 202, 203, 204), 2, 2), T.SignedPart("right", (211, 212), 2, 3), T.SignedPart("lower", (221, 222), 2, 1)]


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey AS p, l_suppkey % 4 = 0 AS still FROM lineitem),
t AS (SELECT l_orderkey, l_linenumber, list_concat(
  list_concat(list_concat([221, p * 3 % 50], [201, p % 50, (p + 1) % 50, 202, (p + 2) % 50, (p + 3) % 50]), CASE WHEN still THEN [] ELSE [211, p * 2 % 50, (p * 2 + 1) % 50, (p * 2 + 2) % 50] END),
  list_concat(list_concat([222, (p * 3 + 1) % 50], [203, (p + 4) % 50, (p + 5) % 50, 204, (p + 6) % 50, (p + 7) % 50]), CASE WHEN still THEN [] ELSE [212, (p * 2 + 3) % 50, (p * 2 + 4) % 50, (p * 2 + 5) % 50] END)) AS t FROM x)
SELECT l_orderkey, l_linenumber, array_to_string(t, ',') AS tokens FROM t""")
def signed_tokens(spark, d):
    l, codes = _signed(spark, d)
    return l.select("l_orderkey", "l_linenumber", F.array_join(T.serialize_signed(_BODY, codes, first=["lower"]), ",").alias("tokens"))


def _signed(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    run = lambda m, n: F.array(*((F.col("l_partkey") * m + j) % 50 for j in range(n)))
    l = l.withColumns({"left": run(1, 8), "right": F.when(F.col("l_suppkey") % 4 != 0, run(2, 6)), "lower": run(3, 2)})
    return l, [F.col(p.name) for p in _BODY]


@query("""SELECT l_orderkey, l_linenumber, part, codes FROM (
  SELECT l_orderkey, l_linenumber, 'left' AS part, array_to_string(list_transform(range(0, 8), lambda j: (l_partkey + j) % 50), ',') AS codes FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'right', array_to_string(list_transform(range(0, 6), lambda j: (l_partkey * 2 + j) % 50), ',') FROM lineitem WHERE l_suppkey % 4 <> 0
  UNION ALL SELECT l_orderkey, l_linenumber, 'lower', array_to_string(list_transform(range(0, 2), lambda j: (l_partkey * 3 + j) % 50), ',') FROM lineitem)""")
def signed_round_trip(spark, d):
    """In a row's own order, behind indicator tokens, and back."""
    l, codes = _signed(spark, d)
    shown = F.filter(F.array(F.lit("left"), F.when(F.col("l_suppkey") % 4 != 0, "right"), F.lit("lower")), lambda x: x.isNotNull())
    tokens = T.with_indicators(T.serialize_signed(_BODY, codes, F.col("l_orderkey")), shown, {"left": 301, "right": 302, "lower": 303}, 399)
    parsed = l.withColumn("t", tokens).select("l_orderkey", "l_linenumber", F.explode(T.parse_signed(T.without_indicators(F.col("t"), 399), _BODY)).alias("part", "c"))
    return parsed.select("l_orderkey", "l_linenumber", "part", F.array_join("c", ",").alias("codes"))


@query("""WITH x AS (SELECT conv_id, turn, list_transform(string_split(coalesce(text, ''), ' '), lambda w: CAST(length(w) AS BIGINT)) AS ids FROM conversations),
b AS (SELECT conv_id, turn, list_concat(ids, list_transform(range(0, (-len(ids)) % 4 + CASE WHEN (-len(ids)) % 4 < 0 THEN 4 ELSE 0 END), lambda i: CAST(-1 AS BIGINT))) AS f FROM x),
n AS (SELECT *, len(f) // 4 AS n, least(len(f) // 4, 1) * 4 AS h FROM b),
y AS (SELECT conv_id, turn,
  CASE WHEN n > 1 THEN list_concat(list_concat(f[1:h], [-2, -2, -2, -2]), list_concat(f[h + 1:], [-3])) ELSE f END AS ids,
  CASE WHEN n > 1 THEN list_concat(list_concat(f[1:h], [-2]), list_concat(f[h + 1:], [-3, -3, -3, -3])) ELSE f END AS labels,
  CASE WHEN n > 1 THEN list_concat(list_concat([3.0, 3.0, 3.0, 3.0], [3.01, 3.01, 3.01, 3.01]), list_concat(list_transform(range(0, len(f) - h), lambda i: 3.0 + 0.01 * (i // 4 + 2)), [3.0])) ELSE list_transform(f, lambda x: 3.0) END AS tags FROM n)
SELECT conv_id, turn, CAST(i AS BIGINT) AS position, ids[i + 1] AS id, labels[i + 1] AS label, round(CAST(tags[i + 1] AS DOUBLE), 2) AS tag FROM (SELECT *, unnest(range(0, len(ids))) AS i FROM y)""")
def block_labels(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w).cast("long")).alias("ids"))
    laid = c.select("conv_id", "turn", T.block_piece(F.col("ids"), 4, -2, -3, -1, direct=1).alias("p"))
    rows = laid.select("conv_id", "turn", F.posexplode(F.arrays_zip("p.ids", "p.labels", "p.tags")).alias("position", "z"))
    return rows.select("conv_id", "turn", F.col("position").cast("long").alias("position"), F.col("z.ids").alias("id"), F.col("z.labels").alias("label"), F.round("z.tags", 2).alias("tag"))


@query("""WITH x AS (SELECT conv_id, turn, role, list_transform(string_split(coalesce(text, ''), ' '), lambda w: CAST(length(w) AS BIGINT)) AS w, turn % 3 = 0 AS dropped FROM conversations),
p AS (SELECT conv_id, turn, 0 AS part, unnest(list_concat(list_concat([901], list_transform(range(0, (56 // 14 // 2) * ((84 + turn * 28) // 14 // 2)), lambda i: 900)), [902])) AS id,
    generate_subscripts(list_concat(list_concat([901], list_transform(range(0, (56 // 14 // 2) * ((84 + turn * 28) // 14 // 2)), lambda i: 900)), [902]), 1) AS i, 'image' AS kind FROM x
  UNION ALL SELECT conv_id, turn, 1, 903, i, 'state' FROM x, (SELECT unnest([1, 2]) AS i) WHERE NOT dropped
  UNION ALL SELECT conv_id, turn, 2, unnest(w), generate_subscripts(w, 1), CASE WHEN role = 'assistant' THEN 'answer' ELSE 'text' END FROM x)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY part, i) - 1 AS BIGINT) AS position, CAST(id AS BIGINT) AS id,
  CAST(CASE WHEN kind = 'answer' THEN id ELSE -100 END AS BIGINT) AS label,
  CAST(CASE kind WHEN 'answer' THEN 6 WHEN 'text' THEN 4 WHEN 'state' THEN 2 ELSE CASE WHEN id = 900 THEN 1 ELSE 4 END END AS DOUBLE) AS tag FROM p""")
def modality_labels(spark, d):
    """An image, a state that may be dropped, and text that is trained where the assistant speaks."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w).cast("long")).alias("w"))
    pieces = [T.image_piece(F.lit(56), 84 + F.col("turn") * 28, 14, 2, 900, 901, 902), T.state_piece(F.lit(2), 903, F.col("turn") % 3 == 0), T.text_piece(F.col("w"), F.col("role") != "assistant")]
    rows = c.withColumn("p", T.joined(pieces)).select("conv_id", "turn", F.posexplode(F.arrays_zip("p.ids", "p.labels", "p.tags")).alias("position", "z"))
    return rows.select("conv_id", "turn", F.col("position").cast("long").alias("position"), F.col("z.ids").alias("id"), F.col("z.labels").alias("label"), F.col("z.tags").alias("tag"))


def _split_sql(source: str, n: int) -> str:
    of = lambda taps: f"list_transform(range(0, {n // 2}), lambda i: list_sum(list_transform(range(0, 8), lambda k: {list(taps)}[k + 1] * {source}[(2 * i + k) % {n} + 1])))"
    low, high = C._filters()
    return f"{of(low)} AS lo, {of(high)} AS hi"


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
a AS (SELECT vec_id, {_split_sql('e', 64)} FROM v), b AS (SELECT vec_id, hi AS d1, {_split_sql('lo', 32).replace('AS lo', 'AS l2').replace('AS hi', 'AS h2')} FROM a),
c AS (SELECT vec_id, d1, h2 AS d2, {_split_sql('l2', 16)} FROM b),
s AS (SELECT vec_id, 'band0' AS band, unnest(lo) AS x, generate_subscripts(lo, 1) - 1 AS i FROM c UNION ALL SELECT vec_id, 'band1', unnest(hi), generate_subscripts(hi, 1) - 1 FROM c
  UNION ALL SELECT vec_id, 'band2', unnest(d2), generate_subscripts(d2, 1) - 1 FROM c UNION ALL SELECT vec_id, 'band3', unnest(d1), generate_subscripts(d1, 1) - 1 FROM c)
SELECT vec_id, band, CAST(i AS BIGINT) AS i, round(x, 6) AS x FROM s""")
def wavelet_bands(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    bands = C.wavelet_bands(v, "e")
    rows = bands.select("vec_id", F.inline(F.array(*(F.struct(F.lit(f"band{i}").alias("band"), F.col(f"band{i}").alias("x")) for i in range(4)))))
    return rows.select("vec_id", "band", F.posexplode("x").alias("i", "x")).select("vec_id", "band", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS i)")
def wavelet_inverse(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    b = C.wavelet_bands(v, "e").withColumn("a", C.wavelet_join(F.col("band0"), F.col("band1")))
    b = b.withColumn("a", C.wavelet_join(F.col("a"), F.col("band2"))).withColumn("a", C.wavelet_join(F.col("a"), F.col("band3")))
    return b.select("vec_id", F.posexplode("a").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))

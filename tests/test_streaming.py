import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from epiframe.operators import serving
from epiframe.operators.episodes import Episodes
from epiframe.streaming import stateful as S

FILES = 3


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("replay"))
    rows = [(k, i, float(10 * k + i), [float(i), float(i + 1), float(i + 2)]) for k in range(3) for i in range(9)]
    schema = "k long, seq long, x double, chunk array<double>"
    for f in range(FILES):
        spark.createDataFrame([r for r in rows if r[1] // 3 == f], schema).coalesce(1).write.mode("append").parquet(path)
    return path, schema, spark.createDataFrame(rows, schema)


def drain(spark, replay, function, name):
    path, schema, _ = replay
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = function(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_history_equals_batch(spark, replay):
    batch = Episodes(replay[2], ["k"], ["seq"])
    want = {(r.k, r.seq): r.h for r in batch.df.select("k", "seq", batch.history("x", 4).alias("h")).collect()}
    assert {(r.k, r.seq): r.history for r in drain(spark, replay, lambda s: S.history(s, "k", "seq", "x", 4), "history").collect()} == want


def test_chunk_cache_equals_batch(spark, replay):
    want = {(r.k, r.seq): r.served for r in serving.chunk_cache(replay[2], "k", ["seq"], "chunk", 4).collect()}
    assert {(r.k, r.seq): r.served for r in drain(spark, replay, lambda s: S.chunk_cache(s, "k", "seq", "chunk", 4), "cache").collect()} == want


def test_ensemble_equals_batch(spark, replay):
    want = {(r.k, r.step): (r.value, r.votes) for r in serving.temporal_ensemble(replay[2], "k", "seq", "chunk").where("step < 9").collect()}
    assert {(r.k, r.seq): (r.value, r.votes) for r in drain(spark, replay, lambda s: S.ensemble(s, "k", "seq", "chunk"), "ensemble").collect()} == want


def test_sensor_sync(spark, tmp_path):
    rows = [(1, 0, "arm", 0.5), (1, 4, "arm", 1.0), (1, 5, "head", 9.0), (1, 6, "arm", 2.0), (1, 7, "arm", 3.0), (1, 7, "head", 8.0)]
    spark.createDataFrame(rows, "k long, t long, topic string, v double").coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k long, t long, topic string, v double").parquet(str(tmp_path / "s"))
    q = S.sensor_sync(stream, "k", "t", "topic", "v", "head", ("arm",), 3).writeStream.format("memory").queryName("sync").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.t, r.nearest) for r in spark.table("sync").collect()) == [(5, [1.0]), (7, [3.0])]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    rows = [(k, i, [float(k), float(i)], [[float(i + j), float(k - j)] for j in range(3)]) for k in range(2) for i in range(6)]
    schema = "k long, seq long, x array<double>, chunk array<array<double>>"
    for f in range(FILES):
        spark.createDataFrame([r for r in rows if r[1] // 2 == f], schema).coalesce(1).write.mode("append").parquet(path)
    return path, schema, spark.createDataFrame(rows, schema)


def test_vector_history_equals_batch(spark, vectors):
    batch = Episodes(vectors[2], ["k"], ["seq"])
    want = {(r.k, r.seq): r.h for r in batch.df.select("k", "seq", batch.history("x", 3).alias("h")).collect()}
    assert {(r.k, r.seq): r.history for r in drain(spark, vectors, lambda s: S.history(s, "k", "seq", "x", 3), "vhistory").collect()} == want


def test_vector_chunk_cache_equals_batch(spark, vectors):
    want = {(r.k, r.seq): r.served for r in serving.chunk_cache(vectors[2], "k", ["seq"], "chunk", 2).collect()}
    assert {(r.k, r.seq): r.served for r in drain(spark, vectors, lambda s: S.chunk_cache(s, "k", "seq", "chunk", 2), "vcache").collect()} == want


def test_vector_ensemble_equals_batch(spark, vectors):
    want = {(r.k, r.step): (r.value, r.votes) for r in serving.ensemble_vectors(vectors[2], "k", "seq", "chunk").where("step < 6").collect()}
    assert {(r.k, r.seq): (r.value, r.votes) for r in drain(spark, vectors, lambda s: S.ensemble(s, "k", "seq", "chunk"), "vensemble").collect()} == want


def test_vector_sensor_sync(spark, tmp_path):
    rows = [(1, 0, "arm", [0.0, 1.0]), (1, 2, "cam", [5.0]), (1, 3, "arm", [2.0, 3.0]), (1, 4, "head", [9.0]), (1, 6, "cam", [6.0]), (1, 7, "head", [8.0])]
    schema = "k long, t long, topic string, v array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "s"))
    q = S.sensor_sync(stream, "k", "t", "topic", "v", "head", ("arm", "cam"), depths={"cam": 1}).writeStream.format("memory").queryName("vsync").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.t, r.clock_value, r.nearest) for r in spark.table("vsync").collect()) == [(4, [9.0], [[2.0, 3.0], [5.0]]), (7, [8.0], [[2.0, 3.0], [6.0]])]


def requests(rng, n):
    """(server, milliseconds, id) in the order of arrival, and one request an hour later that moves the watermark past all waits."""
    at, out = 0, []
    for i in range(n):
        at += rng.choice([0, 1, 5, 40, 400])
        out.append((rng.randrange(3), at, i))
    return [*out, (9, at + 3_600_000, n)]


@pytest.mark.parametrize("files", [1, 5])
def test_micro_batches_equal_batch(spark, tmp_path, files):
    rows = requests(random.Random(files), 120)
    schema = "server long, at timestamp, id long"
    start = datetime(2024, 1, 1)
    size = -(-len(rows) // files)
    for f in range(files):
        part = [(k, start + timedelta(milliseconds=t), i) for k, t, i in rows[f * size : (f + 1) * size]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = S.micro_batches(stream, "server", "at", "id", 4, timedelta(milliseconds=50))
    q = out.writeStream.format("memory").queryName(f"batches{files}").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    base = int(spark.createDataFrame([(start,)], "t timestamp").select(F.unix_millis("t")).first()[0])
    got = sorted((r.server, r.at - base, r.id, r.batch, r.flushed - base) for r in spark.table(f"batches{files}").collect())
    replay = serving.micro_batches(spark.createDataFrame(rows, "server long, at long, id long"), "server", "at", "id", 4, 50)
    want = sorted((r.server, r["at"], r.id, r.batch, r.flushed) for r in replay.collect() if r.server != 9)
    assert got == want  # the last request's own batch is still open


def test_idle_keys_start_anew_and_others_keep_their_state(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "k long, seq long, t timestamp, x double"
    for f, rows in enumerate([[(1, 0, 0, 1.0), (2, 0, 0, 5.0)], [(2, 1, 100, 6.0)], [(2, 2, 101, 7.0)], [(1, 1, 102, 2.0), (2, 3, 102, 8.0)]]):
        spark.createDataFrame([(k, s, start + timedelta(seconds=t), x) for k, s, t, x in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, out in (("kept", S.history(stream(), "k", "seq", "x", 2)), ("idle", S.history(stream().withWatermark("t", "0 seconds"), "k", "seq", "x", 2, "t", timedelta(seconds=30)))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    of = lambda name, k: [r.history for r in spark.table(name).where(f"k = {k}").orderBy("seq").collect()]
    assert of("kept", 1) == [[1.0, 1.0], [1.0, 2.0]] and of("idle", 1) == [[1.0, 1.0], [2.0, 2.0]]
    assert of("kept", 2)[-1] == of("idle", 2)[-1] == [7.0, 8.0]
    with pytest.raises(ValueError):
        S.history(stream(), "k", "seq", "x", 2, idle=timedelta(seconds=1))


def test_isolate_errors(spark):
    got = {}
    df = spark.createDataFrame([(1,), (-1,)], "x int")
    S.isolate_errors(df, F.filter(F.array(F.when(F.col("x") < 0, "negative")), lambda e: e.isNotNull()), lambda d: got.update(good=d.count()), lambda d: got.update(bad=d.count()))
    assert got == {"good": 1, "bad": 1}

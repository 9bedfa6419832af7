import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.sources import store as S
from epiframe.sources import wire
from epiframe.spec import Feature, Part, deep_merge, flatten, json_safe, merge_features, parts_from_config, shared_queries, table_schema, unflatten, version_check

FEATURES = {"action": Feature("float32", (2,), ("a", "b")), "speed": Feature("float64", (1,)), "camera": Feature("video", (3, 4, 4))}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(e, i, [float(e), float(i)], e + i / 10, ["lift", "drop", None][e % 3]) for e in range(5) for i in range(e + 2)]
    df = spark.createDataFrame(rows, "ep long, t long, action array<double>, speed double, task string").withColumn("action", F.col("action").cast("array<float>"))
    return S.write_store(df, str(tmp_path_factory.mktemp("store")), FEATURES, 10.0, "task", "ep", ["t"], file_bytes=200)


def test_roundtrip(store):
    assert store.count() == 20
    f = store.frames().orderBy("index").collect()
    assert [r["index"] for r in f] == list(range(20))
    assert [r.frame_index for r in f[:5]] == [0, 1, 0, 1, 2]
    assert f[1].timestamp == pytest.approx(0.1)
    assert store.info()["total_episodes"] == 5
    assert "camera" not in store.frames().columns


def test_episode_read_takes_no_other_episode(store):
    assert {r.episode_index for r in store.episode(3).collect()} == {3}
    assert "In(episode_index" in store.frames(["index"], [1, 2])._jdf.queryExecution().toString() or "episode_index" in store.frames(["index"], [1, 2])._jdf.queryExecution().toString()


def test_tasks_and_ranges(store, spark):
    assert sorted((r.task_index, r.task) for r in store.tasks().collect()) == [(0, "drop"), (1, "lift")]
    e = {r.episode_index: (r.dataset_from_index, r.dataset_to_index) for r in store.episodes().collect()}
    assert e == {0: (0, 2), 1: (2, 5), 2: (5, 9), 3: (9, 14), 4: (14, 20)}
    wanted = spark.createDataFrame([(3,), (3,), (7,)], "index long")
    assert sorted(r["index"] for r in store.rows(wanted, ["index"]).collect()) == [3, 7]


def test_concat_manifest_annotations(store, spark, tmp_path):
    assert S.concat_stores([store, store]).groupBy("dataset_index").count().count() == 2
    assert S.stores_of_manifest(spark, [store.root, store.root, str(tmp_path / "none")]) == [store.root]
    assert store.annotations().count() == 0
    os.makedirs(f"{store.root}/annotations")
    with open(f"{store.root}/annotations/scene_annotations.jsonl", "w") as f:
        f.write('{"scene_index": 1, "scene": "one"}\n')
    assert [tuple(r) for r in store.annotations().collect()] == [("scene", 1, "one")]


def test_files_hold_whole_episodes_in_order(store):
    e = store.episodes().orderBy("episode_index").collect()
    places = [(r["data/chunk_index"], r["data/file_index"]) for r in e]
    assert places == sorted(places) and len(set(places)) > 1
    assert [r.tasks for r in e] == [["lift"], ["drop"], None, ["lift"], ["drop"]]
    s = {r.episode_index: r for r in store.episode_statistics().collect()}
    assert s[1]["stats/action/min"] == [1.0, 0.0] and s[1]["stats/action/max"] == [1.0, 2.0]
    assert s[1]["stats/action/count"] == [3, 3] and s[1]["stats/action/std"] == pytest.approx([0.0, (2 / 3) ** 0.5])
    assert s[0]["stats/speed/mean"] == pytest.approx([0.05])


def test_append(spark, tmp_path):
    schema = "ep long, t long, action array<float>, speed double, task string"
    rows = lambda eps, task: spark.createDataFrame([(e, i, [float(e), float(i)], 1.0, task) for e in eps for i in range(3)], schema)
    new = S.create_store(spark, str(tmp_path / "s"), FEATURES, 5.0, file_bytes=150)
    assert new.frames().count() == 0
    with pytest.raises(ValueError):
        S.create_store(spark, new.root, FEATURES, 5.0)
    S.append_episodes(new, rows([4, 2], "lift"), "task", "ep", ["t"])
    for _ in range(2):  # an empty table changes nothing
        S.append_episodes(new, rows([], "none"), "task", "ep", ["t"])
    before = new.info()
    S.append_episodes(new, rows([1, 7], "drop").union(rows([9], "lift")), "task", "ep", ["t"])
    after = new.info()
    S.write_json(spark, f"{new.root}/meta/info.json", before)  # as if the run had broken off before its end
    S.append_episodes(new, rows([1, 7], "drop").union(rows([9], "lift")), "task", "ep", ["t"])
    assert new.info() == after
    assert (after["total_episodes"], after["total_frames"], after["total_tasks"]) == (5, 15, 2)
    f = new.frames().orderBy("index").collect()
    assert [r["index"] for r in f] == list(range(15)) and [r.episode_index for r in f] == [e for e in range(5) for _ in range(3)]
    assert [r.action[0] for r in f[::3]] == [2.0, 4.0, 1.0, 7.0, 9.0] and [r.task_index for r in f[::3]] == [0, 0, 1, 1, 0]
    assert sorted((r.task_index, r.task) for r in new.tasks().collect()) == [(0, "lift"), (1, "drop")]
    files = [(r["data/chunk_index"], r["data/file_index"]) for r in new.episodes().orderBy("episode_index").collect()]
    assert files == sorted(files) and set(files[:2]).isdisjoint(files[2:])


def test_listed_episodes_open_only_their_files(store):
    files = {p for _, p in store.data_files()}
    assert len(files) > 2 and all("/data/chunk-000/file-" in p for p in files)
    one = store.episodes().where("episode_index = 3").first()
    opened = {f.split(":", 1)[-1].replace("//", "/") for f in store.frames(episodes=[3]).inputFiles()}
    assert len(opened) == 1 and opened.pop().endswith(S.DATA_FILE.format(one["data/chunk_index"], one["data/file_index"]))
    assert store.frames(episodes=[3, 77]).count() == 5 and store.frames(["index"], [77]).count() == 0


def test_counts_read_no_data_page(store, tmp_path):
    """Files whose pages are overwritten can still be counted, and no longer read."""
    import shutil

    import pyarrow.parquet as pq

    shutil.copytree(store.root, tmp_path / "broken")
    broken = S.Store(store.spark, str(tmp_path / "broken"))
    want = sorted(r.rows for r in store.row_counts().collect())
    for _, path in broken.data_files():
        path = path.removeprefix("file:")
        meta = pq.read_metadata(path)
        pages = [meta.row_group(i).column(j) for i in range(meta.num_row_groups) for j in range(meta.num_columns)]
        with open(path, "r+b") as f:
            for c in pages:
                f.seek(c.dictionary_page_offset or c.data_page_offset)
                f.write(b"\xff" * c.total_compressed_size)
    for f in (tmp_path / "broken").rglob(".*.crc"):
        f.unlink()
    assert broken.count() == 20 and sorted(r.rows for r in broken.row_counts().collect()) == want
    with pytest.raises(Exception):
        broken.frames().collect()


def test_a_store_of_another_writer_is_read(spark, tmp_path):
    import pandas as pd

    root = tmp_path / "other"
    for d in ("meta/episodes/chunk-000", "data/chunk-000", "data/chunk-001"):
        (root / d).mkdir(parents=True)
    features = {"speed": {"dtype": "float64", "shape": [1], "names": None}}
    S.write_json(spark, f"{root}/meta/info.json", {"fps": 10, "total_episodes": 2, "total_frames": 4, "chunks_size": 1, "features": features})
    for e in range(2):
        pd.DataFrame({"speed": [1.0, 2.0], "timestamp": [0.0, 0.1], "frame_index": [0, 1], "episode_index": [e, e], "index": [2 * e, 2 * e + 1], "task_index": [0, 0]}).to_parquet(root / S.DATA_FILE.format(e, 0))
    pd.DataFrame({"episode_index": [0, 1], "length": [2, 2], "dataset_from_index": [0, 2], "dataset_to_index": [2, 4], "data/chunk_index": [0, 1], "data/file_index": [0, 0], "tasks": [["lift"]] * 2}).to_parquet(root / "meta/episodes/chunk-000/file-000.parquet")
    pd.DataFrame({"task_index": [0], "task": ["lift"]}).to_parquet(root / "meta/tasks.parquet")
    other = S.Store(spark, str(root))
    assert other.count() == 4 and [r.episode_index for r in other.episode(1).collect()] == [1, 1] and len(other.frames(episodes=[1]).inputFiles()) == 1
    S.append_episodes(other, spark.createDataFrame([(5, 0, 3.0, "drop")], "ep long, t long, speed double, task string"), "task", "ep", ["t"])
    assert other.count() == 5 and other.frames().where("episode_index = 2").first()["index"] == 4
    assert sorted(r.task for r in other.tasks().collect()) == ["drop", "lift"]


SINGLE = "ep long, t long, action array<float>, speed double, task string, done boolean"


def single(spark, rows):
    return spark.createDataFrame([(e, t, [float(e), float(t)], 0.5, f"task {e % 2}", d) for e, t, d in rows], SINGLE)


BATCHES = [[(4, 0, False), (2, 0, False)], [(4, 1, True), (2, 1, False)], [], [(2, 2, True), (9, 0, True), (7, 0, False)], [(7, 1, True), (4, 0, True)]]


def contents(store):
    columns = ["index", "episode_index", "frame_index", "timestamp", "task_index", "action", "speed"]
    texts = {r.task_index: r.task for r in store.tasks().collect()}
    return [(*r[:4], texts[r.task_index], *r[5:]) for r in store.frames().select(columns).orderBy("index").collect()]


@pytest.fixture(scope="module")
def appended(spark, tmp_path_factory):
    """What the batches' whole episodes are when they are appended as they end."""
    want = S.create_store(spark, str(tmp_path_factory.mktemp("want") / "s"), FEATURES, 5.0, file_bytes=100)
    for rows in ([(4, 0, False), (4, 1, True)], [(2, 0, False), (2, 1, False), (2, 2, True), (9, 0, True)], [(7, 0, False), (7, 1, True), (4, 0, True)]):
        S.append_episodes(want, single(spark, rows).drop("done"), "task", "ep", ["t"])
    return contents(want)


def test_frame_sink_over_a_stream(spark, tmp_path, appended):
    for rows in BATCHES:
        if rows:
            single(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = S.create_store(spark, str(tmp_path / "s"), FEATURES, 5.0, file_bytes=100)
    stream = spark.readStream.schema(SINGLE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(S.FrameSink(got.root, "task", "ep", ["t"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert contents(got) == appended and got.count() == 9


def test_frame_sink_repeats_and_crashes(spark, tmp_path, appended, monkeypatch):
    got = S.create_store(spark, str(tmp_path / "s"), FEATURES, 5.0, file_bytes=100)
    sink, real = S.FrameSink(got.root, "task", "ep", ["t"]), S.write_json

    def broken(*_):
        raise OSError("lost")

    for n, rows in enumerate(BATCHES):
        if n in (1, 3):  # the run breaks off just before its end
            before = contents(got) if n > 1 else []
            monkeypatch.setattr(S, "write_json", broken)
            with pytest.raises(OSError):
                sink(single(spark, rows), n)
            monkeypatch.setattr(S, "write_json", real)
            assert (contents(got) if n > 1 else []) == before and got.count() == len(before)
        sink(single(spark, rows), n)
        after = got.info()
        if n == 3:
            sink(single(spark, rows), n)  # the same batch again
        assert got.info() == after and after["sink"]["batch"] == n
    assert contents(got) == appended


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, None)], "task_index long, task string")
    S.write_json_lines(df.where("task_index = 0"), str(tmp_path / "j"))
    S.write_json_lines(df.where("task_index = 1"), str(tmp_path / "j"), append=True)
    back = spark.read.schema(df.schema).json(str(tmp_path / "j")).orderBy("task_index").collect()
    assert [tuple(r) for r in back] == [(0, "a"), (1, None)]


def test_image_shapes():
    got = S.image_shapes_repaired({"observation.images.top": {"mean": [1, 2, 3], "count": [5]}, "action": {"mean": [1, 2, 3]}})
    assert got == {"observation.images.top": {"mean": [[[1]], [[2]], [[3]]], "count": [5]}, "action": {"mean": [1, 2, 3]}}


def test_rolling(spark):
    e = spark.createDataFrame([(i, 40) for i in range(6)], "episode_index long, size long")
    got = [tuple(r) for r in S.rolled(e, "size", 100, 2).orderBy("episode_index").select("chunk_index", "file_index").collect()]
    assert got == [(0, 0), (0, 0), (0, 0), (0, 1), (0, 1), (1, 0)]
    assert S.next_file(0, 999) == (1, 0) and S.next_file(0, 3) == (0, 4)


def test_statistics_json(spark, tmp_path):
    df = spark.createDataFrame([("arm", 0, 1.5, float("nan"))], "part string, step int, mean double, std double")
    S.statistics_to_json(df, ["part", "step"], spark, str(tmp_path / "s.json"))
    assert S.statistics_from_json(spark, str(tmp_path / "s.json")) == {"arm/0": {"mean": 1.5, "std": None}}


def test_cache_key_ignores_directory_order(spark):
    a, b = spark.range(1).select(S.cache_key(7, ["x", "y"], []), S.cache_key(7, ["y", "x"], [])).first()
    assert a == b


def test_wire():
    for x in (np.arange(6, dtype=np.int16).reshape(2, 3), np.float64(2.5), np.zeros((0, 3), np.float32)):
        assert np.array_equal(wire.unpack(wire.pack(x)), x)
    with pytest.raises(ValueError):
        wire.pack(np.array([1j]))


def test_spec():
    assert table_schema(FEATURES)["action"].dataType.simpleString() == "array<float>"
    with pytest.raises(ValueError):
        table_schema({"a/b": Feature("int64", (1,))})
    with pytest.raises(ValueError):
        Feature("float32", (1, 1, 1, 1, 1, 1)).spark_type()
    m = merge_features({"s": Feature("float32", (2,), ("x", "y"))}, {"s": Feature("float32", (2,), ("y", "z"))})
    assert m["s"] == Feature("float32", (3,), ("x", "y", "z"))
    with pytest.raises(ValueError):
        merge_features({"s": Feature("float32", (1,))}, {"s": Feature("int64", (1,))})
    tree = {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    assert unflatten(flatten(tree)) == tree
    assert deep_merge(tree, {"a": {"b": 5}})["a"] == {"b": 5, "c": {"d": 2}}
    assert json.dumps(json_safe({"a": [float("inf"), 1.0]})) == '{"a": [null, 1.0]}'
    parts = parts_from_config([{"key": "arm", "columns": ["a", "b"], "starts": [0, 1], "widths": [2, 1]}, {"key": "grip", "columns": "a", "widths": 1, "time_offset": 1}])
    assert parts[0].width == 3 and shared_queries(parts, 2) == {"a": [0, 1, 2], "b": [0, 1]}
    with pytest.raises(ValueError):
        parts_from_config([{"key": "x", "columns": "a", "widths": 1, "other": 2}])
    assert version_check("v3.0", "v3.1") == "warn"
    with pytest.raises(ValueError):
        version_check("v2.1", "v3.0")


def test_part_column(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.25],)], "a array<double>")
    assert df.select(Part("g", ("a",), (1,), (2,), flip=True).column()).first()[0] == [0.0, 0.75]


def test_episode_file_store(spark, tmp_path):
    root = str(tmp_path)
    os.makedirs(f"{root}/meta")
    os.makedirs(f"{root}/data/chunk-000")
    S.write_json(spark, f"{root}/meta/info.json", {"fps": 10, "chunks_size": 1000, "features": {"speed": {"dtype": "float64", "shape": [1], "names": None}}})
    import pandas as pd

    for e in range(3):
        pd.DataFrame({"speed": [1.0 * e, 2.0], "timestamp": [0.0, 0.1], "frame_index": [0, 1], "episode_index": [e, e], "index": [2 * e, 2 * e + 1], "task_index": [0, 0]}).to_parquet(f"{root}/data/chunk-000/episode_{e:06d}.parquet")
    with open(f"{root}/meta/tasks.jsonl", "w") as f:
        f.write('{"task_index": 0, "task": "lift"}\n')
    with open(f"{root}/meta/episodes.jsonl", "w") as f:
        f.write('{"episode_index": 0, "tasks": ["lift"], "length": 2}\n')
    store = S.EpisodeFileStore(spark, root)
    assert store.count() == 6
    assert sorted(r["index"] for r in store.frames(["index"], [0, 2]).collect()) == [0, 1, 4, 5]
    assert store.tasks().first().task == "lift" and store.episodes().first().length == 2
    path = spark.range(1).select(S.episode_path(F.lit(1234))).first()[0]
    assert path == "data/chunk-001/episode_001234.parquet"


def test_statistics_are_found_by_key_and_version(spark, tmp_path):
    folder = str(tmp_path)
    path, same = S.find_statistics(spark, folder, "k1", "v2")
    assert same is None and path.endswith("dataset_stats_k1_v2.json")
    S.write_json(spark, f"{folder}/{S.statistics_name('k1', 'v1')}", {"x": 1})
    S.write_json(spark, f"{folder}/{S.statistics_name('k1', 'v0')}", {"x": 0})
    S.write_json(spark, f"{folder}/{S.statistics_name('k2', 'v2')}", {"x": 2})
    path, same = S.find_statistics(spark, folder, "k1", "v2")
    assert same is False and S.read_json(spark, path) == {"x": 0}
    path, same = S.find_statistics(spark, folder, "k1", "v1")
    assert same is True and S.read_json(spark, path) == {"x": 1}

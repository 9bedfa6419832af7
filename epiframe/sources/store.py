"""Reading and writing episode stores.

A packed store has ``data/chunk-NNN/file-NNN.parquet``, ``meta/info.json``,
``meta/tasks.parquet`` and ``meta/episodes/*.parquet``; the older layout has one
data file per episode and JSON lines for its metadata.  All tables are lazy;
predicates on the episode and column lists reach the Parquet scan, and of listed
episodes only the files that hold them are opened.  What a run that broke off left
behind lies beyond the counts of the info file and is not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.operators.episodes import with_offsets
from epiframe.operators.selection import rank_rows
from epiframe.operators.spread import numbered
from epiframe.spec import FRAME_COLUMNS, Feature, json_safe, table_schema

#: The annotation files of a store, as JSON lines of {"<kind>_index", "<kind>"}.
ANNOTATIONS = {
    "subtask": "annotations/subtask_annotations.jsonl",
    "scene": "annotations/scene_annotations.jsonl",
    "gripper_mode": "annotations/gripper_mode_annotation.jsonl",
    "gripper_activity": "annotations/gripper_activity_annotation.jsonl",
    "eef_velocity": "annotations/eef_velocity_annotation.jsonl",
    "eef_acc_mag": "annotations/eef_acc_mag_annotation.jsonl",
    "eef_direction": "annotations/eef_direction_annotation.jsonl",
}
#: Fixed value: the name of a data file by chunk and file number.
DATA_FILE = "data/chunk-{:03d}/file-{:03d}.parquet"
FILES_PER_CHUNK = 1000
FILE_BYTES = 100 << 20
BYTES_OF = {"float32": 4, "float64": 8, "int64": 8, "int32": 4, "bool": 1}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON document, through Spark's file systems."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(json_safe(value), indent=2, sort_keys=True).encode()))
    out.close()


class Store:
    """A store at a path that Spark can read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def info(self) -> dict:
        return read_json(self.spark, f"{self.root}/meta/info.json")

    def features(self) -> dict[str, Feature]:
        return {k: Feature(v["dtype"], tuple(v["shape"]), tuple(v["names"]) if v.get("names") else None) for k, v in self.info()["features"].items()}

    def _committed(self, df: DataFrame) -> DataFrame:
        total = self.info().get("total_episodes")
        return df if total is None else df.where(F.col("episode_index") < total)

    def data_files(self) -> list[tuple[int, str]]:
        """(number, path) of the data files that have the packed layout's names, by one listing."""
        fs, p = _fs(self.spark, f"{self.root}/data/*/*.parquet")
        per_chunk = self.info().get("chunks_size", FILES_PER_CHUNK)
        found = (re.search(r"/chunk-(\d+)/file-(\d+)\.parquet$", x) for x in (str(f.getPath()) for f in fs.globStatus(p) or []))
        return sorted((int(m[1]) * per_chunk + int(m[2]), m.string) for m in found if m)

    def files_of(self, episodes: Sequence[int]) -> list[str] | None:
        """The data files that hold some episodes, by the episodes' metadata; None where they lie elsewhere."""
        if not exists(self.spark, f"{self.root}/meta/episodes"):
            return None
        held = self.episodes().where(F.col("episode_index").isin(*episodes)).select("`data/chunk_index`", "`data/file_index`").distinct()
        paths = sorted(f"{self.root}/{DATA_FILE.format(*r)}" for r in held.collect())
        return paths if all(exists(self.spark, x) for x in paths) else None

    def frames(self, columns: Sequence[str] | None = None, episodes: Sequence[int] | None = None) -> DataFrame:
        """Frames, optionally of some episodes and columns; files are found at any depth below ``data``."""
        schema = table_schema(self.features())
        files = [f"{self.root}/data"] if exists(self.spark, f"{self.root}/data") else []
        if files and episodes is not None and (known := self.files_of(episodes)) is not None:
            files = known
        if not files:
            df = self.spark.createDataFrame([], schema)
            return df.select(*columns) if columns else df
        df = self._committed(self.spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(*files))
        if episodes is not None:
            df = df.where(F.col("episode_index").isin(*episodes))
        return df.select(*columns) if columns else df

    def episode(self, k: int) -> DataFrame:
        """The frames of one episode and of no other."""
        return self.frames(episodes=[k])

    def rows(self, wanted: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Rows whose global ``index`` is in ``wanted``."""
        return self.frames().join(wanted.select("index").distinct(), "index", "left_semi").select(*columns)

    def row_counts(self) -> DataFrame:
        """(path, rows) of the data files.  No column is asked for, so tasks read footers and no data page."""
        df = self.spark.read.option("recursiveFileLookup", "true").schema(table_schema(self.features())).parquet(f"{self.root}/data")
        return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))

    def count(self) -> int:
        """Frames of the committed files, from their footers."""
        if not exists(self.spark, f"{self.root}/data"):
            return 0
        beyond = {x.split(":", 1)[-1].lstrip("/") for n, x in self.data_files() if n >= self.info().get("next_file", math.inf)}
        counts = self.row_counts()
        if beyond:
            counts = counts.where(~F.regexp_replace("path", "^[a-z]+:/*", "").isin(*beyond))
        return counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def tasks(self) -> DataFrame:
        """Texts by number, those of later appends included."""
        return self.spark.read.parquet(f"{self.root}/meta/tasks*.parquet")

    def episodes(self) -> DataFrame:
        """Episode metadata without its statistics columns."""
        df = self._committed(self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/meta/episodes"))
        return df.select(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("stats/")))

    def episode_statistics(self) -> DataFrame:
        """Statistics of each episode, a list per feature and statistic."""
        df = self._committed(self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/meta/episodes"))
        return df.select("episode_index", *(F.col(f"`{c}`") for c in df.columns if c.startswith("stats/")))

    def annotations(self) -> DataFrame:
        """(kind, index, text) of the annotation dictionaries that exist."""
        out = self.spark.createDataFrame([], "kind string, index long, text string")
        for kind, path in ANNOTATIONS.items():
            if exists(self.spark, f"{self.root}/{path}"):
                lines = self.spark.read.schema(f"{kind}_index long, {kind} string").json(f"{self.root}/{path}")
                out = out.union(lines.select(F.lit(kind), f"{kind}_index", kind))
        return out


class EpisodeFileStore(Store):
    """The older layout: one data file per episode, JSON lines for tasks, episodes and their statistics."""

    def frames(self, columns: Sequence[str] | None = None, episodes: Sequence[int] | None = None) -> DataFrame:
        """Frames; of listed episodes only their files are opened."""
        if episodes is None:
            return super().frames(columns)
        per_chunk = self.info().get("chunks_size", FILES_PER_CHUNK)
        paths = [f"{self.root}/data/chunk-{e // per_chunk:03d}/episode_{e:06d}.parquet" for e in episodes]
        df = self.spark.read.schema(table_schema(self.features())).parquet(*paths)
        return df.select(*columns) if columns else df

    def tasks(self) -> DataFrame:
        return self.spark.read.schema("task_index long, task string").json(f"{self.root}/meta/tasks.jsonl")

    def episodes(self) -> DataFrame:
        return self.spark.read.schema("episode_index long, tasks array<string>, length long").json(f"{self.root}/meta/episodes.jsonl")

    def episode_statistics(self) -> DataFrame:
        return self.spark.read.json(f"{self.root}/meta/episodes_stats.jsonl")


def concat_stores(stores: Sequence[Store]) -> DataFrame:
    """All frames with ``dataset_index``; columns that a store lacks are null; frame rates must agree."""
    rates = {s.info().get("fps") for s in stores}
    if len(rates) > 1:
        raise ValueError(f"frame rates differ: {sorted(map(str, rates))}")
    out = None
    for i, s in enumerate(stores):
        df = s.frames().withColumn("dataset_index", F.lit(i).cast("long"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def stores_of_manifest(spark: SparkSession, entries: Sequence[str]) -> list[str]:
    """Distinct, sorted store paths that have an info file; looked up in parallel on the driver."""
    roots = sorted(set(entries))
    with ThreadPoolExecutor(8) as pool:
        there = list(pool.map(lambda r: exists(spark, f"{r.rstrip('/')}/meta/info.json"), roots))
    return [r for r, ok in zip(roots, there) if ok]


def rolled(episodes: DataFrame, size: str, file_bytes: int = FILE_BYTES, per_chunk: int = FILES_PER_CHUNK, first: int = 0) -> DataFrame:
    """(chunk_index, file_index) of each episode: files are cut by running size from file ``first`` on, chunks hold ``per_chunk`` files."""
    run = with_offsets(episodes, "episode_index", size, "_a", "_b")
    file = F.floor(F.col("_a") / file_bytes) + first
    return run.withColumns({"chunk_index": F.floor(file / per_chunk).cast("long"), "file_index": (file % per_chunk).cast("long")}).drop("_a", "_b")


def next_file(chunk: int, file: int, per_chunk: int = FILES_PER_CHUNK) -> tuple[int, int]:
    return (chunk + 1, 0) if file == per_chunk - 1 else (chunk, file + 1)


def frame_bytes(frames: DataFrame, features: dict[str, Feature]) -> float:
    """Bytes of an uncompressed frame: fixed widths by the features' shapes, texts and images by their mean length."""
    width, loose = 8.0 * len(FRAME_COLUMNS), []
    for name, f in features.items():
        if f.dtype in ("string", "image"):
            loose.append(F.avg(F.octet_length(name)))
        elif f.dtype != "video" and name not in FRAME_COLUMNS:
            width += BYTES_OF[f.dtype] * math.prod(f.shape)
    return width + (sum(x or 0.0 for x in frames.agg(*loose).first()) if loose else 0.0)


def _numeric(features: dict[str, Feature]) -> dict[str, int]:
    """Scalars and vectors whose statistics an episode has, with their widths (0 for a scalar)."""
    kept = {k: f for k, f in features.items() if f.dtype not in ("string", "image", "video") and len(f.shape) == 1 and k not in FRAME_COLUMNS}
    return {k: 0 if f.shape == (1,) else f.shape[0] for k, f in kept.items()}


def episode_metadata(rows: DataFrame, tasks: DataFrame, features: dict[str, Feature]) -> DataFrame:
    """One row per episode: length, range of the global index, file, texts of its tasks and ``stats/<feature>/<statistic>`` as lists.

    Deviations are those of the population; a null component is left out of its statistics.
    """
    parts = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop, "count": F.count}
    stats = []
    for name, width in _numeric(features).items():
        dims = [F.get(name, F.lit(i)) for i in range(width)] if width else [F.col(name)]
        stats += [F.array(*(f(x.cast("double")) for x in dims)).alias(f"stats/{name}/{k}") for k, f in parts.items()]
    spans = rows.groupBy("episode_index").agg(
        F.count("*").alias("length"),
        F.min("index").alias("dataset_from_index"),
        (F.max("index") + 1).alias("dataset_to_index"),
        F.first("chunk_index").alias("data/chunk_index"),
        F.first("file_index").alias("data/file_index"),
        *stats,
    )
    texts = rows.select("episode_index", "task_index").distinct().join(tasks, "task_index").groupBy("episode_index").agg(F.sort_array(F.collect_list("task")).alias("tasks"))
    return spans.join(texts, "episode_index", "left")


def _described(features: dict[str, Feature]) -> dict:
    return {k: {"dtype": f.dtype, "shape": list(f.shape), "names": list(f.names) if f.names else None} for k, f in features.items()}


def create_store(spark: SparkSession, root: str, features: dict[str, Feature], fps: float, file_bytes: int = FILE_BYTES, per_chunk: int = FILES_PER_CHUNK) -> Store:
    """An empty store: its info file alone.  A store that is there already raises."""
    root = root.rstrip("/")
    if exists(spark, f"{root}/meta/info.json"):
        raise ValueError(f"{root} holds a store")
    table_schema(features)
    write_json(spark, f"{root}/meta/info.json", {"fps": fps, "total_episodes": 0, "total_frames": 0, "total_tasks": 0, "next_file": 0, "chunks_size": per_chunk, "data_files_size_in_mb": file_bytes / (1 << 20), "features": _described(features)})
    return Store(spark, root)


def _moved(store: Store, written: str, first: int) -> None:
    """Gives the files that a run wrote their names in the packed layout; files from number ``first`` on are of a run that broke off, and go."""
    fs, p = _fs(store.spark, f"{written}/chunk_index=*/file_index=*/*.parquet")
    path = store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for n, x in store.data_files():
        if n >= first:
            fs.delete(path(x), False)

    def move(source: str) -> None:
        chunk, file = map(int, re.search(r"/chunk_index=(\d+)/file_index=(\d+)/", source).groups())
        target = path(f"{store.root}/{DATA_FILE.format(chunk, file)}")
        fs.mkdirs(target.getParent())
        if not fs.rename(path(source), target):
            raise OSError(f"{source} could not be renamed to {target}")

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(move, [str(f.getPath()) for f in fs.globStatus(p) or []]))
    fs.delete(path(written), True)


def append_episodes(store: Store, frames: DataFrame, task: str, episode: str, order: Sequence[str], note: dict | None = None) -> Store:
    """Adds whole episodes: they are numbered in key order after those of the store, and so are their frames and new task texts.

    Files are cut by running size and follow the store's last; an episode lies in one file.  Rows without an episode are
    left out.  The info file is written last and all numbers and folders come from it, so a run that broke off is
    repeated over its own folders.  An empty table changes no count.  ``note`` is written into the info file with the
    counts, or alone where there are no episodes.
    """
    spark, root, info, features = store.spark, store.root, store.info(), store.features()
    per_chunk, limit = info.get("chunks_size", FILES_PER_CHUNK), int(info.get("data_files_size_in_mb", FILE_BYTES >> 20) * (1 << 20))
    if "next_file" not in info:  # a store of another writer
        info = info | {"next_file": store.episodes().agg(F.max(F.col("`data/chunk_index`") * per_chunk + F.col("`data/file_index`"))).first()[0] + 1}
    done, base, begun = info["total_episodes"], info["total_frames"], info.get("total_tasks") or (store.tasks().count() if info["total_episodes"] else 0)
    data, meta, new_tasks = f"{root}/_writing/episodes-{done:09d}", f"{root}/meta/episodes/episodes-{done:09d}", f"{root}/meta/{_tasks_folder(begun)}"

    texts = frames.where(F.col(task).isNotNull()).select(F.col(task).alias("task")).distinct()
    if begun:
        texts = texts.join(store.tasks().where(F.col("task_index") < begun).select("task"), "task", "left_anti")
    rank_rows(texts, ["task"], "_rank").select((F.col("_rank") + begun).alias("task_index"), "task").write.mode("overwrite").parquet(new_tasks)
    tasks = store.tasks()

    spans = rank_rows(frames.where(F.col(episode).isNotNull()).groupBy(episode).agg(F.count("*").alias("_n")), [episode], "_rank")
    spans = spans.select(F.col(episode).alias("_episode"), (F.col("_rank") + done).alias("episode_index"), "_n", (F.col("_n") * F.lit(frame_bytes(frames, features))).cast("long").alias("_bytes"))
    placed = rolled(with_offsets(spans, "episode_index", "_n", "_from", "_to"), "_bytes", limit, per_chunk, info["next_file"]).drop("_n", "_to", "_bytes")

    fps, own_time = F.lit(float(info["fps"])), "timestamp" in frames.columns
    rows = numbered(frames, [episode], order, "_frame").withColumns({"_frame": F.col("_frame").cast("long"), "_episode": F.col(episode), "_task": F.col(task)})
    rows = rows.drop("episode_index", "index", "task_index", "chunk_index", "file_index").join(placed, "_episode").join(tasks.withColumnRenamed("task", "_task"), "_task", "left")
    rows = rows.withColumns({"frame_index": F.col("_frame"), "index": F.col("_from") + F.col("_frame") + base, "timestamp": F.coalesce("timestamp", F.col("_frame") / fps) if own_time else F.col("_frame") / fps})
    schema = table_schema(features)
    files = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema), "chunk_index", "file_index").repartition("chunk_index", "file_index").sortWithinPartitions("chunk_index", "file_index", "index")
    files.write.mode("overwrite").partitionBy("chunk_index", "file_index").parquet(data)

    written = spark.read.schema(schema.add("chunk_index", "long").add("file_index", "long")).parquet(data)
    episode_metadata(written, tasks, features).write.mode("overwrite").parquet(meta)
    total = spark.read.parquet(meta).agg(F.count("*").alias("e"), F.sum("length").alias("f"), F.max(F.col("`data/chunk_index`") * per_chunk + F.col("`data/file_index`")).alias("last")).first()
    _moved(store, data, info["next_file"])
    if not total.e and note:
        write_json(spark, f"{root}/meta/info.json", info | note)
    if total.e:
        write_json(spark, f"{root}/meta/info.json", info | (note or {}) | {"total_episodes": done + total.e, "total_frames": base + total.f, "total_tasks": begun + spark.read.parquet(new_tasks).count(), "next_file": total.last + 1})
    return store


class FrameSink:
    """Adds a stream of single frames to a store: ``frames.writeStream.foreachBatch(FrameSink(...))``.

    Frames of an episode are kept aside until one of them has ``done``; then the episode is appended whole.  The info file
    names the last micro-batch and the folder of the frames kept aside, and is written once, at the end: a batch that comes
    again is left out, and one that broke off anywhere is done anew from the same frames.  Frames without an episode are
    left out; frames of an episode that was saved begin another one.
    """

    def __init__(self, root: str, task: str, episode: str, order: Sequence[str], done: str = "done"):
        self.root, self.task, self.episode, self.order, self.done = root.rstrip("/"), task, episode, list(order), done

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, self.root)
        before = store.info().get("sink", {"batch": -1, "open": None})
        if batch_id <= before["batch"]:
            return
        rows = batch.where(F.col(self.episode).isNotNull())
        if before["open"]:
            rows = spark.read.schema(batch.schema).parquet(f"{self.root}/{before['open']}").unionByName(rows)
        every, aside = (f"{self.root}/_frames/{name}-{batch_id:012d}" for name in ("batch", "open"))
        rows.write.mode("overwrite").parquet(every)
        rows = spark.read.schema(batch.schema).parquet(every)
        ended = rows.where(self.done).select(self.episode).distinct()
        rows.join(ended, self.episode, "left_anti").write.mode("overwrite").parquet(aside)
        whole = rows.join(ended, self.episode, "left_semi").drop(self.done)
        append_episodes(store, whole, self.task, self.episode, self.order, {"sink": {"batch": batch_id, "open": aside.removeprefix(f"{self.root}/")}})
        for old in (every, before["open"] and f"{self.root}/{before['open']}"):
            if old:
                fs, p = _fs(spark, old)
                fs.delete(p, True)


def _tasks_folder(begun: int) -> str:
    return f"tasks-{begun:09d}.parquet" if begun else "tasks.parquet"


def write_store(frames: DataFrame, root: str, features: dict[str, Feature], fps: float, task: str, episode: str, order: Sequence[str], file_bytes: int = FILE_BYTES) -> Store:
    """Writes a packed store where there is none: frames in files of about ``file_bytes``, tasks, episodes with their statistics, and info."""
    return append_episodes(create_store(frames.sparkSession, root, features, fps, file_bytes), frames, task, episode, order)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON lines; ``append`` adds files to those that are there.  Nulls are kept as fields."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def image_shapes_repaired(stats: dict, prefix: str = "observation.images.") -> dict:
    """Statistics whose image entries of shape (3,) are (3, 1, 1), as later writers store them."""
    fix = lambda v: [[[x]] for x in v] if isinstance(v, list) and len(v) == 3 and not isinstance(v[0], list) else v
    return {k: {n: fix(v) if n != "count" else v for n, v in s.items()} if k.startswith(prefix) else s for k, s in stats.items()}


def statistics_to_json(stats: DataFrame, keys: Sequence[str], spark: SparkSession, path: str) -> None:
    """Statistics rows (bounded by parts x steps x dimensions) as one JSON document."""
    write_json(spark, path, {"/".join(str(r[k]) for k in keys): {c: r[c] for c in stats.columns if c not in keys} for r in stats.toLocalIterator()})


def statistics_from_json(spark: SparkSession, path: str) -> dict:
    return read_json(spark, path)


def cache_key(action_size: int, directories: Sequence[str], transforms: Sequence[str]) -> Column:
    """SHA-256 of the canonical description of a statistics run."""
    return F.sha2(F.lit(json.dumps({"action_size": action_size, "directories": sorted(directories), "transforms": list(transforms)}, sort_keys=True)), 256)


def statistics_name(key: str, version: str) -> str:
    """The file of the statistics of a :func:`cache_key` made by a version of the code."""
    return f"dataset_stats_{key}_{version}.json"


def find_statistics(spark: SparkSession, folder: str, key: str, version: str) -> tuple[str, bool | None]:
    """(path, whether it is of this version): of statistics in a folder, else those of another version (the first by name), else the path to write and None."""
    fs, p = _fs(spark, f"{folder.rstrip('/')}/{statistics_name(key, '*')}")
    known = sorted(f.getPath().getName() for f in fs.globStatus(p) or [])
    exact = statistics_name(key, version)
    if exact in known or not known:
        return f"{folder.rstrip('/')}/{exact}", True if known else None
    return f"{folder.rstrip('/')}/{known[0]}", False


def episode_path(episode: Column, per_chunk: int = FILES_PER_CHUNK) -> Column:
    """Data file of an episode in the older layout."""
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", F.floor(episode / per_chunk), episode)

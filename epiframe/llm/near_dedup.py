"""MinHash near-dedup with an LSH forest, links confirmed on full shingle sets.

* Documents with the same shingle set form a class, known by a key of the set, so
  thousands of copies cost one signature.
* Each tree of the forest is an order of the class signatures: tree ``t`` reads
  the hashes from ``t * DEPTH`` on, around the end.  Classes that agree on the
  first ``DEPTH`` values of a tree form a region of that order.
* Every class is a candidate with the smallest key of its regions, and with the
  neighbour of longest common prefix over all orders; a prefix goes as deep as
  its region needs.  That links a large group of near copies with two
  candidates a class, however many regions share them.
* Regions that then hold several components are walked deeper: in each of their
  orders, neighbours of longest common prefix that lie in different components
  are the next candidates.
* After these links, the classes of regions that still hold several components
  are gone through again, by an exact prefix-filter join that covers all pairs
  of different components and needs no bound on a region's size.

Shingles: ``words`` consecutive words after A-Z are lower-cased; shorter texts
are one shingle; empty and null texts have none and are linked with nothing.
A row without an id is linked with nothing, its component is null and it is
kept.  Rows that share an id are linked, whatever their texts; each keeps its own
set, and links are confirmed on the sets of all its texts.  Sets are compared by
64-bit hashes, and known by 192 bits of them.
A link needs 100 * |intersection| >= PERCENT * |union|.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.llm.components import components
from epiframe.llm.staging import dropped, map_arrow, staged
from epiframe.llm.textscan import Words, chunks, mix, rolling, signed, window_rows

SHINGLE = 5
PERCENT = 75
TREES = 32
DEPTH = 4
HASHES = TREES * DEPTH
_A = np.random.default_rng(71).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(72).integers(1, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    words = Words(raw, at, lower=True)
    rows, doc = window_rows(words.first, width)
    grams = rolling(words.hash, width)[rows] if len(rows) else np.zeros(0, np.uint64)
    cut = np.searchsorted(doc, np.arange(len(at)))
    for i in range(len(at) - 1):
        if cut[i + 1] > cut[i]:
            yield np.unique(grams[cut[i] : cut[i + 1]])
        else:
            own = words.hash[words.first[i] : words.first[i + 1]]
            yield rolling(own, len(own)) ^ np.uint64(len(own)) if len(own) else own


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima over a set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[i : i + 2048, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def _digest(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two hashes of a set."""
    if not len(shingles):
        return np.uint64(0), np.uint64(0)
    return np.bitwise_xor.reduce(mix(shingles)), np.add.reduce(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def _describe(width: int):
    """(id, text_hash, text) -> (id, text_hash, size, one, two, sig)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in chunks(batch.column(2)):
                size, one, two, sig = [], [], [], []
                for s in shingle_sets(raw, at, width):
                    size.append(len(s))
                    x, y = _digest(s)
                    one.append(x)
                    two.append(y)
                    sig.append(signature(mix(s)).astype(">u4").tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(signed(np.array(one, np.uint64))), pa.array(signed(np.array(two, np.uint64))), pa.array(sig, pa.binary())],
                    names=["id", "text_hash", "size", "one", "two", "sig"],
                )

    return scan


def _sets(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in chunks(batch.column(0)):
                sets = list(shingle_sets(raw, at, width))
                one, two = zip(*map(_digest, sets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(np.array(one, np.uint64))), pa.array(signed(np.array(two, np.uint64))), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))],
                    names=["size", "one", "two", "set"],
                )

    return scan


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (region, rest of the order, rep) -> (a, b, lcp), both ways, for each two that follow one another in a region."""
    before = (None, b"", None)
    for batch in batches:
        a, b, lcp = [], [], []
        for region, tail, rep in zip(*(c.to_pylist() for c in batch.columns)):
            if region == before[0] and rep != before[2]:
                depth = 0
                while depth < len(tail) and tail[depth : depth + 4] == before[1][depth : depth + 4]:
                    depth += 4
                a += [before[2], rep]
                b += [rep, before[2]]
                lcp += [depth // 4] * 2
            before = (region, tail, rep)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(lcp, pa.int32())], names=["a", "b", "lcp"])


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb") - common
    return pairs.join(left, "a").join(right, "b").where(100 * common >= percent * union).select("a", "b")


def _size_ok(sizes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    a = sizes.select(F.col("id").alias("a"), F.col("size").alias("na"))
    b = sizes.select(F.col("id").alias("b"), F.col("size").alias("nb"))
    return pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")


def forest_regions(classes: DataFrame) -> DataFrame:
    """(region, rep, low, n): for each tree, the classes that share its first DEPTH values with another; low is the region's smallest key."""
    step = 4 * DEPTH
    keys = classes.where("size > 0").select(
        F.col("id").alias("rep"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring(F.col("sig"), t * step + 1, F.lit(step))))).alias("tree", "region"),
    )
    shared = keys.groupBy("region").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("top")).where("low < top").drop("top")
    return keys.join(shared, "region")


def _prefix_pairs(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs that can meet the threshold among ``crowd`` (id, component), of different components.

    Shingles are ordered by rarity.  A pair (the smaller set first) that meets
    the threshold shares one of the rarest ``n - ceil(2p / (100 + p) * n) + 1``
    shingles of the smaller and ``n - ceil(p / 100 * n) + 1`` of the larger set.
    With the places of a shared shingle, no more can be common than what either
    set has from there on: that drops pairs that share only a common passage.
    Shingles held by a single component give no pair.
    """
    posts = crowd.join(sets, "id").select("id", "component", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    counts = staged(posts.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")), "frequencies")
    ranked = posts.join(counts, "shingle").groupBy("id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle", (F.col("lo") < F.col("hi")).alias("mixed")))).alias("all"))
    larger = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    smaller = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)).cast("int") + 1
    rows = staged(ranked.select("id", "component", "n", smaller.alias("smaller"), F.posexplode(F.slice("all", F.lit(1), larger)).alias("place", "s")).where("s.mixed").select("id", "component", "n", "place", "smaller", F.col("s.shingle").alias("shingle")), "prefixes")
    other = rows.where("place < smaller").select("shingle", F.col("id").alias("id2"), F.col("component").alias("component2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    order = (F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") > F.col("id2")))
    most = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    fits = (100 * F.col("n2") >= percent * F.col("n")) & ((100 + percent) * most >= percent * (F.col("n") + F.col("n2")))
    return rows.join(other, "shingle").where(order & (F.col("component") != F.col("component2")) & fits).select(*_ordered("id", "id2")).distinct()


def _class_key():
    """The key of a class, from the hashes and the size of its set."""
    return F.xxhash64("one", "two", "size")


def _mixed(regions: DataFrame, label: DataFrame) -> DataFrame:
    """(region, id, component) of the regions that hold several components."""
    at = regions.select("region", "tree", F.col("rep").alias("id")).join(label, "id")
    mixed = at.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("region")
    return at.join(mixed, "region")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (id, component) after ``links`` join some of its components; only links between components are gone through."""
    of = lambda end: label.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = components(between).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return label.join(found, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, size, component) for every row of ``docs``; component is the smallest id linked with it, directly or not."""
    return _grouped(docs, id_col, text_col, width, percent, True).select("id", "size", "component")


def near_duplicate_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, text_hash, size, group) for every row of ``docs``: its near-duplicate group by its text alone, whatever its id.

    ``text_hash`` is xxhash64 of the text, by which rows of one id are told apart; ``group`` is null for texts without shingles.
    """
    return _grouped(docs, id_col, text_col, width, percent, False).select("id", "text_hash", "size", F.col("root").alias("group"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, join_ids: bool) -> DataFrame:
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    described = staged(map_arrow(text, _describe(width), "id long, text_hash long, size long, one long, two long, sig binary"), "described")
    named = described.where("id is not null and size > 0" if join_ids else "size > 0").withColumn("key", _class_key())
    holder = F.min(F.struct("id", "text_hash")).alias("holder")
    classes = staged(named.groupBy("key").agg(F.first("size").alias("size"), holder, F.first("sig").alias("sig")).withColumnRenamed("key", "id"), "classes")
    # Texts of one id: its class of smallest key is linked with the others.
    shared = named.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("top")).where("a < top").select("id", "a")
    same_id = named.select("id", F.col("key").alias("b")).join(shared, "id").where("a < b").select("a", "b")
    sizes = classes.select("id", "size")
    regions = staged(forest_regions(classes), "regions")

    order = classes.select(F.col("id").alias("rep"), "sig")
    depth = 4 * DEPTH
    tail = F.expr(f"substring(concat(sig, sig), tree * {depth} + {depth + 1}, 48)")

    def neighbours(of: DataFrame) -> DataFrame:
        rows = of.join(order, "rep").select("region", tail.alias("tail"), "rep").repartitionByRange("region", "tail", "rep").sortWithinPartitions("region", "tail", "rep")
        return map_arrow(rows, _neighbours, "a long, b long, lcp int")

    deepest = neighbours(regions.where("n > 2")).groupBy("a").agg(F.max(F.struct("lcp", "b")).alias("m")).select(*_ordered("a", "m.b"))
    lowest = regions.where("rep <> low").groupBy("rep").agg(F.min("low").alias("low")).select(*_ordered("low", "rep"))
    first = staged(_size_ok(sizes, lowest.union(deepest).distinct(), percent), "pairs")

    wanted = regions.select(F.col("rep").alias("id")).distinct()
    holders = wanted.join(classes.select("id", "holder"), "id").select(F.col("holder").alias("row")).distinct()
    texts = text.select(F.struct("id", "text_hash").alias("row"), "text").join(holders, "row")
    found_sets = map_arrow(texts.select("text"), _sets(width), "size long, one long, two long, set array<long>").select(_class_key().alias("id"), "set")
    sets = staged(found_sets.join(wanted, "id").dropDuplicates(["id"]), "sets")
    links = _confirm(first, sets, percent)
    # Every class is there, as those of one id need not share a region.
    label = staged(_joined(classes.select("id", F.col("id").alias("component")), links.union(same_id) if join_ids else links), "labels")

    open_ = staged(_mixed(regions, label), "open")
    walked = neighbours(open_.select(F.col("id").alias("rep"), "region", "tree")).where("a < b").select("a", "b").distinct()
    apart = walked.join(label.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    deeper = staged(_size_ok(sizes, apart.where("ca <> cb").select("a", "b"), percent).join(first, ["a", "b"], "left_anti"), "deeper")
    label_now = staged(_joined(label, _confirm(deeper, sets, percent)), "labels")

    crowd = staged(_mixed(open_.select("region", "tree", F.col("id").alias("rep")), label_now).select("id", "component").distinct(), "crowd")
    second = _prefix_pairs(crowd, sets, percent).join(first.union(deeper), ["a", "b"], "left_anti")
    joined = _joined(label_now, _confirm(second, sets, percent))
    # The smallest id of each class of a component.
    roots = classes.join(joined, "id").select(F.col("id").alias("key"), F.col("component").alias("root"), F.col("holder.id").alias("holder"))
    lowest_id = roots.groupBy("root").agg(F.min("holder").alias("component"))
    of_class = staged(roots.join(lowest_id, "root").select("key", "root", "component"), "components")
    dropped(regions, first, sets, label, open_, deeper, label_now, crowd, classes)

    merged = described.withColumn("key", F.when(F.col("size") > 0, _class_key())).join(of_class, "key", "left")
    return merged.select("id", "text_hash", "size", "root", F.when(F.col("id").isNull() | (F.col("size") == 0), F.col("id")).otherwise(F.coalesce("component", "id")).alias("component"))

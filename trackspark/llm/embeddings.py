"""Embedding near-duplicates: a forest of random-projection trees with spill, then exact counts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared


def vectors(rows: DataFrame) -> DataFrame:
    """Rows ``vec_id``, ``key``, ``unit``: 16 bytes the same for equal vectors, and the vector at length 1 in doubles.

    Both are null where a vector is null, empty, zero, or holds null or a non-finite number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, units = [], []
            for v in b.column(1).to_pylist():
                x = np.array(v if v and None not in v else [], np.float64)
                size = math.sqrt(float(np.dot(y := x / top, y))) if x.size and np.isfinite(x).all() and (top := np.abs(x).max()) > 0 else 0.0
                keys.append(hashlib.md5((x + 0.0).tobytes()).digest() if size else None)
                units.append(y / size if size else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))], ["vec_id", "key", "unit"])

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, key binary, unit array<double>")


def _direction(dims: int, *place: int) -> np.ndarray:
    """The random direction of a node; its place in the forest is the seed, so it is never stored."""
    return np.random.default_rng([dims, *place]).standard_normal(dims)


class Upper:
    """The upper levels of one tree for vectors of ``dims`` numbers: thresholds from a sample."""

    def __init__(self, tree: int, dims: int, depth: int, spill: float, sample: np.ndarray) -> None:
        self.tree, self.dims, self.depth, self.bands = tree, dims, depth, {}
        parts = {1: sample}
        for _ in range(depth):
            below = {}
            for node, x in parts.items():
                side = x @ _direction(dims, tree, node)
                lo, hi = np.quantile(side, [0.5 - spill, 0.5 + spill]) if len(x) else (0.0, 0.0)
                self.bands[node] = (lo, hi)
                below[2 * node], below[2 * node + 1] = x[side <= hi], x[side >= lo]
            parts = below

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of each vector in all lowest nodes that it reaches."""
        at = {1: np.arange(len(x))}
        for _ in range(self.depth):
            below = {}
            for node, rows in at.items():
                side = x[rows] @ _direction(self.dims, self.tree, node)
                lo, hi = self.bands[node]
                below[2 * node], below[2 * node + 1] = rows[side <= hi], rows[side >= lo]
            at = {n: r for n, r in below.items() if len(r)}
        return np.concatenate([np.zeros(0, np.int64), *at.values()]), np.repeat(list(at), [len(r) for r in at.values()]).astype(np.int64)


def leaf_links(x: np.ndarray, tree: int, node: int, least: float, leaf: int, spill: float) -> np.ndarray:
    """For each vector of a cell the smallest index that links within leaves reach.

    The cell is split on at its own medians, by rank, with ``spill`` of the rows going to both sides, until at
    most ``leaf`` are left; these are all compared.
    """
    root = np.arange(len(x))
    todo = [(np.arange(len(x)), node)]
    while todo:
        rows, at = todo.pop()
        if len(rows) > leaf:
            order = rows[np.argsort(x[rows] @ _direction(x.shape[1], tree, at), kind="stable")]
            half, more = len(rows) // 2, int(len(rows) * spill)
            todo += [(order[: half + more], 2 * at), (order[half - more :], 2 * at + 1)]
            continue
        y = x[rows]
        a, b = np.nonzero(np.triu(y @ y.T >= least, 1))
        apart = root[rows[a]] != root[rows[b]]
        if apart.any():
            held = np.flatnonzero(root != np.arange(len(x)))
            root = shared.united(len(x), np.concatenate([held, rows[a[apart]]]), np.concatenate([root[held], rows[b[apart]]]))
    return root


def forest_links(units: DataFrame, least: float = 0.9, trees: int = 12, leaf: int = 256, spill: float = 0.08, cell: int = 16_384, sample: int = 65_536) -> DataFrame:
    """Edges ``a``, ``b`` of ``key`` that connect what links found in the forest connect.

    ``units`` has a row for each distinct vector (``key``, ``unit``). The upper levels of every tree
    are fitted on up to ``sample`` vectors drawn by key, as deep as makes cells of about ``cell``
    vectors (depth up to 12); all vectors go down, those near a threshold on both sides. A cell
    is one group of Spark, split on by its own rows.
    """
    n = units.count()
    depth = min(12, max(0, math.ceil(math.log2(max(1, n) / cell))))
    drawn = units.orderBy(F.xxhash64("key"), "key").limit(sample if depth else 0)
    by_dims: dict[int, list] = {}
    for (v,) in drawn.select("unit").toLocalIterator():
        by_dims.setdefault(len(v), []).append(np.array(v))
    uppers = {d: [Upper(t, d, depth, spill, np.stack(v)) for t in range(trees)] for d, v in by_dims.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy()
            flat, dims = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = flat[ends[rows][:, None] + np.arange(d)]
                for t in range(trees):
                    at, node = uppers[d][t].cells(x) if d in uppers else (np.arange(len(rows)), np.ones(len(rows), np.int64))
                    took = b.take(pa.array(rows[at]))
                    extra = [pa.array(np.full(len(at), v, np.int32)) for v in (d, t)]
                    yield pa.RecordBatch.from_arrays([*took.columns, *extra, pa.array(node)], ["key", "unit", "dims", "tree", "node"])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        d, t, node = (k.as_py() for k in key)
        names = table.column("key").combine_chunks()
        order = pc.sort_indices(names)  # the same links on each run
        table = table.take(order)
        names = table.column("key").combine_chunks()
        x = table.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        root = leaf_links(x, t, node, least, leaf, spill)
        a = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(root[a]))})

    routed = units.select("key", "unit").mapInArrow(route, "key binary, unit array<double>, dims int, tree int, node long")
    return routed.groupBy("dims", "tree", "node").applyInArrow(compare, "a binary, b binary")


def link_counts(units: DataFrame, roots: DataFrame, least: float, block: int = 2_048) -> DataFrame:
    """Rows ``key``, ``n``: vectors, copies counted (``copies``), that link with each key within its component.

    Where every vector of a component is within half the angle of ``least`` of its mean,
    all pairs link and nothing is compared. Other components are dealt to blocks of about ``block``
    vectors; each two blocks meet in one group, so neither a task nor a row holds a whole component.
    """
    inside = units.join(roots.select(F.col("node").alias("key"), "root"), "key")
    inside = shared.materialise(inside, "members")
    mean = inside.select("root", "copies", F.posexplode("unit").alias("at", "v")).groupBy("root", "at").agg(F.sum("v").alias("v"))
    mean = mean.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("mean"))
    cosine = F.aggregate(F.zip_with("unit", "mean", lambda u, m: u * m["v"]), F.lit(0.0), lambda a, b: a + b)
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, m: a + m["v"] * m["v"]))
    near = inside.join(mean, "root").select("root", "copies", F.when(length > 0, cosine / length).otherwise(-1.0).alias("c"))
    stats = near.groupBy("root").agg(F.min("c").alias("c"), F.count("*").alias("size"), F.sum("copies").alias("all"))
    half = math.cos(math.acos(least) / 2) + 1e-9
    stats = shared.materialise(stats.withColumn("tight", F.col("c") >= half), "components")
    tight = inside.join(stats.where("tight"), "root").select("key", (F.col("all") - F.col("copies")).alias("n"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    loose = inside.join(stats.where("not coalesce(tight, false)"), "root").withColumn("blocks", blocks)
    loose = loose.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    loose = loose.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    loose = loose.select("key", "unit", "copies", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        copies, own = (table.column(c).to_numpy() for c in ("copies", "own"))
        x = table.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
        n = np.zeros(len(own), np.int64)
        for at in range(0, len(own), 1024):
            links = x[at : at + 1024] @ x.T >= least
            links[np.arange(len(links)), at + np.arange(len(links))] = False
            if i != j:  # pairs within a block are counted where it meets itself
                links &= own[at : at + 1024, None] != own
            n[at : at + 1024] = links @ copies
        return pa.table({"key": table.column("key"), "n": pa.array(n)})

    counted = loose.groupBy("root", "i", "j").applyInArrow(compare, "key binary, n long")
    return tight.union(counted.groupBy("key").agg(F.sum("n").alias("n")))


def near_duplicates(rows: DataFrame, least: float = 0.9, **forest: object) -> DataFrame:
    """Rows ``vec_id``, ``n_links``, ``component_id``, ``kept``, one for each row of ``rows`` (``vec_id``, ``embedding``).

    Vectors link at a cosine of at least ``least`` in doubles. The forest finds the components, and every
    pair within one is then judged exactly, so links are missed only where no tree brings
    a component's parts together. Equal vectors are one node with a count of copies. Vectors without a direction (null,
    zero, null or non-finite parts) and vectors of different lengths link with nothing. ``component_id`` is the
    smallest ``vec_id`` reached; rows without an id count as vectors, have a null id and are not kept
    unless no vector of their component has one. Other columns are not read.
    """
    v = shared.materialise(vectors(rows), "vectors")
    units = v.where("key is not null").groupBy("key").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    units = shared.materialise(units, "units")
    roots = shared.materialise(shared.components(forest_links(units, least, **forest)), "roots")
    links = link_counts(units.select("key", "unit", "copies"), roots, least)
    nodes = units.select("key", "copies", "low").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").join(links, "key", "left")
    nodes = shared.materialise(nodes.withColumn("root", F.coalesce("root", "key")), "nodes")
    low = nodes.groupBy("root").agg(F.min("low").alias("component"))
    nodes = nodes.join(low, "root").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    out = v.select("vec_id", "key").join(nodes, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Helpers of the operators: shared folders, running totals, connected components."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word rule of all operators: runs of anything but ASCII white space, as ``bytes.split`` has it.
WORD = r"[^\x20\x09-\x0D]+"


@functools.cache
def _own_folder(app: str) -> str:
    return tempfile.mkdtemp(prefix=f"llm-{app}-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``).

    Unset, a local session gets a folder of its own; a cluster gets an error, since
    its executors would not see the driver's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{_own_folder(spark.sparkContext.applicationId)}"
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


#: Tables of the enclosing ``passing`` blocks, the innermost last.
_PASSING: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside is deleted at the end; only what says ``keep`` stays.

    Nothing that is returned may still have to read the others.
    """
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, rows are fixed.

    Inside a ``passing`` block the table goes with it; with ``keep`` it belongs to the block around that, if any.
    """
    path = scratch(df.sparkSession, name)
    holders = _PASSING[:-1] if keep else _PASSING
    if holders:
        holders[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pieces(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in a binary or string column hold about ``most`` bytes, one row at least."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def running_totals(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` (long) over all rows before this one in ``order``.

    Rows are dealt out by range and summed within each partition; the partitions' own
    totals (one row each, so their number is bounded by the partitions) are then added
    up. Rows equal in ``order`` follow each other in no fixed order.
    """
    pid, local = fresh(df, "pid", "local")
    schema = T.StructType([*df.schema.fields, T.StructField(pid, T.IntegerType()), T.StructField(local, T.LongType())])
    at = df.columns.index(value)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        k = TaskContext.get().partitionId()
        for b in batches:
            v = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(v)
            if len(v):
                total = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(v), k, np.int32)), pa.array(ends - v)], [*b.schema.names, pid, local]
            )

    parts = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema), "totals"
    )
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(pid).agg(F.sum(value).alias("t")).select(
        F.col(pid), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset_")
    )
    joined = parts.join(F.broadcast(totals.select(F.col(pid).alias("pid_"), "offset_")), F.col(pid) == F.col("pid_"))
    return joined.select(*df.columns, (F.col(local) + F.col("offset_")).alias(out))


def meet(big: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner", parts: int = 1000) -> DataFrame:
    """``big`` joined with ``small`` on ``key``, a column of both that is unique in ``small``; no task holds a hot key whole.

    Keys of over 1 / ``parts`` of the rows of ``big`` are salted by the column ``by``, as often as they exceed that. They are
    fewer than ``parts``, so the table of them that goes to all tasks has a fixed largest size. Null keys match nothing and are spread, too.
    """
    held, much, salt = fresh(big.select("*", *(F.lit(0).alias(c) for c in small.columns if c not in big.columns)), "held", "much", "salt")
    n = big.count()
    hot = big.groupBy(F.col(key).alias(held)).agg(F.ceil(F.count("*") * parts / max(1, n)).cast("int").alias(much)).where(F.col(much) > 1)
    hot = F.broadcast(materialise(hot, "hot"))
    times = F.coalesce(much, F.lit(1))
    left = big.join(hot, F.col(key) == F.col(held), "left")
    left = left.withColumn(salt, F.pmod(F.xxhash64(by), F.when(F.col(key).isNull(), parts).otherwise(times)).cast("int")).drop(held, much)
    right = small.join(hot, F.col(key) == F.col(held), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), times - 1))).drop(held, much)
    return left.join(right, [key, salt], how).drop(salt)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the edges ``a``, ``b`` (any orderable type): rows ``node``, ``root``.

    ``root`` is the smallest node of the component; only nodes with an edge to another
    node appear. Large-star and small-star steps alternate until nothing changes; each
    step is a partial minimum by node and a join with those minima, so a node with many
    edges is never gathered. Tables are written in the shared folder after every round.
    """
    e = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    state = None
    for _ in range(rounds):
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new[0] == 0 or tuple(new) == state:
            break
        state = tuple(new)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "k")
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(least.select("u", "m")).where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("the components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(e.select(F.col("v"), F.col("v")).distinct())


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices over the links ``a[i]``-``b[i]``."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value begins and ends in them; nulls are empty."""
    column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32, column.offset + len(column) + 1)[column.offset :] if len(column) else np.zeros(1, np.int32)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def count_words(column: pa.Array) -> np.ndarray:
    """Words of each text; null has none."""
    data, at = flat(column)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = at[(at > 0) & (at < len(data))]
    begins[inner] = ~space[inner]
    total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]

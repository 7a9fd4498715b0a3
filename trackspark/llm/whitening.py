"""Whitening of embeddings by a covariance over distinct vectors, each weighted with its copies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared

#: Entries as whole numbers: floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Entries of this size and over have no exact place among the whole numbers here; their vectors count as not finite.
LARGEST = float(1 << 40)
#: Sums of entries are kept in two parts of this base, so that they are exact.
BASE = 1 << 20
#: Rows multiplied at once.
BLOCK = 8_192


def lattice(rows: DataFrame) -> DataFrame:
    """Rows ``row``, ``vec_id``, ``key``, ``x`` (array of long) of all vectors that are neither null nor hold null or non-finite entries.

    ``key`` is 16 bytes, the same for equal ``x``; ``row`` numbers the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends, values = lists.offsets.to_numpy().astype(np.int64), lists.values
            flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
            with np.errstate(invalid="ignore"):
                fits = np.abs(flat) < LARGEST
            bad = np.concatenate([[0], np.cumsum(~fits)])
            good = (bad[ends[1:]] == bad[ends[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
            x = np.floor(STEPS * np.where(fits, flat, 0.0)).astype(np.int64) + SHIFT
            at = np.flatnonzero(good)
            keys = [hashlib.md5(x[i:j].tobytes()).digest() for i, j in zip(ends[at].tolist(), ends[at + 1].tolist())]
            whole = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(keys, pa.binary()), whole], ["vec_id", "key", "x"])

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = rows.mapInArrow(run, "vec_id long, key binary, x array<long>")
    return out.select(F.monotonically_increasing_id().alias("row"), "*")


def _matrix(b: pa.RecordBatch, column: str, dims: int, rows: np.ndarray) -> np.ndarray:
    lists = b.column(b.schema.get_field_index(column))
    starts = lists.offsets.to_numpy()[:-1][rows]
    return lists.values.to_numpy(zero_copy_only=False)[starts[:, None] + np.arange(dims)]


def _totals(table: DataFrame, column: str, one: Callable[[int, np.ndarray, np.ndarray], list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """For each length of vector the sums of the arrays that ``one`` (length, matrix, weights) gives for blocks of rows.

    Each task adds up its own rows; 16 tasks add these up, and only their sums, of a fixed size, reach the driver.
    """

    def add(held: dict[int, list[np.ndarray]], d: int, new: list[np.ndarray]) -> None:
        if d in held:
            for a, b in zip(held[d], new):
                a += b
        else:
            held[d] = [np.array(a) for a in new]

    def rows(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() % 16
        for d, arrays in held.items():
            for k, a in enumerate(arrays):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot], pa.int32()), pa.array([d], pa.int32()), pa.array([k], pa.int32()), pa.array([a.dtype.str]), pa.array([a.tobytes()], pa.binary())],
                    ["slot", "dims", "part", "kind", "sums"],
                )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                lengths = np.diff(b.column(0).offsets.to_numpy())
                weight = b.column(1).to_numpy()
                for d in np.unique(lengths).tolist():
                    of = np.flatnonzero(lengths == d)
                    add(held, d, one(d, _matrix(b, column, d, of), weight[of]))
        yield from rows(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, np.ndarray]] = {}
        for b in batches:
            for _, d, k, kind, raw in zip(*(c.to_pylist() for c in b.columns)):
                a = np.frombuffer(raw, kind) if raw else np.zeros(0, kind)
                own = held.setdefault(d, {})
                own[k] = own[k] + a if k in own else a
        yield from rows({d: [own[k] for k in sorted(own)] for d, own in held.items()})

    kind = "slot int, dims int, part int, kind string, sums binary"
    parts = table.select(column, "weight").mapInArrow(local, kind).repartition(16, "slot").mapInArrow(merge, kind)
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.collect():
        a = np.frombuffer(bytes(r["sums"]), r["kind"]) if r["sums"] else np.zeros(0, r["kind"])
        own = out.setdefault(r["dims"], {})
        own[r["part"]] = own[r["part"]] + a if r["part"] in own else a
    return {d: [own[k] for k in sorted(own)] for d, own in out.items()}


@dataclass
class Fit:
    """What is known of the vectors of one length: ``n`` of them, their sums, and the components."""

    n: int
    sums: list[int]
    middle: np.ndarray  # the mean, rounded
    beyond: np.ndarray  # mean - middle
    eigenvalues: np.ndarray
    vectors: np.ndarray  # a column for each component
    explained: np.ndarray
    error: float | None = None  # of the whitened vectors' covariance, once they are there

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Components of the rows of ``x``; those without variance are NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.eigenvalues > 0, 1 / np.sqrt(self.eigenvalues), np.nan)
        return ((x - self.middle) - self.beyond) @ self.vectors * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n * x - sums) ** 2 over the dimensions, for each row."""
        n, rest = self.n, [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]
        high, low = np.array([r // BASE for r in rest], np.int64), np.array([r % BASE for r in rest], np.int64)
        last, d = sum(r * r for r in rest), x - self.middle
        if d.size and np.abs(d).max() >= 1 << 26:  # products beyond long
            return [sum((n * a - r) ** 2 for a, r in zip(row, rest)) for row in d.tolist()]
        squares, a, b = ((d * d).sum(1), d @ high, d @ low)
        return [n * n * q - 2 * n * (u * BASE + v) + last for q, u, v in zip(squares.tolist(), a.tolist(), b.tolist())]


def fit(distinct: DataFrame, components: int) -> dict[int, Fit]:
    """A fit for each length of vector in ``distinct`` (``x``, ``weight``), two passes: exact sums, then the weighted centred product."""

    def sums(d: int, x: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        return [np.array([w.sum()]), w @ (x // BASE), w @ (x % BASE)]

    found = {}
    for d, (n, high, low) in _totals(distinct, "x", sums).items():
        total = [int(a) * BASE + int(b) for a, b in zip(high, low)]
        middle = [(2 * s + int(n[0])) // (2 * int(n[0])) for s in total]
        found[d] = (int(n[0]), total, np.array(middle, np.int64), np.array([(s - int(n[0]) * m) / int(n[0]) for s, m in zip(total, middle)]))

    def product(d: int, x: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        y = (x - found[d][2]) - found[d][3]
        return [((y * w[:, None]).T @ y).ravel()]

    fits = {}
    for d, (flat,) in _totals(distinct, "x", product).items():
        n, total, middle, beyond = found[d]
        v = flat.reshape(d, d) / n
        e, vectors = np.linalg.eigh((v + v.T) / 2)
        e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
        trace = float(np.trace(v))
        # Numbers this small are rounding; the vectors do not vary that way.
        e = np.where(e > d * np.finfo(float).eps * max(trace, 0.0), e, 0.0)
        top = np.abs(vectors).argmax(0) if d else np.zeros(0, int)
        vectors = vectors * np.where(vectors[top, np.arange(len(e))] < 0, -1.0, 1.0)
        fits[d] = Fit(n, total, middle, beyond, e, vectors, e / trace if trace > 0 else np.zeros(len(e)))
    return fits


def _error(white: DataFrame) -> float:
    """How far the covariance of the whitened vectors, all of one length, is from the identity, at most."""
    ((n, total),) = _totals(white, "whitened", lambda k, y, w: [np.array([w.sum()]), w @ y]).values()
    mean = total / n[0]
    ((product,),) = _totals(white, "whitened", lambda k, y, w: [(((y - mean) * w[:, None]).T @ (y - mean)).ravel()]).values()
    return float(np.abs(product.reshape(len(mean), len(mean)) / n[0] - np.eye(len(mean))).max())


def whiten(rows: DataFrame, components: int = 32, weights: str = "count") -> DataFrame:
    """Rows ``vec_id``, ``n``, ``deviation``, ``components``, ``identity_error``: one for each row of ``rows`` that has a vector.

    ``rows`` has ``vec_id`` and ``embedding``; other columns are not read. Vectors that are null or hold null or non-finite
    entries (or such of 2 ** 40 and over) are left out; entries become whole numbers. Equal vectors are grouped first; the fit
    list weighs each with its copies (``weights="count"``) or once (``"one"``). ``components`` is an array of structs
    ``component`` (from 1, by falling eigenvalue), ``whitened``, ``explained``, up to ``components`` of them; a
    component along which the vectors do not vary has ``whitened`` null and ``explained`` 0. ``identity_error`` is null
    where no component varies. ``deviation`` is null where it exceeds a long.
    Lengths are fitted one by one: vectors of another length are another fit list. Repeated rows and ids stay, null ids
    too; empty vectors have no components; an empty table gives no rows.
    """
    if weights not in ("count", "one"):
        raise ValueError(f"weights {weights!r} is neither count nor one")
    placed = shared.materialise(lattice(rows), "lattice")
    grouped = placed.groupBy("key", "x").agg(F.count("*").alias("copies"))
    weight = F.col("copies") if weights == "count" else F.lit(1).cast("long")
    distinct = shared.materialise(grouped.select("key", "x", weight.alias("weight")), "distinct")
    fits = fit(distinct, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                lengths = np.diff(b.column(1).offsets.to_numpy())
                for d in np.unique(lengths).tolist():
                    of = np.flatnonzero(lengths == d)
                    f, x = fits[d], _matrix(b, "x", d, of)
                    y = f.whitened(x)[:, : int((f.eigenvalues > 0).sum())]
                    deviations = [v if v < 1 << 63 else None for v in f.deviations(x)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                    keep = pa.array(of)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(keep), b.column(2).take(keep), pa.array(np.full(len(of), d, np.int32)), pa.array(deviations, pa.int64()), lists],
                        ["key", "weight", "dims", "deviation", "whitened"],
                    )

    kind = "key binary, weight long, dims int, deviation long, whitened array<double>"
    white = shared.materialise(distinct.select("key", "x", "weight").mapInArrow(run, kind), "whitened")
    for d, f in fits.items():
        if (f.eigenvalues > 0).any():
            f.error = _error(white.where(F.col("dims") == d))

    spark = rows.sparkSession
    known = spark.createDataFrame(
        [(d, f.n, f.error, [float(v) for v in f.explained]) for d, f in fits.items()], "dims int, n long, identity_error double, explained array<double>"
    )
    one = lambda share, k: F.struct((k + 1).cast("int").alias("component"), F.get("whitened", k).alias("whitened"), share.alias("explained"))
    told = white.drop("weight").join(F.broadcast(known), "dims").select("key", "n", "deviation", F.transform("explained", one).alias("components"), "identity_error")
    return shared.meet(placed.select("row", "vec_id", "key"), told, "key", "row").drop("row", "key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 32, "count")
    return found.select("vec_id", "n", "deviation", "identity_error", F.inline("components")).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )

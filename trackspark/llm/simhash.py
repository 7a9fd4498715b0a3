"""SimHash near-duplicates: fingerprints linked through Gray-ordered hierarchical indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared

#: Bits of a fingerprint.
BITS = 64
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_AT = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of one text; see ``fingerprints``."""
    import xxhash

    own = text.lower().split()
    if not own:
        return 0
    k = min(words, len(own))
    joined = b" ".join(own)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros((8, 256), np.int64), len(own) - k + 1
    for at in range(0, n, 1 << 16):
        a, b = starts[at : min(at + (1 << 16), n)].tolist(), ends[at + k - 1 : min(at + (1 << 16), n) + k - 1].tolist()
        h = np.fromiter((digest(joined[i:j], 42) for i, j in zip(a, b)), np.uint64, len(a))
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BIT_OF_BYTE).ravel() * 2 > n
    return int.from_bytes(np.packbits(ones, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """Rows ``doc_id``, ``fp`` (64 bits as a long): a row for each row of ``docs``.

    Texts are lower-cased (A-Z), cut at ASCII white space and hashed by runs of ``words``
    words, repeats included; a bit is 1 if over half of the hashes (XXH64, seed 42) have
    it. Shorter texts are one run; null, empty and blank texts get zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shared.pieces(batch, 1):
                got = [fingerprint(x or b"", words) for x in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of the codes in the Gray sequence, in which neighbours differ by one bit."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Index of codes in groups; within a group they stand in Gray order.

    A node covers ``fan`` neighbours and holds the bits that all of them share and its
    parent does not already hold. A search adds up the differences to those bits on its
    way down and leaves a node, with all below it, once they exceed the distance.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray, fan: int = 8) -> None:
        self.codes, n = codes, len(codes)
        self.levels = []
        ones, zeros, last, g = codes, ~codes, np.arange(n), group
        first_child = n_child = None
        while True:
            self.levels.append({"ones": ones, "mask": ones | zeros, "last": last, "first": first_child, "n": n_child})
            heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            if len(heads) == len(g) and len(self.levels) > 1:
                break
            sizes = np.diff(np.append(heads, len(g)))
            cut = np.flatnonzero((np.arange(len(g)) - np.repeat(heads, sizes)) % fan == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            n_child, first_child = np.diff(np.append(cut, len(g))), cut
            last, g = last[np.append(cut[1:], len(g)) - 1], g[cut]
        self.root_of = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
        for upper, lower in zip(self.levels[1:], self.levels):
            held = np.repeat(upper["mask"], upper["n"])
            lower["free"] = BITS - np.bitwise_count(lower["mask"]).astype(np.int64)
            lower["residual"] = lower["mask"] & ~held

    def links(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of the codes at ``queries`` to later codes of their group.

        Where a node's open bits and the differences so far stay within the distance, all
        its codes are linked with each other and with the query, so its last one stands for all.
        """
        q, node = queries, self.root_of[queries]
        d = np.zeros(len(q), np.int64)
        a, b = [], []
        for upper, lower in zip(self.levels[:0:-1], self.levels[-2::-1]):
            n = upper["n"][node]
            child = np.repeat(upper["first"][node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, d = np.repeat(q, n), np.repeat(d, n)
            d = d + np.bitwise_count((self.codes[q] ^ lower["ones"][child]) & lower["residual"][child])
            keep = (d <= distance) & (lower["last"][child] > q)
            q, d, child = q[keep], d[keep], child[keep]
            whole = d + lower["free"][child] <= distance
            a.append(q[whole])
            b.append(lower["last"][child[whole]])
            q, d, node = q[~whole], d[~whole], child[~whole]
        return np.concatenate(a), np.concatenate(b)


def star_links(codes: np.ndarray, group: np.ndarray, distance: int, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what the links connect, at most one for each code."""
    order = np.lexsort((gray_rank(codes), group))
    codes, group = codes[order], group[order]
    index = GrayIndex(codes, group)
    sizes = np.bincount(index.root_of)
    # As many queries at once as keep (query, node) pairs below the bound.
    load = np.cumsum(np.minimum(sizes[index.root_of], most)) // most
    a = b = np.zeros(0, np.int64)
    for at in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(load)) + 1):
        x, y = index.links(at, distance)
        root = shared.united(len(codes), np.concatenate([a, x]), np.concatenate([b, y]))
        a = np.flatnonzero(root != np.arange(len(codes)))
        b = root[a]
    return order[a], order[b]


def links(codes: DataFrame, distance: int = 4, crowded: int = 200_000) -> DataFrame:
    """Edges ``a``, ``b`` that connect all distinct ``fp`` at most ``distance`` bits apart.

    Two such codes agree on one of ``distance + 1`` bands of bits, so each code goes to
    the index of every band's value (the index's uppermost nodes). A value held by more than ``crowded``
    codes is dealt to blocks and every two blocks meet in a task of their own, so no task
    holds more than two blocks and no pair is lost.
    """
    cuts = [round(i * BITS / (distance + 1)) for i in range(distance + 2)]
    bands = [
        F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(F.shiftleft("fp", BITS - hi), BITS - hi + lo).alias("value"))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ]
    placed = codes.select("fp", F.explode(F.array(*bands)).alias("at")).select("fp", "at.band", "at.value")
    size = placed.groupBy(F.col("band").alias("band_"), F.col("value").alias("value_")).count()
    placed = placed.join(size.where(F.col("count") > crowded), (F.col("band") == F.col("band_")) & (F.col("value") == F.col("value_")), "left")
    n = F.coalesce(F.ceil(F.col("count") / crowded), F.lit(1)).cast("int")
    placed = placed.select("fp", "band", "value", n.alias("n"), F.pmod(F.xxhash64("fp"), n).cast("int").alias("own"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).where("n = 1 or own <> other")
    placed = placed.select("fp", F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    cells = placed.repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            a, b = star_links(*part, distance)
            return pa.RecordBatch.from_arrays([pa.array(part[0][x].view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= 200_000:
                codes_, cell = (np.concatenate(x) for x in zip(*held))
                cut = np.searchsorted(cell, cell[-1])  # the last cell may go on
                if cut:
                    yield flush((codes_[:cut], cell[:cut]))
                held, rows = [(codes_[cut:], cell[cut:])], len(codes_) - cut
        if held:
            yield flush(tuple(np.concatenate(x) for x in zip(*held)))

    return cells.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """Rows ``doc_id``, ``fp``, ``component_id``: one for each row of ``docs``, other columns are not read.

    ``component_id`` is the smallest ``doc_id`` (nulls aside) that links of fingerprints
    at most ``distance`` bits apart reach. Rows with one fingerprint are one node, so
    copies are never paired. An empty table gives no rows.
    """
    rows = shared.materialise(fingerprints(docs, words), "fingerprints")
    codes = shared.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "codes")
    roots = shared.components(links(codes.select("fp"), distance))
    codes = codes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = codes.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "root_")
    codes = codes.join(lowest, F.col("root") == F.col("root_")).select(F.col("fp").alias("fp_"), "component_id")
    return rows.join(codes, F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

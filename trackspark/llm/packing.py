"""Best-fit packing of documents into bins of words, with conflicts of source and duplicate cluster."""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared

PACKED = "doc_id long, source string, size long, cluster long, copy long, piece int, word_start long, n_words long, bin long, bin_offset long"


def rows_of(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id``, ``source``, ``size`` (words), ``cluster`` of documents.

    ``cluster`` is a hash of the lower-cased words, the same for copies that differ in case
    of A-Z or in white space. Two texts that share a hash by chance only keep out of one bin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shared.pieces(batch, 2):
                texts = b.column(2).cast(pa.binary()).to_pylist()
                words = [(t or b"").lower().split() for t in texts]
                cluster = [int.from_bytes(hashlib.md5(b" ".join(w)).digest()[:8], "little", signed=True) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(cluster, pa.int64())],
                    ["doc_id", "source", "size", "cluster"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, size long, cluster long")


def best_fit(items: list[tuple[int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster), taken in the order given.

    Open bins stand by what room is left. From the least that suffices the search goes on
    to the next larger until a bin's bitmaps allow the item: its cluster is not there, and
    not all ``per_source`` bitmaps of sources hold its source.
    """
    shared_clusters = [c for c, n in Counter(c for _, _, c in items).items() if n > 1 and c is not None]
    cluster_bit = {c: 1 << k for k, c in enumerate(shared_clusters)}
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for _, s, _ in items))}
    order: list[tuple[int, int]] = []
    clusters: list[int] = []
    sources: list[list[int]] = []
    out = []
    for size, source, cluster in items:
        c, s = cluster_bit.get(cluster, 0), source_bit[source]
        at = bisect.bisect_left(order, (size, -1))
        while at < len(order) and (clusters[order[at][1]] & c or sources[order[at][1]][-1] & s):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * per_source)
        clusters[b] |= c
        plane = next(k for k in range(per_source) if not sources[b][k] & s)
        sources[b][plane] |= s
        out.append((b, capacity - left))
        bisect.insort(order, (left - size, b))
    return out


def pack(rows: DataFrame, capacity: int = 2048, per_source: int = 4, shard_words: int = 2_000_000, shard_rows: int = 8_000) -> DataFrame:
    """Bins for rows of ``rows_of`` (or with a ``cluster`` of your own): a row for each piece.

    A bin holds up to ``capacity`` words, one piece of a ``cluster`` (null is a cluster of its own) and ``per_source`` of a
    source. Documents above the capacity fill bins of their own, and their last piece is
    packed like a document. Repeated rows are counted first (``copy`` 0, 1, ...) and dealt out by hash with all
    others to shards of about ``shard_words`` words and ``shard_rows`` rows, so hot sources and clusters
    spread over all shards; each is packed largest piece first (ties: ``doc_id``, ``copy``).
    Empty documents are pieces of no words; an empty table gives no rows. Two runs over the same rows agree.
    """
    per = 1 << 16
    kinds = shared.materialise(rows.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("n")), "packing")
    words, n = kinds.agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).first()
    shards = max(1, -(-(words or 0) // shard_words), -(-(n or 0) // shard_rows))
    # Two steps, so that no row holds a long list of copies.
    runs = kinds.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / per))).alias("run"))
    copies = runs.select("*", F.explode(F.sequence(F.col("run") * per, F.least((F.col("run") + 1) * per, F.col("n")) - 1)).alias("copy"))
    dealt = copies.select("doc_id", "source", "size", "cluster", "copy", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(shards)).alias("shard"))

    cols = ["doc_id", "source", "size", "cluster", "copy"]

    def run(key: tuple, part: pa.Table) -> pa.Table:
        bins, out, tails = key[0].as_py() << 32, [], []
        for doc, source, size, cluster, copy in zip(*(part.column(c).to_pylist() for c in cols)):
            full = max(0, size - 1) // capacity
            for k in range(full):
                out.append((doc, source, size, cluster, copy, k, k * capacity, capacity, bins, 0))
                bins += 1
            tails.append((size - full * capacity, doc, source, size, cluster, copy, full))
        tails.sort(key=lambda t: (-t[0], t[1] is not None, t[1] or 0, t[5], t[4] is not None, t[4] or 0, t[2] or ""))
        placed = best_fit([(t[0], t[2], t[4]) for t in tails], capacity, per_source)
        for (left, doc, source, size, cluster, copy, k), (b, at) in zip(tails, placed):
            out.append((doc, source, size, cluster, copy, k, k * capacity, left, bins + b, at))
        columns = zip(*out)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _schema().types)], schema=_schema())

    return dealt.groupBy("shard").applyInArrow(run, PACKED)


def _schema() -> pa.Schema:
    longs = {"piece": pa.int32(), "source": pa.string()}
    return pa.schema([(c.split()[0], longs.get(c.split()[0], pa.int64())) for c in PACKED.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))

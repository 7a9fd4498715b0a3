"""Near copies by exact Jaccard similarity of word runs; candidates come from SimHash links and MinHash bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm import shared, simhash

#: Bands of a sketch and minima in each: at similarity 0.8, 99.9% of pairs agree on a band.
BANDS, ROWS = 24, 6
#: Equal minima of a pair that is compared: at similarity 0.8 fewer than these are 4.4 deviations off.
LEAST = 94
#: Texts and runs of a block; every two blocks of a cluster meet in one task.
BLOCK_TEXTS, BLOCK_RUNS = 512, 1_000_000
_draw = np.random.default_rng(42)
_XOR, _ODD = (_draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def runs(text: bytes, words: int) -> Iterator[bytes]:
    """Runs of ``words`` lower-cased words (A-Z), repeats included; a shorter text is one run, an empty one has none."""
    own = text.lower().split()
    k = min(words, len(own))
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    for i, j in zip(starts[: len(own) - k + 1].tolist() if own else (), ends[k - 1 :].tolist() if own else ()):
        yield joined[i:j]


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def run_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the runs, each once, ascending."""
    import xxhash

    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in runs(text, words)), np.uint64))


def sketch(text: bytes, words: int) -> bytes:
    """The low byte of each MinHash, band by band."""
    h = run_hashes(text, words)
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), 2048):
        np.minimum(low, ((h[at : at + 2048, None] ^ _XOR) * _ODD).min(0), out=low)
    low ^= low >> np.uint64(32)  # the minima have few high bits
    return low.astype(np.uint8).tobytes()


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Rows ``node``, ``digest`` (of the lower-cased words), ``low`` for each row of ``docs`` (``doc_id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shared.pieces(batch, 1):
                texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
                digest = [hashlib.md5(b" ".join(x.lower().split())).digest() for x in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array([sketch(x, words) for x in texts], pa.binary())], ["node", "digest", "low"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, digest binary, low binary")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Nodes, labels, minima and band of each cell with two rows or more; rows ``cell``, ``node``, ``label``, ``band``, ``low`` stand by cell."""

    def split(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        cell, node, label, band = (t.column(k).to_numpy() for k in range(4))
        low = shared.flat(t.column(4).combine_chunks())[0].reshape(-1, BANDS * ROWS)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                yield node[a:b], label[a:b], low[a:b], int(band[a])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if batch.column(0)[0] != batch.column(0)[-1]:
            t = pa.Table.from_batches(held)
            cut = int(np.searchsorted(t.column(0).to_numpy(), batch.column(0)[-1].as_py()))  # the last cell may go on
            yield from split(t.slice(0, cut))
            held = t.slice(cut).to_batches()
    if held:
        yield from split(pa.Table.from_batches(held))


def _stars(node: np.ndarray, label: np.ndarray, low: np.ndarray, band: int, likely: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each node with the first one that it seems alike to, or none: what mostly connects a cell."""
    left = np.arange(len(node))
    while len(left) > 1:
        near = (low[left[1:]] == low[left[0]]).sum(1) >= likely
        b = node[left[1:][near]]
        yield np.full(len(b), node[left[0]]), b
        left = left[1:][~near]


def _maybe(node: np.ndarray, label: np.ndarray, low: np.ndarray, band: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what pairs of unlike labels with ``least`` equal minima do; fewer than nodes."""
    if (label == label[0]).all():
        return
    a = b = np.zeros(0, np.int64)
    for k in range(len(node) - 1):
        at = k + 1 + np.flatnonzero(label[k + 1 :] != label[k])
        at = at[(low[at] == low[k]).sum(1) >= least]
        a, b = np.concatenate([a, np.full(len(at), k)]), np.concatenate([b, at])
        if len(a) > 4 * len(node):
            root = shared.united(len(node), a, b)
            a = np.flatnonzero(root != np.arange(len(node)))
            b = root[a]
    root = shared.united(len(node), a, b)
    a = np.flatnonzero(root != np.arange(len(node)))
    yield node[a], node[root[a]]


def _pairs(placed: DataFrame, find: object, least: int) -> DataFrame:
    """Pairs ``a`` < ``b`` that ``find`` yields over the cells of ``placed``, whose rows it gets in the same order in all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            for a, b in find(*cell, least):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = placed.select("cell", "node", "label", "band", "low", F.xxhash64("node").alias("draw"))
    rows = rows.repartition("cell").sortWithinPartitions("cell", "draw").drop("draw")
    return rows.mapInArrow(run, "a long, b long").distinct()


def alike(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose texts (rows ``node``, ``text``) have a Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for b in batches:
            keep = []
            for k, (a, x, y) in enumerate(zip(b.column(0).to_pylist(), *(b.column(c).cast(pa.binary()).to_pylist() for c in (2, 3)))):
                if a != last:
                    last, own = a, set(runs(x or b"", words))
                if jaccard(own, set(runs(y or b"", words))) >= least:
                    keep.append(k)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    # Many may be paired with one text.
    both = shared.meet(shared.materialise(with_b, "pairs"), texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a", "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _settled(node: np.ndarray, label: np.ndarray, own: np.ndarray, low: np.ndarray, sets: list[np.ndarray], least: float, within: bool) -> tuple[list[int], list[int]]:
    """Pairs of a Jaccard similarity of ``least`` or more that connect all such: none where the two are connected already."""
    _, group = np.unique(label, return_inverse=True)
    a, b = [], []
    for k in range(len(node) - 1):
        at = k + 1 + np.flatnonzero((group[k + 1 :] != group[k]) & ((own[k + 1 :] != own[k]) | within))
        for j in at[(low[at] == low[k]).sum(1) >= LEAST].tolist():
            if group[j] == group[k]:  # by now
                continue
            both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
            either = len(sets[k]) + len(sets[j]) - both
            if (both / either if either else 1.0) >= least:
                group[group == group[j]] = group[k]
                a.append(int(node[k]))
                b.append(int(node[j]))
    return a, b


def across(members: DataFrame, least: float) -> DataFrame:
    """Links ``a``, ``b`` between unlike labels within clusters; with the labels they connect what all such links do.

    ``members`` has ``node``, ``cluster``, ``label``, ``low``, ``hashes`` (of its runs). A cluster is dealt to blocks and every two blocks meet
    in one group, which holds the runs of their texts and gives fewer links than it has texts.
    """
    size = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.size("hashes")).alias("r"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("r") / BLOCK_RUNS)).cast("int")
    dealt = members.join(size.select("cluster", blocks.alias("blocks")), "cluster")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "label", "low", "hashes", "cluster", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, label, own = (table.column(c).to_numpy() for c in ("node", "label", "own"))
        low = shared.flat(table.column("low").combine_chunks())[0].reshape(-1, BANDS * ROWS)
        lists = table.column("hashes").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))
        a, b = _settled(node, label, own, low, np.split(flat, ends[:-1]), least, key[1].as_py() == key[2].as_py())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def later_rows(docs: DataFrame, words: int = 5, distance: int = 6, least: float = 0.8, crowded: int = 256) -> DataFrame:
    """Rows ``doc_id`` (a table): all but the smallest id of each group of ``docs`` (``doc_id``, each once, and ``text``).

    Texts are linked if their sets of ``words``-word runs have an exact Jaccard similarity of ``least`` (0.8 or
    more) or over; groups are what links connect. Compared are the pairs that connect fingerprints up to ``distance``
    bits apart, and the pairs that agree on a band of minima: first stars within each cell, which connect most of a
    group of near copies. Then texts of unlike groups that share a cell and ``LEAST`` minima make clusters, within which all such
    pairs are settled where the runs of both are at hand; a group gives fewer links than texts.
    A cell of more than ``crowded`` texts is dealt to blocks, and every two blocks meet.
    """
    with shared.passing(docs.sparkSession):
        rows = shared.materialise(sketches(docs, words), "sketches")
        # Of equal texts the first stands for all.
        nodes = rows.groupBy("digest").agg(F.min(F.struct("node", "low")).alias("first")).select("first.*")
        nodes = shared.materialise(nodes, "nodes")
        copies_ = rows.select("node").join(nodes.select("node"), "node", "left_anti")
        keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substring("low", k * ROWS + 1, F.lit(ROWS)), k))
        banded = nodes.select("node", F.posexplode(keys).alias("band", "key"))
        size = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("key", "key_")
        placed = banded.join(size, F.col("key") == F.col("key_")).select("node", "band", "key", F.ceil(F.col("size") / crowded).cast("int").alias("n"))
        placed = shared.materialise(placed.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("n")).cast("int")), "placed")

        fp = shared.materialise(simhash.fingerprints(docs, words).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), "fingerprints")
        codes = shared.materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("node")), "codes")
        edges = simhash.links(codes.select("fp"), distance)
        by = lambda c: codes.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_"))
        gray = edges.join(by("a"), "a").join(by("b"), "b").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"))
        same = fp.join(codes, "fp").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))

        one = placed.select("node", F.col("node").alias("label"), "band", F.xxhash64("key", "own").alias("cell")).join(nodes, "node")
        stars = shared.materialise(_pairs(one, _stars, round(least * BANDS * ROWS)).union(gray).union(same).distinct(), "pairs")
        texts = docs.select(F.col("doc_id").alias("node"), "text")
        wanted = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
        links = shared.materialise(alike(stars, shared.materialise(texts.join(wanted, "node", "left_semi"), "texts"), words, least), "links")

        roots = shared.components(links).select("node", F.col("root").alias("label"))
        two = placed.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = two.groupBy("key").agg(F.min("label").alias("low_"), F.max("label").alias("high_")).where("low_ < high_").select("key")
        two = two.join(mixed, "key", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("n = 1 or own <> other")
        two = two.select("node", "label", "band", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell")).join(nodes, "node")
        clusters = shared.components(shared.materialise(_pairs(two, _maybe, LEAST), "maybe")).select("node", F.col("root").alias("cluster"))
        clusters = shared.materialise(clusters.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")).join(nodes, "node"), "clusters")

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = [run_hashes(x or b"", words).view(np.int64) for x in b.column(4).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(lists, pa.list_(pa.int64()))], ["node", "cluster", "label", "low", "hashes"])

        members = clusters.join(texts, "node").select("node", "cluster", "label", "low", "text")
        members = shared.materialise(members.mapInArrow(hashed, "node long, cluster long, label long, low binary, hashes array<long>"), "members")
        links = links.union(shared.materialise(across(members, least), "links"))
        later = shared.components(links).where("node <> root").select("node")
        # A copy's text may be anywhere in its group; a row is later either way.
        return shared.materialise(copies_.union(later).select(F.col("node").alias("doc_id")), "later", keep=True)


def first_rows(docs: DataFrame, **how: object) -> DataFrame:
    """Rows ``doc_id``: the smallest id of each group of ``docs``; see ``later_rows``."""
    return docs.select("doc_id").join(later_rows(docs, **how), "doc_id", "left_anti")

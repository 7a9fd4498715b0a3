"""Audit of filters that interact: which order removes what, from a sparse document-term matrix and one pass over flags.

A dictionary numbers all words of the table: by a hash, after a shuffle of the words has shown which share theirs and need a number of
their own. With it tasks build shards of the matrix as compressed sparse rows. Sums and lengths of the rows decide on length and repetition,
the other filters are flags. All orders follow from the number of documents with each set of failures.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared

FILTERS = "ABCDE"
#: Characters that filter D looks for.
MARKS = b"#$%&*|"
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True

#: Words with a number of their own because their hash is another word's, too; so many go to all tasks.
MOST_CLASHES = 100_000


@dataclass(frozen=True)
class Hashing:
    """How words get their numbers: ``bits`` (63 at most) of XXH64 with ``seed``."""

    seed: int = 0
    bits: int = 63

    def number(self, word: bytes) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(word, self.seed) >> (64 - self.bits)


class _Numbers(dict):
    """Numbers of words, looked up or made when first asked for; forgotten beyond ``most`` words."""

    def __init__(self, hashing: Hashing, clashes: dict[bytes, int], most: int = 1_000_000) -> None:
        super().__init__(clashes)
        self.hashing, self.clashes, self.most = hashing, clashes, most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
            self.update(self.clashes)
            if word in self.clashes:
                return self.clashes[word]
        number = self[word] = self.hashing.number(word)
        return number


def vocabulary(docs: DataFrame, hashing: Hashing = Hashing(), shard_bytes: int = 16 << 20) -> DataFrame:
    """The dictionary's rows ``number``, ``word``: all different words of ``text``, each with its hash.

    Tasks drop repeats within about ``shard_bytes`` of text; one shuffle by number brings the others together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[bytes] = set()
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for some in itertools.batched(found, 100_000):
                numbers = np.fromiter(map(hashing.number, some), np.int64, len(some))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(some, pa.binary())], ["number", "word"])
            found.clear()

        for batch in batches:
            for b in shared.pieces(batch, 0, 4 << 20):
                for text in b.column(0).cast(pa.binary()).to_pylist():
                    if text:
                        found.update(text.split())
                        size += len(text)
                if size >= shard_bytes:
                    yield from rows()
                    size = 0
        yield from rows()

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "number long, word binary")
    return words.repartition("number").dropDuplicates(["number", "word"])


def clashes(words: DataFrame, most: int = MOST_CLASHES) -> dict[bytes, int]:
    """Numbers below 0 for the words of ``vocabulary`` that share their number with others.

    Of n different words n * n / 2 ** 63 are expected to clash, so ``most`` is enough for 9 * 10 ** 11 words; words made to clash do so
    for one seed only. More than ``most`` are an error.
    """
    twice = words.groupBy("number").agg(F.count("*").alias("n")).where("n > 1")  # no shuffle: they lie by number
    numbers = [r["number"] for r in twice.select("number").limit(most + 1).collect()]
    if len(numbers) > most:
        raise ValueError("too many words clash; take another seed")
    if not numbers:
        return {}
    few = words.join(F.broadcast(words.sparkSession.createDataFrame([(n,) for n in numbers], "number long")), "number")
    own = sorted(bytes(r["word"]) for r in few.select("word").limit(2 * most + 1).collect())
    if len(own) > 2 * most:
        raise ValueError("too many words clash; take another seed")
    return {w: -1 - k for k, w in enumerate(own)}


@dataclass
class Shard:
    """Compressed sparse rows: the words of text k are ``terms[starts[k]:starts[k + 1]]``, as often as ``counts`` says there."""

    starts: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    def row_sums(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def nonzeros(self) -> np.ndarray:
        return np.diff(self.starts)


def shard_of(texts: list[bytes], numbers: _Numbers) -> Shard:
    rows = [Counter(t.split()) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    terms = np.fromiter((numbers[w] for r in rows for w in r), np.int64, starts[-1])
    return Shard(starts, terms, np.fromiter((c for r in rows for c in r.values()), np.int64, starts[-1]))


def _shards(docs: DataFrame, told: Callable[[pa.RecordBatch, Shard], pa.RecordBatch], kind: str, hashing: Hashing, shard_bytes: int) -> DataFrame:
    """``told`` of each batch of texts and its shard of the document-term matrix, whose numbers hold for all texts."""
    numbers_of = clashes(vocabulary(docs, hashing, shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(hashing, numbers_of)
        for batch in batches:
            for b in shared.pieces(batch, 2, min(shard_bytes, 4 << 20)):
                data, at = shared.flat(b.column(2))
                raw = data.tobytes()
                texts = [raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                sums = lambda hits: (c := np.concatenate([[0], np.cumsum(hits, dtype=np.int64)]))[at[1:]] - c[at[:-1]]
                upper, chars, marked = sums((data >= 65) & (data <= 90)), sums((data & 0xC0) != 0x80), sums(_MARK[data]) > 0
                digests = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())
                flags = [b.column(0), b.column(1).cast(pa.string()), digests, pa.array(upper), pa.array(chars), pa.array(marked)]
                yield told(pa.RecordBatch.from_arrays(flags, ["doc_id", "part", "digest", "upper", "chars", "marked"]), shard_of(texts, numbers))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, part string, digest binary, upper long, chars long, marked boolean, {kind}")


def document_terms(docs: DataFrame, hashing: Hashing = Hashing(), shard_bytes: int = 16 << 20) -> DataFrame:
    """The document-term matrix of ``docs`` (``doc_id``, ``lang``, ``text``): a row for each row of ``docs``.

    Words are maximal runs without ASCII white space, case-sensitive. ``terms`` (array of long) are the numbers that the dictionary of the
    whole table gives a text's words, ``counts`` how often each occurs: lists of a file, one after another, are compressed sparse rows. Also
    ``doc_id``, ``part`` (lang; null: empty), ``digest`` of the text, ``upper`` (`[A-Z]`), ``chars`` (code points) and
    ``marked`` (holds any of ``MARKS``). Null texts are empty; nothing is cut; an empty table gives no rows.
    """

    def told(flags: pa.RecordBatch, s: Shard) -> pa.RecordBatch:
        starts = pa.array(s.starts.astype(np.int32))
        lists = [pa.ListArray.from_arrays(starts, pa.array(v)) for v in (s.terms, s.counts)]
        return pa.RecordBatch.from_arrays([*flags.columns, *lists], [*flags.schema.names, "terms", "counts"])

    return _shards(docs, told, "terms array<long>, counts array<long>", hashing, shard_bytes)


def failures(docs: DataFrame, least_words: int = 100, distinct_percent: int = 80, upper_percent: int = 10, hashing: Hashing = Hashing(), shard_bytes: int = 16 << 20) -> DataFrame:
    """Rows ``doc_id``, ``part``, ``digest``, ``mask``: bits 1, 2, 4, 8 for failures of A, B, C, D.

    Words are the sum of a text's row of the document-term matrix, different words the number of its entries; tasks read
    these off their shards, which are not written.
    """

    def told(flags: pa.RecordBatch, s: Shard) -> pa.RecordBatch:
        sums = [pa.array(s.row_sums()), pa.array(s.nonzeros())]
        return pa.RecordBatch.from_arrays([*flags.columns, *sums], [*flags.schema.names, "words", "different"])

    m = _shards(docs, told, "words long, different long", hashing, shard_bytes)
    words = F.col("words")
    fails = [words < least_words, 100 * F.col("different") < distinct_percent * words, 100 * F.col("upper") > upper_percent * F.col("chars"), F.col("marked")]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return m.select("doc_id", "part", "digest", mask.alias("mask"))


def patterns(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``part``, ``mask`` (16: also fails E), ``n``, ``good``, ``toxic``: documents with each set of failures.

    Equal rows (copies with one id) are counted before anything meets, so neither a hot id nor a large group of copies is held
    by a task. Among copies, those with the smallest id pass E, and such without an id.
    """
    kinds = failed.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = told.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    kinds = shared.meet(shared.materialise(kinds, "failures"), told, "doc_id", "digest", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # Per task and group of copies a row for each part and label. An id has one row there, so the least struct is the lowest id and its rows.
    same = ["digest", "part", "mask", "good", "toxic"]
    known = F.col("doc_id").isNotNull()
    groups = kinds.groupBy(*same).agg(
        F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("low"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("free")
    )
    groups = shared.materialise(groups, "copies")
    first = groups.groupBy("digest").agg(F.min("low.doc_id").alias("first"))
    groups = groups.join(first, "digest")
    passes = F.col("free") + F.coalesce(F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")), F.lit(0))
    split = F.array(F.struct(F.col("mask"), passes.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passes).alias("n")))
    rows = groups.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "good", "toxic", "s.*").where("n > 0")
    either = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), either("good"), either("toxic"))


def orders(counted: DataFrame) -> DataFrame:
    """The audit from ``patterns``: a row for each ``part``, ``filter_order`` and ``step``.

    A document that fails m filters is removed by each of them in 1 / m of the orders.
    """
    n = len(FILTERS)
    every = list(itertools.permutations(range(n)))
    steps = [(order, step) for order in every for step in range(n)]
    table = F.array(*[
        F.struct(
            F.lit("".join(FILTERS[k] for k in order)).alias("filter_order"), F.lit(step + 1).alias("step"),
            F.lit(sum(1 << k for k in order[:step])).alias("before"), F.lit(1 << order[step]).alias("bit"),
        )
        for order, step in steps
    ])
    rows = counted.select("part", "mask", "n", "good", "toxic", F.inline(table))
    hit, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, what, name: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long").alias(name)
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~hit & ~earlier, F.col("n"), "kept"), total(hit & ~earlier, F.col("n"), "removed"), total(hit & earlier, F.col("n"), "redundant"),
        total(F.col("mask") == F.col("bit"), F.col("n"), "unique_fails"),
        total(hit & ~earlier, F.col("good"), "good_lost"), total(hit & ~earlier, F.col("toxic"), "toxic_lost"),
        total(hit, F.col("n") * F.expr(f"{len(every)} div bit_count(mask)"), "shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **matrix: object) -> DataFrame:
    """Rows ``part``, ``filter_order``, ``step`` and counts for the five filters over ``docs`` (``doc_id``, ``text``, ``lang``).

    Null texts are empty, so they fail A only (and E, where a smaller id has an empty or null text); null langs are the part of the
    empty string. Repeated rows count each; rows of one id do not fail E by each other. Rows without an id pass E and have no label.
    A document is good or toxic if any of its rows in ``labels`` says 1. Parts are the langs that occur; an empty table gives no rows. Other
    columns are not read.
    """
    return orders(shared.materialise(patterns(failures(docs, **matrix), labels), "patterns"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

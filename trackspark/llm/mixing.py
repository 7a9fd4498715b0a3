"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared

#: Weights of the sources in order, again and again.
WEIGHTS = (3, 1, 2)


def sizes(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows ``doc_id``, ``source``, ``size`` (words; null text: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shared.pieces(batch, 2):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.count_words(b.column(2)))], ["doc_id", "source", "size"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, size long")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``target`` to rows ``source``, ``source_size``.

    Sources stand by code point, null last, and weigh ``weights`` in turn. They share
    ``share`` times all words by weight; none gets over ``most`` times its size, and
    what is left goes to the others by weight until none is above. The level at which
    that holds comes from a few sums over the sources, which stay distributed.
    """
    s = sources.withColumns({"last": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    s = shared.materialise(shared.running_totals(s, ["last", "source"], "one", "rank"), "sources")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    s = s.select("source", "source_size", w.alias("weight"), (F.col("source_size") * most).alias("cap"))
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        taken, open_ = s.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (taken or 0.0)) / open_ if open_ else level
        if new <= level:
            break
        level = new
    return s.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def seats(sources: DataFrame, block: int = 8, shards: int = 8) -> DataFrame:
    """Add ``seats`` to rows of ``targets``: an array of the blocks that shards 1 to j give a source, j from 0 to ``shards``.

    The house of all shards is all words to take / ``block``, rounded; each shard has an equal part of it, but for one block. Seats go to the
    highest quotients target / (2k - 1), ties to the source that stands first, then to the lower k: the first part of
    them to shard 1, the next to shard 2, and so on, so that shards 1 to j together are an apportionment, too.
    What a divisor for a house surely smaller or larger by half the sources gives (a rounded target each) is under or over the seats by so many
    that only about two quotients a source are left to be ranked for each shard, however many blocks there are.
    Sources without a target get none.
    """
    s = sources.withColumn("last", F.col("source").isNull())
    total, n = s.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    house = math.floor(total / block + 0.5)
    upto = F.floor(F.col("shard").cast("long") * house / shards).cast("long")  # a long: blocks times shards pass 2^31
    slack = n / 2 + 1  # one more than half a seat for each source: rounding of doubles decides nothing
    at = F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard")
    rounded = lambda words: F.floor(F.col("target") * words / F.lit(total or 1.0) + 0.5).cast("long")
    s = s.select("*", at).withColumn("house", upto)
    s = s.withColumns({"sure": rounded(F.greatest(F.col("house") - slack, F.lit(0.0))), "most": rounded(F.col("house") + slack)})
    open_ = {r["shard"]: r["open"] for r in s.groupBy("shard", "house").agg((F.col("house") - F.sum("sure")).alias("open")).collect()}
    k = F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("k")
    c = s.where("most > sure").select("shard", "last", "source", "target", k)
    c = c.select("shard", "last", "source", "k", (-F.col("target") / (2 * F.col("k") - 1)).alias("low"), F.lit(1).cast("long").alias("one"))
    c = shared.materialise(shared.running_totals(c, ["shard", "low", "last", "source", "k"], "one", "rank"), "quotients")
    first = c.groupBy("shard").agg(F.min("rank").alias("first_"))
    left = F.element_at(F.create_map(*(F.lit(x) for item in (open_ or {0: 0}).items() for x in item)), F.col("shard"))
    won = c.join(F.broadcast(first), "shard").where(F.col("rank") - F.col("first_") < left)
    won = won.select(F.col("source").alias("source_"), F.col("shard").alias("shard_"), "one")
    won = won.groupBy("source_", "shard_").agg(F.sum("one").alias("won"))
    s = s.join(won, F.col("source").eqNullSafe(F.col("source_")) & (F.col("shard") == F.col("shard_")), "left")
    each = F.array_sort(F.collect_list(F.struct("shard", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("n"))))
    s = s.groupBy("source", "source_size", "target").agg(each.alias("each"))
    return s.select("source", "source_size", "target", F.concat(F.array(F.lit(0).cast("long")), F.col("each.n")).alias("seats"))


def mix(rows: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 8, shards: int = 8, seed: int = 1, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``source_size``, ``target``, ``taken`` and ``shard_words`` to rows of ``sizes``.

    Each shard has the same number of blocks of ``block`` words, but for one, apportioned to the sources by ``seats``. A source's documents, in
    an order drawn from ``seed``, are its line of words, read in a circle from a drawn block on; its shards take their quotas one
    after another, so that a document's words stay together. ``taken`` are the words of a document taken so, repeats counted,
    ``shard_words`` those of each shard. A source takes its target but for about a block, and never more than ``most`` times
    its size (there its last block is cut); a document never over ``most`` times its size rounded up to whole passes. Null ids,
    repeated rows and sources without words are rows as any other; an empty table gives none.
    """
    rows = rows.select("doc_id", "source", "size")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    sources = seats(shared.materialise(sources, "targets"), block, shards)
    keyed = rows.withColumns({"last": F.col("source").isNull(), "draw": F.xxhash64(F.lit(seed), "doc_id")})
    line = shared.running_totals(keyed, ["last", "source", "draw", "doc_id", "size"], "size", "at")
    starts = line.groupBy("source").agg(F.min("at").alias("from_"))
    s = sources.alias("s").join(starts.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")))
    n = F.col("source_size")
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("s.source")), F.greatest(F.ceil(n / block), F.lit(1))) * block
    s = s.select(F.col("s.source").alias("source_"), "source_size", "target", "seats", "from_", F.least(start, n).alias("start_"))
    x = line.join(s, F.col("source").eqNullSafe(F.col("source_"))).withColumn("o", F.col("at") - F.col("from_"))

    def covered(words: Column) -> Column:
        """Words of the document among the first ``words`` of the circle."""
        rest = words % n
        ends, a = F.col("o") + F.col("size"), F.col("start_")
        over = lambda lo: F.greatest(F.least(ends, lo + rest) - F.greatest(F.col("o"), lo), F.lit(0))
        return F.when(n > 0, F.floor(words / n) * F.col("size") + over(a) + over(a - n)).otherwise(F.lit(0)).cast("long")

    upto = F.transform("seats", lambda w: F.least(w * block, F.floor(n * most)).cast("long"))
    x = x.withColumn("upto", F.transform(upto, covered))
    cut = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.element_at("upto", j + 1) - F.element_at("upto", j))
    return x.select("doc_id", "source", "size", "source_size", "target", F.element_at("upto", -1).alias("taken"), cut.alias("shard_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.materialise(sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")).select(
        "doc_id", "size", "source_size", "target", "taken", "shard_words"
    )

"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation in numpy.

The model predicts a class from the two before it: each of the most frequent words is a class, the
end of a text is one, and all other words share classes by their last bytes. The
predicted vector is the sum of a vector for each context place; classes score its product
with their own vector plus a bias. A word has its class's probability times its share
of the class, from counts over the whole corpus with one added to each word and one word
unseen. Probabilities of classes are normalised exactly.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared

#: Classes of other words, by CRC-32 of the last three bytes.
TAILS = 128
#: Words longer than this stay out of the table that goes to all workers, so that its size has a bound.
LONGEST = 64


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: CRC-32 of the id as text leaves 2 by 7 (no id: learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows ``word``, ``n`` over all of ``texts`` (``text``); the null word is the end, once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        ends = 0

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for b in shared.pieces(batch, 0):
                for text in b.column(0).cast(pa.binary()).to_pylist():
                    found.update(_words(text))
                ends += b.num_rows
                if len(found) > 400_000:
                    yield rows()
        yield rows()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([ends], pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Classes 0 to k - 1 are words, k the end, then tails; ``words`` has the known words with their counts."""

    k: int
    words: list[bytes]
    counts: np.ndarray
    end: int
    tail_tokens: np.ndarray
    tail_words: np.ndarray

    @property
    def classes(self) -> int:
        return self.k + 1 + TAILS

    def tail(self, word: bytes) -> int:
        return self.k + 1 + zlib.crc32(word[-3:]) % TAILS

    def noise(self) -> np.ndarray:
        n = np.concatenate([self.counts[: self.k], [self.end], self.tail_tokens]).astype(float) + 1.0
        return n / n.sum()


def vocabulary(counts: DataFrame, k: int, table: int) -> Vocabulary:
    """The ``k`` most frequent words as classes, and counts of up to ``table`` of the most frequent for all workers."""
    short = counts.where(F.octet_length("word") <= LONGEST).withColumn("step", F.floor(F.log2("n") * 16))
    # How many words have counts of each step (a few hundred rows) tells from which count on they fit.
    least, room = None, table
    for step, words in sorted(((r["step"], r["count"]) for r in short.groupBy("step").count().collect()), reverse=True):
        room -= words
        if room < 0:
            break
        least = step
    top = short.where(F.col("step") >= least).select("word", "n").collect() if least is not None else []
    top.sort(key=lambda r: (-r["n"], r["word"]))
    words, n = [r["word"].encode() for r in top], np.array([r["n"] for r in top], np.int64)
    tail = F.pmod(F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)), F.lit(TAILS)).cast("int")
    tokens, kinds = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in counts.where("word is not null").groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["tail"]], kinds[r["tail"]] = r["n"], r["v"]
    k = min(k, len(words))
    for w, c in zip(words[:k], n[:k].tolist()):
        tokens[zlib.crc32(w[-3:]) % TAILS] -= c
        kinds[zlib.crc32(w[-3:]) % TAILS] -= 1
    end = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    return Vocabulary(k, words, n, end, tokens, kinds)


class LogBilinear:
    """Vectors of classes (``q``), of the two context places (``c``), and biases."""

    def __init__(self, noise: np.ndarray, dims: int, seed: int) -> None:
        self.noise, m = noise, len(noise)
        rng = np.random.default_rng(seed)
        self.q = rng.normal(0, 0.1, (m, dims)).astype(np.float32)
        self.c = rng.normal(0, 0.1, (2, m + 1, dims)).astype(np.float32)  # the last is "before the text"
        self.b = np.log(noise).astype(np.float32)
        self.squares = [np.full(x.shape, 1e-6, np.float32) for x in (self.q, self.c, self.b)]

    def vector(self) -> np.ndarray:
        """Everything that training changes, one after another."""
        return np.concatenate([x.ravel() for x in (self.q, self.c, self.b, *self.squares)])

    def load(self, v: np.ndarray) -> LogBilinear:
        held = (self.q, self.c, self.b, *self.squares)
        parts = np.split(v.astype(np.float32), np.cumsum([x.size for x in held])[:-1])
        self.q, self.c, self.b, *self.squares = (part.reshape(x.shape).copy() for part, x in zip(parts, held))
        return self

    def train(self, before: np.ndarray, before2: np.ndarray, w: np.ndarray, rng: np.random.Generator, rate: float, k: int = 64) -> None:
        """One step of noise-contrastive estimation; the batch shares ``k`` noise classes."""
        dims = self.q.shape[1]
        noise = np.searchsorted(self._cdf(), rng.random(k), "right").clip(max=len(self.noise) - 1)
        log_kp = np.log(k * self.noise).astype(np.float32)
        r = self.c[0, before] + self.c[1, before2]
        qw, qn = self.q[w], self.q[noise]
        with np.errstate(over="ignore"):
            g = 1 / (1 + np.exp(np.einsum("ij,ij->i", r, qw) + self.b[w] - log_kp[w]))
            gn = 1 / (1 + np.exp(log_kp[noise] - r @ qn.T - self.b[noise]))
        gr = g[:, None] * qw - gn @ qn
        places = np.arange(dims)

        def spread(at: np.ndarray, grad: np.ndarray, rows: int) -> np.ndarray:
            return np.bincount((at[:, None] * dims + places).ravel(), grad.ravel(), rows * dims).reshape(rows, dims)

        m = len(self.b)
        gq = spread(w, g[:, None] * r, m)
        np.subtract.at(gq, noise, gn.T @ r)
        gb = np.bincount(w, g, m)
        np.subtract.at(gb, noise, gn.sum(0))
        gc = np.stack([spread(before, gr, m + 1), spread(before2, gr, m + 1)])
        for x, grad, sq in zip((self.q, self.c, self.b), (gq, gc, gb), self.squares):
            grad = (grad / len(w)).astype(np.float32)
            sq += grad * grad
            x += rate * grad / np.sqrt(sq)

    def _cdf(self) -> np.ndarray:
        if not hasattr(self, "_sums"):
            self._sums = np.cumsum(self.noise)
        return self._sums


class Scorer:
    """Normalised log10 probabilities of classes; normalisers are kept by context.

    Products are taken in doubles and a token's value is rounded to 9 decimals, since their last bits depend on what
    else is in a block: equal texts have equal scores.
    """

    def __init__(self, model: LogBilinear) -> None:
        self.q, self.c, self.b = (x.astype(np.float64) for x in (model.q, model.c, model.b))
        self.log_z = np.full((len(model.b) + 1, len(model.b) + 1), np.nan)

    def __call__(self, before: np.ndarray, before2: np.ndarray, w: np.ndarray) -> np.ndarray:
        new = np.isnan(self.log_z[before, before2])
        todo = np.unique(before[new].astype(np.int64) * self.log_z.shape[1] + before2[new])
        for at in range(0, len(todo), 4096):
            a, b = np.divmod(todo[at : at + 4096], self.log_z.shape[1])
            s = (self.c[0, a] + self.c[1, b]) @ self.q.T + self.b
            top = s.max(1)
            self.log_z[a, b] = top + np.log(np.exp(s - top[:, None]).sum(1))
        out = np.empty(len(w))
        for at in range(0, len(w), 1 << 17):
            p = slice(at, at + (1 << 17))
            out[p] = np.einsum("ij,ij->i", self.c[0, before[p]] + self.c[1, before2[p]], self.q[w[p]]) + self.b[w[p]] - self.log_z[before[p], before2[p]]
        return np.round(out / math.log(10), 9)


class Encoder:
    """Class, log10(count + 1) and log10 of the share of the class, for the known words and for others."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.known = {w: i for i, w in enumerate(v.words)}
        self.classes = np.array([i if i < v.k else v.tail(w) for i, w in enumerate(v.words)], np.int64)
        self.log_count = np.log10(v.counts + 1.0)
        self.whole = np.log10(v.tail_tokens + v.tail_words + 1.0)
        self.share = np.where(np.arange(len(v.words)) < v.k, 0.0, self.log_count - self.whole[np.maximum(self.classes - v.k - 1, 0)])

    def classes_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Place in ``words`` (-1: not known) and class of each word; the words not known."""
        get = self.known.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = self.classes[at] if len(self.classes) else np.zeros(len(words), np.int64)
        missing = np.flatnonzero(at < 0)
        rare = [words[i] for i in missing.tolist()]
        if rare:
            out[missing] = np.fromiter(map(self.v.tail, rare), np.int64, len(rare))
        return at, out, rare


#: What a worker has unpacked of the last broadcast: its key and the objects.
_UNPACKED: dict[str, object] = {}


def _unpacked(key: str, make: object) -> object:
    if key not in _UNPACKED:
        _UNPACKED.clear()
        _UNPACKED[key] = make()
    return _UNPACKED[key]


def _contexts(classes: list[np.ndarray], end: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two classes before each token and the token's own, texts one after another, each with its end."""
    w, a, b = [], [], []
    s, s2, e = np.array([start]), np.array([start, start]), np.array([end])
    for c in classes:
        w += (c, e)
        a += (s, c)
        b += (s2, c[:-1]) if len(c) else (s,)
    return np.concatenate(a), np.concatenate(b), np.concatenate(w)


#: Tokens, in whole texts, that are shuffled together before they are learned from.
CHUNK = 1 << 18


def train(
    docs: DataFrame, vocab: Vocabulary, tokens: int, dims: int = 16, rounds: int = 3, shard_tokens: int = 500_000,
    batch: int = 2048, rate: float = 0.1, seed: int = 1,
) -> LogBilinear:
    """Train on every token of ``docs`` (``doc_id``, ``text``; about ``tokens``) once, in ``rounds``.

    A hash of id and text deals the rows to rounds and shards of about ``shard_tokens`` and orders them there, so
    that neither partitions nor the order of rows matter; the id is in it so that copies of a text spread.
    In a round each shard goes on from the same parameters; their mean by tokens is where the next begins.
    A shard returns one row of parameters of a fixed size; 16 tasks average these before the driver reads 16 rows.
    """
    spark = docs.sparkSession
    shards = max(1, -(-tokens // (rounds * shard_tokens)))
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(vocab)
    model = LogBilinear(vocab.noise(), dims, seed)
    dealt = docs.select("text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"))
    dealt = dealt.select("text", "draw", F.pmod("draw", F.lit(rounds)).alias("round"), F.pmod(F.xxhash64("draw"), F.lit(shards)).cast("int").alias("shard"))
    kind = "shard int, n double, v binary"

    def row(shard: int, n: float, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n]), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["shard", "n", "v"])

    def one_round(k: int, start: LogBilinear) -> np.ndarray | None:
        begin = spark.sparkContext.broadcast(start.vector())
        noise = start.noise

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = _unpacked(key, lambda: Encoder(sent.value))
            shard, own, rng, n, held, size = None, None, None, 0, [], 0

            def learn() -> None:
                nonlocal n, size
                if not held:
                    return
                a, a2, w = _contexts(held, coder.v.k, coder.v.classes)
                order = rng.permutation(len(w))
                for at in range(0, len(w), batch):
                    p = order[at : at + batch]
                    own.train(a[p], a2[p], w[p], rng, rate)
                n += len(w)
                size = 0
                held.clear()

            for b in batches:
                for part in shared.pieces(b, 0, 4 << 20):
                    for text, at in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist()):
                        if at != shard:
                            learn()
                            if n:
                                yield row(shard, float(n), own.vector())
                            shard, n = at, 0
                            own, rng = LogBilinear(noise, dims, seed).load(begin.value), np.random.default_rng([seed, k, at])
                        held.append(coder.classes_of(_words(text))[1])
                        size += len(held[-1]) + 1
                        if size >= CHUNK:
                            learn()
            learn()
            if n:
                yield row(shard, float(n), own.vector())

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, first = None, 0.0, 0
            for b in batches:
                for shard, weight, v in zip(*(c.to_pylist() for c in b.columns)):
                    add = np.frombuffer(v, np.float32).astype(np.float64) * weight
                    total, n, first = (add, weight, shard) if total is None else (total + add, n + weight, first)
            if total is not None:
                yield row(first, n, total / n)

        rows = dealt.where(F.col("round") == k).repartition(shards, "shard").sortWithinPartitions("shard", "draw", "text").select("text", "shard").mapInArrow(run, kind)
        # Sums are taken in a fixed order, as their last bits depend on it.
        rows = rows.repartition(16, "shard").sortWithinPartitions("shard").mapInArrow(mean, kind).collect()
        if not rows:
            return None
        rows.sort(key=lambda r: r["shard"])
        n = np.array([r["n"] for r in rows])
        return (np.stack([np.frombuffer(r["v"], np.float32) for r in rows]) * (n / n.sum())[:, None]).sum(0)

    for k in range(rounds):
        learned = one_round(k, model)
        if learned is not None:
            model.load(learned)
    return model


def score(docs: DataFrame, k: int = 895, table: int = 131_072, dims: int = 16, rounds: int = 3, shard_tokens: int = 500_000) -> DataFrame:
    """Rows ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for all rows.

    Learns from the whole texts of all documents that are not held out; null, empty and blank
    texts are their end alone; repeated rows stay and count each; other columns are not read.
    ``table`` words of up to 64 bytes with their counts go to all workers (a few MB at most); other words
    meet their counts in a join, after each document has counted its own. Without documents to learn from
    every count is 0. An empty table gives no rows. Partitions and the order of rows do not change a score beyond rounding.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    learned = docs.where("not held_out")
    counts = shared.materialise(word_counts(learned), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    vocab = vocabulary(counts, k, table)
    model = train(learned, vocab, n, dims, rounds, shard_tokens)
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast((vocab, model))
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, counted double, model double, rare array<string>, rare_n array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, scorer = _unpacked(key, lambda: (Encoder(sent.value[0]), Scorer(sent.value[1])))
        voc = coder.v
        for batch in batches:
            for b in shared.pieces(batch, 1):
                classes, rows, rare_words, rare_n, ends = [], [], [], [], [0]
                for text in b.column(1).cast(pa.binary()).to_pylist():
                    words = _words(text)
                    at, own, rare = coder.classes_of(words)
                    at = at[at >= 0]
                    unknown = Counter(rare)
                    rare_words.extend(unknown)
                    rare_n.extend(unknown.values())
                    ends.append(len(rare_words))
                    share = coder.share[at].sum() - sum(coder.whole[voc.tail(w) - voc.k - 1] * c for w, c in unknown.items())
                    rows.append((len(words) + 1, len(at) + (voc.end > 0), coder.log_count[at].sum() + math.log10(voc.end + 1), share))
                    classes.append(own)
                a, a2, w = _contexts(classes, voc.k, voc.classes)
                sums = np.add.reduceat(scorer(a, a2, w), np.cumsum([0, *(len(c) + 1 for c in classes[:-1])]))
                n_tokens, n_known, counted, share = (np.array(x) for x in zip(*rows))
                at = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), b.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(counted, pa.float64()), pa.array(sums + share),
                        pa.ListArray.from_arrays(at, pa.array(rare_words, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(rare_n, pa.int32())),
                    ],
                    [c.split()[0] for c in kind.split(", ")],
                )

    rows = shared.materialise(docs.mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("tf"))
    rare = rare.join(counts.where("word is not null"), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))).alias("known_"), F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("counted_")
    )
    out = rows.drop("rare", "rare_n").join(rare, "row", "left")
    more = F.coalesce("counted_", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("counted") + more - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

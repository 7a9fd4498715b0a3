"""Token ids as Parquet list columns: range order, set encodings, selective reads."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared

#: A word and the marks at its end. After a letter they are a token of their own, or several.
_MARKS = ".,!?;:%$&#*|"
_MARKED = rf"(?s)\A(?P<core>.*[A-Za-zÀ-ÖØ-öø-ɏ])(?P<tail>[{_MARKS}]+)\z"
#: Columns of the files.
SCHEMA = "doc_id long, text_hash long, ids array<int>, n_tokens long"
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _cut_bytes(raw: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The ids ``raw`` as one binary value up to each of ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _offsets(values: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int64, len(values) + 1)


class PieceEncoder:
    """Encodes texts by pieces that start at a lone space or line end, and remembers pieces that recur.

    A byte-level pre-tokenizer starts a token at each space between two characters that
    are not white space, so the ids of a text are the ids of its pieces one after another. With
    GPT-2's rule, the usual one, the same holds for line ends, and for marks after a letter.
    Pieces, with the space or line end they start with, are one Arrow array, their ids another. Unknown
    pieces are encoded in one call, glued together, and cut where a token begins with a space
    or line end. At twice ``most`` pieces, the half that was wanted in fewest batches is forgotten.
    Texts with other runs of spaces are cut only where that rule holds, texts
    with a token that was added to the vocabulary (an end mark, say) nowhere.
    """

    def __init__(self, path: str, most: int = 200_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        rule = self.tokenizer.pre_tokenizer
        self.plain = isinstance(rule, pre_tokenizers.ByteLevel) and rule.use_regex
        #: Texts that hold one of these are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.starts = {}
        for lead, sign in ((" ", "Ġ"), ("\n", "Ċ")):
            self.starts[lead] = np.zeros(max(vocab.values()) + 1, bool)
            self.starts[lead][[i for t, i in vocab.items() if t[0] == sign]] = True
        self.pieces, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        # The batches that wanted each piece: how many (fewer as they age), and the last.
        self.wanted, self.last, self.batch = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.tails: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.most = most

    def _find(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of each piece stand; unknown pieces are learned."""
        found = pc.index_in(pieces, value_set=self.pieces)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        left = np.flatnonzero(at < 0)
        coded = pieces.take(pa.array(left)).dictionary_encode()
        new, code = coded.dictionary, coded.indices.to_numpy()
        # First those that start with a space, then those that start with a line end.
        line = pc.starts_with(new, "\n").to_numpy(zero_copy_only=False)
        order = np.argsort(line, kind="stable")
        rank = np.empty(len(new), np.int64)
        rank[order] = np.arange(len(new)) + len(self.pieces)
        at[left] = rank[code]
        new, spaced = new.take(pa.array(order)), len(new) - int(line.sum())
        # Whole before anything is changed: a failed task leaves its worker's encoder as it was.
        learned = [*self._learn(new[:spaced], " "), *self._learn(new[spaced:], "\n")]
        self.pieces, self.ids = pa.concat_arrays([self.pieces, new]), pa.concat_arrays([self.ids, *learned])
        self.batch += 1
        self.wanted = np.append(self.wanted, np.zeros(len(new), np.int64))
        self.last = np.append(self.last, np.zeros(len(new), np.int64))
        self.last[at] = self.batch
        self.wanted += self.last == self.batch
        return at

    def _learn(self, new: pa.Array, lead: str) -> Iterator[pa.Array]:
        """The ids of pieces that start with ``lead`` and hold no other."""
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000].to_pylist()
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            first = np.flatnonzero(self.starts[lead][ids])
            if len(first) != len(some) or first[0]:
                raise ValueError("the vocabulary does not start tokens at spaces")
            yield _cut_bytes(ids, np.append(first[1:], len(ids)))

    def _forget(self) -> None:
        """Back to ``most`` pieces, if there are twice as many or they are long."""
        if len(self.heads) > self.most:
            self.heads.clear()
        if len(self.tails) > self.most:
            self.tails.clear()
        if len(self.pieces) <= 2 * self.most and self.pieces.nbytes <= 80 * self.most:
            return
        fit = np.flatnonzero(pc.binary_length(self.pieces).to_numpy() <= 100)
        keep = np.sort(fit[np.lexsort((-self.last[fit], -self.wanted[fit]))[: self.most]])
        self.pieces, self.ids = self.pieces.take(pa.array(keep)), self.ids.take(pa.array(keep))
        self.wanted, self.last = self.wanted[keep] // 2, self.last[keep]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remembered(self, texts: list[str], memory: dict[str, bytes]) -> list[bytes]:
        new = [t for t in dict.fromkeys(texts) if t not in memory]
        found = dict(zip(new, self._whole(new)))
        memory.update((t, x) for t, x in found.items() if len(t) <= 100)
        return [found[t] if t in found else memory[t] for t in texts]

    def _words(self, words: pa.Array) -> pa.LargeBinaryArray:
        """The ids of words that follow a space; they begin and end with something else than white space."""
        parts, ends = pc.binary_join_element_wise(" ", words, ""), np.arange(len(words) + 1)
        if self.plain:
            # Lines that begin or end with white space stay together.
            lines = pc.split_pattern(words, "\n")
            split = pc.not_equal(lines.values, pc.utf8_trim_whitespace(lines.values))
            split = pc.or_(split, pc.equal(lines.values, "")).to_numpy(zero_copy_only=False)
            ends = lines.offsets.to_numpy().astype(np.int64)
            odd = np.logical_or.reduceat(split, ends[:-1])
            several = ~odd & (np.diff(ends) > 1)
            if several.any():
                some = lines.filter(pa.array(several))
                begins = np.zeros(len(some.values), bool)
                begins[some.offsets.to_numpy()[:-1]] = True
                some_parts = pc.binary_join_element_wise(pc.if_else(pa.array(begins), " ", "\n"), some.values, "")
                count = np.ones(len(words), np.int64)
                count[several] = np.diff(some.offsets.to_numpy())
                ends = np.concatenate([[0], np.cumsum(count)])
                at = np.repeat(np.arange(len(words)), count)
                at[np.repeat(several, count)] = len(words) + np.arange(len(some_parts))
                parts = pa.concat_arrays([parts, some_parts]).take(pa.array(at))
            else:
                ends = np.arange(len(words) + 1)
        tail = np.zeros(len(parts), np.int64)
        tails: list[bytes] = []
        if self.plain:
            marked = np.flatnonzero(pc.not_equal(parts, pc.utf8_rtrim(parts, characters=_MARKS)).to_numpy(zero_copy_only=False))
            cut = pc.extract_regex(parts.take(pa.array(marked)), _MARKED)
            fits = cut.is_valid().to_numpy(zero_copy_only=False)
            marked, cut = marked[fits], cut.filter(pa.array(fits))
            at = np.arange(len(parts))
            at[marked] = len(parts) + np.arange(len(marked))
            parts = pa.concat_arrays([parts, cut.field("core")]).take(pa.array(at))
            coded = cut.field("tail").dictionary_encode()
            tails = self._remembered(coded.dictionary.to_pylist(), self.tails)
            tail[marked] = 1 + coded.indices.to_numpy()
        known = self._find(parts)
        both = np.empty(2 * len(parts), np.int64)
        both[0::2], both[1::2] = known, len(self.ids) + tail
        ids = pa.concat_arrays([self.ids, pa.array([b"", *tails], pa.large_binary())]).take(pa.array(both))
        self._forget()
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(_offsets(ids)[2 * ends]), ids.buffers()[2]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids one after another."""
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy()
        first, many = at[:-1], np.diff(at)
        coded = lists.values.dictionary_encode()
        piece, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        n = len(words)
        heads = words.take(pa.array(piece[first])).to_pylist()
        # White space beside a space shows as an empty piece or at the end of one.
        bare = pc.utf8_trim_whitespace(words)
        unsafe = pc.or_(pc.equal(bare, ""), pc.not_equal(bare, words)).to_numpy(zero_copy_only=False)
        bad = unsafe[piece]
        bad[first] = [w[-1:].isspace() for w in heads]
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        odd = (np.logical_or.reduceat(bad, first) | whole) & (many > 1)
        inner = ~np.repeat(whole, many)
        inner[first] = False
        used = np.zeros(n, bool)
        used[piece[inner]] = True
        used = np.flatnonzero(used & ~unsafe)
        own = self._remembered(heads, self.heads)
        for k in np.flatnonzero(odd).tolist():
            text = texts[k].as_py()
            own[k] = b"".join(self._whole([text] if whole[k] else _CUT.split(text)))
        # The ids of the used words, then nothing, then those of heads and of odd texts.
        place = np.full(n, len(used))
        place[used] = np.arange(len(used))
        piece = place[piece]
        piece[np.repeat(odd, many)] = len(used)
        piece[first] = len(used) + 1 + np.arange(len(own))
        entries = pa.concat_arrays([self._words(words.take(pa.array(used))), pa.array([b"", *own], pa.large_binary())])
        ids = entries.take(pa.array(piece))
        ends = _offsets(ids)
        return np.diff(ends[at]) // 4, np.frombuffer(ids.buffers()[2] or b"", "<u4", int(ends[-1]) // 4)


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    """One encoder for all tasks of a worker, so that the pieces it holds serve the next task too."""
    return PieceEncoder(path)


def encode(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Rows ``doc_id``, ``text_hash``, ``ids`` (list of int, ends with ``end_id``), ``n_tokens``, in order.

    The order is that of ``doc_id``, then of ``text_hash`` (XXH64 of the text).

    Texts, not ids, go through the one shuffle (ids take more room); null texts are empty,
    null ids come first, repeated rows stay, an empty table gives no rows. Other columns
    are not read.
    """
    order = ["doc_id", "text_hash"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The hash makes reruns agree where rows share an id.
    rows = rows.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for b in shared.pieces(batch, 1, 4 << 20):
                lengths, ids = encoder.encode(b.column(1).cast(pa.string()))
                ids = np.insert(ids, np.cumsum(lengths), end_id).view("<i4")
                lengths += 1
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), ids, pa.array(lengths)], ["doc_id", "text_hash", "ids", "n_tokens"]
                )

    return rows.mapInArrow(run, SCHEMA)


def write(encoded: DataFrame, path: str, *, encoding: str = "delta", row_group_mb: int = 32, page_rows: int = 2_000) -> None:
    """Write ids as Parquet. ``delta``: binary packed differences; ``dictionary``: dictionary pages.

    Row groups and the rows of a page are bounded; Parquet's column and page indexes are
    written with them, so that reads of some ids or of ``n_tokens`` alone skip the rest.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"encoding {encoding!r} is neither delta nor dictionary")
    w = encoded.write.option("parquet.block.size", row_group_mb << 20).option("parquet.page.row.count.limit", page_rows)
    w = w.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
    w.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_crc32`` from the ids as they stand in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(values[i:j]) for i, j in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "text_hash", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "text_hash", "ids").mapInArrow(run, "doc_id long, text_hash long, n_tokens long, ids_crc32 long")


def starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``: the number of ids of all documents before, in order of ``doc_id``."""
    # Written first: dealing out by range looks at its input twice.
    return shared.running_totals(shared.materialise(tokens, "digests"), ["doc_id", "text_hash"], "n_tokens", "start")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared.scratch(spark, "ids")
    write(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")), path)
    return starts(digests(read(spark, path))).select("doc_id", "start", "n_tokens", "ids_crc32")

"""Personal data: patterns of fixed form, and identifiers of other forms found by the words around them.

What the fixed patterns find are seeds. The words around a seed make lexical patterns; patterns and the values that
stand in them are the two sides of a graph that Spark scores in rounds. A pattern whose values are known to be of one kind, by far more
than chance, vouches for its other values of that kind; values vouched for well enough are known in
the next round. All mentions of a value so found become spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared

#: Kinds in their order in results.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits matches from its start or not at all, so a search need not begin inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _NO_DIGITS = re.compile(r"[0-9]"), re.compile(r"[^0-9]+")

# Strings that may be identifiers in other forms: numbers with marks between, words with an at sign, groups of hex digits.
_NUMBER = re.compile(r"(?<![A-Za-z0-9])[(]?[0-9](?:[\x20 ().\-/_]{0,2}[0-9])+(?![A-Za-z0-9])")
_AT = re.compile(r"(?<!\S)[^\s@(\[]++(?:@|[(\[]at[)\]])[^\s@]++")
_GROUPS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")
_OUTER = ".,;:!?)]}>\"'"
#: Words of a context that are longer than this stand in it by their digest, and values longer than four times this.
LONGEST = 32

_MENTION = "struct<start: int, stop: int, seed: int, may: int, value: string, patterns: array<string>>"
_ROW = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind: int, start: int, stop: int>>, mentions array<{_MENTION}>"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the leftmost matches of local part, ``@`` and dotted domain are, in time linear in the text."""
    last = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns of fixed form, by kind and start, in code points."""
    out = [(EMAIL, *s) for s in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = _NO_DIGITS.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGITS.sub("", m.group())) <= 15:
                out.append((PHONE, *m.span()))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds as bits) of strings that may be identifiers and overlap none ``taken`` nor each other."""
    found: list[tuple[int, int, int]] = []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            digits = _NO_DIGITS.sub("", m.group())
            may = (1 << PHONE if 7 <= len(digits) <= 15 else 0) | (1 << CARD if 13 <= len(digits) <= 19 and luhn(digits) else 0)
            found.append((*m.span(), may))
        if text.count(":") >= 3:
            found += [(*m.span(), 1 << IP) for m in _GROUPS.finditer(text)]
    if "@" in text or "(at)" in text or "[at]" in text:
        for m in _AT.finditer(text):
            n = len(m.group().rstrip(_OUTER))
            found.append((m.start(), m.start() + n, 1 << EMAIL))
    found.sort(key=lambda c: (c[0], -c[1]))
    spans = sorted((s, e) for _, s, e in taken)
    out, k, last = [], 0, 0
    for start, end, may in found:
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if start >= last and end > start and not (k < len(spans) and spans[k][0] < end):
            out.append((start, end, may))
            last = end
    return out


def value_of(text: str, numeric: bool) -> str:
    """What is the same for mentions of one identifier: the digits of a number, else the letters in lower case."""
    value = "n" + _NO_DIGITS.sub("", text) if numeric else "a" + text.lower()
    return value if len(value) <= 4 * LONGEST else "\u0001" + hashlib.md5(value.encode()).hexdigest()


def _word(word: str) -> str:
    word = re.sub("[0-9]", "0", word.lower())
    return word if len(word) <= LONGEST else "\u0001" + hashlib.md5(word.encode()).hexdigest()


def _words_beside(text: str, at: int, left: bool) -> list[str]:
    """The two words next to a place, however long; the outer one first or last, marks where the text ends."""
    n = 64
    while True:
        words = (text[max(0, at - n) : at] if left else text[at : at + n]).split()
        whole = at <= n if left else at + n >= len(text)
        if whole or len(words) > 2:  # the outermost may be cut
            break
        n *= 4
    if left:
        return ([] if len(words) > 1 else ["\u0002"] * (2 - len(words))) + [_word(w) for w in words[-2:]]
    return [_word(w) for w in words[:2]] + ([] if len(words) > 1 else ["\u0003"] * (2 - len(words)))


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a mention: one and two words before, a word on both sides, two words after."""
    (b2, b1), (a1, a2) = _words_beside(text, start, True), _words_beside(text, end, False)
    return [f"{b1} _", f"{b2} {b1} _", f"{b1} _ {a1}", f"_ {a1} {a2}"]


def mentions(docs: DataFrame) -> DataFrame:
    """Rows ``row``, ``doc_id``, counts and digest of base spans, ``base`` and ``mentions`` (seeds and candidates with their patterns)."""

    def joined(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions")
        span = pa.struct([(c, pa.int32()) for c in ("kind", "start", "stop")])
        mention = pa.struct([*((c, pa.int32()) for c in ("start", "stop", "seed", "may")), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
        kinds = [*[pa.int64()] * 5, pa.string(), pa.list_(span), pa.list_(mention)]
        for batch in batches:
            for b in shared.pieces(batch, 1, 4 << 20):
                rows = []
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    text = text or ""
                    base = base_spans(text)
                    found = [(s, e, k, 1 << k, value_of(text[s:e], k >= CARD)) for k, s, e in base]
                    for s, e, may in candidates(text, base):
                        found.append((s, e, None, may, value_of(text[s:e], may & (1 << IP | 1 << EMAIL) == 0)))
                    counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
                    rows.append((
                        i, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), [dict(zip(("kind", "start", "stop"), x)) for x in base],
                        [{"start": s, "stop": e, "seed": k, "may": may, "value": v, "patterns": patterns_at(text, s, e)} for s, e, k, may, v in found],
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], list(names))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _ROW).select(F.monotonically_increasing_id().alias("row"), "*")


def _scored(edges: DataFrame, known: DataFrame, prior: list[float], least: float, chance: float, support: int) -> DataFrame:
    """Rows ``pattern``, ``kind``, ``trust`` of patterns that vouch for a kind.

    Of a pattern's values those known to be of the kind speak for it, known ones of other kinds and such that can't be of it against, the rest
    half against: they may be what is looked for. ``trust`` is the share that speaks for it. It has to be ``least``, from ``support`` values on,
    and so far above the kind's share of all values that by Chernoff's bound no more than ``chance`` is left for it.
    """
    told = shared.meet(edges, known, "value", "pattern", "left").withColumn("has", F.coalesce("has", F.lit(0)))
    bit = lambda c, k: F.col(c).bitwiseAND(F.lit(1 << k)) != 0
    sums = []
    for k in range(len(KINDS)):
        open_ = (F.col("has") == 0) & bit("may", k)
        sums += [F.count_if(bit("has", k)).alias(f"for{k}"), F.count_if(open_).alias(f"open{k}")]
    counted = told.groupBy("pattern").agg(F.count("*").alias("n"), *sums)
    each = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"for{k}").alias("yes"), (F.col("n") - F.col(f"open{k}") / 2.0).alias("all"), F.lit(prior[k]).alias("prior"), F.col(f"open{k}").alias("open"))
        for k in range(len(KINDS))
    ])
    rows = counted.select("pattern", F.inline(each)).where(F.col("yes") >= support).withColumn("trust", F.col("yes") / F.col("all"))
    c, p = F.col("trust"), F.col("prior")
    evidence = F.col("all") * (c * F.ln(c / p) + F.when(c < 1, (1 - c) * F.ln((1 - c) / (1 - p))).otherwise(0.0))
    return rows.where((c >= least) & (c > p) & (evidence >= -math.log(chance)) & (F.col("open") > 0)).select("pattern", "kind", "trust")


def discover(edges: DataFrame, least: float = 0.8, chance: float = 0.01, support: int = 5, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Values found by patterns (``value``, ``kind``, ``score``), and the patterns of the last round (``pattern``, ``kind``, ``trust``).

    ``edges`` has a row for each ``pattern`` and ``value`` that meet, with ``seed`` and ``may``: kinds as bits. Patterns of fewer than
    ``support`` values can never vouch and go first. ``chance`` is divided among all patterns. A value's score is the chance
    that one of its patterns is right, if their errors were independent.
    """
    spark = edges.sparkSession
    values = shared.materialise(edges.groupBy("value").agg(F.bit_or("seed").alias("has"), F.bit_or("may").alias("may")), "values")
    n, *seeds = values.agg(F.count("*"), *(F.count_if(F.col("has").bitwiseAND(F.lit(1 << k)) != 0) for k in range(len(KINDS)))).first()
    prior = [min(0.5, max(0.01, s / max(1, n))) for s in seeds]
    known = values.where("has <> 0").select("value", "has")
    found = spark.createDataFrame([], "value string, kind int, score double")
    often = edges.groupBy("pattern").agg(F.count("*").alias("n_")).where(F.col("n_") >= support)
    edges = shared.materialise(shared.meet(edges.select("pattern", "value", "may"), often, "pattern", "value").drop("n_"), "edges")
    share = chance / max(1, edges.agg(F.count_distinct("pattern")).first()[0])
    patterns = spark.createDataFrame([], "pattern string, kind int, trust double")
    for _ in range(rounds):
        patterns = shared.materialise(_scored(edges, known, prior, least, share, support), "patterns")
        by = patterns.groupBy("pattern").agg(F.collect_list(F.struct("kind", "trust")).alias("vouched"))  # a kind each, four at most
        hits = shared.meet(edges, by, "pattern", "value").select("value", "may", F.inline("vouched"))
        hits = hits.where(F.expr("may & shiftleft(1, kind) <> 0")).join(known, "value", "left_anti")
        scores = hits.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.ln(1 - 0.99 * F.col("trust"))))).alias("score"))
        best = scores.groupBy("value").agg(F.max(F.struct("score", -F.col("kind"))).alias("b"))
        new = best.select("value", (-F.col("b.col2")).cast("int").alias("kind"), F.col("b.score").alias("score")).where(F.col("score") >= least)
        new = shared.materialise(new, "found")
        if not new.take(1):
            break
        found = found.union(new)
        known = known.union(new.select("value", F.expr("shiftleft(1, kind)").alias("has")))
    return found, patterns


def extract(docs: DataFrame, **scoring: float) -> DataFrame:
    """Rows ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``, one for each row of ``docs`` (``doc_id``, ``text``).

    The counts and the digest are those of the fixed patterns; ``spans`` is an array of structs ``kind``, ``start``, ``stop`` (code points),
    ``added`` by kind and start, with the spans that the method adds: numbers in other forms that are a seed's digits, and mentions of values that patterns vouch
    for. These overlap no span of the fixed patterns. Null and empty texts have no spans; texts of any length are read whole; repeated rows and
    null ids stay; an empty table gives no rows; other columns are not read.
    """
    rows = shared.materialise(mentions(docs), "mentions")
    each = rows.select("row", F.inline("mentions"))
    edges = each.select(F.explode("patterns").alias("pattern"), "value", F.coalesce(F.expr("shiftleft(1, seed)"), F.lit(0)).alias("seed"), "may")
    edges = shared.materialise(edges.groupBy("pattern", "value").agg(F.bit_or("seed").alias("seed"), F.bit_or("may").alias("may")), "edges")
    found, _ = discover(edges, **scoring)
    seeds = edges.groupBy("value").agg(F.bit_or("seed").alias("bits")).where("bits <> 0").select("value", "bits")
    told = shared.materialise(seeds.union(found.select("value", F.expr("shiftleft(1, kind)"))), "told")
    new = shared.meet(each.where("seed is null").select("row", "start", "stop", "may", "value"), told, "value", "row")
    fits = F.col("may").bitwiseAND(F.col("bits"))
    first: Column = reduce(lambda out, k: F.when(fits.bitwiseAND(F.lit(1 << k)) != 0, k).otherwise(out), reversed(range(len(KINDS))), F.lit(None).cast("int"))
    new = new.select("row", F.struct(first.alias("kind"), "start", "stop", F.lit(True).alias("added")).alias("s")).where("s.kind is not null")
    new = new.groupBy("row").agg(F.collect_list("s").alias("more"))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(False).alias("added")))
    kind = "array<struct<kind: int, start: int, stop: int, added: boolean>>"
    spans = F.array_sort(F.concat(base.cast(kind), F.coalesce(F.col("more").cast(kind), F.array().cast(kind))))
    return rows.drop("mentions").join(new, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.withColumn("spans", text)

"""Quality rules: shape statistics of texts and a decision list learned by sequential covering."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared

#: Counted as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks")
#: Ratios that rules set thresholds on: name, counted, of what.
RATIOS = (
    ("chars_per_word", "word_chars", "n_words"), ("symbols_per_word", "n_symbols", "n_words"), ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_word_share", "n_repeat_words", "n_words"), ("distinct_word_share", "n_distinct_words", "n_words"), ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"), ("marks_per_word", "n_marks", "n_words"), ("words_per_line", "n_words", "n_lines"),
)
FEATURES = ("n_words", *(r[0] for r in RATIOS))
_UPPER, _DIGITS, _MARKS = re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[!?]")


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that come twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    runs = lambda: zip(*(words[k:] for k in range(window)))
    found = Counter(runs())
    if len(found) == n:
        return 0
    covered = np.zeros(n + window, np.int64)
    hit = np.fromiter((found[w] > 1 for w in runs()), bool, n)
    covered[:n] += hit
    covered[window:] -= hit
    return int((np.cumsum(covered) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of a text; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words), len(b"".join(words).decode()), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(set(words)), len(_UPPER.findall(text)), len(_DIGITS.findall(text)), len(_MARKS.findall(text)),
    )


def with_counts(docs: DataFrame, name: str) -> DataFrame:
    """Add the struct ``name`` of ``COUNTS`` of ``text``; each text goes to Python once."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in texts], columns=list(COUNTS)).astype("int64")

    # Not deterministic to the optimiser, which else runs it for a filter and again for the output.
    return docs.withColumn(name, count.asNondeterministic()(F.col("text").cast("string")))


def feature(name: str, struct: str) -> Column:
    """A feature as an expression; a ratio to nothing is 0."""
    if name == "n_words":
        return F.col(f"`{struct}`.n_words").cast("double")
    top, of = next((a, b) for n, a, b in RATIOS if n == name)
    return F.coalesce(F.col(f"`{struct}`.{top}").cast("double") / F.nullif(F.col(f"`{struct}`.{of}"), F.lit(0)), F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, ">" or "<=", threshold) holds."""

    conditions: tuple[tuple[str, str, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        tests = [x[f] > t if op == ">" else x[f] <= t for f, op, t in self.conditions]
        return reduce(np.logical_and, tests)

    def expression(self, struct: str) -> Column:
        tests = [feature(f, struct) > t if op == ">" else feature(f, struct) <= t for f, op, t in self.conditions]
        return reduce(lambda a, b: a & b, tests)

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:g}" for f, op, t in self.conditions)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> Rule | None:
    """Add the condition of the largest information gain until no kept row is covered."""
    rows, picked = np.ones(len(bad), bool), []
    while len(picked) < longest and (good := rows & ~bad).any():
        p, n = (rows & bad).sum(), good.sum()
        best = (1e-9, None)
        for f, values in x.items():
            v = values[rows]
            b = bad[rows]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 65)))
            # Midway to the next value, so that a rule has room on both sides.
            s = np.unique(v)
            k = np.searchsorted(s, cuts, "right") - 1
            k = np.unique(k[k < len(s) - 1])
            cuts = (s[k] + s[k + 1]) / 2
            if not len(cuts):
                continue
            at = np.searchsorted(cuts, v, "left")  # v <= cuts[j] for all j >= at
            below = np.stack([np.cumsum(np.bincount(at[m], minlength=len(cuts) + 1))[:-1] for m in (b, ~b)])
            for op, (pp, nn) in (("<=", below), (">", np.array([[p], [n]]) - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n))), -1.0)
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], (f, op, float(cuts[j])))
        if best[1] is None:
            break
        picked.append(best[1])
        rows &= Rule((best[1],)).holds(x)
    return Rule(tuple(picked)) if picked else None


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, int, int]:
    """The rule cut after the condition with the best (bad - good) share; bad and good rows it covers."""
    best = None
    for k in range(len(rule.conditions), 0, -1):
        r = Rule(rule.conditions[:k])
        hit = r.holds(x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if best is None or worth > best[0]:
            best = (worth, r, p, n)
    return best[1:]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, draw: np.ndarray, longest: int = 3, most: int = 12, precision: float = 0.97) -> list[Rule]:
    """A decision list that rejects ``bad`` rows; what no rule rejects is kept.

    Each rule is grown on two thirds of the rows that no earlier rule covers (by ``draw``) and pruned on
    the rest; one that is right for under ``precision`` of what it covers ends the list.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    for _ in range(most):
        grow, prune = left & (draw % 3 != 0), left & (draw % 3 == 0)
        if not (grow & bad).any():
            break
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow], longest)
        if rule is None:
            break
        rule = _pruned(rule, {f: v[prune] for f, v in x.items()}, bad[prune])[0]
        hit = rule.holds(x) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < max(2, 0.002 * bad.sum()) or p < precision * (p + n):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[Rule]:
    """Learn the list from ``labels`` (``doc_id``, ``quality`` 0 or 1) of ``docs``.

    The fit takes up to ``sample`` labelled documents, drawn by hash of ``doc_id``; labels that
    are null are left out, and of several labels of a document the lowest counts, as of several rows with
    its id the one with the least features. Without labels of both kinds there are no rules.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id_")).agg(F.min("quality").alias("quality_"))
    known = known.withColumn("draw_", F.xxhash64("id_")).orderBy("draw_", "id_").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(F.broadcast(known), F.col("doc") == F.col("id_"))
    rows = with_counts(rows, "c").select("doc", "quality_", "draw_", *(feature(f, "c").alias(f) for f in FEATURES))
    rows = rows.groupBy("doc", "quality_", "draw_").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc", "quality_", "draw_", "x.*")
    table = rows.toPandas().sort_values(["draw_", "doc"])
    bad = table["quality_"].to_numpy() == 0
    if bad.all() or not bad.any():
        return []
    return learn({f: table[f].to_numpy(float) for f in FEATURES}, bad, table["draw_"].to_numpy().view(np.uint64) >> np.uint64(7))


def base_failed(struct: str) -> Column:
    c = lambda n: F.col(f"`{struct}`.{n}")
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


def verdict(rules: list[Rule], struct: str) -> Column:
    """The rejecting rule's text, or null, as one ordered conditional expression."""
    out = F.when(base_failed(struct), "base")
    for rule in rules:
        out = out.when(rule.expression(struct), str(rule))
    return out.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``counts`` (struct), ``base_failed`` and ``rejected_by`` (null: kept) to each row.

    Null, empty and blank texts have no words and fail the base; texts of any length are
    counted whole, repeated rows stay. Columns of ``docs`` with these names are
    replaced; others stay as they are.
    """
    rows = with_counts(docs, "counts")
    return rows.withColumns({"base_failed": base_failed("counts"), "rejected_by": verdict(rules, "counts")})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns."""
    (name,) = shared.fresh(docs, "counts")
    return with_counts(docs, name).where(verdict(fit(docs, labels), name).isNull()).select(*(f"`{c}`" for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select(
        "doc_id", *(f"counts.{c}" for c in COUNTS[:5]), "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by"
    )

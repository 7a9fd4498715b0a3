"""URL filter: host and path rules, and a likelihood ratio of character models for the rest.

All of it is DataFrame expressions, joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared

#: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Written before and after a url, so that its start and end count as characters.
START, END = "\u0002", "\u0003"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits ``host`` and ``path``, or null."""
    out = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule string, verdict string>")


def _grams(texts: DataFrame, order: int) -> DataFrame:
    """A row for each character of a text: it with the ``order`` characters before it."""
    padded = F.concat(F.lit(START * order), F.col("text"), F.lit(END))
    starts = F.sequence(F.lit(1), F.char_length("text") + 1)
    return texts.select("*", F.explode(F.transform(starts, lambda k: F.substring(padded, k, F.lit(order + 1)))).alias("gram"))


def model(texts: DataFrame, order: int = 3, weight: float = 2.0, alphabet: int = 256) -> DataFrame:
    """Rows ``gram``, ``ratio``: log of the accepted over the rejected model's probability of its last character.

    ``texts`` has ``text`` and ``use`` ("allow", "block": trained on; else only in need of
    scores). Counts of all orders come from one count of the longest grams. The model of
    order k adds ``weight`` times the model of order k - 1 to its counts, so where a
    context was not seen the shorter one decides; below order 0 all characters are equal.
    """
    counted = _grams(texts, order).groupBy("gram").agg(*(F.count(F.when(F.col("use") == u, 1)).alias(u) for u in ("allow", "block")))
    counted = shared.materialise(counted, "grams")
    lower = None
    for k in range(order + 1):
        t = counted.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        seen = t.groupBy(F.left("gram", F.lit(k)).alias("context")).agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
        t = t.join(seen, F.left("gram", F.lit(k)) == F.col("context"))
        if lower is not None:
            t = t.join(lower.withColumnsRenamed({"gram": "shorter", "p_allow": "q_allow", "p_block": "q_block"}), F.right("gram", F.lit(k)) == F.col("shorter"))
        else:
            t = t.withColumns({"q_allow": F.lit(1.0 / alphabet), "q_block": F.lit(1.0 / alphabet)})
        p = [((F.col(u) + weight * F.col(f"q_{u}")) / (F.col(f"all_{u}") + weight)).alias(f"p_{u}") for u in ("allow", "block")]
        lower = t.select("gram", *p)
    return lower.select("gram", (F.ln("p_allow") - F.ln("p_block")).alias("ratio"))


def scored(texts: DataFrame, ratios: DataFrame, order: int = 3) -> DataFrame:
    """Rows ``id``, ``score``: the mean log ratio over the characters of a text."""
    rows = _grams(texts.select("id", "text"), order).select("id", "gram")
    return rows.join(ratios, "gram").groupBy("id").agg(F.avg("ratio").alias("score"))


def threshold(scores: DataFrame, width: float = 0.01) -> float:
    """The score from which to allow, by held-out scores (``use``, ``score``).

    It has the best mean of the shares allowed rightly and blocked rightly (of equals that nearest 0),
    and lies midway between two scores that occur, in steps of ``width``; 0 where one kind is missing.
    """
    bins = scores.groupBy(F.floor(F.col("score") / width).cast("long").alias("bin")).agg(
        F.count(F.when(F.col("use") == "allow", 1)).alias("a"), F.count(F.when(F.col("use") == "block", 1)).alias("b")
    )
    bins = bins.selectExpr(
        "bin", "sum(a) over () as all_a", "sum(b) over () as all_b", "sum(a) over (order by bin desc) as a_from", "sum(b) over (order by bin) - b as b_below",
        "(bin + coalesce(lag(bin) over (order by bin) + 1, bin)) / 2 as middle"
    )
    best = bins.where("all_a > 0 and all_b > 0").orderBy(F.desc(F.expr("a_from / all_a + b_below / all_b")), F.abs("bin"), "bin").first()
    return best["middle"] * width if best else 0.0


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, order: int = 3) -> DataFrame:
    """Rows ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score``, one for each row of ``pages``.

    Urls that a rule fits are the models' examples: of the distinct ones four fifths train
    the models and a fifth sets the threshold. Urls without a rule are allowed from that mean log
    ratio on; where the rules give no examples of one kind, they are all allowed. The models read whole urls, of any length.
    Null urls and such without ``://`` have an empty host and path; null ones are judged as empty text; repeated rows and ids stay;
    other columns are not read; an empty table gives no rows.
    """
    p = pages.select(F.col("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.coalesce("url", F.lit("")).alias("text"))
    p = p.withColumn("by", rule_of(rules))
    texts = p.groupBy("text").agg(F.min("by.verdict").alias("verdict"))
    fold = F.pmod(F.xxhash64("text"), F.lit(5))
    use = F.when(F.col("verdict").isNotNull() & (fold > 0), F.col("verdict"))
    held = F.when(fold == 0, F.col("verdict"))
    texts = shared.materialise(texts.select(F.monotonically_increasing_id().alias("id"), "text", use.alias("use"), held.alias("held")), "urls")
    kinds = {r["use"] for r in texts.where("use is not null").select("use").distinct().collect()}
    scores = shared.materialise(texts.join(scored(texts, model(texts, order), order), "id", "left").select("text", "held", "score"), "scores")
    least = threshold(scores.where("held is not null").select(F.col("held").alias("use"), "score")) if len(kinds) == 2 else None
    verdict = F.when(F.col("score") < least, "block").otherwise("allow") if least is not None else F.lit("allow")
    found = scores.select(F.col("text").alias("text_"), "score", verdict.alias("guess"))
    out = p.join(found, F.col("text") == F.col("text_"))
    return out.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", "guess").alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))

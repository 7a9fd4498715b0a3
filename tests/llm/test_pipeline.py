"""The pipeline's stages on a small table, each against what it has to keep."""

from __future__ import annotations

import collections
import random

import corpus_pipeline
from trackspark.llm import near_copies, simhash


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "mix", "pack"]
    (_, quality), (_, dedupe), (_, mix), (_, pack) = corpus_pipeline.STAGES
    good = quality(spark, docs, d)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    doubled = good.union(good.limit(5))
    once = dedupe(spark, doubled, d)
    assert once.columns == docs.columns
    # One text of each group that exact similarity connects, by brute force.
    sets = {r.text: set(near_copies.runs(r.text.encode(), 5)) for r in good.collect()}
    by = list(sets)
    group = list(range(len(by)))
    links = [(a, b) for b in range(len(by)) for a in range(b) if near_copies.jaccard(sets[by[a]], sets[by[b]]) >= 0.8]
    for _ in by:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    kept = [group[by.index(r.text)] for r in once.collect()]
    assert links and sorted(kept) == sorted(set(group))
    mixed = mix(spark, once, d)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in once.collect()}
    packed = pack(spark, mixed, d).collect()
    assert sum(r.n_words for r in packed) == sum(len(r.text.encode().split()) for r in mixed.collect())


def test_stages_take_empty_tables_and_odd_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 as row", "2 as copy", "3 as counts", "4 as size")
    for table in (docs.limit(0), docs.limit(20).unionByName(docs.limit(1).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "lang", "cast(null as string) source", "n_chars", "row", "copy", "counts", "size"))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, d)
            out.count()
            if k < 3:
                assert out.columns == docs.columns


def test_near_duplicates_are_found_by_similarity(spark):
    """Texts of 0.8 and more, most of them over 6 bits apart, are linked; texts below, however near their bits, are not."""
    rng = random.Random(3)
    texts = []
    for n in (40, 90, 250):
        for _ in range(25):
            own = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = own.copy()
            for _ in range(rng.randrange(1, n // 20 + 1)):
                other[rng.randrange(n)] = "other"
            texts += [" ".join(own), " ".join(other)]
    base = [f"b{k}" for k in range(60)]
    # A crowd of copies of one text: each with a word of its own, alike to 0.8 or not by where it stands.
    texts += [" ".join([*base[:at], f"x{k}", *base[at + 1 :]]) for k, at in enumerate([*range(60)] * 2)]
    texts += ["", " ", "a b", "A  b", "a c"]
    sets = [set(near_copies.runs(t.encode(), 5)) for t in texts]
    first = list(range(len(texts)))
    alike = [(a, b) for b in range(len(texts)) for a in range(b) if near_copies.jaccard(sets[a], sets[b]) >= 0.8]
    for _ in texts:
        for a, b in alike:
            first[a] = first[b] = min(first[a], first[b])
    codes = [simhash.fingerprint(t.encode(), 5) % (1 << 64) for t in texts]
    assert sum((codes[a] ^ codes[b]).bit_count() > corpus_pipeline.DISTANCE for a, b in alike) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for crowded in (256, 16):
        got = {r.doc_id for r in near_copies.first_rows(docs, crowded=crowded).collect()}
        assert got == {k for k, f in enumerate(first) if k == f}

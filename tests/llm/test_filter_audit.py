"""The filter audit against applying the filters one after another, and its matrix against counts of words."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import duckdb
import pytest

from trackspark.llm import catalog, filter_audit

DOCS = "doc_id long, text string, lang string, mask int, n long, words string"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    vocab = [f"{rng.choice('abcdeé')}{k}" for k in range(400)]
    texts = []
    for k in range(70):
        n = rng.choice([5, 60, 99, 100, 101, 160])
        text = " ".join(rng.choices(vocab if k % 3 else vocab[:90], k=n))
        text = text.upper() if k % 5 == 0 else text
        texts.append(text + rng.choice(["", "", " #", "|", "\n\t x y"]))
    texts += texts[:25] + [None, "", "", " \t\n", "A" * 30_000, "x y " * 9_000, texts[0], texts[0]]
    rows = [(k if k not in (9, 30) else None, t, (None, "", "en", "de")[k % 4], 1, 2, "w") for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame([*rows, rows[3], rows[3]], DOCS).repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, int(k % 7 == 0), "t") for k in range(0, 104, 2)] + [(4, 1, None, "t"), (4, 0, 1, "t"), (None, 1, 1, "t"), (6, None, None, "t")]
    return spark.createDataFrame(rows, LABELS)


def fails(rows):
    """The set of filters that each row fails."""
    low = {}
    for i, t, *_ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = t.encode().split()
        found = {"A"} if len(w) < 100 else set()
        found |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        found |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        found |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        out.append(found | ({"E"} if i is not None and i > low[t] else set()))
    return out


@pytest.mark.parametrize("shard_bytes", [16 << 20, 5_000])
def test_audit_against_applying_every_order(docs, labels, shard_bytes):
    rows = [tuple(r) for r in docs.collect()]
    told = collections.defaultdict(set)
    for i, q, x, _ in labels.collect():
        if i is not None:
            told[i] |= ({"good"} if q == 1 else set()) | ({"toxic"} if x == 1 else set())
    by_part = collections.defaultdict(list)
    for (i, _, lang, *_), f in zip(rows, fails(rows)):
        by_part[lang or ""].append((f, told[i] if i is not None else set()))
    want = {}
    for part, own in by_part.items():
        removed_by = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[0]]
                left = [d for d in left if name not in d[0]]
                removed_by[name] += len(gone)
                failing = sum(name in f for f, _ in own)
                want[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(f == {name} for f, _ in own), sum("good" in t for _, t in gone), sum("toxic" in t for _, t in gone),
                ]
        for (p, order, step), v in want.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(docs, labels, shard_bytes=shard_bytes).collect()}
    assert got == want


@pytest.mark.parametrize("bits", [63, 5])
def test_document_terms(docs, bits):
    """Equal numbers for equal words in all shards, others for others, be it that hashes clash."""
    rows = filter_audit.document_terms(docs, filter_audit.Hashing(bits=bits), shard_bytes=5_000).collect()
    texts = {hashlib.md5((r.text or "").encode()).digest(): (r.text or "").encode().split() for r in docs.collect()}
    assert len(rows) == docs.count()
    number, word = {}, {}
    for r in rows:
        own = collections.Counter(texts[bytes(r.digest)])
        assert sorted(r.counts) == sorted(own.values()) and len(set(r.terms)) == len(r.terms)
        # Rows list a text's words in the order of their first occurrence.
        for w, n, c in zip(own, r.terms, r.counts):
            assert number.setdefault(w, n) == n and word.setdefault(n, w) == w and own[w] == c
    assert any(n < 0 for n in word) == (bits < 63)


def test_empty_tables(docs, labels):
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {0}


def test_audit_equals_its_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()["op12_filter_audit"])
    got = filter_audit.query(spark, d)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())

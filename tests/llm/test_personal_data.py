"""Personal data: the fixed patterns against plain regular expressions, and planted identifiers that only their context shows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from trackspark.llm import personal_data as pd_

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    def right(kind, m):
        digits = [int(c) for c in re.sub("[^0-9]", "", m)]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            doubled = [d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, name in enumerate(pd_.KINDS) for m in PLAIN[name].finditer(text) if right(name, m.group())]


def with_luhn(digits):
    return next(digits + str(d) for d in range(10) if pd_.luhn(digits + str(d)))


def test_fixed_patterns_against_plain_expressions():
    rng = random.Random(8)
    parts = ["a", "b.c", "@", "@", "x-1", ".", ".", "-", " ", " ", "+1", "+", "(", ")", "255", "256", "0", "00", "1.2.3.4", "192.168.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "é", "\n", "_%", "9", "555-0199", "日", "4", "4111111111111111"]
    hits = 0
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 22)))
        got = pd_.base_spans(text)
        hits += len(got)
        assert got == plain(text), text
    assert hits > 5_000


def test_long_texts_take_linear_time():
    for text in ("x" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "1 " * 200_000, "+1" * 200_000, "a.b@c." * 60_000, "(1" * 200_000, "a:b" * 130_000):
        spans = pd_.base_spans(text)
        pd_.candidates(text, spans)


def test_words_beside_are_whole():
    text = "a" * 3000 + " bb  cc 12345 d\te" + "f" * 500
    at = text.index("12345")
    assert pd_.patterns_at(text, at, at + 5) == ["cc _", "bb cc _", "cc _ d", f"_ d {pd_._word('e' + 'f' * 500)}"]
    assert pd_.patterns_at("12345", 0, 5) == ["\u0002 _", "\u0002 \u0002 _", "\u0002 _ \u0003", "_ \u0003 \u0003"]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choices(["the", "of", "und", "der", "la", "que", "et", "12", "2021", "7"], k=n))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    texts, unseen = [], []

    def add(before, value, after, kind=None):
        text = f"{fill(8)} {before} {value} {after} {fill(6)}"
        if kind is not None:
            at = text.index(value)
            unseen.append((len(texts), kind, at, at + len(value)))
        texts.append(text)

    for k in range(40):
        add("please call", f"+1 (743) 555-{k:04}", "before noon")
        add("charged to", with_luhn("4" + digits(14)), "last month")
        add("write to", f"user{k}@mail{k % 5}.example.com", "for help")
        add("logged from", f"10.{k}.7.{k + 1}", "at night")
        # Numbers of no kind where all kinds stand.
        add("number", digits(11), "there")
        add("number", rng.choice([f"+1 (743) 556-{k:04}", f"u{k}@a.example", f"10.9.8.{k}"]), "there")
    for k in range(4):
        add("please call", f"(743) 557-{k:04}", "before noon", pd_.PHONE)
        add("charged to", ".".join(re.findall("....?", with_luhn("37" + digits(12)))), "last month", pd_.CARD)
        add("write to", f"anna{k}@localhost", "for help", pd_.EMAIL)
        add("logged from", f"2001:db8:0:{k}:1::7", "at night", pd_.IP)
    add("some other words", "(743) 557-0001", "stand here", pd_.PHONE)  # a value found above, where no pattern knows it
    add("some other words", "1.743.555.0003", "stand here", pd_.PHONE)  # a seed in another form
    return texts, unseen


def test_contexts_find_unseen_identifiers_and_nothing_else(spark, planted):
    texts, unseen = planted
    rows = [(k, t, 1, "r", "v") for k, t in enumerate(texts)]
    rows += [(None, texts[0], 1, "r", "v"), (3, texts[3], 1, "r", "v"), (3, texts[3], 1, "r", "v"), (9_000, None, 1, "r", "v"), (9_001, "", 1, "r", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, base string, value string").repartition(3)
    got = pd_.extract(df).collect()
    assert len(got) == len(rows)
    added = sorted({(r.doc_id, s.kind, s.start, s.stop) for r in got for s in r.spans if s.added})
    assert added == sorted(unseen)
    by_id = {i: t or "" for i, t, *_ in rows if i is not None}
    for r in got:
        base = plain(by_id[r.doc_id] if r.doc_id is not None else texts[0])
        assert [(s.kind, s.start, s.stop) for s in r.spans if not s.added] == base
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pd_.KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    assert pd_.extract(df.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pd_.query(spark, "/root/testdata/sf0.01").collect()}
    for r in docs.collect():
        base = [f"{pd_.KINDS[k]}:{s}:{e}" for k, s, e in plain(r.text or "")]
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[r.doc_id].spans.split(","))
    print("added", sum(len(r.spans.split(",")) for r in got.values() if r.spans) - sum(len(plain(r.text or "")) for r in docs.collect()))

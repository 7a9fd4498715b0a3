"""The operators against brute force, on odd rows: nulls, empty and long texts, ties, repeats, other columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import chat_format, embeddings, language_model, mixing, packing, quality_rules, shared, simhash, token_ids, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, counts int"


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    out = [" ".join(rng.choices(vocab, k=rng.randrange(12, 60))) for _ in range(60)]
    near = out[0].split()
    near[5] = "Changed"
    return [*out, out[0], out[0].upper(), " ".join(near), None, "", " \n\t ", "one", "one", " ".join(rng.choices(vocab, k=30_000)), "a\u00a0b  c \n d", "x" * 50_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k if k != 7 else None, t, None, None if k % 9 == 0 else f"s{k % 4}", None, "x", "y", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[3]], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, shared.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root[n] for n in linked}


def test_running_totals(spark):
    rows = [(k % 7, k) for k in range(100)]
    got = shared.running_totals(spark.createDataFrame(rows, "k int, v long").repartition(5), ["k", "v"], "v", "before").collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.k, r.v)):
        assert r.before == total
        total += r.v


def test_chat(spark):
    odd = ["", None, "</turn>\n### user:\n\\", "\\### Assistant: </turn> ok", "####", "é" * 9, "\n</turn>\n", "\\\\</turn>"]
    rows = [(c, t, r, odd[(c + t) % len(odd)], 1) for c in range(20) for t, r in enumerate(["system", "user", "assistant", None, "a\nb:\\n"])]
    rows += [(3, 1, "user", odd[4], 1), (None, 0, "assistant", "no id", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    made = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.digests(made).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t, r or "", x or ""))
    assert len(got) == len(by)
    for c, turns in by.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        said = "".join(x for r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    one = next(r for r in made.collect() if r.conv_id == 4)
    assert [chat_format.unescape(one.formatted[a:b]) for a, b in zip(one.loss_starts, one.loss_ends)] == [odd[6]]
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_long_conversations_come_in_parts(spark):
    rows = [(1, t, "assistant", f"{t} " * 60_000) for t in range(60)]
    made = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [r.part for r in made.orderBy("part").collect()] == list(range(made.count())) and made.count() > 1
    said = "".join(r[3] for r in rows)
    (r,) = chat_format.digests(made).collect()
    assert (r.n_turns, r.loss_sha256) == (60, hashlib.sha256(said.encode()).hexdigest())


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([rng.normal(size=(300, 16)), centres[rng.integers(0, 30, 300)] + rng.normal(size=(300, 16)) * 0.12])
    rows = [(k, [float(v) for v in r], 1) for k, r in enumerate(x)]
    rows += [(900, rows[0][1], 1), (901, rows[0][1], 1), (901, rows[0][1], 1), (902, None, 1), (903, [], 1), (904, [0.0] * 16, 1), (905, [1.0, None], 1), (906, [float("nan")] * 16, 1), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (None, [5.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int")
    # Small cells and leaves, so that trees really split.
    got = embeddings.near_duplicates(df, leaf=24, cell=150, sample=400).collect()
    good = [(i, np.array(v)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    n, root = collections.Counter(), {i: i for i, _ in good}
    links = [(a, b) for k, (a, u) in enumerate(good) for b, v in good[:k] if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9]
    for a, b in links:
        n[a] += 1
        n[b] += 1
    links = [(a, b) for a, b in links if a is not None and b is not None]
    for _ in range(30):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    n[901] //= 2
    assert len(got) == len(rows)
    right = sum(r.n_links == n[r.vec_id] and r.component_id == root.get(r.vec_id, r.vec_id) for r in got)
    assert right >= 0.9 * len(rows) and all(r.n_links <= n[r.vec_id] for r in got)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got if r.vec_id is not None)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_simhash(spark, docs, texts, empty):
    import xxhash

    def brute(text):
        w = words(text)
        k = min(4, len(w))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = {t: brute(t) for _, t in rows}
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    codes = sorted(set(prints.values()))
    root = {c: c for c in codes}
    for _ in range(8):
        for a in codes:
            for b in codes:
                if (a ^ b).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    low = {}
    for i, t in rows:
        if i is not None:
            low[root[prints[t]]] = min(i, low.get(root[prints[t]], i))
    by_id = {i: t for i, t in rows}
    for r in got:
        assert r.fp % (1 << 64) == prints[by_id[r.doc_id]] and r.component_id == low.get(root[prints[by_id[r.doc_id]]])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowded", [200_000, 50])
def test_gray_links_connect_what_all_pairs_do(spark, crowded):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (1500, 3), dtype=np.uint64), axis=1)
    codes = np.unique(np.concatenate([base[rng.integers(0, 40, 1500)] ^ flips, base]))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    got = dict(map(tuple, shared.components(simhash.links(df, 4, crowded)).collect()))
    a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes) <= 4, 1))
    root = shared.united(len(codes), a, b)
    same = {}
    for c, r in zip(codes.view(np.int64).tolist(), root.tolist()):
        same.setdefault(r, set()).add(got.get(c, c))
    assert all(len(s) == 1 for s in same.values()) and len(set().union(*same.values())) == len(same)


def test_packing(spark, docs, texts, empty):
    rows = packing.rows_of(docs)
    got = packing.pack(rows, capacity=64, per_source=2, shard_rows=30).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.doc_id, r.cluster, r.copy] += r.n_words
    assert sum(sizes.values()) == sum(len(words(r.text)) for r in docs.collect()) and len(sizes) == docs.count()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    for held in bins.values():
        assert sum(r.n_words for r in held) <= 64
        assert max(collections.Counter(r.source for r in held).values()) <= 2
        assert max(collections.Counter(r.cluster for r in held).values()) == 1
        at = 0
        for r in sorted(held, key=lambda r: (r.bin_offset, r.n_words)):
            assert r.bin_offset == at
            at += r.n_words
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, packing.pack(rows.repartition(7), capacity=64, per_source=2, shard_rows=30).collect()), key=str)
    assert packing.pack(packing.rows_of(empty)).count() == 0


def test_best_fit_takes_the_tightest_bin_that_is_allowed():
    items = [(6, "a", 1), (5, "b", 2), (4, "c", 1), (3, "d", 2), (1, "a", 9)]
    # 4 does not join its own cluster's bin (4 left) but the next (5 left); 3 then finds 4 left.
    assert packing.best_fit(items, 10, 1) == [(0, 0), (1, 0), (1, 5), (0, 6), (1, 9)]


def test_language_model(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = collections.defaultdict(list)
    out = language_model.score(docs, k=20, table=60).collect()
    for r in out:
        got[r.doc_id].append(r)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    assert len(out) == len(rows)
    for i, t in rows:
        w = [*words(t), None]
        r = got[i][0]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and len({x.score for x in got[i]}) == 1
    assert language_model.score(empty).count() == 0


def test_language_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.limit(1).crossJoin(spark.range(50).select("id")).selectExpr("100000 + id", "text", "lang", "source", "n_chars"))
    runs = []
    for parts in (1, 5, 7):
        out = language_model.score(docs.repartition(parts, F.rand(parts)), k=100, shard_tokens=4_000).select("doc_id", "score").collect()
        runs.append(np.array([r.score for r in sorted(out, key=lambda r: r.doc_id)]))
    assert len(runs[0]) == docs.count() and all(np.allclose(runs[0], x, rtol=1e-7) for x in runs[1:])


def test_language_model_is_normalised_and_learns_contexts():
    rng = np.random.default_rng(3)
    model = language_model.LogBilinear(np.full(12, 1 / 12), 16, 1)
    before = rng.integers(0, 12, 20_000)
    w = (before + 1) % 12
    for at in range(0, 20_000, 500):
        model.train(before[at : at + 500], before[at : at + 500], w[at : at + 500], rng, 0.1)
    score = language_model.Scorer(model)
    p = 10 ** score(np.full(12, 3), np.full(12, 12), np.arange(12))
    assert math.isclose(p.sum(), 1, rel_tol=1e-5)
    assert score(before[:500], before[:500], w[:500]).mean() > math.log10(0.5)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    out = language_model.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    better, base = out.agg(F.sum("score"), F.sum("base_score")).first()
    assert better > 0.97 * base  # measured: 3.5% fewer bits than the counts alone


def test_quality_counts(docs, texts, empty):
    for r in quality_rules.judge(docs, []).collect():
        w = (r.text or "").encode().split()
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often = collections.Counter(runs)
        inside = {k + j for k, x in enumerate(runs) if often[x] > 1 for j in range(5)}
        c = r["counts"]
        assert (c.n_words, c.word_chars, c.n_dup_lines, c.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w)) and (r.rejected_by is None) == (not r.base_failed)
    assert quality_rules.counts("a b c d e f a b c d e\nx\nx #$")[2:5] == (2, 0, 10)
    assert quality_rules.judge(empty, []).count() == 0


def test_decision_list_learns_thresholds():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(2000), "b": rng.random(2000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5) | (x["b"] > 0.95)
    rules = quality_rules.learn(x, bad, rng.integers(0, 99, 2000))
    said = np.any([r.holds(x) for r in rules], axis=0)
    assert (said & ~bad).sum() <= 10 and (said & bad).sum() >= 0.95 * bad.sum()


def test_quality_rules_on_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.judge(docs, quality_rules.fit(docs, labels)).join(labels, "doc_id")
    right, n, lost = judged.agg(
        F.sum(((F.col("rejected_by").isNull()) == (F.col("quality") == 1)).cast("int")), F.count("*"),
        F.sum((F.col("rejected_by").isNotNull() & ~F.col("base_failed") & (F.col("quality") == 1)).cast("int")),
    ).first()
    assert right >= 0.95 * n and lost <= 0.01 * n
    assert quality_rules.keep_good(docs, labels.limit(0)).columns == docs.columns


URLS = [
    ("http://A.Example.NET/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://net/x?/en/", "net", "/x", "net/", "block"),
    ("https://example.net", "example.net", "", None, None), ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("http://b.org/fr/#x", "b.org", "/fr/", "org/fr/", "allow"),
    (None, "", "", None, None), ("no scheme", "", "", None, None), ("", "", "", None, None), ("http://h.com?q=://z", "h.com", "", None, None),
]


def test_url_filter(spark):
    rows = [(k, u[0], "x") for k, u in enumerate(URLS)] + [(None, URLS[0][0], "x"), (0, URLS[0][0], "x")]
    many = [(100 + k, f"http://{'good' if k % 2 else 'evil'}{k}.{'org/fr/nice' if k % 2 else 'net/casino'}", "x") for k in range(200)]
    free = [(900, "http://good7.com/nice", "x"), (901, "http://evil8.com/casino", "x")]
    df = spark.createDataFrame(rows + many + free, "page_id long, url string, score string")
    got = url_filter.judge(df).collect()
    assert len(got) == df.count()
    by = {r.page_id: r for r in got}
    asked = [(k, f"http://site{k}.com/x?{'free=nice' if k % 2 else 'play=casino'}{k}", "x") for k in (901, 902)]
    told = [(300 + k, f"http://w{k}.{'org/fr/' if k % 2 else 'net/'}?{'free=nice' if k % 2 else 'play=casino'}{k}", "x") for k in range(200)]
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(asked + told, "page_id long, url string, score string")).collect()}
    assert (verdicts[901], verdicts[902]) == ("allow", "block")  # they differ after the question mark only
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (by[k].host, by[k].path, by[k].rule) == (host, path, rule) and by[k].verdict in ({verdict} if verdict else {"allow", "block"})
    assert (by[900].verdict, by[901].verdict) == ("allow", "block")
    assert {r.verdict for r in url_filter.judge(df.where("page_id in (6, 7)")).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_model_against_brute_force(spark):
    train = [("abab", "allow"), ("abba", "allow"), ("bbbb", "block"), ("xyz", None)]
    df = spark.createDataFrame(train, "text string, use string")
    got = {r.gram: r.ratio for r in url_filter.model(df, order=2).collect()}

    def p(gram, use, k=2):
        if k < 0:
            return 1 / 256
        grams = [("\2\2" + t + "\3")[i : i + 3] for t, u in train if u == use for i in range(len(t) + 1)]
        g = gram[-k - 1 :]
        same, seen = sum(x.endswith(g) for x in grams), sum(x[2 - k : 2] == g[:-1] for x in grams)
        return (same + 2 * p(gram, use, k - 1)) / (seen + 2)

    assert all(math.isclose(r, math.log(p(g, "allow") / p(g, "block")), abs_tol=1e-9) for g, r in got.items())


def test_mixing(spark, docs, empty):
    rows = mixing.sizes(docs)
    got = mixing.mix(rows, block=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(mixing.sizes(docs.repartition(6)), block=4).collect()))
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(words(r.text))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert r.taken <= 2 * r.size and sum(r.shard_words) == r.taken
    assert len(got) == docs.count() and all(abs(taken[s] - target[s]) <= 4 for s in order)
    assert mixing.mix(mixing.sizes(empty)).count() == 0


@pytest.mark.parametrize("shards, block", [(8, 8), (3, 5), (5, 1000)])
def test_shards_have_equal_houses_of_the_highest_quotients(spark, shards, block):
    told = {"a": 311.5, "b": 47.0, "c": 47.0, "d": 1009.25, "e": 0.0, "f": 3.5, None: 1650.0, "g": 2.0}
    df = spark.createDataFrame([(s, 1, t) for s, t in told.items()], "source string, source_size long, target double")
    got = {r.source: list(r.seats) for r in mixing.seats(df, block, shards).collect()}
    house = math.floor(sum(told.values()) / block + 0.5)
    quotients = sorted((-t / (2 * k - 1), s is None, s or "", k) for s, t in told.items() if t for k in range(1, house + 2))
    for j in range(shards + 1):
        won = collections.Counter(s if not last else None for _, last, s, _ in quotients[: j * house // shards])
        assert {s: x[j] for s, x in got.items()} == {s: won[s] for s in told}
        assert sum(x[j] for x in got.values()) == j * house // shards


@pytest.mark.parametrize("times", [1, 9, 10_000])
def test_blocks_times_shards_may_pass_the_integers(spark, times):
    # From 2^31 words to take on, the house times 8 shards is no int; at nine times as many the house itself is none.
    told = {"a": 700_000_001.5, "b": 90_000_000.25, "c": 410_000_003.0, None: 950_000_000.0, "d": 3.5, "e": 0.0}
    told = {s: t * times for s, t in told.items()}
    df = spark.createDataFrame([(s, 1, t) for s, t in told.items()], "source string, source_size long, target double")
    got = {r.source: list(r.seats) for r in mixing.seats(df).collect()}
    house = math.floor(sum(told.values()) / 8 + 0.5)
    assert got.keys() == told.keys() and house * 8 > 2**31
    for j in range(9):
        assert sum(x[j] for x in got.values()) == j * house // 8
        lost = max(told[s] / (2 * x[j] + 1) for s, x in got.items())
        assert all(told[s] / (2 * x[j] - 1) >= lost for s, x in got.items() if x[j])
    sizes = [(k, s, int(t / 3)) for k, (s, t) in enumerate(told.items()) for _ in range(2)]
    rows = mixing.mix(spark.createDataFrame(sizes, "doc_id long, source string, size long")).collect()
    words, target = 0, 0.0
    for s in told:
        own = [r for r in rows if r.source == s]
        assert len(own) == 2 and all(sum(r.shard_words) == r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8
        words, target = words + sum(r.taken for r in own), target + own[0].target
    assert words > 2**31 and math.isclose(target, 1.5 * sum(size for _, _, size in sizes), rel_tol=1e-9)
    each = [sum(r.shard_words[j] for r in rows) for j in range(8)]
    assert max(each) - min(each) <= 8 * len(told)


def test_warc(spark):
    big, other = "é" * 600, "y" * 3000
    rows = [(1, "http://a/\r\nX: y", big, 1), (2, None, big, 1), (3, "u", big, 1), (4, "u", "short", 1), (5, "u", "short", 1), (6, "u", None, 1), (7, "u", "", 1), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 9000, 1), (None, "u", other, 1), (9, "u", other, 1), (9, "u", other, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    warc.register(spark)
    path = shared.scratch(spark, "test-warc")
    warc.records(df).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    got = {(r.page_id, r.record_type): r for r in back.where("record_type <> 'warcinfo'").collect()}
    assert {(1, "revisit"), (2, "revisit"), (3, "response"), (4, "response"), (5, "response"), (None, "revisit"), (9, "response")} <= set(got)
    assert got[1, "revisit"].refers_to_page_id == 3 and got[1, "revisit"].payload is None and got[1, "revisit"].payload_length == 1200
    assert bytes(got[8, "response"].payload).decode() == rows[7][2] and bytes(got[6, "response"].payload) == b""
    assert got[3, "response"].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert back.where("record_type = 'response'").count() == 8 and back.where("page_id = 4").count() == 1
    bare = spark.read.format("warc").option("payload", "false").load(path).where("record_type in ('response', 'revisit')").collect()
    assert len(bare) == len(rows) and all(r.payload is None for r in bare)
    path = shared.scratch(spark, "test-warc")
    warc.records(df.limit(0)).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 0


def test_token_ids(spark, docs, texts, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    name = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(name)
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(5000, "see <|endoftext|> here"), (5001, "<|endoftext|>"), (5002, "a<|endoftext|>b  <|endoftext|> c")], "doc_id long, text string"))
    for encoding in ("delta", "dictionary"):
        path = shared.scratch(spark, "test-ids")
        token_ids.write(token_ids.encode(docs, name), path, encoding=encoding)
        back = token_ids.read(spark, path)
        for r in back.collect():
            assert r.ids[-1] == 2 and r.n_tokens == len(r.ids)
        assert sorted(str(list(r.ids)) for r in back.collect()) == sorted(str([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect())
    total = 0
    for r in token_ids.starts(token_ids.digests(back)).orderBy("doc_id", "text_hash").collect():
        assert r.start <= total
        total = max(total, r.start + r.n_tokens)
    path = shared.scratch(spark, "test-ids")
    token_ids.write(token_ids.encode(empty, name), path)
    assert token_ids.starts(token_ids.digests(token_ids.read(spark, path))).count() == 0


def test_pieces_are_encoded_like_whole_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    encoder = token_ids.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), most=50)
    rng = random.Random(3)
    parts = ["a", "Foo", " ", " ", "  ", "\n", "\t", ".", ",", "\u00a0", "é", "9", "'s", "'", "|", "\x1c", "\u2003", "<|endoftext|>", "日本", "%%", "\x85", "🙂"]
    some = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    for at in range(0, 3000, 300):
        sizes, ids = encoder.encode(pa.array(some[at : at + 300]))
        for text, got in zip(some[at : at + 300], np.split(ids, np.cumsum(sizes)[:-1])):
            assert got.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pieces_of_known_words_are_not_encoded_again():
    """Words that meet at a line end, or carry marks, cost what the words cost."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    encoder = token_ids.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    plain, asked = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("rn", "st", "lly", "ß")]
    some = [" ".join(f"{x}{mark}\n{y}" for y in words) for x, mark in zip(words, [".", "!!", "", ",", "\n", "\r"] * 20)]
    sizes, ids = encoder.encode(pa.array(some))
    for text, got in zip(some, np.split(ids, np.cumsum(sizes)[:-1])):
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    # A third of the pieces hold two line ends, which are not cut.
    assert sum(map(len, asked)) < 0.45 * sum(map(len, some))


def test_pieces_of_other_rules_are_cut_at_spaces_only(tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rule = Regex(r" ?\p{L}+| ?[^\s\p{L}]+[\r\n]*|\s+(?!\S)|\s+")
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(rule, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    encoder = token_ids.PieceEncoder(str(tmp_path / "other.json"), most=20)
    rng = random.Random(5)
    some = ["".join(rng.choices(["ab", "Cd", " ", " ", "\n", ".", "!?", "é"], k=rng.randrange(30))) for _ in range(600)]
    for at in range(0, 600, 60):
        sizes, ids = encoder.encode(pa.array(some[at : at + 60]))
        for text, got in zip(some[at : at + 60], np.split(ids, np.cumsum(sizes)[:-1])):
            assert got.tolist() == other.encode(text, add_special_tokens=False).ids, text


def test_quality_fit_takes_one_row_of_each_id(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(["aa", "bb", "cc", "dd"] if k % 2 else ["x!", "y!", "z!"], k=60 + k % 7))) for k in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, quality int")
    once = quality_rules.fit(docs, labels, sample=100)
    again = quality_rules.fit(docs.union(docs).union(docs).repartition(5), labels.union(labels), sample=100)
    assert once and list(map(str, once)) == list(map(str, again))


def test_packing_against_plain_best_fit():
    rng = random.Random(9)
    for _ in range(200):
        capacity, per_source = rng.choice([10, 50, 100]), rng.choice([1, 2, 4])
        items = [(rng.randrange(0, capacity + 1), rng.choice("abc"), rng.choice([None, *range(12)])) for _ in range(rng.randrange(1, 80))]
        items.sort(key=lambda t: -t[0])
        bins, want = [], []
        for size, source, cluster in items:
            fits = [
                (capacity - sum(x[0] for x in held), k) for k, held in enumerate(bins)
                if sum(x[0] for x in held) + size <= capacity and sum(x[1] == source for x in held) < per_source and (cluster is None or all(x[2] != cluster for x in held))
            ]
            if fits:
                k = min(fits)[1]
            else:
                k = len(bins)
                bins.append([])
            want.append((k, sum(x[0] for x in bins[k])))
            bins[k].append((size, source, cluster))
        assert packing.best_fit(items, capacity, per_source) == want

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import decontam, ngram_join as nj, substring as sub, tables
from gleanery.llm import textkit as tk
from gleanery.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 160))] for _ in range(n)]
    shared = [rng.choice(vocab) for _ in range(50)]
    out = []
    for i, w in enumerate(base):
        out.append(w)
        for _ in range(rng.randint(0, 4) if i % 3 == 0 else 0):  # near copies
            c = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            out.append(c)
        if i % 5 == 0:
            out.append(w[:20] + shared + w[20:])
    texts = [rng.choice((" ", "\n", "  ")).join(w) for w in out]
    texts += [texts[0].upper(), texts[0], "a b c", "A B C", "a b", "", " \n", "x " * 200, "x " * 90]
    return list(enumerate(texts))


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", len(t or "")) for i, t in rows], "doc_id long, text string, source string, n_chars int")


@pytest.mark.parametrize("hub_rounds", [0, 2])
def test_components_match_brute_force(spark, monkeypatch, hub_rounds):
    monkeypatch.setattr(nj, "HUB_ROUNDS", hub_rounds)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def near_copies(sizes=(3, 12, 150), seed=5):
    """Groups of near copies: a base and its tails, edited copies, and copies of copies that no longer all link."""
    rng = random.Random(seed)
    texts = []
    for g, many in enumerate(sizes):
        base = [f"g{g}w{i}" for i in range(80)]
        texts += [base, base + [f"g{g}tail"], base + [f"g{g}other"]]
        group = [base]
        while len(group) < many - 2:
            c = list(rng.choice(group))
            for _ in range(rng.randint(1, 2)):
                c[rng.randrange(len(c))] = f"g{g}n{rng.randrange(10**6)}"
            group.append(c[: rng.randint(70, 80)])
        texts += group[1:]
    rows = [" ".join(t) for t in texts]
    return list(enumerate(rows + rows[:2]))


def brute_links(rows):
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    return {i: sum(5 * len(a & b) >= 4 * len(a | b) for j, b in sets.items() if j != i) for i, a in sets.items()}


@pytest.mark.parametrize("block", [512, 20])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK_SETS", block)
    rows = near_copies()
    got = nj.ngram_join(frame(spark, rows)).collect()
    assert {r.doc_id: r.n_links for r in got} == brute_links(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_join_edges(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (7, None), (None, ""), (9, "")]
    df = frame(spark, rows).withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in nj.ngram_join(df).collect())
    assert got == [("5", 36, "5", 2), ("5", 36, "5", 2), ("7", 0, "7", 0), ("9", 0, "9", 0), ("None", 0, "None", 0), ("None", 36, "5", 2)]
    kept = nj.deduplicated(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "7", "9", "None", "None"]
    assert nj.ngram_join(df.limit(0)).count() == 0


def test_filters_lose_no_similar_pair():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, nj.SKETCH).astype(np.uint32)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop = rng.random(len(x)) < rng.choice([0.0, 0.05, 0.11, 0.3])
        y = np.unique(np.concatenate([x[~drop], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, n // 10)))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        assert nj.suffix_bound(x, y) >= both
        similar = 5 * both >= 4 * (len(x) + len(y) - both)
        assert nj.similar(x, y) == similar
        if similar and len(y):
            p = lambda s: nj.rare_first(s, counts)[: len(s) - -(-4 * len(s) // 5) + 1]  # noqa: E731, B023
            px, py = p(x), p(y)
            shared = len(np.intersect1d(px, py))
            suffix = max(-(-4 * len(x) // 5), -(-4 * len(y) // 5)) - 1
            assert shared and 9 * (shared + suffix) >= 4 * (len(x) + len(y))
            first = min((i, j) for i, t in enumerate(px) for j, u in enumerate(py) if t == u)
            assert 9 * min(len(x) - first[0], len(y) - first[1]) >= 4 * (len(x) + len(y))


def test_components_both_ways(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    one, many = ({(r.node, r.root) for r in components(df, one_task=n).collect()} for n in (1000, 0))
    assert one == many and (1040, 1000) in one and (None not in {n for n, _ in one})
    assert components(df.limit(0)).count() == 0


# --- repeated windows ----------------------------------------------------------------------------------------------


def brute_removed(rows, k=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((str(doc), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def passages():
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(50)]
    long = [rng.choice(vocab) for _ in range(90)]
    rows = []
    for i in range(40):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 300))]
        if i % 4 == 0:
            a = rng.randrange(len(w) + 1)
            cut = rng.randint(30, 90)
            w[a:a] = long[:cut]
        rows.append((i, rng.choice((" ", "\n", " \t ")).join(w)))
    rows += [(100, "same " * 200), (101, "a b c " * 40), (102, None), (103, ""), (None, " ".join(long)), (4, rows[4][1]), (4, rows[4][1]), (200, " ".join(long[:34])), (201, " ".join(long[:35]))]
    return rows


def test_removal_matches_brute_force(spark):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("ranges", F.lit("x"))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in sub.substring_dedup(df).collect())
    assert got == brute_removed(rows)
    assert sub.substring_dedup(df.limit(0)).count() == 0


def test_super_kmers_cover_every_window_once():
    rng = np.random.default_rng(0)
    for n in (0, 34, 35, 36, 500):
        h = rng.integers(0, 30, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        first, last, least = sub.super_kmers(h, max_run=16)
        assert sum((last - first).tolist()) == max(0, n - 34) and (not len(first) or (last - first).max() <= 16)
        g = tk.window_hashes(h, sub.GRAM)
        for a, b, m in zip(first.tolist(), last.tolist(), least.tolist(), strict=True):
            assert all(int(g[i : i + 28].min()) == m for i in range(a, b))


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(tk, "word_hashes", lambda data, start, end: np.ones(len(start), np.uint64))
    a, b = " ".join(f"a{i}" for i in range(36)), " ".join(f"b{i}" for i in range(35))
    string, offset = sub.repeated_windows("\n".join([a, b, a]).encode(), 35)
    assert sorted(zip(string.tolist(), offset.tolist(), strict=True)) == [(0, 0), (0, 1), (2, 0), (2, 1)]


# --- decontamination -----------------------------------------------------------------------------------------------


def plain_alignment(a, b):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + (1 if x == y else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
    return max(map(max, h))


def test_alignment_scores():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (rng.integers(0, 12, int(rng.integers(1, 25))).astype(np.uint64) for _ in range(2))
        score, x, y = decontam.align(a, b)
        assert score == pytest.approx(plain_alignment(a.tolist(), b.tolist()))
        assert plain_alignment(a.tolist(), b[x:y].tolist()) == pytest.approx(score) and decontam.matches_bound(a, b) >= score


def leak_rows():
    rng = random.Random(9)
    vocab = [f"z{i}" for i in range(300)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 50)))) for i in range(12)] + [(90, None), (91, "two words")]
    docs, truth = [], set()
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        if d % 4 == 0:
            item = rng.randrange(12)
            c = items[item][1].split()
            for _ in range(rng.randint(0, len(c) // 6)):  # edited copies
                p = rng.randrange(len(c))
                c[p : p + 1] = rng.choice(([], [rng.choice(vocab)], [c[p].upper() + ","]))
            at = rng.randrange(len(w))
            w[at:at] = c
            truth.add((d, item))
        docs.append((d, " ".join(w)))
    return docs, items, truth


def test_finds_what_full_alignment_finds(spark):
    docs, items, truth = leak_rows()
    flat = lambda t: decontam.flat((t or "").encode()).split()
    want = {(d, i) for d, t in docs for i, x in items if (len(flat(x)) >= 3 or flat(x) == flat(t)) and x and plain_alignment(flat(x), flat(t)) >= decontam.THRESHOLD * len(flat(x))}
    assert truth <= want
    found = decontam.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_many_blocks_and_a_hot_item(spark, monkeypatch):
    docs, items, truth = leak_rows()
    docs += [(1000 + i, f"intro {i} " + items[3][1]) for i in range(100)]
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, docs), bench).collect()}
    assert truth <= found and {(1000 + i, 3) for i in range(100)} <= found
    kept = decontam.decontaminated(frame(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}


def test_decontam_edges(spark):
    rows = [(None, None), (1, ""), (1, "")]
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontam.contaminated(frame(spark, rows), bench).count() == 0
    assert decontam.decontaminated(frame(spark, rows), bench.limit(0)).count() == 3
    assert decontam.contaminated(frame(spark, rows).limit(0), bench).count() == 0
    named = spark.createDataFrame([("i-1", "a b c d e"), (None, "q r s t u"), ("s", "Two words"), ("e", "")], "Item_ID string, text string")
    texts = frame(spark, [(1, "x a b c d e"), (2, "q r s t u"), (3, "two words!"), (4, "here are two words more"), (5, "")])
    assert sorted((r.doc_id, str(r.item_id)) for r in decontam.contaminated(texts, named).collect()) == [(1, "i-1"), (2, "None"), (3, "s")]
    assert sorted(r.doc_id for r in decontam.decontaminated(texts.withColumnRenamed("text", "TEXT"), named).collect()) == [4, 5]
    long = frame(spark, [(1, "w " * 300_000 + "a b c d e " + "w " * 300_000)])
    assert [(r.first_word, r.last_word) for r in decontam.contaminated(long, bench).collect()] == [(300_000, 300_005)]
    hit = frame(spark, [(None, "x A, b! c d e y")] * 2)
    assert [(r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in decontam.contaminated(hit, bench).collect()] == [(None, 1, 1.0, 1, 6)] * 2


@pytest.mark.parametrize("copies", [1, 40])
def test_no_alignment_avoids_the_seeds(spark, copies):
    rng = random.Random(17)
    items = [(i, " ".join(f"q{i}x{rng.randrange(500)}" for _ in range(60))) for i in range(30)]
    docs = []
    for i, text in items:
        w, c = text.split(), text.split()
        share = (0.2, 0.25, 0.3)[i % 3]
        if i < 24:  # words replaced at random, or evenly
            for j in rng.sample(range(60), int(60 * share)) if i < 12 else range(i % 3, 60, round(1 / share)):
                c[j] = f"other{i}y{j}"
        else:  # a word put in behind every word, or behind every second; every third word left out
            c = [[x for v in w for x in (v, "um")][:-1], [x for j, v in enumerate(w) for x in ((v, "um") if j % 2 else (v,))], [v for j, v in enumerate(w) if j % 3]][i % 3]
        docs += [(100 * i + n, " ".join([f"before{n}"] * 8 + c + ["after"] * 8)) for n in range(copies)]
    split = lambda t: decontam.flat(t.encode()).split()
    want = {d for d, t in docs if plain_alignment(split(items[d // 100][1]), split(t)) >= decontam.THRESHOLD * 60}
    assert {d // 100 for d in want} >= {*range(0, 12, 3), 24, 25, 26}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, docs), bench).collect()} == {(d, d // 100) for d in want}
    assert {r.doc_id for r in decontam.decontaminated(frame(spark, docs), bench).collect()} == {d for d, _ in docs} - want


@pytest.mark.parametrize("most", [0, 3000])
def test_large_buckets_are_dealt_out_by_windows(spark, monkeypatch, most):
    monkeypatch.setattr(sub, "BUCKET_BYTES", most)
    monkeypatch.setattr(sub, "BUFFER_TEXTS", 5)
    rows = passages()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in sub.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_removed(rows)


def test_very_long_texts(spark):
    long = " ".join(f"n{i % 70_001}" for i in range(200_000))
    rows = frame(spark, [(1, long), (2, long + " more"), (3, "x" * 2_000_000), (4, None)])
    got = {r.doc_id: (r.component_id, r.n_links) for r in nj.ngram_join(rows).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    done = {r.doc_id: (r.n_words, r.n_removed) for r in sub.substring_dedup(rows).collect()}
    assert done == {1: (200_000, 200_000), 2: (200_001, 200_000), 3: (1, 0), 4: (0, 0)}


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tables, "HOT_KEYS", 5)
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [(f"k{i % 9}", i) for i in range(30)] + [(None, 99), ("none", 1)], "k string, v int")
    right = tables.cut(spark.createDataFrame([("hot", 50, "h")] + [(f"k{i}", 4, f"r{i}") for i in range(9)], "k string, n int, w string"), "right")
    got = sorted((str(r.k), r.v, r.w) for r in tables.spread_join(left, right, "k", "n", 80).collect())
    want = {"hot": "h"} | {f"k{i}": f"r{i}" for i in range(9)}
    assert got == sorted((str(r.k), r.v, want.get(r.k)) for r in left.collect())
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_filter_of_keys(spark):
    keys = list(range(-5000, 5000, 7))
    bits = tables.key_bits(spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long"))
    assert tables.has_key(bits, np.array(keys, np.int64).view(np.uint64)).all()
    assert not tables.has_key(bits, np.arange(10_000, 20_000).astype(np.uint64)).any()


def test_no_table_is_left(spark, tmp_path, monkeypatch):
    from gleanery import storage

    monkeypatch.setattr(storage, "work_dir", lambda _: f"file://{tmp_path}/work")
    nj.ngram_join(frame(spark, corpus(n=20))).collect()
    sub.substring_dedup(spark.createDataFrame(passages(), "doc_id long, text string")).collect()
    left = sorted(p.name.split("-")[0] for p in (tmp_path / "work").iterdir())
    assert left == ["joined", "ranges"]  # what the results are read from; they go with the application

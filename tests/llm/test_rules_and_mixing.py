import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm import mixing, quality_rules as q
from gleanery.llm import textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = ["", " \n\t", "one", "a b c d e f g h a b c d e f g h", "x " * 500, "é ß 字 " * 30, "l1\nl1\n\nl2\nl1", "a#b|c <x>", "nbsp joined \x1c sep", "w" * 100_000, "a b\n" * 3000]


def test_measures_match_brute_force():
    got = [q.measure(*d) for d in tk.hashed_docs(t.encode() for t in TEXTS)]
    assert got == [brute(t) for t in TEXTS]


def test_hashes_are_of_words_alone():
    (_, _, _, a), (_, _, _, b) = tk.hashed_docs([b"x yy  zzz", b"\nyy zzz x\t"])
    assert sorted(a.tolist()) == sorted(b.tolist()) and len(set(a.tolist())) == 3


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, host string")


def test_rows_without_anything(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good, "a", "clash", "c"), (1, good, "a", None, None), (2, None, None, None, None), (None, "", "a", None, None), (3, good, None, None, None)]
    got = q.quality_rules(docs(spark, rows)).select("doc_id", "n_words", "base_failed", "kept").collect()
    assert sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in got) == [("1", 30, False, True), ("1", 30, False, True), ("2", 0, True, False), ("3", 30, False, True), ("None", 0, True, False)]
    assert q.quality_rules(docs(spark, [])).count() == 0


def test_bad_host_is_rejected_and_small_one_is_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    rows = [(i, bad if i % 10 else good, "spam", None, None) for i in range(200)] + [(1000 + i, good if i % 10 else bad, f"h{i % 8}", None, None) for i in range(400)] + [(5000, bad, "tiny", None, None), (5001, good, "tiny", None, None)]
    got = {r.doc_id: r for r in q.quality_rules(docs(spark, rows)).collect()}
    assert not got[0].kept and not got[0].base_failed and not got[0].host_ok
    assert got[1001].kept and got[5001].kept and got[5001].host_rate < 0.5
    kept = q.quality_filter(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "n_words", "host"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_poisson_counts_have_the_asked_mean(spark):
    rows = [(i, "x" * 10, "big" if i % 4 else "small", None, None) for i in range(4000)]
    d = docs(spark, rows)
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("none", 5.0)], "s string, w double")
    got = mixing.mix_sources(d, weights, epochs=20.0)
    by = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = 20.0 * 4000 / 2  # a source without documents takes no share
    assert by["big"] == pytest.approx(share, rel=0.05) and by["small"] == pytest.approx(share, rel=0.05)
    assert got.groupBy("doc_id").agg((F.max("mix_copy") == F.count(F.lit(1))).alias("ok")).where("not ok").count() == 0


def test_mixing_edges(spark):
    rows = [(None, "abc", None, None, None), (1, None, "empty", None, None), (2, "abc", "a", None, None), (2, "abc", "a", None, None)]
    d = docs(spark, rows).withColumn("mix_copy", F.lit("clash")).withColumn("_rate", F.lit(7))
    got = mixing.mix_sources(d, epochs=10.0)
    assert got.where("source = 'empty'").count() == 0 and got.where("source is null").count() > 0
    assert got.columns.count("mix_copy") == 1 and got.where("_rate = 7").count() == got.count()
    counts = {r["n"] for r in got.where("doc_id = 2").groupBy("mix_copy").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts <= {2}
    assert mixing.mix_sources(d.limit(0)).count() == 0
    again = mixing.mix_sources(d.repartition(7), epochs=10.0)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_poisson_table(spark):
    import math

    got = spark.range(1).select(mixing.poisson_table(F.lit(3.5)).alias("c")).first().c
    want, total = [], 0.0
    for k in range(mixing.PIECE_TOP + 1):
        total += math.exp(-3.5) * 3.5**k / math.factorial(k)
        want.append(total)
    assert got == pytest.approx(want, abs=1e-12)

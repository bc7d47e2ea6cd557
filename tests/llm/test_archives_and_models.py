import hashlib
import random
import zlib

import numpy as np
import pytest
import zstandard

from gleanery.llm import chat, compression as cm, warc

PAGES = "page_id long, url string, html string, digest string"


def test_url_keys():
    assert warc.url_key("http://Blog.Example.com:80/a?b#c") == "com,example,blog)/a?b"
    assert warc.url_key(None) == ")/" and warc.url_key("https://x.org") == "org,x)/" and " " not in warc.url_key("http://x/a b\r\nc")


def test_record_round_trip():
    body = "päge".encode() * 400
    digest = hashlib.sha1(body).hexdigest()
    fields, payload = warc.parse_record(warc.record("http://x/\r\nInjected: 1", 7, body, digest, None, "2024-01-01T00:00:00Z"))
    assert payload == body and fields["WARC-Type"] == "response" and "Injected" not in fields and warc.digest_of(fields) == digest
    fields, payload = warc.parse_record(warc.record("http://x/", 7, body, digest, 9, "2024-01-01T00:00:00Z"))
    assert payload == b"" and fields["WARC-Refers-To"] == warc.record_id(9, digest)


def test_archive_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rng = random.Random(1)
    bodies = ["b" * 999, "c" * 1000, "é" * 700, "", None, "d" * 5000]
    rows = [(i, f"http://h{rng.randrange(5)}.com/{rng.randrange(6)}", rng.choice(bodies), "clash") for i in range(90)]
    rows += [(200, None, "c" * 1000, None), (None, "http://h1.com/1", "c" * 1000, None), (None, "http://z/", "only" * 400, None), (201, "http://h1.com/1", "twice" * 300, None), (201, "http://h1.com/1", "twice" * 300, None)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    archive = warc.Archive(df)
    got = archive.lookup(df).collect()
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "").encode() == data and p is not None]
        last = max(same, default=None)
        again = len(data) >= 1000 and last is not None and (page is None or page < last)
        want.append((str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", str(last) if again else "None"))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert all(bytes(r.payload) == b"" or hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.payload is not None)
    index = warc.CaptureIndex(archive.folder, archive.shards)
    assert index.captures("aaa") == [] and index.captures("zzz 1") == []
    firsts = [warc.Directory(index.fs, f"{index.root}/{name}.dir") for _, name in archive.shards]
    assert sum(d.n for d in firsts) > len(archive.shards)
    none = df.limit(0)
    assert warc.Archive(none).lookup(none).count() == 0


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, prompt string")


def test_preferences_by_hand(spark):
    start = [(1, 0, "system", "s", None), (1, 1, "user", "hi <|im_end|>", None)]
    c = start + [(1, 2, "assistant", "góod", None), (1, 3, "user", None, None), (2, 0, "user", "same", None), (3, 0, "user", "alone", None), (None, 0, "user", "x", None)]
    r = start[::-1] + [(1, 2, "assistant", "bad", None), (2, 0, "user", "same", None), (None, 0, "user", "x", None)]
    got = {x.pair_id: x for x in chat.format_preferences(turns(spark, c), turns(spark, r)).collect()}
    assert set(got) == {1, 2} and got[1].n_prompt_turns == 2
    assert got[1].prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi < |im_end|><|im_end|>\n"
    assert got[1].chosen == "<|im_start|>assistant\ngóod<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    a, b = map(int, got[1].chosen_mask.split(":"))
    assert got[1].chosen[a:b] == "góod<|im_end|>"
    a, b = map(int, got[1].rejected_mask.split(":"))
    assert got[1].rejected[a:b] == "bad<|im_end|>"
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", "")
    assert chat.format_preferences(turns(spark, []), turns(spark, r)).count() == 0


def test_scores_on_held_out_rows(spark):
    import zlib

    rng = random.Random(3)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        good = i % 3 > 0
        docs.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "x"))
        labels.append((i, int(good)))
    docs += [(None, None, "x"), (1000, "", "x"), (1, docs[1][1], "x")]
    labels += [(None, 1), (2, None), (5, 0), (5, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = cm.quality_scores(d, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in docs if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held if r.doc_id < 600) / len(held) > 0.95
    empty = next(r.score for r in got if r.doc_id == 1000)
    assert 0.2 < empty < 0.95 and len({r.score for r in got if r.doc_id == 1}) == 1
    flat = cm.quality_scores(d, lab.limit(0)).collect()
    assert {r.score for r in flat} == {0.5} and cm.quality_scores(d.limit(0), lab).count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark):
    import zlib

    rows = [(i, f"text number {i} " * 5) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = [(i, i % 2) for i, _ in rows]
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in lab]
    a, b = (sorted((r.doc_id, r.score) for r in cm.quality_scores(d, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (lab, other))
    assert [i for i, _ in a] == [i for i, _ in b] and [x for _, x in a] == pytest.approx([x for _, x in b])


def test_scores_against_plain_steps(spark):
    """Dictionaries, sizes block by block and the fitted curve, step by step in plain Python."""
    rng = random.Random(12)
    good, bad = (["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)] for _ in range(2))
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(0, 400))), i % 2) for i in range(240)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in cm.quality_scores(docs, labels).collect()}

    turn = {i: hashlib.md5(str(i).encode()).hexdigest() for i, _, _ in rows}
    out = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    half = lambda i: int(turn[i][0], 16) % 2
    taught = sorted((turn[i], y, t) for i, t, y in rows if i not in out and half(i) == 0)
    made = [zstandard.ZstdCompressionDict(cm.dictionary([t.encode() for _, v, t in taught if v == y])) for y in (1, 0)]

    def size(text, d):
        c = zstandard.ZstdCompressor(dict_data=d, level=cm.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(text[k : k + 1024])) for k in range(0, len(text), 1024))

    diff = {i: size(t.encode(), made[1]) - size(t.encode(), made[0]) for i, t, _ in rows}
    fit = [(i, len(t), y) for i, t, y in rows if i not in out and half(i) == 1]
    mean = sum(diff[i] for i, _, _ in fit) / sum(n for _, n, _ in fit)
    x = {i: (diff[i] + cm.PULL * mean) / (len(t) + cm.PULL) for i, t, _ in rows}
    a, b = cm.fit_logistic(np.array([x[i] for i, _, _ in fit]), np.array([float(y) for *_, y in fit]))
    for i, _, _ in rows:
        want = 1 / (1 + np.exp(-(a + b * x[i])))
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].held_out == (i in out) and got[i].predicted == int(want >= 0.7)
    # the curve is the best one: no step in either direction is likelier (the ridge is too small to matter)
    z = np.array([x[i] for i, _, _ in fit])
    y = np.array([float(v) for *_, v in fit])
    sd = z.std()
    loss = lambda a, b: np.logaddexp(0, -(2 * y - 1) * (a + b * z)).sum() + 0.5e-3 * ((b * sd) ** 2 + (a + b * z.mean()) ** 2)
    assert all(loss(a, b) <= loss(a + da, b + db / sd) + 1e-9 for da, db in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)))


def test_very_long_text_is_scored_whole(spark):
    docs = spark.createDataFrame([(1, "good words " * 200_000), (4, "bad stuff " * 300)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in cm.quality_scores(docs, labels).collect())

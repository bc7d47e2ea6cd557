import hashlib
import math
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanery.llm import pii, secret_scan as ss, spans as sp
from gleanery.llm import tagger as tg

KEY = "ghp_R8x2LqT9vZk41NpWc7Yd3Ms6Bf0"


def contract_secrets(t):
    found = [("assign", *m.span()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ss.BASE_KINDS.index(s[0])))


def contract_private(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], tg.KINDS.index(s[0])))


def noise(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_base_secrets_match_the_patterns():
    rng = random.Random(5)
    pieces = ["token", "TOKEN", "api_key", "password", " = ", ":", '"', "AKIA", "ABCD1234", "deadbeef0123", "é", " ", "\n", "x", "secret="]
    for _ in range(600):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        got = [s for s in ss.find_secrets(t) if s[0] in ss.BASE_KINDS]
        assert sorted(got, key=lambda s: (s[1], ss.BASE_KINDS.index(s[0]))) == contract_secrets(t), t
    assert contract_secrets("toKen = abcdefgh") == [] == ss.find_secrets("toKen = abcdefgh")


def test_base_private_data_matches_the_patterns():
    rng = random.Random(6)
    pieces = ["a@b.co", "@", ".", "1", "255", "256.", "10.0.0.1", "+1 (555) 123-4567", "4111 1111 1111 1111", "-", " ", "x", "é", "\n", "+", "0" * 30, "a.b-c"]
    for _ in range(1500):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert sorted(pii.base_spans(t), key=lambda s: (s[1], tg.KINDS.index(s[0]))) == contract_private(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000):
        pii.base_spans(t)
        ss.find_secrets(t)


def test_entropy_windows_by_hand():
    cls = ss.CLASSES[2]
    run = KEY + "aaaaaaaaaaaaaaaaaaaaaaaaaa"

    def entropy(w):
        return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))

    hot = [i for i in range(len(run) - cls.window + 1) if entropy(run[i : i + cls.window]) >= cls.bits - 1e-12 and all(set(n) & set(run[i : i + cls.window]) for n in cls.needs)]
    covered = {j for i in hot for j in range(i, i + cls.window)}
    assert {j for a, b in ss.hot_windows(run, cls) for j in range(a, b)} == covered


def test_entropy_adds_and_allow_list_suppresses():
    kinds = lambda t: [k for k, _, _ in ss.find_secrets(t)]
    assert kinds(f"use {KEY} now") and all(k.startswith("entropy") for k in kinds(f"use {KEY} now"))
    assert kinds("id 123e4567-e89b-12d3-a456-426614174000") == [] and kinds("see https://x.org/R8x2LqT9vZk41NpWc7Yd3Ms6Bf0") == []
    assert kinds("losasmentementementemente internationalization") == []


@pytest.mark.parametrize("around", ["{} https://x.org", "{},https://x.org", "https://x.org {}", "EXAMPLE {}", "{} EXAMPLE", "{} commit 1", "{}\nsha256: x", "0123456789 {}"])
def test_words_beside_a_key_do_not_allow_it(around):
    at = around.index("{}")
    assert [t for t in ss.find_secrets(around.format(KEY)) if t[0].startswith("entropy") and at <= t[1] and t[2] <= at + len(KEY)]
    assert not ss.find_secrets(f"commit {KEY}") and not ss.find_secrets(f"sha256:{KEY}") and not ss.find_secrets(f"{KEY}EXAMPLE")


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_tagger_on_fresh_windows(model):
    import numpy as np

    maker = pii._Maker(99)
    x, y = map(np.array, zip(*(maker.window() for _ in range(400)), strict=True))
    t = tg.viterbi(tg.emissions(model, x.T), model.transitions())
    assert (t == y.T).mean() > 0.97 and (t == y.T)[y.T > 0].mean() > 0.93


def test_gradients_by_differences():
    import numpy as np

    maker = pii._Maker(3)
    x, y = map(np.array, zip(*(maker.window() for _ in range(2)), strict=True))
    m = tg.Model.fresh(1)
    for name in ("table", "inner", "bias", "out", "out_bias", "trans"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    _, grads = tg.gradients(m, x.T, y.T)
    for p, g, at in zip(m.params(), grads, [(0, int(x[0, 5]), 3), (1, 2, 7), (0, 4), (3, 1), (2,), (0, 3)], strict=True):
        old = p[at]
        p[at] = old + 1e-4
        up = tg.gradients(m, x.T, y.T)[0]
        p[at] = old - 1e-4
        down = tg.gradients(m, x.T, y.T)[0]
        p[at] = old
        assert (up - down) / 2e-4 == pytest.approx(float(g[at]), rel=2e-2, abs=1e-4)


def test_tagger_adds_what_patterns_miss_and_leaves_plain_text(model):
    texts = ["call (555) 123-4567 now", "from 2001:db8:85a3:0:0:8a2e:370:7334 ok", "card 4111.1111.1111.1111 paid", "on 2024-01-05 12:30:11 version 1.2.3", "", "no digits at all " * 50]
    got = pii.find_private(texts, model)
    assert [[(k, t[a:b]) for k, a, b in s] for t, s in zip(texts, got, strict=True)] == [[("tagged_phone", "(555) 123-4567")], [("tagged_ip", "2001:db8:85a3:0:0:8a2e:370:7334")], [("tagged_card", "4111.1111.1111.1111")], [], [], []]


def test_skipped_windows_would_add_nothing(model, monkeypatch):
    import numpy as np

    rng = random.Random(2)
    maker = pii._Maker(7)
    texts = [" ".join(maker.private()[1] if rng.random() < 0.05 else maker.word() for _ in range(80)) for _ in range(20)]
    few = pii.find_private(texts, model)
    monkeypatch.setattr(pii, "text_windows", lambda p: [int(i) for i in np.arange(0, max(1, len(p) - tg.WIDTH + pii.STRIDE), pii.STRIDE)])
    assert pii.find_private(texts, model) == few


@pytest.mark.parametrize("kind, private", [("ip", "2001:0db8:85a3:1234:5678:8a2e:0370:7334"), ("email", "ediner.schungen.anderes @ reanderesin.ungheinand.example.com")])
def test_spans_longer_than_the_overlap_of_windows(model, kind, private):
    around = "there he and then another on the order of heed in the end " * 4
    assert len(private) in (39, 60)
    texts = [around[i:] + private + " " + around for i in range(pii.STRIDE)]
    got = pii.find_private(texts, model)
    assert [[(k, t[a:b]) for k, a, b in s] for t, s in zip(texts, got, strict=True)] == [[(f"tagged_{kind}", private)]] * pii.STRIDE


def test_long_runs_are_decoded_in_linear_time(model):
    assert pii.find_private(["7" * 60_000 + " " + "ab:" * 5_000], model) == [[]]


def test_reconciled_takes_the_best_set():
    spans = [("phone", 0, 10, 0.9), ("card", 5, 20, 0.95), ("phone", 18, 30, 0.9), ("ip", 40, 50, 0.99), ("ip", 40, 50, 0.95)]
    got = pii.reconciled(spans)
    best = max((c for n in range(5) for c in __import__("itertools").combinations(spans[:4], n) if all(a[2] <= b[1] or b[2] <= a[1] for i, a in enumerate(c) for b in c[i + 1 :])), key=lambda c: sum(s[3] * (s[2] - s[1]) for s in c))
    assert got == [s[:3] for s in best]


def test_rows_and_digest(spark):
    rows = [(1, "token = abcdef1", "x"), (1, "token = abcdef1", "x"), (None, None, "x"), (2, "", None), (3, "ü a@b.co 10.0.0.1", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = ss.scan_secrets(d).select("doc_id", sp.written(F.col("spans")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in got) == [("1", "assign:0:15"), ("1", "assign:0:15"), ("2", ""), ("3", ""), ("None", "")]
    private = pii.scan_private(d)
    assert {(r.doc_id, r.redacted) for r in private.where("doc_id = 3 or doc_id is null").collect()} == {(3, "ü [EMAIL] [IP]"), (None, None)}
    assert hashlib.sha256(b"").hexdigest() == private.where("doc_id = 2").select(F.sha2(sp.written(F.col("spans")), 256)).first()[0]
    assert ss.scan_secrets(d.limit(0)).count() == 0 == pii.scan_private(d.limit(0)).count()
    clean = pii.redacted(d.withColumn("n_chars", F.lit(0)))
    assert clean.columns == ["doc_id", "text", "spans", "n_chars"] and clean.where("doc_id = 3").first().n_chars == len("ü [EMAIL] [IP]")


def test_replacing_overlaps():
    assert sp.replaced("abcdef", [("x", 1, 3), ("y", 2, 5)]) == "a[X]f"


def plain_texts():
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE length(text) BETWEEN 300 AND 3000").fetchall()
    return [t for (t,) in rows if not pii.base_spans(t) and not ss.find_secrets(t)]


def recalled(find, forms, kind_of, seed=4, each=20):
    """Of strings put in plain texts at random words, those of which four fifths are found; and what is found elsewhere."""
    rng, texts = random.Random(seed), plain_texts()
    hits = many = elsewhere = 0
    for kind, form in forms:
        for _ in range(each):
            private, w = form(rng), rng.choice(texts).split(" ")
            at = rng.randrange(1, len(w))
            a = len(" ".join(w[:at])) + 1
            b = a + len(private)
            found = find(" ".join([*w[:at], private, *w[at:]]))
            many += 1
            hits += any(kind_of(k, kind) and 5 * (min(y, b) - max(x, a)) >= 4 * (b - a) for k, x, y in found)
            elsewhere += sum(y <= a or b <= x for _, x, y in found)
    return hits / many, elsewhere


def digits(rng, *groups):
    return [noise(rng, "0123456789", n) for n in groups]


def card(rng, sep):
    body = rng.choice("456") + noise(rng, "0123456789", 14)
    whole = next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))
    return sep.join(whole[i : i + 4] for i in range(0, 16, 4))


HEX = "0123456789abcdef"
PRIVATE = [
    ("email", lambda r: r.choice(("anna.schmidt", "joe", "claire_dupont", "k.brown77")) + " @ " + r.choice(("posteo.de", "mail.example.com", "orange.fr"))),
    ("ip", lambda r: ":".join(noise(r, HEX, 4) for _ in range(8))),
    ("ip", lambda r: "2001:db8::" + noise(r, HEX, 4) + ":" + noise(r, HEX, 3)),
    ("ip", lambda r: " . ".join(str(r.randint(1, 255)) for _ in range(4))),
    ("card", lambda r: card(r, ".")),
    ("card", lambda r: card(r, "  ")),
    ("phone", lambda r: "0" + " ".join(digits(r, 2, 3, 4))),
    ("phone", lambda r: "({}) {} {} {}".format(*digits(r, 4, 2, 2, 2))),
    ("phone", lambda r: "-".join(digits(r, 3, 3, 4))),
    ("phone", lambda r: "0033 " + " ".join(digits(r, 1, 2, 2, 2, 2))),
    ("phone", lambda r: ".".join(digits(r, 3, 3, 4))),
]


def test_tagger_finds_what_patterns_miss_in_plain_texts(model):
    recall, elsewhere = recalled(lambda t: pii.find_private([t], model)[0], PRIVATE, lambda got, want: got.removeprefix("tagged_") == want)
    assert recall >= 0.9 and elsewhere == 0
    assert not any(pii.find_private(plain_texts(), model))


def test_entropy_finds_what_patterns_miss_in_plain_texts():
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = [("entropy", lambda r, a=a: noise(r, a, r.randint(28, 48))) for a in (letters, letters + "+/", letters + "_-", "0123456789ABCDEF")]
    recall, elsewhere = recalled(ss.find_secrets, forms, lambda got, want: got.startswith(want), each=60)
    assert recall >= 0.9 and elsewhere == 0


def test_what_no_span_is():
    assert not pii.acceptable("ip", "dead:beef:cafe:face") and not pii.acceptable("ip", ":::") and not pii.acceptable("phone", "2024-01-05 1200")
    assert pii.acceptable("ip", "2001:db8::1:2") and pii.acceptable("phone", "0221 47 11 08 15")


def test_many_spans_take_linear_time():
    took = []
    for n in (2000, 16_000):
        text = f"x {KEY} " * n
        began = time.perf_counter()
        assert len(ss.find_secrets(text)) == 2 * n  # one class within the other
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]


def test_the_model_is_kept(spark, tmp_path, monkeypatch, model):
    monkeypatch.setattr(pii, "work_dir", lambda _: f"file://{tmp_path}")
    first = pii.shared_model(spark).value
    monkeypatch.setattr(pii, "trained", lambda: pytest.fail("trained again"))
    again = pii.shared_model(spark).value
    assert all((a == b).all() for a, b in zip(first.params(), again.params(), strict=True))

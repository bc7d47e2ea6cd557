import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions import chunking, metadata, naming, text


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("word", "parts"),
    [("XMLParser", ["XML", "Parser"]), ("SSL", ["SSL"]), ("", []), ("ПолучитьДату", ["Получить", "Дату"]), ("item2Name", ["item2", "Name"])],
)
def test_case_boundaries(spark, word, parts):
    assert one(spark, text.pascal_parts(F.col("w")), w=word) == parts


def test_expansion_adds_a_line_of_parts(spark):
    assert one(spark, text.expanded(F.col("t")), t="use XMLParser now") == "use XMLParser now\nXML Parser"
    assert one(spark, text.expanded(F.col("t")), t="plain") == "plain"


def test_query_tokens(spark):
    tokens = lambda q: one(spark, text.query_tokens(F.col("q")), q=q)
    assert tokens("the Quick quick fox") == ["quick", "fox"]
    assert tokens("the and of") == ["the", "and", "of"]
    assert tokens("the") == ["the"]
    assert tokens("ПолучитьДату") == ["получитьдату", "получить", "дату"]
    assert tokens("...") == []


def test_index_terms_fold_latin_accents_only(spark):
    assert one(spark, text.index_terms(F.col("t")), t="Café Über ёж ß, a_b") == ["cafe", "uber", "ёж", "ß", "a", "b"]
    assert one(spark, text.index_terms(F.col("t")), t=None) == []


def test_snippet_window(spark):
    body = "a" * 100 + " needle " + "b" * 200
    s = one(spark, text.snippet(F.col("b"), F.lit("T"), F.lit("needle")), b=body)
    assert s.startswith("…") and s.endswith("…") and "needle" in s and len(s) == 120 + 6 + 2
    assert one(spark, text.snippet(F.col("b"), F.lit("T"), F.lit("zzz")), b="short body") == "short body"
    assert one(spark, text.snippet(F.col("b"), F.lit("My needle"), F.lit("needle")), b="") == "My needle"


def test_metadata(spark):
    assert one(spark, metadata.section(F.col("f")), f="query__x") == "query"
    assert one(spark, metadata.section(F.col("f")), f="x") == "objects"
    assert one(spark, metadata.kind(F.col("f")), f="_index.md") == "index"
    assert one(spark, metadata.kind(F.col("f")), f="A.B.md") == "member"
    assert one(spark, metadata.kind(F.col("f")), f="A.md") == "page"
    assert one(spark, metadata.title(F.col("t"), F.lit("n.md")), t="x\n#  Head \ny") == "Head"
    assert one(spark, metadata.title(F.col("t"), F.lit("n.md")), t="none\n#x") == "n"


@pytest.mark.parametrize(
    ("target", "page"),
    [
        ("Page.md#part", "Page"),
        ("Page.html", "Page"),
        ("https://example.org/x", None),
        ("obsidian://x", None),
        ("#only", None),
        ("bookhelp://SyntaxHelperLanguage/def.html#a", "lang__def"),
        ("bookhelp://SyntaxHelperContext/Array", "Array"),
        ("bookhelp://Unknown/x", None),
        ("bookhelp://SyntaxHelperLanguage/", None),
    ],
)
def test_link_targets(spark, target, page):
    assert one(spark, metadata.normal_target(F.col("t")), t=target) == page


def test_links_keep_repeats(spark):
    assert one(spark, metadata.link_targets(F.col("b")), b="[a](x.md) ![i](y.png) [b](x.md)") == ["x.md", "y.png", "x.md"]


def test_descriptions():
    page = "# T\n\nОписание:\n\nПервая [ссылка](x.md) и **жирный**.\nВторая.\n\nСинтаксис:\nнет\n\n**Описание варианта:** Хвост.\nещё\n---\nнет"
    assert metadata.describe(page) == "Первая ссылка и жирный. Вторая. Хвост. ещё"
    assert metadata.describe("без секций") == ""


@pytest.mark.parametrize(
    ("line", "ends"),
    [("---", True), ("Синтаксис:", True), ("Вариант синтаксиса: x", True), ("**Имя**", True), ("**Имя:** текст", True), ("**:**", True), ("****", False), ("слово", False), ("1 пункт:", False), ("- пункт:", False), ("а:б", False), ("слово б: в:", False), ("x " + "y" * 70 + ":", False), (":", False)],
)
def test_section_ends(line, ends):
    assert metadata.ends_section(line) is ends


def test_description_heads():
    assert metadata.head_tail("  **Описание варианта метода:** Текст") == "Текст"
    assert metadata.head_tail("ОПИСАНИЕ :") == "" and metadata.head_tail("Описание формы:") is None and metadata.head_tail("Описание") is None


def test_scheme_is_a_parameter(spark):
    assert one(spark, metadata.normal_target(F.col("t"), "other"), t="other://SyntaxHelperQueries/a.html") == "query__a"


def test_chunks_by_hand():
    assert chunking.chunk_text("short") == ["short"]
    assert [len(c) for c in chunking.chunk_text("x" * 4000)] == [1400, 1500, 1500]
    assert [len(c) for c in chunking.chunk_text("a" * 1400 + "\n" + "b" * 1400)] == [1400, 2801]
    assert [len(c) for c in chunking.chunk_text("a" * 1500)] == [1500]
    assert chunking.chunk_text("\n".join(["x" * 600] * 3), 1500, 0) == ["\n".join(["x" * 600] * 2), "x" * 600]


def test_no_line_is_lost():
    rng = random.Random(42)
    for _ in range(30):
        lines = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 300))) for _ in range(rng.randint(1, 60))]
        chunks = chunking.chunk_text("\n".join(lines), 500, 80)
        assert all(any(line in c.split("\n") or line in c for c in chunks) for line in lines)


def test_chunks_in_spark(spark):
    rows = spark.createDataFrame([(1, "x" * 4000), (2, None), (3, "")], "page_id long, body string")
    got = sorted((r.page_id, r.chunk_index, len(r.body), r.total_chunks) for r in chunking.chunks(rows).collect())
    assert got == [(1, 0, 1400, 3), (1, 1, 1500, 3), (1, 2, 1500, 3), (2, 0, 0, 1), (3, 0, 0, 1)]


def test_names(spark):
    assert one(spark, naming.path_name(F.col("p"), "lang__"), p="./a\\b c.HTML") == "lang__a__b_c.md"
    assert one(spark, naming.path_name(F.col("p")), p="a/b") == "a__b.md"
    assert one(spark, naming.path_name(F.col("p")), p="a/b.png") == "a__b.png"
    assert one(spark, naming.title_name(F.col("t")), t='What? a/b. ') == "What_ab.md"
    assert one(spark, naming.title_name(F.col("t")), t="??") == ""
    long = one(spark, naming.shortened(F.col("n"), F.lit("a/b")), n="x" * 300 + ".md")
    assert len(long) == 200 and "__TRUNC_" in long


def test_names_are_told_apart(spark):
    rows = [("b", str(i), n) for i, n in enumerate(["a.md", "a.md", "a-2.md", "a.md", "b.md"])]
    got = naming.disambiguated(spark.createDataFrame(rows, "source string, path string, name string"))
    assert [r.filename for r in got.orderBy("path").collect()] == ["a.md", "a-3.md", "a-2.md", "a-4.md", "b.md"]


def test_titled_parents_and_links(spark):
    pages = spark.createDataFrame([("a.html", "A"), ("a/b.html", ""), ("a/b/c/d.html", "D"), ("a/x.html", "X")], "path string, title string")
    got = {r.path: r.parent_title for r in naming.titled_parents(pages).collect()}
    assert got == {"a.html": "", "a/b.html": "", "a/b/c/d.html": "A", "a/x.html": ""}
    links = spark.createDataFrame([("A/B.html",), ("c",), ("none",), ("",)], "path string")
    known = spark.createDataFrame([("a/b", "B.md"), ("c.htm", "C.md"), ("c.html", "C1.md")], "key string, target string")
    assert {r.path: r.target for r in naming.resolved_links(links, known).collect()} == {"A/B.html": "B.md", "c": "C1.md", "none": None, "": None}

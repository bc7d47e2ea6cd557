import math

import pytest
from pyspark.sql import functions as F

from gleanery.operators import fts, hybrid, incremental, retrieval, vector
from gleanery.operators import index as ix

DOCS = [
    ("Array", "# Array\n\nОписание:\nordered values\n\nСинтаксис:\nsee [Map](Map.md) and [Map](Map.md) and [Gone](Gone.md) and [Array](Array.md)"),
    ("Map", "# Map\n\nkeys and values, unlike an array"),
    ("query__Select", "# Select statement\n\nselects rows quickly from a table"),
    ("lang__long", "# Long page\n\n" + "\n".join(f"line {i} about garbage collection and memory" for i in range(120))),
]


@pytest.fixture(scope="module")
def index(spark):
    return ix.build(spark.createDataFrame(DOCS, "filename string, text string"))


def ask(spark, index, *queries, **args):
    df = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    rows = fts.search(index, df, **args).orderBy("query_id", "rank").collect()
    return [[r for r in rows if r.query_id == i] for i in range(len(queries))]


def test_tables(index):
    assert [r.filename for r in index.pages.orderBy("id").collect()] == ["Array", "Map", "lang__long", "query__Select"]
    chunks = index.chunks.orderBy("chunk_id").collect()
    assert [c.chunk_id for c in chunks] == list(range(1, len(chunks) + 1))
    long = [c for c in chunks if c.filename == "lang__long"]
    assert len(long) > 2 and long[0].prev_id is None and long[1].prev_id == long[0].chunk_id and long[-1].next_id is None
    assert sorted((r.src, r.dst) for r in index.links.collect()) == [("Array", "Map"), ("Array", "Map")]
    assert index.stats()["pages"] == 4


def test_ranks_title_before_description_before_body(spark, index):
    (got,) = ask(spark, index, "array")
    assert [r.id for r in got] == ["Array", "Map"] and got[0].stage == 2 and got[1].stage == 5


def test_back_off_or_and_prefix(spark, index):
    two, prefix, nothing, sub = ask(spark, index, "values nowhere", "quic", "zzz", "arbag")
    assert {r.id for r in two} == {"Array", "Map"} and two[0].stage == 6
    assert [r.id for r in prefix] == ["query__Select"] and prefix[0].stage == 8
    assert nothing == []
    assert {r.id for r in sub} == {"lang__long"} and sub[0].stage == 10 and "arbag" in sub[0].snippet


def test_page_cap_filters_and_limit(spark, index):
    (got,) = ask(spark, index, "garbage collection", per_page=2, limit=50)
    assert len(got) == 2 and len({r.chunk_id for r in got}) == 2
    (all_,) = ask(spark, index, "garbage collection", per_page=0, limit=100)
    assert len(all_) == index.chunks.where("filename = 'lang__long'").count()
    (none,) = ask(spark, index, "garbage", section="query")
    assert none == []
    (cut,) = ask(spark, index, "garbage collection", limit=2, per_page=0)
    assert len(cut) <= 2


def test_bm25_formula(spark, index):
    (got,) = ask(spark, index, "rows")
    n, mean = index.corpus()
    size = index.sizes.where(F.col("chunk_id") == got[0].chunk_id).first().n_terms
    want = -math.log((n - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * size / mean))
    assert got[0].score == pytest.approx(want, abs=1e-12)


def test_near_needs_closeness(spark):
    far = "alpha " + "x " * 30 + "beta"
    idx = ix.build(spark.createDataFrame([("close", "alpha y beta"), ("far", far)], "filename string, text string"))
    (got,) = ask(spark, idx, "alpha beta")
    assert [(r.id, r.stage) for r in got] == [("close", 4), ("far", 5)]


def test_vectors_and_fusion(spark, index):
    unit = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    index.vectors = spark.createDataFrame([(i + 1, v) for i, v in enumerate(unit)], "chunk_id long, vec array<double>")
    q = spark.createDataFrame([(0, "array", [0.0, 1.0, 0.0, 0.0])], "query_id long, query string, vec array<double>")
    got = vector.search(index, q, limit=3).orderBy("rank").collect()
    assert got[0].chunk_id == 2 and got[0].score == pytest.approx(1.0)
    only = vector.search(index, q, limit=3, section="lang").collect()
    assert {r.section for r in only} == {"lang"}
    both = hybrid.search(index, q, limit=5).orderBy("rank").collect()
    assert {r.chunk_id for r in both[:2]} == {1, 2}
    index.vectors = None


def test_fusion_order(spark):
    rows = [(0, 0, 1, "x"), (0, 0, 2, "y"), (0, 0, 3, "z"), (0, 1, 1, "z"), (0, 1, 2, "x")]
    got = hybrid.fuse(spark.createDataFrame(rows, "query_id long, list_no int, rank int, key string"), ("key",)).orderBy("fused_rank").collect()
    assert [r.key for r in got] == ["x", "z", "y"]
    assert got[0].fused == pytest.approx(1 / 61 + 1 / 62)


def test_retrieval(spark, index):
    page = retrieval.get_page(index, "lang__long")
    assert page["truncated"] and page["total_chunks"] == len(page["chunks"]) and len(page["body"]) < page["chars"]
    assert retrieval.get_page(index, "lang__long", 1)["chunk_index"] == 1
    assert retrieval.get_page(index, "1")["filename"] == "Array"
    for bad in (("nowhere", None), ("Array", 7)):
        with pytest.raises(LookupError):
            retrieval.get_page(index, *bad)
    many = retrieval.get_pages(index, ["Array", "gone", "Map", "lang__long"], 400)
    assert many["returned"] == 2 and many["missing"] == ["gone"] and many["truncated"] and many["total_chars"] > 400
    assert retrieval.related(index, "Map") == {"id": "Map", "title": "Map", "outgoing": [], "incoming": ["Array", "Array"]}
    assert retrieval.hierarchy(index)["sections"] == [{"section": "lang", "count": 1}, {"section": "objects", "count": 2}, {"section": "query", "count": 1}]
    assert retrieval.hierarchy(index, "objects")["groups"] == [{"name": "Array", "count": 1}, {"name": "Map", "count": 1}]


def test_append_finds_old_links_and_is_idempotent(spark, index):
    more = spark.createDataFrame([("Gone", "# Gone\n\nback to [Map](Map.md)"), ("Map", "ignored")], "filename string, text string")
    grown = incremental.append(index, more)
    assert grown.pages.count() == 5 and grown.pages.agg(F.max("id")).first()[0] == 5
    assert {("Gone", "Map"), ("Array", "Gone")} <= {(r.src, r.dst) for r in grown.links.collect()}
    assert incremental.append(grown, more) is grown
    (got,) = ask(spark, grown, "back")
    assert got[0].id == "Gone"


def test_embedding_resumes(spark, index, tmp_path):
    calls = str(tmp_path / "calls")

    def make():
        def embed(texts):
            with open(calls, "a") as f:
                f.write("x" * len(texts))
            return [[3.0, 4.0] for _ in texts]

        return embed

    at = f"file://{tmp_path}/vectors"
    n = index.chunks.count()
    assert incremental.embed_pending(index, at, make, super_batch=3) >= 2
    assert len(open(calls).read()) == n
    v = spark.read.parquet(at)
    assert v.count() == n and [round(x, 5) for x in v.first().vec] == [0.6, 0.8]
    assert incremental.embed_pending(index, at, make) == 0 and len(open(calls).read()) == n

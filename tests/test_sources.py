import io
import json
import struct
import threading
import time
import urllib.request
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanery import serve, storage
from gleanery.config import Config
from gleanery.operators.index import Index
from gleanery.plans import queries
from gleanery.service import Engine
from gleanery.sources import container, discovery, embedding, html, markdown, transcripts
from gleanery.streaming import ingest


def block(data: bytes, after: int = container.END, total: int | None = None) -> bytes:
    return f"\r\n{len(data) if total is None else total:08x} {len(data):08x} {after:08x} \r\n".encode() + data


def small_container() -> bytes:
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/b.html", "<html><h1>T</h1></html>")
    name = struct.pack("QQi", 0, 0, 0) + "FileStorage\0".encode("utf-16-le")
    description = block(name)
    payload = z.getvalue()
    half = len(payload) // 2
    at = container.HEADER + container.BLOCK_HEAD + 16
    toc = struct.pack("2i", at, at + len(description)) + struct.pack("i", container.END) + b"\0\0\0\0"
    first_at = at + len(description)
    second_at = first_at + container.BLOCK_HEAD + half
    return b"\0" * container.HEADER + block(toc) + description + block(payload[:half], second_at, len(payload)) + block(payload[half:])


def test_container(spark, tmp_path):
    data = small_container()
    assert container.container_format(data) == 15 and container.container_format(b"\xff" * 16) == 16
    assert dict(container.pages_of(data)) == {"a/b.html": b"<html><h1>T</h1></html>"}
    with pytest.raises(KeyError):
        container.entry(data, "other")
    with pytest.raises(NotImplementedError):
        container.entries(b"\xff" * 16)
    (tmp_path / "good.bin").write_bytes(data)
    (tmp_path / "new.bin").write_bytes(b"\xff" * 64)
    rows = container.read_containers(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.error is None) for r in rows if r.path) == [("a/b.html", True)]
    assert [r.error.split(":")[0] for r in rows if r.path is None] == ["NotImplementedError"]


def test_toc_skips_free_blocks():
    mark = struct.pack("i", container.END)
    assert container.toc(struct.pack("2i", 1, 2) + mark + b"abcd" + mark + struct.pack("2i", 3, 4) + mark + b"tail") == [(1, 2), (3, 4)]


def test_markdown_rendering():
    page = """<html><head><title>x</title><style>p{}</style></head><body><h1 class="V8SH_pagetitle">Имя (Name)</h1>
    <p class="V8SH_title">Имя (Name)</p><h2>Part</h2><p>See <a href="b.html#x">B&lt;T&gt;</a>, <a href="c.html">C</a> and <a href="http://e.org">E</a>.<br>New</p>
    <ul><li>one<li>two</ul><table><tr><th>h</th></tr><tr><td>a|b</td></tr></table><script>no()</script><pre>x  y</pre></body></html>"""
    got = html.markdown(page, "a/p.html", {"a/b.html": "B.md"})
    assert got.startswith("# Имя\n\n## Part\n\nSee [B\\<T\\>](B.md#x), C and [E](http://e.org).")
    assert "- one\n- two" in got and "| h |\n| --- |\n| a\\|b |" in got and "no()" not in got and "```\nx  y\n```" in got
    assert html.decode("Привет".encode("cp1251")) == "Привет"
    assert html.two_names("Имя (Name) ") == ("Имя", "Name") and html.two_names("a (b) c") == ("a (b) c", "") and html.two_names("f(x) (g)") == ("f(x)", "g")
    assert html.primitive("lang__def_Null.md") and html.primitive("x/lang__Дата.md") and not html.primitive("lang__other.md")
    assert html.mended('<a HREF = http://e.org/x?id = "12">t</a><a href="y?z=1">') == '<a data-broken-href="12">t</a><a href="y?z=1">'
    assert html.mended('<a href=http://e.org/x>t</a> "q"') == '<a href=http://e.org/x>t</a> "q"'
    assert html.tidy("a\n[ Методическая информация\nsee 1centerprise.com/devlinks\nb") == "a\nb\n"
    assert html.link_path("other:SyntaxHelperContext/a\\b.html#x", "p", "other") == ("find", "a/b.html", "x")


def test_page_files(spark):
    rows = [("a.html", b"x"), ("a.css", b"<html>"), ("noext", b"\xef\xbb\xbf<!DOCTYPE html>"), ("noext2", b"text"), ("b.HTM", b"")]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert [r.path for r in df.where(html.is_page(F.col("path"), F.col("content"))).collect()] == ["a.html", "noext", "b.HTM"]


def test_discovery(tmp_path):
    for v, sub in (("8.3.9.1", "bin"), ("8.3.25.10", ""), ("8.5", "bin")):
        (tmp_path / v / sub).mkdir(parents=True)
        (tmp_path / v / sub / ("x.hbk" if v != "8.5" else "x.txt")).touch()
    assert [x["version"] for x in discovery.installations([tmp_path])] == ["8.3.25.10", "8.3.9.1"]
    assert discovery.newest([tmp_path]).endswith("8.3.25.10") and discovery.newest([tmp_path / "none"]) is None
    assert discovery.version("v8.5.1.1423") == (8, 5, 1, 1423) and discovery.version("") is None
    assert discovery.dotted_version("1C 8.2 (8.2.19.130)") == (8, 2, 19, 130) and discovery.dotted_version("1C") is None


def test_conversion_resolves_forward_links(spark):
    page = lambda t, to: f'<html><body><h1 class="V8SH_pagetitle">{t}</h1><a href="{to}">go</a></body></html>'
    rows = [("b", "", "a/x.html", page("Same", "y.html")), ("b", "", "a/y.html", page("Same", "x.html")), ("b", "", "z.html", page("Z &amp; Co", "nowhere.html"))]
    got = {r.path: r for r in html.convert(spark.createDataFrame(rows, "book string, prefix string, path string, page string")).collect()}
    assert got["z.html"].filename == "Z_&_Co.md" and got["z.html"].markdown == "# Z & Co\n\ngo\n"
    assert {got["a/x.html"].filename, got["a/y.html"].filename} == {"a__x.md", "a__y.md"}
    assert "[go](a__y.md)" in got["a/x.html"].markdown


def test_titles_as_in_sql(spark, tmp_path):
    titles = ["a &amp;&amp", "a &copy; &#39; &ampx", "&amp;lt;&lt &NBSP;", " \n&nbsp;b&gt;\t", "a < b", "a<b>c</b><d", "<<<", "<>x", "$1\\", ""]
    pages = [f"<p><h1>{t}</h1>" for t in titles]
    pages += ["<H1 ID=x>Upper</H1><h1>second</h1>", '<h1 class="other">class</h1>', "<h1>open", "<h1", "<h1 x" * 9, "", None, "<h1>" * 3 + "x</h1>", "<h10>ten</h1>"]
    pages += ["x" * 5000 + "<h1>late</h1>", f"<h1>{'long ' * 2000}</h1>"]
    at = str(tmp_path / "pages.parquet")
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(at)
    expected = duckdb.connect().sql(queries.ORACLE["html_titles"].replace("FROM pages", f"FROM read_parquet('{at}/*.parquet')")).fetchall()
    got = {tuple(r) for r in queries.html_titles(spark, str(tmp_path)).collect()}
    assert len(expected) == len(pages) and got == set(expected)
    head = lambda p: html.unescaped(html.quick_title(F.lit(p)))
    mark = f'<h1 class="{html.PAGE_TITLE}">'
    shown = spark.range(1).select(head(f"<h1>no</h1>{mark}a &amp</h1>").alias("a"), head("<h1>no</h1>").alias("b"), head("x" * 4096 + f"{mark}c</h1>").alias("c")).first()
    assert tuple(shown) == ("a &", "", "")


def test_transcripts():
    assert transcripts.commands("Команды:\n\nbuild\nclean-up-source\n\nЧтобы...\n") == ["build", "clean-up-source"]
    assert transcripts.usages('Варианты вызова:\n1. export --project "s"\n2. export\n') == ['export --project "s"', "export"]
    assert transcripts.usages('Текст.\n\nИспользование:\n\n  cf2lib "a" "b"\n\nЕщё текст.\n') == ['cf2lib "a" "b"']
    assert transcripts.summary('Варианты вызова:\n1. export\n\nВариант 1:\nexport --p\n    Экспортирует проект.\n', "export") == "Экспортирует проект."
    assert transcripts.status_codes("Общие коды состояний:\n\n0\n    Норма.\n\n200\n    Ошибка.\n") == [("0", "Норма."), ("200", "Ошибка.")]
    assert transcripts.modes("Поддерживаемые режимы:\n  help    - помощь\n  infobase  - базы\n\nДалее") == [("infobase", "базы")]
    assert transcripts.modes("Поддерживаемые режимы:\nhelp    помощь\ninfobase  базы данных\n\nДалее нет") == [("infobase", "базы данных")]
    assert transcripts.usages("Текст\n8.3.25 сборка\nИспользование:\n  cmd a") == ["cmd a"]
    assert transcripts.decode("ok".encode("utf-16-le")) == "ok" and transcripts.decode("привет".encode("utf-16")) == "привет"
    utility = transcripts.ToolHelp("rac", overview="Поддерживаемые режимы:\ncluster  кластер\n", topics={"cluster": "help of it"})
    made = transcripts.render_utilities([utility], "u__")
    assert sorted(made) == ["u__index", "u__rac", "u__rac-cluster"] and "(u__rac-cluster) — кластер" in made["u__rac"] and "help of it" in made["u__rac-cluster"]
    pages = transcripts.render(transcripts.ToolHelp("tool", "1", "modes", {"export": "1. export\n"}, "0\n  ok\n"), "t__")
    assert "(t__export)" in pages["t___index"] and "1. `export`" in pages["t__export"] and "- **0** — ok" in pages["t__status-codes"]


def test_embedding_client(monkeypatch):
    sent = []

    class Reply(io.BytesIO):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    def urlopen(request, timeout):
        sent.append(json.loads(request.data))
        return Reply(json.dumps({"data": [{"embedding": [1.0, 2.0]} for _ in sent[-1]["input"]]}).encode())

    monkeypatch.setattr(embedding.urllib.request, "urlopen", urlopen)
    s = embedding.Service("m", "http://x/")
    assert s.embed(["a", "b"]) == [[1.0, 2.0]] * 2 and sent[0] == {"model": "m", "input": ["a", "b"]}
    with pytest.raises(embedding.EmbeddingError):
        embedding.Service("m", "http://x", dims=3).embed(["a"])
    with pytest.raises(embedding.EmbeddingError):
        embedding.Service().embed(["a"])


def test_config(tmp_path):
    c = Config()
    c.update({"search": {"limit": 5}, "sources": [{"id": "a", "container": "a.bin"}]})
    c.save(tmp_path / "c.toml")
    again = Config.load(tmp_path / "c.toml", {"GLEANERY_SEARCH_LIMIT": "7", "GLEANERY_BUILD_CHUNK_SIZE": "x"})
    assert again.search.limit == 7 and again.build.chunk_size == 1500 and again.sources[0].id == "a"
    with pytest.raises(KeyError):
        c.update({"search": {"nope": 1}})
    with pytest.raises(TypeError):
        c.update({"search": {"limit": "1"}})
    assert c.search.limit == 5


def test_service_builds_publishes_and_answers(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "Array.md").write_text("# Array\n\nordered, see [Map](Map.md)", encoding="utf-8")
    (corpus / "Map.md").write_bytes("# Map\n\nkeys ".encode() + b"\xff")
    config = Config(corpus=f"file://{corpus}", index=f"file://{tmp_path}/index")
    engine = Engine(spark, config)
    assert engine.discover()["index"] == {"exists": False}
    assert engine.build_now()["skipped"] is False and engine.build_now()["skipped"] is True
    assert engine.build_now(chunk_size=900)["skipped"] is False and config.build.chunk_size == 1500
    assert [r["id"] for r in engine.search("keys")["results"]] == ["Map"]
    config.search.backend = "hybrid"
    assert engine.search("keys")["backend"] == "fts (fallback)"
    assert engine.get_page(["Array", "Map"])["returned"] == 2 and engine.related("Map")["incoming"] == ["Array"]
    job = engine.build(force=True)
    while engine.build_status(job["job_id"])["status"] == "running":
        time.sleep(0.2)
    assert engine.build_status(job["job_id"])["status"] == "done"
    assert Index.read(spark, config.index).pages.count() == 2


def test_build_from_containers_and_service(spark, tmp_path):
    books = tmp_path / "books"
    books.mkdir()
    (books / "one.hbk").write_bytes(small_container())
    (books / "two.hbk").write_bytes(small_container())
    (books / "bad.hbk").write_bytes(b"\xff" * 64)
    config = Config(corpus=f"file://{tmp_path}/none", index=f"file://{tmp_path}/index", containers=str(books), link_scheme="other")
    config.update({"sources": [{"id": "one", "container": "one.hbk", "prefix": "one__"}, {"id": "bad", "container": "bad.hbk"}, {"id": "two", "container": "two.hbk", "prefix": "two__", "lang": "en"}]})
    engine = Engine(spark, config)
    call = serve.Protocol(serve.Tools(engine, str(tmp_path / "c.toml")))
    ask = lambda name, **args: json.loads(call.called(name, args)["content"][0]["text"])
    with pytest.raises(LookupError):
        engine.build_now(sources=["nowhere"])
    job = ask("build", sources=["one", "bad"], lang="ru")
    while ask("build_status", job_id=job["job_id"])["status"] == "running":
        time.sleep(0.2)
    done = ask("build_status", job_id=job["job_id"])
    assert done["status"] == "done" and done["pages"] == 1 and len(done["failed"]) == 1 and done["failed"][0].startswith("bad: NotImplemented")
    assert [r["id"] for r in ask("search", query="T")["results"]] == ["one__a__b"]
    assert engine.add_source("two")["pages"] == 2 and engine.rebuild_text()["pages"] == 2
    assert ask("discover")["index"]["meta"]["link_scheme"] == "other" and ask("hierarchy")["sections"] == [{"section": "objects", "count": 2}]
    assert ask("config_set", values={"search.limit": 3})["search"]["limit"] == 3 and Config.load(tmp_path / "c.toml", {}).search.limit == 3
    assert call.called("get_page", {"id": "nowhere"})["isError"] and call.called("nothing", {})["isError"]

    sink = io.StringIO()
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "none"}]
    serve.over_streams(call, io.StringIO("\n".join(map(json.dumps, lines)) + "\nbroken\n"), sink)
    said = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert said[0]["result"]["serverInfo"]["name"] == "gleanery" and {t["name"] for t in said[1]["result"]["tools"]} == set(serve.TOOLS)
    assert said[1]["result"]["tools"][0]["inputSchema"]["required"] == ["query"] and said[2]["error"]["code"] == -32601 and said[3]["error"]["code"] == -32700
    server = serve.over_http(call, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    post = urllib.request.Request(f"http://127.0.0.1:{server.server_port}", json.dumps({"jsonrpc": "2.0", "id": 9, "method": "tools/call", "params": {"name": "get_page", "arguments": {"id": ["one__a__b", "gone"]}}}).encode())
    got = json.loads(urllib.request.urlopen(post, timeout=60).read())
    server.shutdown()
    assert json.loads(got["result"]["content"][0]["text"])["missing"] == ["gone"]


def test_work_folder_is_shared_and_left_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "work_dir", lambda _: f"file://{tmp_path}/work")
    with storage.scope():
        a = storage.written(spark.range(3), "a")
        with storage.scope():
            storage.written(spark.range(3), "b")
            c = storage.written(a, "c", keep=True)
        assert c.count() == 3
    storage.discard(storage.written(spark.range(3), "d"))
    assert list((tmp_path / "work").iterdir()) == []


def test_stream_follows_a_folder(spark, tmp_path):
    src, root = tmp_path / "in", f"file://{tmp_path}/index"
    src.mkdir()
    put = lambda rows: spark.createDataFrame(rows, "filename string, text string").coalesce(1).write.mode("append").parquet(str(src))
    put([("a", "alpha")])
    for _ in range(2):
        ingest.follow(spark, str(src), root, str(tmp_path / "cp")).awaitTermination(120)
        put([("b", "beta [a](a.md)"), ("a", "again")])
    idx = Index.read(spark, root)
    assert sorted(r.filename for r in idx.pages.collect()) == ["a", "b"] and idx.links.count() == 1
    assert storage.current_version(spark, root)


def test_markdown_sink(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    assert markdown.write(spark.createDataFrame([("x y", " body ")], "filename string, body string"), at) == 1
    assert [(r.filename, r.text) for r in markdown.read(spark, at).collect()] == [("x y", "body\n")]

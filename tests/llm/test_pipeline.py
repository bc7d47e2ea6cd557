import corpus_pipeline
from gleanery.llm import pii, registry


def test_stages_against_plain_steps(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    base = words("a", 60)
    near = base.replace("a30 ", "other ")
    leak = words("leak", 30)
    docs = [
        (1, base, "en", "s1", 0),
        (2, near, "en", "s1", 0),
        (3, base, "en", "s2", 0),
        (4, "too short", "en", "s1", 0),
        (5, words("b", 40) + " " + leak, "en", "s1", 0),
        (6, words("c", 40) + " mail me@x.org now", "en", "s2", 0),
        (7, words("d", 40), None, None, None),
        (8, None, "en", "s1", 0),
        (9, words("e", 8) + " " + words("f", 9) * 1 + " " + (words("g", 9) + " ") * 8, "en", "s1", 0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [{1, 2, 3, 5, 6, 7}, {1, 5, 6, 7}, {1, 6, 7}, {1, 6, 7}]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), ids in zip(corpus_pipeline.STAGES, left, strict=False):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in now.collect()} == ids
    six = now.where("doc_id = 6").first()
    assert "me@x.org" not in six.text and "[EMAIL]" in six.text and six.n_chars == len(six.text)
    assert now.where("doc_id = 1").first().text == base
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in last} <= {1, 6, 7}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.mix_copy) for r in whole) == sorted((r.doc_id, r.mix_copy) for r in last)


def test_registered():
    assert [n.split("_")[0] for n in sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "decontaminate", "personal_data", "mix_sources"]
    assert pii.trained() is pii.trained()

import random

import corpus_pipeline
from tempo.llm import simhash, toxicity


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, say(120)) for i in range(60)]
    rows += [(100 + i, f"{say(10)} You are a clown, {say(10)}") for i in range(30)]
    rows += [(200 + i, f"{rows[i][1]} ") for i in range(5)]  # exact copies but for white space
    rows += [(300 + i, rows[10 + i][1].replace("word7 ", "changed ", 1) + " ending") for i in range(5)]  # near copies
    passage = " ".join(say(12) for _ in range(5))
    rows += [(400 + i, f"{say(30)} {passage} {say(30)}") for i in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 130)) for i, _ in rows if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows if not 100 <= i < 130}
    once = stages["exact_dedup"](spark, clean, str(tmp_path))
    assert {r.doc_id for r in once.collect()} == ({i for i, _ in rows if not 100 <= i < 130} - {0, 1, 2, 3, 4})  # the longer original stays
    single = stages["simhash_near_dedup"](spark, once, str(tmp_path))
    assert {r.doc_id for r in once.collect()} - {r.doc_id for r in single.collect()} == {300, 301, 302, 303, 304}
    cut = stages["sentence_spans"](spark, single, str(tmp_path))
    assert cut.columns == docs.columns and cut.count() == single.count()
    text = {r.doc_id: r.text for r in cut.collect()}
    assert passage in text[400] and not any(s in text[401] for s in passage.split(". "))
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == set(text)


def test_stages_take_awkward_and_empty_tables(spark, awkward, empty, tmp_path):
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.count()
            assert name == "packing" or out.columns == docs.columns


def test_stages_keep_columns_named_like_working_ones(spark, tmp_path):
    names = ["gone_id", "GONE_ID_", "gone_sha", "gone_size", "cut_id", "cuts", "done", "n_sentences", "n_removed", "component_id", "text_sha256", "kept"]
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = "One sentence with quite a few words in it. Another sentence with quite a few words in it."
    rows = [(i, text if i < 3 else f"{text} And document {i} goes on alone here.", *[f"{n}{i}" for n in names]) for i in range(6)] + [(None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(r[n] == (f"{n}{r.doc_id}" if r.doc_id is not None else None) for r in out.collect() for n in names), name


def test_a_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from tempo.llm import common

    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        common.shared_folder(cluster)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert simhash.RADIUS == 2 and toxicity.FOLDS == 5

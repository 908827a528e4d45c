"""The stages of the pipeline on documents with planted cases."""

import random

import corpus_pipeline
from chainloom.llm import common


def planted(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = " ".join(word() for _ in range(120))
    rows = [(i, " ".join(word() for _ in range(60)) + (" vilelout grimfool" if i % 5 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(200)]
    rows += [(300 + i, base.replace(" ", "  ", i), "en", "s1", 1) for i in range(4)] + [(310, base + " tail", "en", "s2", 1), (311, base, "de", "s2", 1)]
    rows += [(400, "12 34 !!", "en", "s0", 1), (401, None, "en", "s0", 1), (402, "write to hidden.person@mail.example.net now " + " ".join(word() for _ in range(40)), "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = planted(spark, tmp_path)
    docs = common.table(spark, str(tmp_path), "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    everything = {r[0] for r in rows}
    assert ids["toxicity"] == everything - {i for i in range(200) if i % 5 == 0}
    assert ids["language_id"] == ids["toxicity"] - {400, 401}
    assert ids["near_dedup"] == ids["language_id"] - {301, 302, 303, 310, 311}
    assert ids["pii"] == ids["near_dedup"] == ids["packing"]
    text = {r.doc_id: r.text for r in seen["pii"].collect()}
    assert "hidden.person" not in text[402] and text[402].startswith("write to ") and text[1] == rows[1][1]


def test_run_gives_the_last_stage(spark, tmp_path):
    planted(spark, tmp_path)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.columns == ["bin_id", "doc_id", "piece", "piece_start", "n_tokens", "bin_start"] and packed.count() > 100


def test_language_stage_without_labels_keeps_texts(spark, tmp_path):
    rows = [(1, "some words", None), (2, "слово", None), (3, "12 34 !!", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()) == [1, 2]

"""The corpus pipeline, stage by stage, on documents whose fate is known."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, texts, labels, items):
    rows = [(i, t, "en", "hot", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_decide_as_they_should(spark, tmp_path):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("lmnopqrst"), 6)) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    plain = [(i, text(80)) for i in range(120)]
    toxic = [(200 + i, text(60) + " gruntle flibber gruntlest flibbering") for i in range(40)]
    copied = text(100)
    near = copied.split()
    near[50] = "other"
    item = text(30)
    odd = [(300, None), (301, ""), (302, copied), (303, " ".join(near)), (304, f"{text(40)} {item} {text(40)}"), (305, plain[0][1]), (306, f"{plain[1][1]}\n{text(50)}"), (None, text(50)), (307, text(60)), (307, text(60))]
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 1, 1) for i in range(20)] + [(None, None, None)]
    tables(spark, str(tmp_path), plain + toxic + odd, labels, [(1, item), (2, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        assert k == 4 or now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({} if k == 4 else {(r["doc_id"], r["text"]) for r in now.collect()})
        docs = now
    ids = [{d for d, _ in x} for x in left]
    assert not ids[0] & set(range(200, 240)) and set(range(120)) | {300, 301, 302, None} <= ids[0]
    # Lines: a document that repeats another's only line goes, another loses the repeated one.
    assert 305 not in ids[1] and {t.count("\n") for d, t in left[1] if d == 306} == {0}
    assert {302, 303} & ids[2] == {302} and {300, 301} & ids[2] == {300} and 304 in ids[2] and len([d for d, _ in left[2] if d == 307]) == 2
    assert ids[3] == ids[2] - {304}
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == ids[3] and max(r["offset"] + r["length"] for r in pieces) <= 1024


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

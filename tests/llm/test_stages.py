"""The pipeline's stages on odd rows: nulls, empty texts and tables, repeated rows, clashing column names."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans int, label int, share int, component_id int, score double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    text = lambda n=40: " ".join(rng.choices(words, k=n))
    item, same = text(), text()
    rows = [(1, text()), (2, None), (3, ""), (4, same), (5, f"{same} more"), (6, "repeated"), (6, "repeated"), (6, "repeated too"), (None, text()), (None, same), (None, f"{text()} {item}"), (None, None), (None, None), (8, f"{item} {text()}"), (9, f"{text(5)} token=abcdefgh12"), (10, "short one"), (11, " ".join(rng.choices(words, k=200_000)))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 0.5) for i, t in rows], COLUMNS)
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "short one"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda i: (i is None, i))
    stages = dict(corpus_pipeline.STAGES)
    toxic = stages["toxicity"](spark, docs, folder)
    assert toxic.columns == docs.columns and toxic.count() == docs.count()
    near = stages["minhash near-dedup"](spark, docs, folder)
    # 5 and a row without doc_id are near copies of 4; of the rows of 6 one stays; null texts are copies of nothing.
    assert near.columns == docs.columns and ids(near) == [1, 2, 3, 4, 6, 8, 9, 10, 11, None, None, None, None]
    assert [r["text"] for r in near.where("doc_id = 6").collect()] == ["repeated"]
    clean = stages["benchmark decontamination"](spark, near, folder)
    assert clean.columns == docs.columns and ids(clean) == [1, 2, 3, 4, 6, 9, 10, 11, None, None, None]
    hidden = stages["secret scan"](spark, clean, folder)
    assert hidden.columns == docs.columns and hidden.count() == clean.count()
    one = hidden.where("doc_id = 9").first()
    assert one["text"].endswith("[SECRET]") and one["n_chars"] == len(one["text"]) and one["spans"] == 1
    assert hidden.where("text is null").count() == 3 and hidden.where("text is null and n_chars is null").count() == 3
    pieces = stages["best-fit packing"](spark, hidden, folder)
    assert pieces.where("piece = 0").count() == hidden.count()


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name

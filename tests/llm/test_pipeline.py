"""The stages' contract on the smallest tables."""

import corpus_pipeline
from kinfold.llm.scratch import trim_native

DIR = "/root/testdata/sf0.001"


def test_light_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(120)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    for name in ("decontamination", "pii"):
        out = stages[name](spark, docs, DIR)
        assert out.columns == docs.columns and 0 < out.count() <= 120
    mixed = stages["mixing"](spark, docs, DIR)
    assert mixed.columns == [*docs.columns, "words", "weight", "copies"] and mixed.where("copies < 1").isEmpty()


def test_null_and_shared_ids(spark):
    """No clean document is lost or multiplied, whatever its id."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(2)), (2, text(3)), (3, text(1)), (4, text(2) + " more"), (None, text(5)), (None, text(5)), (None, text(6)), (None, text(7)), (8, text(7)), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["near_dedup"](spark, docs, DIR)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    texts = [t for _, t in got]
    assert all(texts.count(text(k)) == 1 for k in (1, 3, 5, 6, 7)) and text(2) in texts or text(2) + " more" in texts
    assert len(got) == 8 and texts.count(None) == texts.count("") == 1
    mixed = stages["mixing"](spark, docs, DIR).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in mixed) == sorted((str(i), str(t)) for i, t in rows)
    assert all(r.words == len((r.text or "").split()) for r in mixed)


def test_stages_begin_lean(spark, monkeypatch):
    """Each stage first gives back what the driver no longer needs, memory outside the heap included."""
    released = []
    monkeypatch.setattr(corpus_pipeline.Scratch, "release", lambda self: released.append(1))
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(5)
    for n, name in enumerate(("pii", "decontamination"), 1):
        dict(corpus_pipeline.STAGES)[name](spark, docs, DIR)
        assert len(released) == n
    assert trim_native(spark)

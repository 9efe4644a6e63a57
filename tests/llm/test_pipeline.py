"""The pipeline against the same steps in plain Python."""

import hashlib

import corpus_pipeline
from limnoscope.llm import pii
from limnoscope.llm.queries import public_model

SF = "/root/testdata/sf0.001"


def test_stages_and_rows(spark):
    import sentencepiece

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, rules), (_, dedup), (_, clean), (_, mask), (_, tokens) = corpus_pipeline.STAGES
    a = rules(spark, docs, SF)
    b = dedup(spark, a, SF)
    c = clean(spark, b, SF)
    d = mask(spark, c, SF)
    for frame in (a, b, c, d):
        assert frame.schema.names == docs.schema.names
    expected = {}
    library = sentencepiece.SentencePieceProcessor(model_file=public_model())
    for r in d.collect():
        assert r.n_chars == len(r.text) and not pii.base_spans(r.text)
        ids = library.encode(r.text)
        expected[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected


def test_odd_rows_pass_all_stages(spark):
    prose = "The and of to in is that it was for on with as by be this are at from one two three four. "
    text = " ".join(f"{prose} Item number {w} follows." for w in ("red", "green", "blue", "white", "black"))
    rows = [(1, text, "en", "s", 5, "x"), (1, text, "en", "s", 5, "x"), (2, None, None, None, None, None), (3, "", "en", None, 0, "y"), (None, text + " More words here.", "en", "s", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaks string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[-1] == "leaks"
    kept = docs.collect()
    assert sorted(r.doc_id or 0 for r in kept) in ([0, 1], [])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(kept)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_texts_that_share_an_id_are_not_copies(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (2, c, "z"), (2, c, "y"), (3, b + " more", "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text, r.source) for r in kept) == [(0, a, "x"), (1, a, "x"), (2, b, "x"), (2, c, "y")]


def test_scattered_changes_are_no_near_copy_in_the_stage(spark):
    words = [f"w{i}" for i in range(100)]
    changed = [f"v{i}" if i % 20 == 10 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:-1]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()) == [1, 2]

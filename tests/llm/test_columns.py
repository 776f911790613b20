"""Columns of any type and name beside a text, and ids that stand for several vectors."""

import pytest

import corpus_pipeline
from xrefloom.llm import embeddings, language, pii, token_counts

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, odd struct<`x y`:int,`a``b`:array<string>>, tags map<string,int>"


@pytest.fixture(scope="module")
def docs(spark):
    words = "a quiet river runs below the old stone bridge near town"
    rows = [(k, f"{words} {k} " * 3, "en", "web", 9, (k, ["z"]), {"k": k}) for k in range(6)] + [(6, None, None, None, None, None, None), (0, f"{words} 0 " * 3, "en", "web", 9, (0, ["z"]), {"k": 9})]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES][1:4])
def test_stages_keep_odd_columns(spark, docs, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
    got = {(r.doc_id, tuple(sorted((r.tags or {}).items()))): r.odd for r in out.collect()}
    assert out.columns == docs.columns and got[5, (("k", 5),)]["x y"] == 5 and len(got) == (7 if stage == "near_duplicates" else 8)


def test_operators_keep_odd_columns(docs):
    keep = ("doc_id", "odd", "tags")
    model = language.fit(docs)
    outs = [language.predict(docs, model, keep=keep), pii.pseudonymise(docs, b"k", keep=keep), token_counts.token_counts(docs, {bytes([k]): k for k in range(256)}, keep=keep)]
    for out in outs:
        assert sorted(r.odd["x y"] for r in out.collect() if r.odd) == [0, 0, 1, 2, 3, 4, 5] and set(keep) <= set(out.columns)


def turned(x, y=0.0):
    return [1.0, x, y, 0.0]


def test_ids_with_several_vectors(spark):
    one, two, near = turned(0.0), turned(0.3), turned(0.15)  # cosine of one and two: 0.96; of one and far: 0.2
    far, apart = turned(4.9), turned(0.0, 4.9)
    cases = {
        "near both": ([(5, one), (5, two), (7, near), (9, apart)], {5: 2, 7: 2, 9: 0}),
        "one of two": ([(5, one), (5, far), (8, far), (7, turned(0.1))], {5: 1, 7: 1, 8: 1}),
    }
    for name, (rows, links) in cases.items():
        df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
        got = embeddings.classes(df).collect()
        assert len(got) == len(rows) and {r.vec_id: r.n_links for r in got} == links, name
        assert {r.vec_id: r.component_id for r in got} == {i: 9 if i == 9 else 5 for i in links}, name

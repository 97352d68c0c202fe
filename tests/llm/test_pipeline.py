"""The stages on a small table, each against a slow version of its own input."""

import random

import corpus_pipeline
from phaseloom.llm import registry


def _prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_stages(spark):
    rnd = random.Random(1)
    clean = [_prose(rnd, 200) for _ in range(12)]
    passage = _prose(rnd, 80)
    near = clean[0].split()
    near[50] = "other"
    texts = [*clean, clean[1] + " ", " ".join(near), None, "", "few words", "###### " * 100, clean[2] + "\n" + passage, _prose(rnd, 150) + "\n" + passage + "\n" + _prose(rnd, 90)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == {*range(14), 18, 19}
    assert set(kept[1]) == set(kept[0]) - {1}  # the copy has one more code point
    assert set(kept[2]) == set(kept[1]) - {13}
    assert set(kept[3]) == set(kept[2]) and passage not in kept[3][19] and passage in kept[3][18] and kept[3][18].strip() == passage
    assert {r.doc_id for r in docs.collect()} == set(kept[3])


def test_registry(spark, tmp_path):
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) == 14

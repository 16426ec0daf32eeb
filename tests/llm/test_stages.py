"""The pipeline's stages on odd rows: null and repeated ids, null, empty and long texts, clashing column names, empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratocloud.llm import packing, quality_classifier, simhash
from stratocloud.llm.queries import tokenizer_path

ODD = "_text _taken _size _id _copy _score score uid again gram n_words n_removed kept_sha256 fingerprint component_id _c0 _row".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in ODD)


def _docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(70))
    prose = [" ".join(word() for _ in range(120)) for _ in range(6)]
    texts = [
        (1, prose[0]), (2, prose[0]), (None, prose[0]), (3, prose[1]), (3, prose[2]), (3, prose[2]), (None, prose[3]),
        (None, prose[3]), (4, None), (5, ""), (None, " \n "),
    ]
    texts += [(6, prose[4] + " " + passage), (7, passage + " " + prose[5]), (8, passage), (9, "long " * 60_000)]
    rows = [(i, t, "en", (None, "a", "b")[k % 3], len(t or ""), *(f"{c}{k}" for c in ODD)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _stage(spark, k, docs, d="/root/testdata/sf0.001"):
    return corpus_pipeline.STAGES[k][1](spark, docs, d)


def _rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("k", range(5))
def test_empty_tables(spark, k):
    found = _stage(spark, k, _docs(spark).filter("doc_id < 0"))
    assert found.isEmpty() and (k == 4 or found.schema.names == _docs(spark).schema.names)


def test_quality_stage_keeps_rows_as_they_are(spark):
    docs, d = _docs(spark), "/root/testdata/sf0.001"
    found, given = _rows(_stage(spark, 0, docs)), _rows(docs)
    model = quality_classifier.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good = quality_classifier.score_quality(docs, model, "of_model").filter("of_model >= 0.7").drop("of_model")
    assert found == _rows(good) and not found - given


def test_near_dedup_keeps_one_of_each_class(spark):
    docs = _docs(spark)
    found = _stage(spark, 1, docs)
    rows = found.collect()
    assert found.columns == docs.columns and not _rows(found) - _rows(docs)
    prints = {r["text"]: simhash.fingerprint(r["text"]) for r in docs.collect()}
    roots = {p: p for p in prints.values()}
    for a in roots:
        for b in roots:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                old, new = roots[a], roots[b]
                roots = {x: new if r == old else r for x, r in roots.items()}
    classes = {}
    for r in docs.collect():
        i = r["doc_id"] if r["doc_id"] is not None else float("inf")
        c = roots[prints[r["text"]]]
        classes[c] = min(classes.get(c, i), i)
    kept = Counter(roots[prints[r["text"]]] for r in rows)
    assert set(kept) == set(classes) and set(kept.values()) == {1}
    assert all((r["doc_id"] if r["doc_id"] is not None else float("inf")) == classes[roots[prints[r["text"]]]] for r in rows)


def test_substring_stage_cuts_later_copies(spark):
    docs = _docs(spark)
    found = {r["doc_id"]: r for r in _stage(spark, 2, docs).filter("doc_id > 5").collect()}
    given = {r["doc_id"]: r for r in docs.filter("doc_id > 5").collect()}
    assert 8 not in found  # nothing is left of it
    assert found[6]["text"] == given[6]["text"] and found[7]["text"].split() == given[7]["text"].split()[70:]
    assert found[7]["n_chars"] == len(found[7]["text"]) and all(found[i][c] == given[i][c] for i in (6, 7, 9) for c in ODD)
    assert found[9]["text"] == given[9]["text"]
    rest = _stage(spark, 2, docs).filter("doc_id IS NULL OR text IS NULL OR text = ''")
    assert _rows(rest) == _rows(docs.filter("doc_id IS NULL OR text IS NULL OR text = ''"))


def test_mixing_stage_repeats_rows_whole(spark):
    docs = _docs(spark)
    found = _stage(spark, 3, docs)
    assert found.columns == docs.columns and set(_rows(found)) <= set(_rows(docs))
    empty = _rows(docs.filter("text IS NULL OR trim(text) = ''").filter("doc_id IS NOT NULL"))
    assert not empty - _rows(found)


def test_packing_stage_places_every_row(spark):
    docs = _docs(spark)
    found = _stage(spark, 4, docs)
    assert found.filter("piece = 0").count() == docs.count()
    full = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n > 4096 OR n <> end").isEmpty()


def test_other_vocabularies_are_used_as_they_are():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Some Text\twith  spaces ", None, "", "Ünï 123"]
    ids, sizes = packing.WordTokenizer(path).encode(texts)
    full = [[*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == sum(full, []) and sizes.tolist() == list(map(len, full))
    assert packing.WordTokenizer(tokenizer_path()).by_word and not packing.WordTokenizer(path).by_word

"""The classifiers' samples through ``train``, columns with odd names, rows of the substring operator's joins, and the pipeline as a whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from stratocloud.llm import lm_scoring, packing, quality_classifier, substring_dedup, toxicity, training


def test_prior_through_train(spark):
    """Half of the good documents are labelled; 70 % of all are good."""
    rng = random.Random(31)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["$$$", "##", "12", "CLICK", "NOW!!"]) for _ in range(60))
    kinds = [rng.random() < 0.7 for _ in range(3000)]
    docs = spark.createDataFrame([(k, good() if g else bad()) for k, g in enumerate(kinds)], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(k, 1) for k, g in enumerate(kinds) if g and rng.random() < 0.5], "doc_id bigint, quality int")
    model = quality_classifier.train(docs, labels)
    assert model.prior == pytest.approx(np.mean(kinds), abs=0.03)
    found = quality_classifier.classify_quality(docs, model).collect()
    assert np.mean([bool(r["predicted"]) == kinds[r["doc_id"]] for r in found]) > 0.97
    few = quality_classifier.train(docs, labels, positives=300, unlabelled=600)  # samples smaller than the tables
    assert few.prior == pytest.approx(np.mean(kinds), abs=0.06)


def test_a_document_drawn_twice_is_in_both_samples(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a b"), (3, "c")], "doc_id bigint, text string")
    ids = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 1)], "doc_id bigint, y int")
    assert sorted((r["doc_id"], r["y"]) for r in training.texts_of(docs, ids).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_labels_and_texts_of_a_sample_belong_together(spark):
    """Texts that share their least shingle, but not their label."""
    rng = random.Random(32)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(200):
        text = [rng.choice(words) for _ in range(12)]
        rows.append((2 * k, 0, " ".join(text)))
        rows.append((2 * k + 1, 1, " ".join([*text, "vile"])))
    sample = spark.createDataFrame(rows, "doc_id bigint, y int, text string")
    chosen = training.one_of_copies(sample).collect()
    assert all(("vile" in r["text"]) == bool(r["y"]) for r in chosen) and len({r["mark"] for r in chosen}) < len(chosen)


def test_no_clean_text_is_learnt_as_toxic(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    ids = training.labelled_ids(labels, "toxic", 3, 1)
    of = {}
    for r in docs.join(ids, "doc_id").select("text", "y").collect():
        of.setdefault(r["text"], set()).add(r["y"])
    chosen = training.one_of_copies(training.texts_of(docs, ids)).collect()
    assert chosen and all(r["y"] in of[r["text"]] for r in chosen)
    assert toxicity.THRESHOLD == 0.7


def _odd(spark, texts):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType())])
    schema = schema.add("we`ird", T.StringType()).add("a.b", T.StringType()).add("UID", T.StringType()).add("N_Removed", T.StringType())
    schema = schema.add("of two", T.StructType([T.StructField("a part", T.IntegerType()), T.StructField("b`", T.StringType())]))
    rows = [(k, t, "s", len(t), f"w{k}", f"d{k}", f"u{k}", "r", (k, "x")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("k", range(4))
def test_stages_carry_columns_with_odd_names(spark, k):
    rng = random.Random(33)
    docs = _odd(spark, [" ".join(f"word{rng.randint(0, 400)}" for _ in range(80)) for _ in range(5)])
    found = corpus_pipeline.STAGES[k][1](spark, docs, "/root/testdata/sf0.001")
    assert found.columns == docs.columns
    given = {r["doc_id"]: r for r in docs.collect()}
    for r in found.collect():
        assert r == given[r["doc_id"]]


def test_operator_replaces_columns_of_its_names_in_any_case(spark):
    docs = _odd(spark, ["one two three"]).drop("a.b")
    found = substring_dedup.dedup_substrings(docs)
    assert found.columns == ["doc_id", "text", "source", "n_chars", "we`ird", "of two", "n_words", "n_removed"] and found.first()["n_words"] == 3


def _near_copies(spark, n):
    """Documents that are one long text but for a word each: all windows away from that word are shared by runs that differ."""
    rng = random.Random(34)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for k in range(n):
        own = list(base)
        own[rng.randrange(400)] = f"own{k}"
        rows.append((k, " ".join(own)))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rows


def test_rows_of_the_joins_follow_the_runs(spark, monkeypatch):
    """Windows that a run shares with the first of its gram need no row of their own, so what is told window by window stays few."""
    made = []
    for n in (60, 120):
        docs, rows = _near_copies(spark, n)
        seen = {}
        real = substring_dedup._beside_first

        def counted(joined, seen=seen):
            out = substring_dedup.kept(real(joined))
            seen["runs"], seen["left"], seen["windows"] = out.agg(F.count("*"), F.sum(F.size("at")), F.sum("n")).first()
            return out

        with monkeypatch.context() as m:
            m.setattr(substring_dedup, "_beside_first", counted)
            found = {r["doc_id"]: (r["n_removed"], r["n_words"]) for r in substring_dedup.dedup_substrings(docs, text=False).collect()}
        windows, own = {}, {}
        for k, t in rows:
            words = t.split()
            own[k] = [" ".join(words[i : i + 50]) for i in range(351)]
            for w in own[k]:
                windows[w] = min(windows.get(w, k), k)
        for k, _ in rows:
            gone = {i + j for i, w in enumerate(own[k]) if windows[w] < k for j in range(50)}
            assert found[k] == (len(gone), 400)
        made.append(seen)
    assert made[1]["runs"] < 2.5 * made[0]["runs"] and made[1]["left"] < 2.5 * made[0]["left"]


def test_whole_run(spark):
    """Every piece's document passes every stage, and a second run gives the same rows but for the sequences' numbers."""
    d = "/root/testdata/sf0.001"
    first, second = (corpus_pipeline.run(spark, d).collect() for _ in range(2))
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert first and key(first) == key(second)
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.kept(stage(spark, docs, d))
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept is None or ids <= kept
        kept = ids
    assert {r["doc_id"] for r in first} == kept
    places = {}
    for r in first:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_slices_added_up_in_groups_give_the_same_totals(spark):
    rng = random.Random(35)
    texts = [" ".join(rng.choice(["the", "a", f"w{rng.randint(0, 3000)}"]) for _ in range(300)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(12)
    models = lm_scoring.train(docs.filter("doc_id < 5"), docs, slice_words=1_500, shard_words=1_000)
    assert models.slices.select("slice").distinct().count() > 9
    key = lambda df: sorted(df.collect(), key=lambda r: (r["shard"], r["slice"] is not None, r["slice"] or 0))
    once = key(lm_scoring.answers(models.slices, lm_scoring.BACKGROUND))
    assert len({r["shard"] for r in once}) > 3
    for size in (1, 4):
        assert key(lm_scoring.answers(models.slices, lm_scoring.BACKGROUND, size)) == once


def test_repacking_goes_on_while_it_saves(spark):
    """Many partitions that each leave a gap: together they reach the bound, or the last round saved nothing."""
    rng = np.random.default_rng(36)
    sizes = rng.integers(30, 70, 3_000).tolist()
    pieces = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(sizes)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    found = packing.pack(pieces, capacity=100, part_rows=150).collect()
    used = {}
    for r in found:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert len(found) == 3_000 and max(used.values()) <= 100
    alone = int(packing.best_fit(np.sort(np.array(sizes))[::-1], 100)[0].max()) + 1
    assert packing.lower_bound(np.bincount(sizes, minlength=101), 100) <= len(used) <= alone * 1.03

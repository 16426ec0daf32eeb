"""A text pipeline: each stage takes documents and returns those it keeps, the last one their packing.

Every stage reads the whole output of the one before. Intermediate tables are written to the shared
folder, so that a lost executor costs no earlier stage.

All stages take documents with doc_id, text, source and n_chars and any other columns, whatever these are called, and carry them
along. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocloud.llm import mixing, packing, quality_classifier, simhash, substring_dedup
from stratocloud.llm.common import all_of, fresh, kept, table
from stratocloud.llm.queries import tokenizer_path

#: No SQL can express the learnt classifier and the tokenizer.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the positive-unlabelled classifier rejects.

    Null and empty texts are judged by the score that the model gives a text without features, null ids and repeated rows like any.
    Without trusted positives all scores are 0.5, and every document goes.
    """
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "_score")
    scored = quality_classifier.score_quality(docs, model, score)
    scored = scored.filter(F.col(score) >= quality_classifier.THRESHOLD)
    return scored.select(*all_of(scored, docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: the one with the smallest id (a null id comes last) and, of rows that share
    it, the one whose text has the smallest hash; of rows that repeat both id and text, an arbitrary one.

    Null, empty and blank texts have the same fingerprint, so one of them stays.
    """
    keys = F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")
    found = simhash.near_duplicates(docs.select(F.struct(*keys).alias("doc_id"), "text"))
    first = found.select("component_id.*").distinct()
    own, text = fresh(docs, "_id", "_text")
    first = first.select(F.col("id").alias(own), F.col("hash").alias(text))
    met = docs["doc_id"].eqNullSafe(F.col(own)) & (F.xxhash64(docs["text"]) == F.col(text))
    return docs.join(first, met).dropDuplicates([own, text]).select(*all_of(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; documents of which nothing is left go. n_chars of a cut text is its new length.

    Null and empty texts stay as they are. Rows with a null id keep their words and mark no others; rows with the same id do not mark one
    another.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *(c.alias(f"_c{k}") for k, c in enumerate(all_of(docs, others) if others else [])))  # no name clashes with the operator's
    found = substring_dedup.dedup_substrings(plain)
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    back = {c: F.col(f"_c{k}") for k, c in enumerate(others)} | {c: F.col(c) for c in ("doc_id", "text")}
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(back["n_chars"])
    back["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return left.select(*(back[c].alias(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources have their target weights.

    A document taken for more than its own words appears again; the one at a source's cut is kept whole if at
    least half of its words fit. A document without words appears once. A null source is one of its own; rows that share an id, null
    too, share their words taken.
    """
    mixed = mixing.repeated(docs)
    return mixed.select(*all_of(mixed, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens.

    Null and empty texts are the end mark alone; null ids and repeated rows are packed like any. The columns are the operator's.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs)
    return docs

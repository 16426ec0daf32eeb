"""Quality rules: a table of thresholds compiled into one Spark projection.

No user function runs: every measure is a built-in expression over the whole text, and the
table :data:`RULES` becomes a conjunction of comparisons. Stop words are compared in lower case (A-Z) and without
anything but letters and digits.

The thresholds were set on labelled documents (of check_s: 17,832 good, 2,766 poor) such that hardly a good one that passes the
base rule is lost; README gives both error counts.

Edge cases: a null or empty text has no words, every count is 0 and it fails the base rule.
A null ``doc_id`` is carried through. Repeated rows give repeated results. Extra input columns
are ignored. Texts of any length are measured whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocloud.llm.common import words_of

SYMBOLS = "[#*$%&|<>]"
LETTER = r"\p{L}"
BARE = r"[^\p{L}\p{N}\x20\x09-\x0D]+"  # what stop words are compared without
BULLET = r"^[\x20\x09]*[-*\u2022]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 5

#: Frequent function words of English, German, French and Spanish (lower case).
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der die ein eine er für ich im in ist mit nicht sich sie und von zu "
    "au avec dans de des du en est et il la le les pas pour que sur un une "
    "al como con del el en es la las lo los no por se su una y"
).split()
STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS))


class Rule(NamedTuple):
    """``low <= numerator / denominator <= high``; either bound may be None. An empty denominator passes."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


RULES = (
    Rule("length", "n_words", None, 10.0, 1_000_000.0),
    Rule("mean word length", "word_chars", "n_words", 2.0, 20.0),
    Rule("letters", "n_letters", "word_chars", 0.5, None),
    Rule("symbols a word", "n_symbols", "n_words", None, 0.1),
    Rule("stop words", "n_stop_words", "n_words", 0.02, None),
    Rule("words said again at once", "n_echoes", "n_words", None, 0.2),
    Rule("words a line", "n_words", "n_lines", 1.5, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bulleted lines", "n_bullet_lines", "n_lines", None, 0.9),
)


def _windows(hashes: str, n: int = WINDOW) -> Column:
    """A hash for each run of ``n`` words, from the array of word hashes."""
    last = F.size(hashes) - n
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(F.col(hashes), i + k) for k in range(n)))),
    ).otherwise(F.array().cast("array<bigint>"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with the counts that the rules compare: words, their code points, letters, symbols, lines, stop words, repeats."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.regexp_replace(F.translate("text", UPPER, LOWER), BARE, "")
    df = df.select(
        "doc_id",
        words_of(F.col("text")).alias("words"),
        words_of(bare).alias("bare"),
        lines.alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(LETTER)).cast("long").alias("n_letters"),
    )
    df = df.select(
        "doc_id",
        "n_symbols",
        "n_letters",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.filter("bare", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(BULLET))).cast("long").alias("n_bullet_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    echoes = F.filter("hashes", lambda h, i: h == F.get(F.col("hashes"), i - 1))  # the first word has none before it
    df = df.withColumns({"windows": _windows("hashes"), "n_echoes": F.size(echoes).cast("long")})
    # Only texts with an equal pair of windows are sorted; most have none.
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.when(some, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("pairs", pairs).drop("windows", "hashes")
    at = lambda j: F.get(F.col("pairs"), j)["h"]  # noqa: E731  null beyond the ends
    twice = F.filter("pairs", lambda x, j: x["h"].eqNullSafe(at(j + 1)) | x["h"].eqNullSafe(at(j - 1)))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("pairs")


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean expression over the columns of :func:`measures`."""
    passed = F.lit(True)
    for r in rules:
        value = F.col(r.numerator).cast("double")
        below = F.lit(1.0) if r.denominator is None else F.col(r.denominator).cast("double")
        if r.low is not None:
            passed = passed & (value >= r.low * below)
        if r.high is not None:
            passed = passed & (value <= r.high * below)
    return passed


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every document; see the module for edge cases."""
    df = measures(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))

"""The registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocloud.llm import lm_scoring, quality_classifier, token_alignment, toxicity, warc
from stratocloud.llm.common import table
from stratocloud.llm.conversation_trie import digested, prefix_trie, rebuilt
from stratocloud.llm.hamming_search import code_of, top_k
from stratocloud.llm.mixing import mix
from stratocloud.llm.packing import pack_documents
from stratocloud.llm.quality_rules import STOP_WORDS, quality_rules
from stratocloud.llm.simhash import near_duplicates
from stratocloud.llm.substring_dedup import dedup_substrings
from stratocloud.llm.url_filter import UrlRule, filter_urls

URL_RULES = [UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The tokenizer's vocabulary file; it is read in place and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), text=False)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify_quality(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of every document to the benchmark's texts, against the documents themselves as background."""
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.train(table(spark, sf_dir, "benchmark"), docs))


def op10_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 rows nearest to every row whose id is divisible by 20, by the signs of the vectors' components."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), code_of(F.col("embedding")).alias("code"))
    return top_k(rows, rows.filter("id % 20 = 0"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.through_archives(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(digested(table(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_best_fit_packing, op3_simhash, op4_quality_rules, op5_substring_dedup, op6_quality_classifier, op7_mixing,
        op8_url_filter, op9_lm_scoring, op10_hamming_top_k, op11_token_alignment, op12_warc_index, op13_conversation_trie,
    )
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op4_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS words FROM documents),
lines AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '^[\x20\x09]*[-*•]')) AS n_bullet_lines
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
pos AS (SELECT id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5),
win AS (SELECT id, i, count(*) OVER (PARTITION BY id, array_to_string(words[i:i+4], ' ')) AS n FROM pos),
cov AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM win, range(0, 5) AS r(k) WHERE n > 1 GROUP BY id),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_bullet_lines, 0) AS n_bullet_lines, len(regexp_extract_all(text, '\p{{L}}')) AS n_letters,
    len(list_filter(regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g'), '[^\x20\x09-\x0D]+'),
      lambda w: w IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop_words,
    len(list_filter(list_zip(words[2:], words[:-2]), lambda p: p[1] = p[2])) AS n_echoes
  FROM d LEFT JOIN lines USING (id) LEFT JOIN cov USING (id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words BETWEEN 10 AND 1000000 AND word_chars::DOUBLE >= 2.0::DOUBLE * n_words AND word_chars::DOUBLE <= 20.0::DOUBLE * n_words
  AND n_letters::DOUBLE >= 0.5::DOUBLE * word_chars AND n_symbols::DOUBLE <= 0.1::DOUBLE * n_words AND n_stop_words::DOUBLE >= 0.02::DOUBLE * n_words
  AND n_echoes::DOUBLE <= 0.2::DOUBLE * n_words AND n_words::DOUBLE >= 1.5::DOUBLE * n_lines AND n_dup_lines::DOUBLE <= 0.5::DOUBLE * n_lines
  AND n_bullet_lines::DOUBLE <= 0.9::DOUBLE * n_lines AS kept FROM b""",
    "op5_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {WORDS_SQL} AS words FROM documents),
pos AS (SELECT id, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50 AND doc_id IS NOT NULL),
win AS (SELECT id, i, doc_id > min(doc_id) OVER (PARTITION BY md5(array_to_string(words[i:i+49], ' '))) AS dup FROM pos),
cov AS (SELECT DISTINCT id, i + k AS i FROM win, range(0, 50) AS r(k) WHERE dup),
w AS (SELECT id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
k AS (SELECT w.id, count(cov.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (cov.i IS NULL), '') AS kept FROM w LEFT JOIN cov USING (id, i) GROUP BY w.id)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (id)""",
    "op7_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight FROM d GROUP BY source),
f AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS goal,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM s),
l AS (SELECT max((goal - full_before) / weight_left) FILTER ((goal - full_before) / weight_left * weight <= cap) AS level FROM f),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM f, l),
o AS (SELECT d.doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('42:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
  (budget // source_size * size + greatest(0, least(size, budget - budget // source_size * source_size - before)))::BIGINT END AS taken FROM o""",
    "op10_hamming_top_k": """
WITH v AS (SELECT vec_id AS id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0 AND NOT isnan(embedding[i]), false)) AS bits FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.id AS query_id, v.id, list_sum(list_transform(range(1, 65), lambda i: (q.bits[i] <> v.bits[i])::INT))::BIGINT AS distance FROM v AS q JOIN v ON q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, id, distance, rank FROM r WHERE rank <= 10""",
    "op12_warc_index": """
WITH p AS (SELECT row_number() OVER () AS id, page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, sha1(html) AS hex, row_number() OVER w AS k, first_value(page_id) OVER w AS top FROM p
  WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || hex[5 * i + 1 : 5 * i + 5])::BIGINT) AS parts FROM r)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(parts, lambda v: array_to_string(
    list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v >> s) % 32 + 1]), '')), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM v""",
    "op13_conversation_trie": """
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))) % 6 AS h FROM ids),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
given AS (SELECT h.conv_id, t.role, t.text, t.i FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND t.i <= h.h),
n AS (SELECT h.conv_id, h.h, count(given.i) AS k FROM h LEFT JOIN given USING (conv_id) GROUP BY ALL),
r AS (SELECT * FROM given UNION ALL SELECT t.conv_id, t.role, t.text, t.i - n.h + n.k FROM t JOIN n USING (conv_id) WHERE t.i > n.h),
c AS (SELECT conv_id, i AS depth, length(text) AS size, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY i)
    OVER (PARTITION BY conv_id ORDER BY i)) AS node FROM r),
c0 AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent FROM c),
p AS (SELECT conv_id, depth, size, node, parent, depth = n AS ends FROM c0
  UNION ALL SELECT ids.conv_id, 0, 0, 'root', NULL, ids.conv_id NOT IN (SELECT conv_id FROM r) FROM ids),
node AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, min(size) AS size,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM p GROUP BY node),
kids AS (SELECT parent, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * size AS saved FROM node LEFT JOIN kids ON kids.parent = node.node),
lines AS (SELECT DISTINCT a.node AS top, b.node AS sub FROM p AS a JOIN p AS b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT top, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM lines JOIN full_ ON full_.node = lines.sub GROUP BY top)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ AS f LEFT JOIN full_ AS up ON up.node = f.parent JOIN sums ON sums.top = f.node""",
    "op8_url_filter": """
WITH p AS (SELECT row_number() OVER () AS id, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS t(verdict, rule_host, rule_path)),
f AS (SELECT p.page_id, host, path, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY p.id ORDER BY len(string_split(rule_host, '.')) DESC NULLS LAST, length(rule_path) DESC, verdict DESC) AS rank
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE rank = 1""",
}

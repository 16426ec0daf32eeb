"""Token alignment against both tokenizers run on whole texts, and groups found token by token."""

import hashlib
from collections import Counter, defaultdict

from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from stratocloud.llm import token_alignment
from stratocloud.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    None, "", " ", "  a  b ", "x ▁ y", "日本語 テキスト 👩‍👩‍👧 é è", "<|endoftext|> <s> </s> <0x41>", "a" * 5000, "= " * 300 + "=" * 999,
    "don't  we\t\tgo\r\n\r\nnow", "١٢٣ ３４５ 12345   x\u0085y 　z", "\u001c \u001d a  b", "\0 a\0b", "The house, the houses; THE HOUSE 1999. " * 400,
    "one two three four", "one two three four", "one two three four five", "word\n" * 50,
]


def _docs(spark):
    rows = [(k, t, "x", [1]) for k, t in enumerate(TEXTS)] + [(None, "null id two", "y", None), (3, "  a  b ", "x", [1]), (3, "other", "x", [2])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, slice string, pairs array<int>").repartition(3)


def _groups(text, a, b, sizes):
    """The ids of both sides and their groups, or none where the bytes are not those of the text."""
    ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
    tokens = [[of[i] for i in own] for own, of in zip(ids, sizes)]
    if not text or any(b"".join(t) != (" " + text).encode() for t in tokens):
        return [], [], []
    ends, found = [], []
    for side in tokens:
        at = 0
        ends.append([at := at + len(t) for t in side])
    before = 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        found.append(tuple([i for i, e in zip(own, at) if before < e <= end] for own, at in zip(ids, ends)))
        before = end
    return *ids, found


def _brute(rows):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    words = token_alignment.Words(A, B)
    docs = [(i, *_groups(t, a, b, (words.a_bytes, words.b_bytes))) for i, t in rows]
    links = [[(m, n) for left, right in groups for m in left for n in right] for *_, groups in docs]
    counts, best = Counter(p for own in links for p in set(own)), defaultdict(int)
    for (m, _), n in counts.items():
        best[m] = max(best[m], n)
    text = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [
        (
            i, len(x), len(y), len(groups), len(own), sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own),
            hashlib.sha256(text(groups).encode()).hexdigest() if groups else "",
        )
        for (i, x, y, groups), own in zip(docs, links)
    ]


def _found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_alignment_matches_brute_force(spark):
    docs = _docs(spark)
    want = sorted(_brute([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    assert _found(token_alignment.align(docs, A, B)) == want
    assert _found(token_alignment.align(docs, A, B, slice_bytes=50)) == want  # a slice for nearly every document
    assert sum(r[3] for r in want) > 4000 and sum(r[1] == 0 for r in want) >= 3


def test_memory_may_be_dropped_at_any_step(spark, monkeypatch):
    docs = _docs(spark).select("doc_id", "text").collect()
    for limit in ("REMEMBERED", "REMEMBERED_BYTES", "LINKS"):
        monkeypatch.setattr(token_alignment, limit, 1)
    memory = token_alignment.Windows(token_alignment.Words(A, B))
    import pyarrow as pa

    now = token_alignment.Slice()
    for r in docs:
        now.add(memory, pa.array([r.doc_id], pa.int64()), [r.text])
    row = now.row(1, pa.int64()).to_pylist()[0]
    want = _brute([(r.doc_id, r.text) for r in docs])
    assert list(zip(row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["groups_sha256"])) == [(*w[1:5], w[7]) for w in want]
    pairs = Counter(p for *_, groups in (_groups_of(memory, r.text) for r in docs) for p in {(m, n) for x, y in groups for m in x for n in y})
    assert dict(zip(row["pairs"], row["docs"])) == {m << 32 | n: k for (m, n), k in pairs.items()}


def _groups_of(memory, text):
    return _groups(text, memory.words.a, memory.words.b, (memory.words.a_bytes, memory.words.b_bytes))


def test_groups_are_spans_of_the_text(spark):
    for r in token_alignment.groups(_docs(spark), A, B).join(_docs(spark), "doc_id").filter("doc_id > 5").collect():
        at = 0
        for g in r.groups:
            assert g.start == at < g.end and g.a and g.b
            at = g.end
        assert at == (len((" " + r.text).encode()) if r.groups else 0)


def test_empty_table(spark):
    assert _found(token_alignment.align(_docs(spark).filter("1 = 0"), A, B)) == []

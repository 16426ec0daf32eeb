"""The trie of conversations against one built prefix by prefix."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from stratocloud.llm.conversation_trie import build, chained, digested, prefix_trie, rebuilt, two_fattest
from stratocloud.llm.queries import ORACLES

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(60), 100, 101, 102, 103, 110, 150, 199, 205, 206, 207, 301, -5, 10**12]:
        last = c % 7 if c < 40 else c
        rows += [(c, k, "user" if k % 2 else None, f"{'é' * (k + 1)} {last if k > 1 else 0} {rng.randint(0, 1)}") for k in range(rng.randint(1, 9))]
    rows += [(50, None, "system", None), (50, 1, "user", "tie b"), (50, 1, "user", "tie a"), (51, 0, "user", ""), (None, 0, "user", "nobody's"), (199, None, None, None)]
    rows += [(400, k, "r", f"turn {k}") for k in range(70)] + [(401, k, "r", f"turn {k}") for k in range(70)]
    for c in range(500, 530):  # a chain: each conversation continues the one before
        rows += [(c, k, "r", f"link {k}") for k in range(c - 499)]
    return [(*r, "x", b"p", 1) for r in rows]


def _conversations(spark):
    return spark.createDataFrame(_rows(), "conv_id bigint, turn bigint, role string, text string, id string, p binary, depth int").repartition(3)


def _turns(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(own)] for c, own in by.items()}


def _rebuilt(rows):
    turns, out = _turns(rows), {}
    for c, own in turns.items():
        h, donor = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = turns.get(donor, [])[:h] + own[h:]
    return out


def _brute(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in nodes:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(nodes[node]) - 1) * len(node[-1][1]) if node else 0)
    ends = defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
    return sorted(
        (
            (
                min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(kids[node]), leaves[node], saved[node],
                hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
            )
            for node, members in nodes.items()
        ),
        key=str,
    )


def _found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_trie_matches_brute_force(spark):
    want = _brute(_rebuilt(_rows()))
    assert _found(prefix_trie(rebuilt(digested(_conversations(spark))))) == want
    assert any(r[1] == 70 for r in want) and any(r[3] > 5 and r[1] > 3 for r in want)


def test_trie_without_rebuilding(spark):
    assert _found(prefix_trie(digested(_conversations(spark)))) == _brute(_turns(_rows()))


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in _rows()])
    got = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_conversation_trie']})").fetchall()
    assert sorted(got, key=str) == _brute(_rebuilt(_rows()))


def test_rebuilt_without_turns_and_empty_tables(spark):
    rows = [(c, 0, "r", "only") for c in range(201, 215)]  # no conversation 200: with h > 0 nothing is left
    convs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = _brute(_rebuilt(rows))
    assert _found(prefix_trie(rebuilt(digested(convs)))) == want and want[0][3] < 14 or len(want) <= 2
    none = _found(prefix_trie(rebuilt(digested(convs.filter("1 = 0")))))
    assert none == []
    alone = _found(prefix_trie(rebuilt(digested(convs.filter(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)) > 0)))))
    assert len(alone) == 1 and alone[0][1:3] == (0, None) and alone[0][4:6] == (0, 1)


def test_nodes_are_where_strings_branch_or_end(spark):
    convs = chained(digested(_conversations(spark)))
    strings = convs.groupBy(F.col("end").alias("id")).agg(F.first("p").alias("p"), F.first("sums").alias("sums"))
    nodes, owned = build(strings)
    paths = [tuple(r.p) for r in strings.select("p").collect()]
    kids = defaultdict(set)
    for p in paths:
        for d in range(len(p)):
            kids[p[:d]].add(p[d])
    want = {p[-1] for p in paths} | {p[-1] for p, k in kids.items() if p and len(k) > 1}
    rows = nodes.collect()
    assert sorted(bytes(r.id) for r in rows) == sorted(map(bytes, want))
    depth = {bytes(x): d + 1 for p in paths for d, x in enumerate(p)}
    for r in rows:
        assert r.high == depth[bytes(r.id)] and r.low == depth.get(bytes(r.parent), 0) and len(r.edge) == r.high - r.low == len(r.sums) - 1
        fat = max(range(r.low + 1, r.high + 1), key=lambda d: d & -d)
        assert bytes(r.handle) == bytes(r.edge[fat - r.low - 1]) and bytes(r.first) == bytes(r.edge[0])
    assert owned.count() == strings.count()


@pytest.mark.parametrize("top", [1, 2, 7, 8, 100, 1025])
def test_two_fattest(spark, top):
    rows = spark.range(top).selectExpr("CAST(id AS INT) AS low", f"{top} AS high").select("low", two_fattest(F.col("low"), F.col("high")).alias("f")).collect()
    assert all(r.f == max(range(r.low + 1, top + 1), key=lambda d: d & -d) for r in rows)

"""A z-fast trie of conversations: which prefixes they share, and what each shared prefix saves.

A conversation is a string of turns; a turn stands for 128 bits of a hash of role and text, and each prefix for 128 bits that chain
them. Equal conversations become one string with a number of members. The compacted trie has a node where strings branch or end; a node's
edge is the stretch of depths from its parent's (excluded) to its own. The dictionary of the trie is keyed by handles: the prefix of a node at the
two-fattest depth of its edge, the one that is divisible by the largest power of two.

Strings are inserted in batches. All strings that are not yet in the trie search for their exit by fat binary search: each step looks the string's prefix at
the two-fattest depth of what is left of its range up in the dictionary, all strings in one join, and halves the range; after as many steps as the
longest range has bits the deepest node that the string passes is known, and one more join, by the first prefix of an edge, gives the edge on which it leaves. Strings that
leave at the same place by the same turn are a group, of which one, chosen by a hash, is inserted: edges are split at all places where
strings leave or end, and the chosen strings become leaves. The others go on below. Each batch leaves a random string's whole path behind, so
the number of batches is about the logarithm of a group's size, and at most the number of turns of the longest conversation. No group
is ever gathered.

Sums over subtrees need no walk up the tree: each is a sum over the strings that pass a node, with map-side combining. A string is the owner of the part of its path that it
brought into the trie; what a subtree's nodes cost once is the sum of their owners' parts. Lists of the conversations that end at a node are hashed in
order, in stretches that are joined up to ``STRETCH_BYTES`` first; no list is ever in memory whole.

Edge cases: null role or text is empty, a null turn comes first, and turns that share a number follow role and text. Rows with a null conv_id
belong to no conversation and are left out. A conversation may have no turn at all after rebuilding; it ends at the root. An empty table gives no node.
Extra columns are ignored. Turns of a conversation travel as some 40 bytes each in one row; texts are read whole but never travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocloud.llm.common import kept

#: Of a list of conversations, joined before it is sent on.
STRETCH_BYTES = 1 << 16
ROOT = bytes(16)


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, in order: digest of role and text, and the code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(both.cast("binary"), 256)), 1, 16)
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(text).alias("hash"), digest.alias("digest"), F.length(text).alias("size"))
    rows = conversations.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(order)).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns exchanged for those of c - c % block; h is crc32 of c in decimal, modulo ``most``."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    donor = turns.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most - 1).alias("given"))
    rows = turns.withColumn("donor", F.col("conv_id") - F.col("conv_id") % block).join(donor, "donor", "left").withColumn("h", h)
    nothing = F.slice("turns", 1, 0)
    given = F.coalesce(F.slice("given", F.lit(1), F.col("h")), nothing)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(given, own).alias("turns"))


def chained(turns: DataFrame) -> DataFrame:
    """conv_id, p (digests of the prefixes of 1, 2, ... turns), sums (code points of the first 0, 1, 2, ... turns) and end, the digest of all turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, sums, ends = [], [], []
            for turns in batch.column(1).to_pylist():
                last, own, total = ROOT, [], [0]
                for t in turns:
                    last = xxhash.xxh3_128_digest(last + t["digest"])
                    own.append(last)
                    total.append(total[-1] + t["size"])
                prefixes.append(own)
                sums.append(total)
                ends.append(last)
            columns = [batch.column(0), pa.array(prefixes, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64())), pa.array(ends, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "p", "sums", "end"])

    return turns.mapInArrow(run, "conv_id bigint, p array<binary>, sums array<bigint>, end binary")


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the largest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high).cast("long"))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


_NODE = ("id", "low", "high", "handle", "first", "parent", "edge", "sums")


def _nodes(rows: DataFrame) -> DataFrame:
    """Nodes from low, high, parent, edge (prefixes at depths low + 1 to high) and sums (code points down to depths low to high)."""
    at = lambda depth: F.element_at("edge", (depth - F.col("low")).cast("int"))
    rows = rows.withColumns({"id": F.element_at("edge", -1), "first": F.element_at("edge", 1), "handle": at(two_fattest(F.col("low"), F.col("high")))})
    return rows.select(*_NODE)


def _exits(strings: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """Adds to strings (id, p, low) the depth at which each leaves the trie, and the node on whose edge it does (null at a node's own depth).

    ``low`` is the depth of a node that the string is known to pass. Rows that look for nothing have their own id as key, so that they
    do not meet in one task."""
    now = strings.withColumn("top", F.size("p"))
    handles = nodes.select(F.col("handle").alias("key"), F.col("id").alias("found"), F.col("low").alias("begin"), F.col("high").alias("depth"))
    for _ in range(steps):
        fat = F.when(F.col("low") < F.col("top"), two_fattest(F.col("low"), F.col("top")))
        now = now.withColumn("fat", fat).withColumn("key", F.coalesce(F.try_element_at("p", F.col("fat")), F.col("id")))
        now = now.join(handles, "key", "left")
        over, missed = F.col("fat").isNull(), F.col("found").isNull()
        passes = F.coalesce(F.try_element_at("p", F.col("depth")) == F.col("found"), F.lit(False))
        # a string that reaches the handle but not the node leaves on this edge, whose beginning it passes
        low = F.when(over | missed, F.col("low")).when(passes, F.col("depth")).otherwise(F.col("begin"))
        top = F.when(over, F.col("top")).when(missed, F.col("fat") - 1).when(passes, F.col("top")).otherwise(F.col("begin"))
        now = now.withColumns({"low": low, "top": top}).drop("key", "found", "begin", "depth", "fat")
    edges = nodes.select(F.col("first").alias("key"), F.col("id").alias("node"), "edge")
    now = now.withColumn("next", F.try_element_at("p", F.col("low") + 1)).withColumn("key", F.coalesce("next", "id")).join(edges, "key", "left")
    on_edge = F.col("next").isNotNull() & F.col("node").isNotNull()
    both = F.arrays_zip(F.col("edge").alias("e"), F.slice("p", F.col("low") + 1, F.greatest(F.size("edge"), F.lit(0))).alias("q"))
    same = F.size(F.filter(both, lambda x: x["e"] == x["q"]))
    depth = F.col("low") + F.when(on_edge, same).otherwise(0)
    return now.withColumns({"depth": depth, "node": F.when(on_edge, F.col("node"))}).drop("low", "top", "next", "edge", "key")


def _split(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Nodes whose edges are cut at the depths in (node, depth)."""
    cuts = cuts.groupBy("node").agg(F.array_sort(F.collect_set("depth")).alias("cuts"))  # at most as many as the edge is long
    rows = nodes.join(cuts, nodes["id"] == cuts["node"], "left")
    whole = rows.filter("cuts IS NULL").select(*_NODE)
    points = F.concat(F.array("low"), "cuts", F.array("high")).alias("points")
    parts = rows.filter("cuts IS NOT NULL").select("low", "edge", "sums", "parent", points, F.explode(F.sequence(F.lit(1), F.size("cuts") + 1)).alias("k"))
    begin, end = F.element_at("points", F.col("k")), F.element_at("points", F.col("k") + 1)
    start, n = begin - F.col("low"), end - begin
    parent = F.when(F.col("k") == 1, F.col("parent")).otherwise(F.try_element_at("edge", F.nullif(start, F.lit(0))))
    cut = {"edge": F.slice("edge", start + 1, n), "sums": F.slice("sums", start + 1, n + 1)}
    parts = parts.select(begin.alias("low"), end.alias("high"), parent.alias("parent"), *(v.alias(c) for c, v in cut.items()))
    return whole.unionByName(_nodes(parts))


def build(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the compacted trie below the root, and (id, own): the depth from which on each string owns its path.

    ``strings``: id (the digest of all turns), p and sums of distinct strings of one turn or more."""
    pending = kept(strings.select("id", "p", "sums", F.lit(0).alias("low")))
    left, longest = pending.agg(F.count("*"), F.max(F.size("p"))).first()
    nodes = _nodes(pending.filter("1 = 0").select("low", F.size("p").alias("high"), F.col("id").alias("parent"), F.col("p").alias("edge"), "sums"))
    owned = pending.filter("1 = 0").select("id", F.col("low").alias("own"))
    first = True
    while left:
        if first:
            found = pending.withColumns({"node": F.lit(None).cast("binary"), "depth": F.lit(0)}).drop("low")
        else:
            found = kept(_exits(pending, nodes, int(longest).bit_length()))
        place = F.coalesce(F.try_element_at("p", F.nullif("depth", F.lit(0))), F.lit(ROOT))
        found = found.withColumns({"place": place, "next": F.try_element_at("p", F.col("depth") + 1)})
        leading = found.filter("next IS NOT NULL").groupBy("next").agg(F.min_by("id", F.xxhash64("id")).alias("id"))  # a prefix names its place, too
        chosen = found.join(leading, ["next", "id"], "left_semi")
        n = F.size("p") - F.col("depth")
        tail = F.slice("p", F.col("depth") + 1, n).alias("edge"), F.slice("sums", F.col("depth") + 1, n + 1).alias("sums")
        leaves = chosen.select(F.col("depth").alias("low"), F.size("p").alias("high"), F.col("place").alias("parent"), *tail)
        ended = found.filter("next IS NULL").select("id", F.size("p").alias("own"))
        new = kept(chosen.select("id", F.col("depth").alias("own")).unionByName(ended))
        owned = new if first else owned.unionByName(new)
        inner = found.filter("node IS NOT NULL").select("node", "depth")
        nodes = kept(_nodes(leaves) if first else _split(nodes, inner).unionByName(_nodes(leaves)))
        pending = kept(found.join(new, "id", "left_anti").select("id", "p", "sums", F.col("depth").alias("low")))
        left, first = pending.count(), False
    return nodes, owned


def _lines(nodes: DataFrame) -> DataFrame:
    """(id, line): each node's own and all its ancestors' depths and ids, by doubling."""
    lines = kept(nodes.select("id", F.array(F.struct(F.col("high").alias("depth"), F.col("id").alias("node"))).alias("line"), F.col("parent").alias("up")))
    root = F.lit(ROOT)
    while not lines.filter(F.col("up") != root).isEmpty():
        above = lines.select(F.col("id").alias("key"), F.col("line").alias("more"), F.col("up").alias("further"))
        key = F.when(F.col("up") != root, F.col("up")).otherwise(F.col("id"))  # those at the root ask for themselves, and do not use it
        both = lines.withColumn("key", key).join(above, "key", "left")
        open_ = F.col("up") != root
        lines = kept(both.select("id", F.when(open_, F.concat("line", "more")).otherwise(F.col("line")).alias("line"), F.when(open_, F.col("further")).otherwise(F.col("up")).alias("up")))
    return lines.select("id", "line")


def _ends(convs: DataFrame) -> DataFrame:
    """(end, ends_sha256): the digest of the list of conversations that end at each node, read in order and never held whole."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, first, ids, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for e, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (e != end or size >= STRETCH_BYTES):
                    out.append((end, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    end, first = e, c
                ids.append(str(c))
                size += len(ids[-1])
            if ids:
                out.append((end, first, ",".join(ids)))
                ids, size = [], 0
            yield _batch(out, ("end", "first", "ids"), (pa.binary(), pa.int64(), pa.string()))
            out = []

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, state = None, None
        for batch in batches:
            out = []
            for e, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if e != end:
                    if state:
                        out.append((end, state.hexdigest()))
                    end, state = e, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(out, ("end", "ends_sha256"), (pa.binary(), pa.string()))
        if state:
            yield _batch([(end, state.hexdigest())], ("end", "ends_sha256"), (pa.binary(), pa.string()))

    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = convs.select("end", "conv_id").repartitionByRange(n, "end", "conv_id").sortWithinPartitions("end", "conv_id")
    rows = rows.mapInArrow(join, "end binary, first bigint, ids string")
    return rows.repartition(n, "end").sortWithinPartitions("end", "first").mapInArrow(digest, "end binary, ends_sha256 string")


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], list(names))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of (conv_id, turns): conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    convs = kept(chained(turns))
    strings = convs.groupBy(F.col("end").alias("id")).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("p").alias("p"), F.first("sums").alias("sums"))
    strings = kept(strings)
    nodes, owned = build(strings.filter(F.size("p") > 0))
    children = kept(nodes.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children")))
    lines = _lines(nodes)
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit(ROOT).alias("node")))
    each = strings.join(owned, "id", "left").join(children, "id", "left").join(lines, "id", "left")
    line = F.explode(F.concat(F.coalesce("line", F.slice(root, 1, 0)), root)).alias("x")
    each = each.select("n", "conv_id", "sums", F.coalesce("own", F.lit(0)).alias("own"), F.col("n_children").isNull().cast("long").alias("leaf"), line)
    before = F.greatest(F.col("x.depth") - 1, F.lit(0))
    to = lambda depth: F.element_at("sums", depth + 1)
    all_ = F.element_at("sums", -1)
    saved = F.col("n") * (all_ - to(before)) - (all_ - to(F.greatest("own", before)))
    stats = each.select(F.col("x.node").alias("id"), "n", "conv_id", "leaf", saved.alias("saved")).groupBy("id").agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved"),
    )
    stats = kept(stats.join(children, "id", "left").join(_ends(convs).withColumnRenamed("end", "id"), "id", "left"))
    parents = stats.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    rows = nodes.select("id", "parent", "low", "high", "sums").join(stats, "id").join(parents, "parent")
    rows = rows.withColumn("depth", F.explode(F.sequence(F.col("low") + 1, F.col("high"))))
    at = lambda depth: F.element_at("sums", depth - F.col("low") + 1)
    own, nothing = F.col("depth") == F.col("high"), F.lit(hashlib.sha256(b"").hexdigest())
    count = F.coalesce("n_children", F.lit(0)).cast("long")
    below = rows.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == F.col("low") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(own, count).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * (at(F.col("high") - 1) - at(F.col("depth") - 1))).alias("saved_tokens"),
        F.when(own, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
    )
    top = stats.filter(F.col("id") == F.lit(ROOT)).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", count.alias("n_children"), "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    return top.unionByName(below)

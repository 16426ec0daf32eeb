"""WARC archives of pages, and a two-level index of their captures.

Writing: every page becomes a record, compressed by itself. Of pages with equal payloads of at least ``least`` bytes the one with the
largest id is a response and the others are revisits of it; which is which comes from counts of digests, so only compressed records, not
payloads, are shuffled, and revisits leave theirs behind. Each task appends to archives of its own in the shared folder
and returns where its records are; the written table of captures has those of the attempts that succeeded, so files of lost or repeated attempts are
never read.

Index: captures are dealt into ranges of (key, id) and sorted. A range is a shard: blocks of ``BLOCK_LINES`` lines, each compressed by itself,
and a sparse directory with each block's first key and place. Keys are URLs with the host's labels reversed, so that a domain's pages
stand together. The table of shards (two key prefixes a shard, at most ``MAX_SHARDS`` rows) is what is broadcast.

Reading: keys are sorted by ranges; each is searched for in the table of shards, then in the shard's directory, and meets the blocks that may hold it;
a URL with very many captures has many blocks, which are dealt apart. A block is read as a range of its file and searched for its keys. The records
found are read in order of their places, neighbours together.

Edge cases: null html is an empty payload, a null url has an empty key, a null page_id counts as smaller than any. Of rows that repeat id, url and payload one
can be the response and the others revisit it; of payloads under ``least`` all are responses. An empty table gives no archives and no rows.
Extra columns are ignored. Texts are written whole.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocloud.llm.common import kept, shared_dir
from stratocloud.llm.packing import _slices

ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 3000
SHARD_LINES = 1_000_000
MAX_SHARDS = 10_000
#: Bytes of a shard's first and last key that are compared; longer keys that agree so far are looked for in all shards that may hold them.
BOUND = 128
#: Of an archive, whose records are read by one task in order, and the most that is read at once.
STRETCH_BYTES = 64 << 20
READ_BYTES = 8 << 20
#: Directories that a reading task keeps.
DIRECTORIES = 8
DATE = "2000-01-01T00:00:00Z"  # pages have no date; WARC asks for one

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def url_key(url: Column) -> Column:
    """The host's labels reversed and joined by commas, ``)``, and path and query; white space is escaped."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)).otherwise(F.regexp_extract(url, r"(?s)^([^#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _escaped(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def _escaped(text: Column) -> Column:
    """Without what separates fields and lines of the index."""
    for raw, escaped in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id: str | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, repr((page_id, url, digest)))}>"


def _plain(value: str) -> str:
    """A header's value: line ends would end it."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _member(kind: str, page_id: str | None, url: str | None, digest: str, size: int, payload: bytes, refers: tuple[str | None, str | None] | None) -> bytes:
    """A record, compressed by itself. ``refers``: id and url of the response that a revisit repeats."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, url, digest)), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", _plain(url))] if url is not None else []
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head += [("X-Page-Id", page_id)] if page_id is not None else []
    if refers:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(*refers, digest))]
        head += [("WARC-Refers-To-Target-URI", _plain(refers[1]))] if refers[1] is not None else []
        head += [("X-Refers-To-Page-Id", refers[0])] if refers[0] is not None else []
    head.append(("Content-Length", str(len(block))))
    text = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return zlib.compress(text.encode() + block + b"\r\n\r\n", 6, 31)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of its block, and the payload."""
    data = zlib.decompress(member, 31)
    at = data.index(b"\r\n\r\n")
    fields = lambda raw: dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])
    head = fields(data[:at])
    block = data[at + 4 : at + 4 + int(head["Content-Length"])]
    if head["WARC-Type"] == "warcinfo":
        return head, {}, block
    at = block.index(b"\r\n\r\n")
    return head, fields(block[:at]), block[at + 4 :]


def repeated_payloads(pages: DataFrame, least: int = 0) -> DataFrame:
    """digest, and page_id, url and number of rows (n) of its response, for each payload that several rows have."""
    digest = F.unhex(F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    rows = pages.select("page_id", "url", digest.alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    rows = rows.filter(F.col("size") >= least).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    top = rows.groupBy("digest").agg(F.max(F.struct("page_id", "url", "n")).alias("top"), F.sum("n").alias("all")).filter(F.col("all") > 1)
    return top.select("digest", *(F.col(f"top.{c}").alias(f"top_{c}") for c in ("page_id", "url", "n")))


def _responses(pages: DataFrame) -> DataFrame:
    """page_id (as text), url, digest, payload_bytes and the record of each page as a response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(2)):
                ids, urls = (batch.column(k).slice(at, len(texts)).to_pylist() for k in (0, 1))
                digests, sizes, members = [], [], []
                for i, url, t in zip(ids, urls, texts):
                    payload = t.encode() if t else b""
                    digest = hashlib.sha1(payload).digest()
                    digests.append(digest)
                    sizes.append(len(payload))
                    members.append(_member(RESPONSE, i, url, base32(digest), len(payload), payload, None))
                columns = [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(sizes, pa.int64()), pa.array(members, pa.binary())], ["page_id", "url", "digest", "payload_bytes", "member"],
                )

    schema = "page_id string, url string, digest binary, payload_bytes bigint, member binary"
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInArrow(run, schema)


def _typed(pages: DataFrame, least: int) -> DataFrame:
    """Every page's record-to-be: ``member`` for a response, ``top_page_id`` and ``top_url`` for a revisit."""
    copies = kept(repeated_payloads(pages, least).withColumn("top_page_id", F.col("top_page_id").cast("string")))
    rows = _responses(pages).join(copies, "digest", "left")
    is_top = F.col("page_id").eqNullSafe(F.col("top_page_id")) & F.col("url").eqNullSafe(F.col("top_url"))
    kind = F.when(F.col("top_n").isNull() | is_top, RESPONSE).otherwise(REVISIT)
    rows = rows.withColumn("kind", kind).withColumn("member", F.when(F.col("kind") == RESPONSE, F.col("member")))
    out = ["page_id", "url", "digest", "payload_bytes", "member", "kind", "top_page_id", "top_url"]
    if copies.filter("top_n > 1").isEmpty():
        return rows.select(*out)
    # Rows that repeat a response in everything: one is written as such, the others as its revisits.
    again = (F.col("kind") == RESPONSE) & (F.coalesce(F.col("top_n"), F.lit(1)) > 1)
    first = rows.filter(again).groupBy("digest", "top_page_id", "top_url", "top_n").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("member").alias("member"))
    first = first.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top_n"))))
    first = first.withColumns({"page_id": F.col("top_page_id"), "url": F.col("top_url"), "kind": F.when(F.col("k") == 1, RESPONSE).otherwise(REVISIT)})
    first = first.withColumn("member", F.when(F.col("k") == 1, F.col("member")))
    return rows.filter(~again).select(*out).unionByName(first.select(*out))


@dataclass
class Archives:
    """``captures``: page_id (text), url, kind, digest, payload_bytes, file, offset and length of every record; ``path``: the archives' folder."""

    path: str
    captures: DataFrame


def write_archives(pages: DataFrame, path: str | None = None, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> Archives:
    """Writes a record for each row of ``pages`` (page_id, url, html) below ``path``, which all executors must reach."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _opened(path)
        fs.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                places: dict[str, list] = {"file": [], "offset": [], "length": []}
                for row in batch.to_pylist():
                    if out is None or at >= archive_bytes:
                        if out:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                        at = out.write(_information(name))
                    member, digest = row["member"], base32(row["digest"])
                    if member is None:
                        refers = row["top_page_id"], row["top_url"]
                        member = _member(REVISIT, row["page_id"], row["url"], digest, row["payload_bytes"], b"", refers)
                    out.write(member)
                    for key, value in zip(places, (name, at, len(member))):
                        places[key].append(value)
                    at += len(member)
                columns = {c: batch.column(c) for c in ("page_id", "url", "kind", "digest", "payload_bytes")}
                columns |= {"file": pa.array(places["file"], pa.string()), "offset": pa.array(places["offset"], pa.int64()), "length": pa.array(places["length"], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)
        finally:
            if out:
                out.close()

    schema = "page_id string, url string, kind string, digest binary, payload_bytes bigint, file string, offset bigint, length bigint"
    return Archives(path, kept(_typed(pages, least).mapInArrow(run, schema)))


def _information(name: str) -> bytes:
    body = "software: stratocloud\r\nformat: WARC File Format 1.1\r\n"
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name, "")), ("WARC-Date", DATE), ("WARC-Filename", name)]
    head += [("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
    return zlib.compress((VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + body + "\r\n\r\n").encode(), 6, 31)


@dataclass
class Index:
    """``shards``: (first key, last key, name) of every shard in order, keys cut to ``BOUND`` bytes; ``path``: its folder, ``archives``: that of the archives."""

    path: str
    archives: str
    shards: list[tuple[bytes, bytes, str]]

    def may_hold(self, key: bytes) -> list[str]:
        """Names of the shards that may hold a key, by binary search for the last that begins no later."""
        key, found = key[:BOUND], []
        k = bisect.bisect_right(self.shards, key, key=lambda s: s[0])
        while k and self.shards[k - 1][1] >= key:
            found.append(self.shards[k - 1][2])
            k -= 1
        return found


def build_index(archives: Archives, path: str | None = None, block_lines: int = BLOCK_LINES, shard_lines: int = SHARD_LINES) -> Index:
    spark = archives.captures.sparkSession
    path = path or f"{shared_dir(spark)}/cdx-{uuid.uuid4().hex}"
    cores = spark.sparkContext.defaultParallelism
    n_lines = archives.captures.count()
    n = min(MAX_SHARDS, max(-(-n_lines // shard_lines), min(cores, -(-n_lines // block_lines)), 1))
    rows = archives.captures.select(url_key(F.col("url")).alias("key"), _escaped(F.col("page_id")).alias("page_id"), "kind", "file", "offset", "length")
    rows = rows.repartitionByRange(n, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _opened(path)
        name, out, at = uuid.uuid4().hex, None, 0
        block: list[bytes] = []
        directory: list[bytes] = []
        first = last = b""

        def end_block() -> None:
            nonlocal at
            data = zlib.compress(b"\n".join(block), 6, 31)
            directory.append(b"\t".join([block[0].split(b"\t", 1)[0], b"%d" % at, b"%d" % len(data)]))
            out.write(data)
            at += len(data)
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                line = "\t".join("" if v is None else str(v) for v in row).encode()
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{name}.cdx.gz", compression=None)
                    first = row[0].encode()
                last = row[0].encode()
                block.append(line)
                if len(block) >= block_lines:
                    end_block()
        if out:
            if block:
                end_block()
            out.close()
            with fs.open_output_stream(f"{folder}/{name}.idx.gz", compression=None) as f:
                f.write(zlib.compress(b"\n".join(directory), 6, 31))
            yield pa.RecordBatch.from_pydict({"first": [first[:BOUND]], "last": [last[:BOUND]], "name": [name]})

    shards = kept(rows.mapInArrow(run, "first binary, last binary, name string")).collect()  # at most MAX_SHARDS rows
    return Index(path, archives.path, sorted((bytes(s["first"]), bytes(s["last"]), s["name"]) for s in shards))


def _blocks(index: Index, keys: DataFrame) -> DataFrame:
    """(name, at, size, key): the blocks that may hold each key."""
    shared = keys.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        fs, folder = _opened(own.path)
        open_now: OrderedDict[str, tuple] = OrderedDict()

        def directory(name: str) -> tuple[list[bytes], list[tuple[int, int]]]:
            if name not in open_now:
                if len(open_now) >= DIRECTORIES:
                    open_now.popitem(last=False)
                with fs.open_input_file(f"{folder}/{name}.idx.gz") as f:
                    lines = [x.split(b"\t") for x in zlib.decompress(f.read(), 31).split(b"\n")]
                open_now[name] = [x[0] for x in lines], [(int(x[1]), int(x[2])) for x in lines]
            return open_now[name]

        for batch in batches:
            found: list[tuple] = []
            for key in batch.column(0).to_pylist():
                raw = key.encode()
                for name in own.may_hold(raw):
                    firsts, places = directory(name)
                    # all blocks that begin with the key, and the one before them
                    for k in range(max(0, bisect.bisect_left(firsts, raw) - 1), bisect.bisect_right(firsts, raw)):
                        found.append((name, *places[k], key))
            for k in range(0, len(found), 10_000):
                part = list(zip(*found[k : k + 10_000]))
                yield pa.RecordBatch.from_pydict({c: list(v) for c, v in zip(("name", "at", "size", "key"), part)})

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.repartitionByRange(n, "key").sortWithinPartitions("key")
    return keys.mapInArrow(run, "name string, at bigint, size bigint, key string")


def lookup(index: Index, urls: DataFrame) -> DataFrame:
    """key, page_id (text), kind, file, offset and length of all captures of each url in column ``url``."""
    keys = urls.select(url_key(F.col("url")).alias("key")).distinct()
    path = index.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _opened(path)
        here, lines, firsts, source = None, [], [], None
        for batch in batches:
            found: list[bytes] = []
            for name, at, size, key in zip(*(c.to_pylist() for c in batch.columns)):
                if here != (name, at):
                    if here is None or here[0] != name:
                        if source:
                            source.close()
                        source = fs.open_input_file(f"{folder}/{name}.cdx.gz")
                    here = name, at
                    lines = zlib.decompress(source.read_at(size, at), 31).split(b"\n")
                    firsts = [x.split(b"\t", 1)[0] for x in lines]
                raw = key.encode()
                found += lines[bisect.bisect_left(firsts, raw) : bisect.bisect_right(firsts, raw)]
                if len(found) >= 10_000:
                    yield _captures(found)
                    found = []
            if found:
                yield _captures(found)
        if source:
            source.close()

    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(index, keys).repartition(n, "name", "at").sortWithinPartitions("name", "at", "key")
    return blocks.mapInArrow(run, "key string, page_id string, kind string, file string, offset bigint, length bigint")


def _captures(lines: list[bytes]) -> pa.RecordBatch:
    key, page_id, kind, file, offset, length = zip(*(x.decode().split("\t") for x in lines))
    numbers = [pa.array(list(map(int, v)), pa.int64()) for v in (offset, length)]
    texts = [pa.array(list(v), pa.string()) for v in (key, [p or None for p in page_id], kind, file)]
    return pa.RecordBatch.from_arrays([*texts, *numbers], ["key", "page_id", "kind", "file", "offset", "length"])


def read_records(index: Index, captures: DataFrame, page_id: T.DataType | None = None, payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, with ``payload``, what responses hold, of each capture.

    A response whose payload has another digest than its header says ends in an error."""
    path = index.archives

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _opened(path)
        here, source = None, None
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            k = 0
            while k < len(files):
                if here != files[k]:
                    if source:
                        source.close()
                    here, source = files[k], fs.open_input_file(f"{folder}/{files[k]}")
                to, end = k + 1, offsets[k] + lengths[k]  # records that follow one another are read together
                while to < len(files) and files[to] == here and offsets[to] == end and end + lengths[to] - offsets[k] <= READ_BYTES:
                    end += lengths[to]
                    to += 1
                data = source.read_at(end - offsets[k], offsets[k])
                if len(data) < end - offsets[k]:
                    raise ValueError(f"{here} ends before its record at {offsets[k]}")
                yield _read([data[o - offsets[k] : o - offsets[k] + n] for o, n in zip(offsets[k:to], lengths[k:to])], payload)
                k = to
        if source:
            source.close()

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = captures.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / STRETCH_BYTES))
    places = places.repartition(n, "file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")
    found = places.mapInArrow(run, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload)
    kind = page_id or T.StringType()
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def _read(members: list[bytes], payload: bool) -> pa.RecordBatch:
    rows = []
    for member in members:
        head, http, body = parse(member)
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        response = head["WARC-Type"] == RESPONSE
        if response and base32(hashlib.sha1(body).digest()) != digest:
            raise ValueError(f"the payload of {head['WARC-Record-ID']} has another digest than {digest}")
        size = len(body) if response else int(http["Content-Length"])
        row = (head.get("X-Page-Id"), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], head.get("X-Refers-To-Page-Id"))
        rows.append((*row, body if response else None) if payload else row)
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], list(names[: len(columns)]))


def through_archives(pages: DataFrame, least: int = 0, payload: bool = False) -> DataFrame:
    """Writes the pages' archives and their index, looks every url up and returns the records found (``read_records``)."""
    archives = write_archives(pages, least=least)
    index = build_index(archives)
    return read_records(index, lookup(index, pages.select("url")), pages.schema["page_id"].dataType, payload)

"""Archives, their index and what is read back."""

import base64
import gzip
import hashlib
import io
from collections import defaultdict

import duckdb
import pyarrow.fs as pafs
import pytest

from stratocloud.llm import warc
from stratocloud.llm.queries import ORACLES

PAGES = [
    (0, "http://a.example.org/x?y=1#z", "<p>é</p>"), (1, None, None), (2, "https://b.example.org/", ""), (3, "no scheme at all\n", "x" * 300_000),
    (4, "http://u:p@A.Example.org:80/x y\tz", "copy"), (5, "http://a.example.org/x?y=1", "copy"), (7, "http://a.example.org/x?y=1", "copy"),
    (None, "http://a.example.org/x?y=1", "copy"), (None, None, "null id"), (9, "http://c.net/", "again"), (9, "http://c.net/", "again"),
    (9, "http://c.net/", "again"), (9, "http://d.net/", "again"), (8, "http://c.net/", "again"), (9, "http://c.net/", "other"),
] + [(100 + k, "http://hot.example.com/", f"page {k % 37}") for k in range(400)]


def _pages(spark):
    rows = [(*p, "k", b"x", 3) for p in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, key string, digest binary, offset int").repartition(3)


def _want(rows, least=0):
    groups = defaultdict(list)
    for i, url, html in rows:
        groups[html or ""].append((i is not None, i or 0, url is not None, url or "", i))
    found = []
    for html, group in groups.items():
        data = html.encode()
        ranked = sorted(group, reverse=True)
        for k, own in enumerate(ranked):
            response = k == 0 or len(data) < least
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            found.append((own[-1], len(data), digest, "response" if response else "revisit", None if response else ranked[0][-1]))
    return sorted(found, key=str)


def _found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 5, 10_000])
def test_pages_come_back(spark, least):
    assert _found(warc.through_archives(_pages(spark), least=least)) == _want(PAGES, least)


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    got = con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLES['op12_warc_index']})").fetchall()
    assert sorted(got, key=str) == _want(PAGES)


def test_archives_are_plain_warc_files(spark):
    """Read by a reader of its own: members one after the other, each with the headers that the format asks for."""
    archives = warc.write_archives(_pages(spark), archive_bytes=2_000)
    fs, folder = warc._opened(archives.path)
    listed = {r.file: [] for r in archives.captures.collect()}
    for r in archives.captures.collect():
        listed[r.file].append((r.offset, r.length, r.kind))
    ids, n = defaultdict(set), 0
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        data = fs.open_input_file(info.path).read()
        whole = gzip.decompress(data)
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        end = 0
        for offset, length, kind in sorted(listed[info.base_name]):
            raw = gzip.GzipFile(fileobj=io.BytesIO(data[offset : offset + length])).read()
            head, http, body = warc.parse(data[offset : offset + length])
            assert raw.endswith(b"\r\n\r\n") and head["WARC-Type"] == kind and head["WARC-Date"] and int(http["Content-Length"]) >= len(body)
            ids[kind].add(head["WARC-Record-ID"])
            if kind == "revisit":
                ids["refers"].add(head["WARC-Refers-To"])
                assert head["WARC-Profile"] == warc.REVISIT_PROFILE and body == b""
            assert end == 0 or offset == end
            end, n = offset + length, n + 1
        assert end == len(data)
    assert n == len(PAGES) and len(listed) > 3 and ids["refers"] <= ids["response"]


def test_index_finds_all_captures_of_a_url(spark):
    archives = warc.write_archives(_pages(spark))
    index = warc.build_index(archives, block_lines=7, shard_lines=60)  # the hot url has blocks in several shards
    assert len(index.shards) > 3 and sum(1 for s in index.shards if s[0] <= b"com,example,hot)/" <= s[1]) > 2
    asked = spark.createDataFrame([("http://hot.example.com/#x",), ("http://HOT.example.com/",), ("http://a.example.org:8080/x?y=1",), ("http://none.org/",)], "url string")
    found = warc.read_records(index, warc.lookup(index, asked))
    rows = found.collect()
    want = [p for p in PAGES if p[1] in ("http://hot.example.com/", "http://a.example.org/x?y=1", "http://a.example.org/x?y=1#z")]
    assert sorted(str(r.page_id) for r in rows) == sorted(str(p[0]) for p in want)
    texts = {str(i): html for i, _, html in want}
    assert all(r.payload.decode() == texts[r.page_id] for r in rows if r.record_type == "response")
    keys = sorted(r.key for r in archives.captures.select(warc.url_key(archives.captures.url).alias("key")).distinct().collect())
    assert ")" in keys and "org,example,a)/x%20y%09z" in keys and ")no%20scheme%20at%20all%0A" in keys


def test_long_keys_share_their_bounds(spark):
    pages = spark.createDataFrame([(k, f"http://x.org/{'a' * 300}{k:03}", str(k)) for k in range(90)], "page_id bigint, url string, html string")
    archives = warc.write_archives(pages)
    index = warc.build_index(archives, block_lines=4, shard_lines=10)
    assert len(index.shards) > 4
    found = warc.lookup(index, pages.select("url")).select("page_id").collect()
    assert sorted(int(r.page_id) for r in found) == list(range(90))


def test_a_changed_payload_is_an_error(spark):
    archives = warc.write_archives(spark.createDataFrame([(1, "http://x.org/", "body")], "page_id bigint, url string, html string"))
    place = archives.captures.first()
    member = warc._member("response", "1", "http://x.org/", place.digest and warc.base32(bytes(place.digest)), 4, b"bodx", None)
    with pytest.raises(ValueError, match="another digest"):
        warc._read([member], True)


def test_empty_table(spark):
    assert _found(warc.through_archives(_pages(spark).filter("1 = 0"))) == []

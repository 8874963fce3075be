import hashlib
import os

import pytest

from gatewise.llm import warc

TRICKY = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc</p>"


def _written(spark, tmp_path, rows, **how):
    path = str(tmp_path / "archives")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_pages(pages.withColumnRenamed("page_id", "page_id"), path, **how)
    return path


def _expected(rows, least=1000):
    """page_id, bytes, digest, type, refers_to by brute force; repeats of the kept page revisit it."""
    raw = [((-(2**63) if p is None else p), p, (h or "").encode()) for p, _, h in rows]
    out, kept = [], {}
    for key, p, body in sorted(raw, key=lambda r: r[0], reverse=True):
        first = len(body) < least or body not in kept
        if first and len(body) >= least:
            kept[body] = p
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "response" if first else "revisit", None if first else kept[body]))
    return sorted(out, key=str)


def _found(spark, path):
    got = warc.page_digests(warc.read_records(spark, path))
    assert got.where("problem is not null").count() == 0
    return sorted((tuple(r) for r in got.drop("problem").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [
    (1, "http://a/1", "x" * 999),
    (2, "http://a/2", "x" * 999),  # equal but short: both are responses
    (3, "http://a/3", "y" * 1000),
    (7, "http://a/7", "y" * 1000),
    (5, None, "y" * 1000),
    (7, "http://a/7", "y" * 1000),  # a repeated row
    (None, "http://a/n", "y" * 1000),
    (8, "bad\r\nWARC-Type: x é", None),
    (9, "http://a/9", ""),
    (10, "http://a/10", TRICKY * 40 + "é€😀"),
    (11, "http://a/11", "é€😀" * 30_000),  # many segments, cut inside characters
    (-4, "http://a/m", "z\r\n\r\n"),
]


@pytest.mark.parametrize("segment", [100, 16 * 1024])
def test_round_trip(spark, tmp_path, segment):
    path = _written(spark, tmp_path, ROWS, segment_bytes=segment)
    assert _found(spark, path) == _expected(ROWS)


def test_payloads_come_back_whole_when_files_are_split(spark, tmp_path):
    path = _written(spark, tmp_path, ROWS * 3, segment_bytes=500)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (700, 4099, 65536 + 11):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert _found(spark, path) == _expected(ROWS * 3)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_every_part_file_is_a_sequence_of_records_by_length(spark, tmp_path):
    path = _written(spark, tmp_path, ROWS, segment_bytes=500)
    n = 0
    for name in os.listdir(path):
        if name.startswith("part-"):
            data = open(f"{path}/{name}", "rb").read()
            at = 0
            while at < len(data):
                head = data.index(b"\r\n\r\n", at)
                end = head + 4 + int(warc.fields(data[at:head])["content-length"])
                assert data[at:].startswith(b"WARC/1.1\r\n") and data[end : end + 4] == b"\r\n\r\n"
                at, n = end + 4, n + 1
    assert n > len(ROWS)


def test_a_separator_inside_another_writers_payload(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(TRICKY) + TRICKY.encode()
    data = b"".join(warc._record("response", f"urn:x:{i}", "http://a", i, body, []) + b"\r\n\r\n" for i in range(5))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(data)
    (tmp_path / "in" / "b.warc").write_bytes(warc._record("warcinfo", "urn:x:w", None, None, b"a: b", []) + b"\r\n\r\n" + warc._record("response", "urn:x:9", "http://a", 9, b"HTTP/1.0 200 OK\r\n\r\nhi", []) + b"\r\n\r\n")
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(spark, str(tmp_path / "in")).collect()}
    assert got == {**{i: TRICKY for i in range(5)}, 9: "hi"}


def test_damaged_segments_are_told(spark, tmp_path):
    def records(page, spoil):
        return spoil(warc.page_records(f"urn:p:{page}", "http://a", page, b"q" * 1000, None, 300))

    whole = records(1, lambda r: r[::-1])
    lost = records(2, lambda r: r[:1] + r[2:])
    first = records(3, lambda r: r[1:])
    other = records(4, lambda r: [*r, r[1].replace(b"qqqq", b"wqqq", 1)])
    short = records(5, lambda r: [x.replace(b"Total-Length: 1", b"Total-Length: 2") for x in r])
    digest = records(6, lambda r: [x.replace(b"sha1:", b"sha1:A") for x in r])
    again = records(7, lambda r: r + r)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in [*whole, *lost, *first, *other, *short, *digest, *again]))
    got = {r["record_id"]: r["problem"] for r in warc.read_records(spark, str(tmp_path / "in")).collect()}
    assert got == {"urn:p:1": None, "urn:p:2": "segment missing", "urn:p:3": "segment missing", "urn:p:4": "segments differ", "urn:p:5": "total length", "urn:p:6": "digest", "urn:p:7": None}


def test_revisit_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(warc.page_records("urn:r", "http://a", 1, b"x", "urn:gone", 300)[0] + b"\r\n\r\n")
    row = warc.page_digests(warc.read_records(spark, str(tmp_path / "in"))).first()
    assert (row["page_id"], row["payload_bytes"], row["refers_to"], row["problem"]) == (1, None, None, "no response")


def test_chunk_framing():
    for body in (b"", b"a", b"ab" * 5000, TRICKY.encode()):
        assert warc.dechunked(warc.chunked(body, 7)) == body
        assert warc.BORDER.encode() not in warc.chunked(body)
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    assert warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n") is None and warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"") is None


def test_empty_table_and_clashing_columns(spark, tmp_path):
    path = _written(spark, tmp_path, [])
    assert _found(spark, path) == []
    rows = spark.createDataFrame([(1, "u", "h", "x", 5)], "page_id long, url string, html string, payload string, row int")
    warc.write_pages(rows, str(tmp_path / "more"))
    assert len(_found(spark, str(tmp_path / "more"))) == 1


def test_hot_join_beyond_the_broadcast_bound(spark, monkeypatch):
    from gatewise.llm import store

    monkeypatch.setattr(store, "MOST_BROADCAST", 0)
    rows = spark.range(5000).selectExpr("case when id < 3000 then 'hot' when id < 3010 then null else concat('k', id) end k", "id")
    keyed = spark.range(2900, 4000).selectExpr("concat('k', id) k", "id v").unionAll(spark.createDataFrame([("hot", -1)], "k string, v long"))
    got = {r["id"]: r["v"] for r in store.hot_join(rows, keyed, "k").collect()}
    assert got == {i: -1 if i < 3000 else i if 3010 <= i < 4000 else None for i in range(5000)}

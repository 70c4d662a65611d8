import gzip
from collections import defaultdict

import pytest

from tidemark.llm import shared, warc


def test_round_trip_matches_brute_force(spark):
    rows = [(i, f"http://h{i % 5}/a b\n{i}", f"<p>é {i % 7}</p>\r\n\r\nWARC/1.1\n" * (i % 3), "x") for i in range(60)]
    rows += [(60, None, None, "x"), (61, "u", "", "y"), (None, "v", "null id", "z"), (62, "big", "ß" * 300000, "q"), (7, "again", "<p>", None), (7, "again", "<p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    ids = {r["record_id"]: r for r in got}
    assert len(ids) == len(rows)  # repeated rows too
    for r in got:
        if r["record_type"] == "revisit":
            to = ids[r["refers_to_id"]]
            assert (to["record_type"], to["page_id"], to["payload_digest"]) == ("response", r["refers_to"], r["payload_digest"])
        else:
            assert r["refers_to_id"] is None
    groups = defaultdict(list)
    for i, _, html, _ in rows:
        groups[(html or "").encode()].append(i)
    by = defaultdict(list)
    for r in got:
        by[r["payload_digest"]].append(r)
    assert len(by) == len(groups)
    for payload, ids in groups.items():
        own, top = by[warc.sha1_base32(payload)], max((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) and {r["payload_bytes"] for r in own} == {len(payload)}
        assert [r["page_id"] for r in own if r["record_type"] == "response"] == [top]
        assert all(r["refers_to"] == top for r in own if r["record_type"] == "revisit") and all(r["refers_to"] is None for r in own if r["record_type"] == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_both_arc_versions_are_parsed(version, tmp_path, spark):
    body = warc.arc_head(version, "x.arc").encode() + b"\n" + warc.arc_record(version, 5, "http://a/ b", "<p>\n1 2 3", "x.arc") + b"\n\n" + warc.arc_record(version, None, "u", "", "x.arc") + b"\n"
    first, second = warc.parse_arc(body)
    assert first.version == version and first.url == "http://a/%20b" and warc.split_http(first.content)[1:] == (b"<p>\n1 2 3", 5)
    assert warc.split_http(second.content)[1:] == (b"", None)
    members = b"".join(gzip.compress(x) for x in (body[:50], body[50:]))
    assert warc.inflate(members) == warc.inflate(members + b"\0") == body and warc.iso_date("20240203") == "2024-02-03T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(body[:-20]))
    assert shared.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_payloads_of_any_encoding_are_kept(spark, tmp_path):
    """An archive of another maker: Latin-1 payloads, no page ids, not even HTTP headers in one record."""
    blocks = [b"HTTP/1.0 200 OK\r\n\r\n\xe9t\xe9\x00\xff", b"\xff\xfe raw", b"HTTP/1.0 404\r\n\r\n\xe9t\xe9\x00\xff"]
    head = warc.arc_head(1, "old.arc").encode()
    data = head + b"".join(b"\nhttp://old/%d 1.2.3.4 19970102030405 text/html %d\n%s" % (i, len(b), b) for i, b in enumerate(blocks)) + b"\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0.arc.gz").write_bytes(gzip.compress(data))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {r["url"]: r for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert len(got) == 3 and all(r["intact"] and r["date"] == "1997-01-02T03:04:05Z" for r in got.values())
    assert [got[f"http://old/{i}"]["payload_bytes"] for i in range(3)] == [5, 6, 5]
    assert sorted(r["record_type"] for r in got.values()) == ["response", "response", "revisit"]


def test_files_are_bounded_and_records_are_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    files = list(warc._files_of(iter([b"r%d" % i * 500 for i in range(9)] + [b"x" * 9000, b"y"]), lambda k: b"head%d" % k, b"\n"))
    content = [warc.inflate(f["value"][0]) for f in files]
    assert len(content) == 5 and all(c.startswith(b"head%d\n" % i) for i, c in enumerate(content)) and b"".join(content).count(b"\n") == 11 + 5
    assert all(f["value"][0].count(b"\x1f\x8b\x08") == c.count(b"\n") for f, c in zip(files, content))
    pages = spark.createDataFrame([(i, f"u{i}", "<p>%d</p>" % (i % 3) * 40000) for i in range(120)], "page_id long, url string, html string").coalesce(1)
    warc.write_arc(pages, str(tmp_path / "arc"))
    parts = sorted(p for p in (tmp_path / "arc").iterdir() if p.name.startswith("part-"))
    assert len(parts) == 5  # 43 MB in files of 8, and a bit
    assert gzip.decompress(parts[0].read_bytes()).startswith(b"filedesc://0-part-00000.arc")
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(120)) and sum(r["record_type"] == "response" for r in got) == 3 and all(r["intact"] for r in got)

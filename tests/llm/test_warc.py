from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pytest

from graphloom.llm.warc import read_chunks, records, round_trip, write_chunks, write_record


def file_of(payloads, gz=False):
    out = io.BytesIO()
    for k, p in enumerate(payloads):
        one = io.BytesIO()
        write_record(one, f"urn:row:{k}", f"http://x/{k}", p, "text/html")
        out.write(gzip.compress(one.getvalue()) if gz else one.getvalue())
    return out.getvalue()


PAYLOADS = [b"", b"a", b"x" * 100, random.Random(1).randbytes(1000), b"\r\n\r\nWARC/1.1\r\n" * 9]


@pytest.mark.parametrize("gz", [False, True])
@pytest.mark.parametrize("chunk", [1, 7, 100, 5000])
def test_round_trip(gz, chunk):
    got, seen = {}, {}
    for row in records(io.BytesIO(file_of(PAYLOADS, gz)), chunk):
        k = row["record_id"]
        assert row["chunk_no"] == seen.get(k, -1) + 1 and row["byte_offset"] == len(got.get(k, b"")) and row["n_bytes"] <= chunk
        seen[k] = row["chunk_no"]
        got[k] = got.get(k, b"") + row["payload"]
        assert row["sha256"] == hashlib.sha256(got[k]).hexdigest()  # of the payload so far
        assert row["is_last"] == (len(got[k]) == row["content_length"]) and row["digest_ok"] is (True if row["is_last"] else None)
    assert [got[f"urn:row:{k}"] for k in range(len(PAYLOADS))] == PAYLOADS


def test_an_oversized_payload_is_never_held_whole():
    """The reader asks for a stream that is far larger than what it may keep."""

    class Endless(io.RawIOBase):
        size, given, most = 64 << 20, 0, 0
        head = b"WARC/1.0\r\nWARC-Record-ID: <big>\r\nContent-Length: %d\r\n\r\n" % (64 << 20)

        def read(self, n):
            self.most = max(self.most, n)
            if self.head:
                out, self.head = self.head[:n], self.head[n:]
                return out
            out = b"y" * min(n, self.size - self.given)
            self.given += len(out)
            return out

    stream, rows, size = Endless(), 0, 0
    for row in records(stream, 1 << 16):
        rows += 1
        size += row["n_bytes"]
    assert stream.most <= 1 << 18 and rows == 1025 and size == 64 << 20 and row["error"]  # the end of the record is missing


def test_damage_is_told_and_what_came_before_stays():
    whole = file_of(PAYLOADS[2:4])
    for cut in (10, 150, len(whole) - 500):
        rows = list(records(io.BytesIO(whole[:cut]), 64))
        assert rows[-1]["error"] and all(r.get("error") is None for r in rows[:-1])
    rows = list(records(io.BytesIO(whole.replace(b"xxxx", b"xxyx", 1)), 64))
    assert [r["digest_ok"] for r in rows if r["is_last"]] == [False, True]
    assert list(records(io.BytesIO(b""))) == [] and list(records(io.BytesIO(b"junk\n")))[0]["error"]
    assert list(records(io.BytesIO(file_of(PAYLOADS, True)[:-30])))[-1]["error"]
    folded = b"WARC/1.0\r\nwarc-type: response\r\nX: a\r\n b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [(r["warc_type"], r["payload"]) for r in records(io.BytesIO(folded))] == [("response", b"hi")]
    assert list(records(io.BytesIO(b"WARC/1.0\r\nContent-Length: x\r\n\r\n")))[0]["error"]


def test_tables(spark, tmp_path):
    long = "é" * 100_000
    rows = [(1, "http://a/\n b", "<p>"), (2, None, None), (3, "u", ""), (4, "u", long), (4, "u", long), (None, None, "x")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, chunk_no string")
    got = {}
    for r in round_trip(spark, pages, chunk_bytes=4096).orderBy("page_id", "chunk_no").collect():
        assert r["error"] is None and (not r["is_last"] or r["digest_ok"])
        got.setdefault((r["page_id"], r["target_uri"]), []).append(bytes(r["payload"]))
    assert {k: b"".join(sorted(set(v), key=v.index)) if k[0] != 4 else len(v) for k, v in got.items()} == {
        (1, "http://a/ b"): b"<p>", (2, None): b"", (3, "u"): b"", (4, "u"): 2 * -(-200_000 // 4096), (None, None): b"x",
    }
    assert round_trip(spark, pages.limit(0)).count() == 0
    (tmp_path / "one.warc.gz").write_bytes(file_of(PAYLOADS, True))
    paths = spark.createDataFrame([(f"file://{tmp_path}/one.warc.gz",), (None,), (f"file://{tmp_path}/missing.warc",)], "path string")
    found = read_chunks(paths).collect()
    assert sum(r["is_last"] and r["error"] is None for r in found) == len(PAYLOADS) and sum(r["error"] is not None for r in found) == 1


@pytest.mark.parametrize("gz", [False, True])
def test_a_fault_costs_no_other_record(gz):
    def one(k, uri=None, change=lambda x: x):
        out = io.BytesIO()
        write_record(out, f"urn:row:{k}", uri or f"http://x/{k}", b"payload %d" % k, "text/html")
        return (gzip.compress if gz else bytes)(change(out.getvalue()))

    uri = "data:" + "x" * 700_000
    whole = (
        one(0) + one(1, uri) + one(2, change=lambda x: x.replace(b"Content-Length", b"Content-Other")) + one(3)
        + one(4, change=lambda x: x.replace(b"payload 4\r\n\r\n", b"payload 4 and more\r\n\r\n")) + one(5) + (gzip.compress if gz else bytes)(b"junk\nmore junk\n") + one(6)
        + one(7, change=lambda x: x[:-4]) + one(8)
    )
    rows = list(records(io.BytesIO(whole)))
    good = {r["record_id"]: r for r in rows if r.get("payload") is not None}
    assert [good[f"urn:row:{k}"]["payload"] for k in (0, 1, 3, 4, 5, 6, 7, 8)] == [b"payload %d" % k for k in (0, 1, 3, 4, 5, 6, 7, 8)]
    assert good["urn:row:1"]["target_uri"] == uri and all(r["digest_ok"] for r in good.values())
    assert [r.get("record_id") for r in rows if r.get("error")] == ["urn:row:2", "urn:row:4", None, "urn:row:7"]


def test_a_page_of_a_very_long_uri_stays(spark):
    pages = spark.createDataFrame([(k, "u" * (200_000 if k == 3 else 5), f"<{k}>") for k in range(8)], "page_id long, url string, html string").coalesce(1)
    got = round_trip(spark, pages).collect()
    assert sorted((r["page_id"], len(r["target_uri"]), bytes(r["payload"]).decode()) for r in got) == [(k, 200_000 if k == 3 else 5, f"<{k}>") for k in range(8)]


def test_no_length_loops_or_ends_the_file():
    bad = b"WARC/1.0\r\nContent-Length: -5\r\n\r\nhello\r\n\r\n"
    rows = list(records(io.BytesIO(bad + file_of([b"good"]))))
    assert [bool(r.get("error")) for r in rows] == [True, False] and rows[1]["payload"] == b"good"


@pytest.mark.parametrize("name", ["md5", "sha1", "sha256", "SHA-1"])
def test_digests_in_hex_and_base_32(name):
    raw = hashlib.new(name.lower().replace("-", ""), b"hi").digest()
    for text, want in ((raw.hex(), True), (base64.b32encode(raw).decode(), True), (base64.b32encode(raw).decode().rstrip("=").lower(), True), (base64.b32encode(raw[1:] + b"x").decode(), False), ("ABC", None)):
        file = f"WARC/1.0\r\nWARC-Block-Digest: {name}:{text}\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n".encode()
        assert [r["digest_ok"] for r in records(io.BytesIO(file))] == [want], text


def test_paths_that_are_none_and_reads_that_break_off(spark, tmp_path, monkeypatch):
    (tmp_path / "ok.warc").write_bytes(file_of([b"x"]))
    paths = [("plain/path.warc",), ("nosuch://a/b",), (f"file://{tmp_path}",), (f"file://{tmp_path}/ok.warc",)]
    found = {r["path"]: r["error"] for r in read_chunks(spark.createDataFrame(paths, "path string")).collect()}
    assert [bool(found[p]) for (p,) in paths] == [True, True, True, False]

    from graphloom.llm import warc

    def broken(stream, chunk):
        yield from list(records(io.BytesIO(file_of([b"x"]))))
        raise OSError("gone")

    monkeypatch.setattr(warc, "records", broken)
    rows = list(warc._of_file(f"file://{tmp_path}/ok.warc", 9))
    assert [r.get("error") for r in rows] == [None, "reading broke off: OSError"] and rows[1]["record_no"] == 1


def test_ids_of_any_type_come_back_and_end_no_line(spark):
    ids = ["a", "x>\r\nContent-Length: 0\r\n\r\n", "null", None, "ü + %41"]
    pages = spark.createDataFrame([(i, "u", f"<{i}>") for i in ids], "key string, url string, html string")
    got = {r["key"]: bytes(r["payload"]).decode() for r in round_trip(spark, pages, id_col="key").collect()}
    assert got == {i: f"<{i}>" for i in ids}


def test_chunks_become_records_again(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(file_of(PAYLOADS))
    (tmp_path / "b.warc.gz").write_bytes(file_of(PAYLOADS[::-1], True))
    read = lambda paths: read_chunks(spark.createDataFrame([(p,) for p in paths], "path string"), chunk_bytes=70)
    chunks = read([f"file://{tmp_path}/a.warc", f"file://{tmp_path}/b.warc.gz"]).cache()
    files = write_chunks(chunks.union(chunks.limit(3)), f"file://{tmp_path}/out").collect()
    assert sum(r["records"] for r in files) == 2 * len(PAYLOADS)
    again = read([r["path"] for r in files]).collect()
    got = {}
    for r in sorted(again, key=lambda r: (r["path"], r["record_no"], r["chunk_no"])):
        assert r["error"] is None and r["digest_ok"] in (None, True)
        got.setdefault((r["path"], r["record_no"]), b"")
        got[r["path"], r["record_no"]] += bytes(r["payload"])
    assert sorted(got.values()) == sorted(PAYLOADS * 2)
    assert write_chunks(chunks.limit(0), f"file://{tmp_path}/out").collect() == []

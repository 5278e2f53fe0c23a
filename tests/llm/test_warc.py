import base64
import gzip
import hashlib
import zlib

from trackloom.llm import warc


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_pages_come_back_with_roles(spark):
    schema = "page_id bigint, url string, html string, payload string, keeper string"
    rows = [(1, "http://a/", "same é", "?", "?"), (2, None, "same é", "?", "?"), (3, "u", None, "?", "?"), (4, "u", "", "?", "?"), (5, "u", "x" * 300000, "?", "?"), (6, "u\r\nEvil: 1", "\r\n\r\nWARC/1.1", "?", "?"), (6, "u\r\nEvil: 1", "\r\n\r\nWARC/1.1", "?", "?"), (None, "u", "alone", "?", "?")]
    got = sorted((tuple(r) for r in warc.archive_pages(spark, spark.createDataFrame(rows, schema)).collect()), key=repr)
    last = {}
    for page, _, html, *_ in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    want = []
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        keeper = last[html or ""]
        revisit = keeper >= 0 and page != keeper
        want.append((page, len(body), sha(body), "revisit" if revisit else "response", keeper if revisit else None, True))
    assert got == sorted(want, key=repr)
    empty = warc.archive_pages(spark, spark.createDataFrame([], schema))
    assert empty.collect() == [] and empty.columns[0] == "page_id"


def test_reader_reports_damage_and_goes_on(spark, tmp_path):
    good = warc.record_bytes("response", "1", None, "u", sha(b"one"), b"one")
    wrong_digest = warc.record_bytes("response", "2", None, "u", sha(b"other"), b"two")
    wrong_frame = gzip.compress(zlib.decompress(good, 31).replace(b"Content-Length: 3", b"Content-Length: 9"))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(good + wrong_digest + wrong_frame + gzip.compress(b"no header") + good + good[:-9])
    read = warc.read_archives(spark.createDataFrame([(str(path),)], "archive string"))
    rows = sorted(read.collect(), key=lambda r: r["position"])
    assert [r["valid"] for r in rows] == [True, False, False, False, True, False]
    assert rows[0]["payload"] == bytearray(b"one") and rows[1]["fault"] == "payload digest differs"
    assert rows[5]["fault"] == "cut off"


def test_members_do_not_depend_on_piece_size(tmp_path, monkeypatch):
    import pyarrow.fs as pafs

    blob = b"".join(warc.record_bytes("response", str(i), None, None, sha(b"p" * i * 999), b"p" * i * 999) for i in range(9))
    (tmp_path / "b").write_bytes(blob)
    seen = []
    for piece in (7, 1 << 16):
        monkeypatch.setattr(warc, "PIECE", piece)
        with pafs.LocalFileSystem().open_input_stream(str(tmp_path / "b")) as stream:
            seen.append(list(warc.members(stream)))
    assert seen[0] == seen[1] and len(seen[0]) == 9 and not any(f for _, f in seen[0])


def test_a_flipped_byte_costs_one_record(tmp_path, monkeypatch):
    import random

    import pyarrow.fs as pafs

    rng = random.Random(4)
    bodies = [bytes(rng.choice(b"abcdef <>") for _ in range(rng.randint(0, 900))) for _ in range(5)]
    records = [warc.record_bytes("response", str(i), None, None, sha(b), b) for i, b in enumerate(bodies)]
    ends = [sum(map(len, records[: i + 1])) for i in range(5)]
    blob = b"".join(records)
    for at in range(ends[0], ends[1]):
        broken = blob[:at] + bytes([blob[at] ^ (1 << at % 8)]) + blob[at + 1 :]
        (tmp_path / "c").write_bytes(broken)
        monkeypatch.setattr(warc, "PIECE", rng.choice((5, 300, 1 << 16)))
        with pafs.LocalFileSystem().open_input_stream(str(tmp_path / "c")) as stream:
            read = [warc.parse_record(*m) for m in warc.members(stream)]
        good = [r["block"] for r in read if not r["fault"]]
        # a flip in what gzip does not check leaves the record as it was
        assert good in ([bodies[0], *bodies[2:]], bodies), at
        assert len(good) == 5 or sum(bool(r["fault"]) for r in read) >= 1

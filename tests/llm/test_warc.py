import hashlib

from threadloom.llm import warc

BIG = "x" * 1500
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (2, "http://a/2", BIG), (None, None, BIG), (3, "u\r\nX-Bad: 1", "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", ""), (7, "u7", "é" * 700 + "\r\n\r\nWARC/1.1\r\n")]


def archive(spark, tmp_path, rows):
    path = str(tmp_path / "archive")
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, header string")
    warc.write_archive(pages, path)
    return path


def test_index(spark, tmp_path):
    found = warc.read_index(spark, archive(spark, tmp_path, ROWS)).collect()
    want = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and h == BIG and i != 2
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", "2" if revisit else None))
    assert sorted(((r.record, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == sorted(want, key=str)
    assert "u%0D%0AX-Bad: 1" in {r.url for r in found}


def test_payloads_once_and_records_in_full(spark, tmp_path):
    path = archive(spark, tmp_path, ROWS)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in ROWS})
    for r in warc.read_records(spark, path).collect():
        head, _, block = bytes(r.bytes).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert block[int(fields["Content-Length"]) :] == b"\r\n\r\n"
        if fields["WARC-Type"] == "response":
            payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
            assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()


def test_export_is_a_plain_sequence_of_records(spark, tmp_path):
    path, target = archive(spark, tmp_path, ROWS), tmp_path / "warc"
    warc.export_warc(spark, path, str(target))
    n = 0
    for file in target.glob("part-*"):
        data = file.read_bytes()
        while data:
            assert data.startswith(b"WARC/1.1\r\n")
            head, _, rest = data.partition(b"\r\n\r\n")
            length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
            assert rest[length : length + 4] == b"\r\n\r\n"
            data, n = rest[length + 4 :], n + 1
    assert n == len(ROWS)


def test_empty_and_all_null_ids(spark, tmp_path):
    assert warc.read_index(spark, archive(spark, tmp_path / "a", [])).count() == 0
    found = warc.read_index(spark, archive(spark, tmp_path / "b", [(None, "u", BIG), (None, "v", BIG)])).collect()
    assert {r.record_type for r in found} == {"response"}

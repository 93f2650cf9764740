import base64
import gzip
import hashlib
import io
import zlib

import pytest
from pyarrow.fs import FileSystem

from leafmill.llm import warc
from leafmill.session import scratch


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pages():
    rows = [(i, f"http://a/{i}", f"<p>page {i % 40}</p>" * (i % 7 + 1), "x") for i in range(120)]
    return rows + [(500, "http://a/ \r\nb", None, None), (501, None, "", "x"), (502, "u", "é😀" * 400_000, "x"), (3, "u", rows[3][2], "x"), (None, "u", "<p>page 1</p>", "x"), (None, "u", "own", "x")]


def expected(rows, least=0):
    last = 1 << 63
    first = {}
    for i, _, h, _ in rows:
        p = (h or "").encode()
        first[p] = min(first.get(p, last), last if i is None else i)
    out = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        again = len(p) >= least and (last if i is None else i) > first[p]
        out.append((i, len(p), digest(p), "revisit" if again else "response", first[p] if again else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 20])
def test_pages_come_back(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, archive string").repartition(4)
    got = warc.archived(frame, least_bytes=least, payloads=True).collect()
    assert expected(rows, least) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    for r in got:
        if r.record_type == "response":
            assert digest(bytes(r.payload)) == r.payload_digest
        else:
            assert r.payload is None


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(none).count() == 0


def test_each_record_is_a_member_and_the_sidecar_finds_it(spark):
    folder = scratch(spark, "warc-test")
    files, place = FileSystem.from_uri(folder)
    files.create_dir(f"{place}/whole")
    records = [warc.record(str(i), f"http://a/{i}", bytes([i]) * (i * 1000), None if i % 3 else "0") for i in range(30)]
    with files.open_output_stream(f"{place}/whole/one.warc.gz", compression=None) as out:
        out.write(gzip.compress(b"".join(records[:20])))
        out.write(gzip.compress(b"".join(records[20:])))  # two members are read as one stream
    archives = spark.createDataFrame([("one.warc.gz",)], "archive string")
    index = warc.normalise(archives, f"{folder}/whole", f"{folder}/members").collect()
    name = index[0].archive
    data = files.open_input_file(f"{place}/members/{name}").read()
    lines = files.open_input_file(f"{place}/members/{name}.idx").read().decode().splitlines()
    assert len(index) == len(lines) == 30
    for whole, line, row in zip(records, lines, sorted(index, key=lambda r: r.offset), strict=True):
        at, size, kind, name = line.split(" ")
        assert (row.offset, row.length, row.type, row.record) == (int(at), int(size), kind, name)
        assert zlib.decompress(data[int(at) : int(at) + int(size)], 31) == whole
    assert gzip.decompress(data) == b"".join(records)


def test_chunks_of_any_size(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    records = [warc.record(str(i), "u", b"x\r\n\r\n" * i, None) for i in range(9)]
    stream, found = warc.Stream(io.BytesIO(gzip.compress(b"".join(records)))), []
    while (head := stream.head()) is not None:
        found.append(head + b"".join(stream.take(int(warc.fields(head)["content-length"]) + 4)))
    assert found == records


def test_cut_off_archive_is_an_error():
    whole = gzip.compress(warc.record("1", "u", bytes(range(256)) * 100, None))
    stream = warc.Stream(io.BytesIO(whole[: len(whole) // 2]))
    with pytest.raises((ValueError, zlib.error)):
        head = stream.head()
        list(stream.take(int(warc.fields(head)["content-length"]) + 4))

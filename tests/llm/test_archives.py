import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from quillspark.llm import archives as A


def pages_df(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}\r\nno", h, 1) for i, h in rows], "page_id long, url string, html string, refers_to int")


def expected(rows):
    first = {}
    for i, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        f = first.get(raw)
        refers = f if f is not None and f != i else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


@pytest.mark.parametrize("size", [1, 700, 64 << 20])
def test_round_trip(spark, size):
    long = "é" * 60
    rows = [(5, long), (2, long), (9, long), (9, long), (3, "short"), (4, "short"), (7, None), (8, ""), (None, long), (None, "z" * 200), (None, "z" * 200), (1, "a\r\n\r\nb" * 40), (6, "x" * 300_000), (2, "again " * 30)]
    packages = A.write_archives(pages_df(spark, rows), A.new_folder(spark), package_bytes=size)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in A.read_archives(packages).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_empty_table(spark):
    packages = A.write_archives(pages_df(spark, []), A.new_folder(spark))
    assert A.read_archives(packages).count() == 0


def record(n):
    return A.warc_record("response", f"http://u/{n}", b"p" * n, headers={"X-Page-ID": str(n)}, digest="d")


def test_archives_without_index_and_deflated_ones():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/plain.warc", b"".join(record(n) for n in (10, 200_000, 30)))
        z.writestr("indexes/other.idx", "x")
        z.comment = b"a note PK\x05\x06"
    data = out.getvalue()
    got = list(A.records_of(io.BytesIO(data), len(data)))
    assert [h["x-page-id"] for _, _, h, _ in got] == ["10", "200000", "30"] and [len(A.payload_of(b)) for *_, b in got] == [10, 200_000, 30]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc", record(5))
    with pytest.raises(ValueError, match="stored"):
        list(A.records_of(io.BytesIO(out.getvalue()), len(out.getvalue())))


def zip64(name, data):
    """A ZIP file of one stored member all of whose lengths and offsets stand in ZIP64 fields."""
    pad = b"leading bytes"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    extra = struct.pack("<HHI", 0x7777, 4, 9) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), len(pad))
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(pad) + len(local) + len(data)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    return pad + local + data + central + end + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_zip64():
    data = zip64(b"archive/z.warc", record(7) + record(8))
    member = A.central_directory(io.BytesIO(data), len(data))[0]
    assert (member.name, member.size) == ("archive/z.warc", len(record(7) + record(8)))
    assert [h["x-page-id"] for _, _, h, _ in A.records_of(io.BytesIO(data), len(data))] == ["7", "8"]


def test_broken_files():
    for data in (b"", b"PK\x05\x06", b"not a zip at all" * 10):
        with pytest.raises(ValueError):
            A.central_directory(io.BytesIO(data), len(data))


def foreign(archives, indexes):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        for name, data in {**indexes, **archives}.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def gz(data):
    c = zlib.compressobj(9, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@pytest.mark.parametrize("kind", ["cdxj", "cdxj.gz", "cdx", "unknown", "two without names"])
def test_packages_of_other_writers(kind):
    """Index lines with JSON, compressed ones, CDX columns; and lines of no known form, so that the archives are read through."""
    numbers = {"one.warc.gz": (3, 70_000, 5), "two.warc.gz": (9, 1)}
    bodies, lines = {}, []
    for name, ns in numbers.items():
        at, data = 0, b""
        for n in ns:
            z = gz(record(n))
            lines.append((name, at, len(z), n))
            data, at = data + z, at + len(z)
        bodies[f"archive/{name}"] = data
    lines = [x for x in lines if x[3] != 5] if kind.startswith("cdx") else lines
    text = {
        "cdxj": "".join(f'com,u)/{n} 2020 {{"url": "http://u/{n}", "offset": "{at}", "length": {size}, "filename": "{name}"}}\n' for name, at, size, n in lines),
        "cdx": " CDX N b a S V g\n" + "".join(f"com,u)/{n} 2020 http://u/{n} {size} {at} {name}\n" for name, at, size, n in lines),
        "unknown": "some other index\n",
        "two without names": "".join(f"{at} {size} response\n" for _, at, size, _ in lines),
    }
    data = {"indexes/index.cdxj.gz": gzip.compress(("!meta\n" + text["cdxj"]).encode())} if kind == "cdxj.gz" else {"indexes/index.cdx": text[kind].encode()}
    package = foreign(bodies, data)
    got = [(name, h["x-page-id"], len(A.payload_of(b))) for name, _, h, b in A.records_of(io.BytesIO(package), len(package))]
    assert sorted(got) == sorted((f"archive/{name}", str(n), n) for name, _, _, n in lines)


def test_digests_of_other_kinds_are_not_compared(spark, tmp_path):
    body = A.warc_record("response", "http://u/1", b"text", headers={}, digest="x").replace(b"sha256:x", b"sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ")
    (tmp_path / "a.wacz").write_bytes(foreign({"archive/a.warc": body}, {}))
    packages = spark.createDataFrame([(f"file://{tmp_path}/a.wacz", (tmp_path / "a.wacz").stat().st_size)], "path string, size long")
    row = A.read_archives(packages).first()
    assert (row.page_id, row.payload_bytes, row.payload_digest) == (None, 4, hashlib.sha256(b"text").hexdigest())

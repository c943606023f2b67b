"""WARC archives packaged in ZIP files: a writer, and a reader that takes ranges of the files only.

Packages. A ZIP file holds stored members: archive/data.warc.gz (one gzip member a record) and
indexes/index.cdx (a line for each record: offset and length within the archive, then its type). The writer
closes a package once it holds package_bytes of records.

Reading. The end record, the ZIP64 locator and end record where there are any, and the central directory are
parsed from ranges at the file's end; a member's data begins after its local header, whose own name and
extra lengths count. Records are then read by the offsets of the package's indexes, plain or compressed: this
writer's lines, lines that end in a JSON object with offset, length and filename, or columns named by a CDX header. An
archive that no index line names, or of an index with a line of another form, is read one record after another. Nothing is extracted. Files are opened by their own store's file system, so a package may lie in any.

Tasks write files of names of their own and report them in a table; readers open only files of that table,
so what a lost or repeated task left behind is never read.

Defined results: a null payload is empty; equal payloads of least_bytes or more are revisits of the one with
the smallest page_id (rows of that same id are all responses); a row without page_id is never referred to.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


# --- ZIP ---


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


def read_at(source, offset: int, size: int) -> bytes:
    source.seek(offset)
    return source.read(size)


def central_directory(source, size: int) -> list[Member]:
    """Members of a ZIP file of size bytes, from its ZIP64 end record where it has one."""
    tail_at = max(0, size - 65_557)
    tail = read_at(source, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    locator_at = tail_at + at - 20
    if locator_at >= 0 and (locator := read_at(source, locator_at, 20))[:4] == b"PK\x06\x07":
        end = read_at(source, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("bad ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", end, 32)
    data = read_at(source, offset, length)
    out, p = [], 0
    for _ in range(count):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        flags, method = struct.unpack_from("<HH", data, p + 8)
        stored, full, n, extra, note = struct.unpack_from("<IIHHH", data, p + 20)
        header = struct.unpack_from("<I", data, p + 42)[0]
        name = data[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        q, stop = p + 46 + n, p + 46 + n + extra
        while q + 4 <= stop:
            kind, long = struct.unpack_from("<HH", data, q)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{long // 8}Q", data, q + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + long
        out.append(Member(name, method, full, stored, header))
        p = stop + note
    return out


def data_offset(source, member: Member) -> int:
    head = read_at(source, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n, extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + extra


def read_member(source, member: Member) -> bytes:
    raw = read_at(source, data_offset(source, member), member.stored)
    return raw if member.method == 0 else zlib.decompress(raw, -15)


# --- WARC ---


def warc_record(kind: str, url: str, payload: bytes, *, headers: dict[str, str], digest: str) -> bytes:
    """A record whose block is an HTTP response; a revisit's has no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((url, sorted(headers.items()), digest)))}>",
        "WARC-Target-URI": " ".join(url.split()),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        **headers,
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the beginning of raw."""
    end = raw.index(b"\r\n\r\n")
    first, *lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    return headers, raw[end + 4 : end + 4 + size], end + 4 + size + 4


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def gunzipped(raw: bytes) -> tuple[bytes, int]:
    """The first gzip member of raw, and its length."""
    d = zlib.decompressobj(31)
    out = d.decompress(raw)
    return out, len(raw) - len(d.unused_data)


def package(records: list[tuple[bytes, str]]) -> bytes:
    """A ZIP file of an archive of (record, type) and its index."""
    body, lines, at = io.BytesIO(), [], 0
    for record, kind in records:
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        z = c.compress(record) + c.flush()
        body.write(z)
        lines.append(f"{at} {len(z)} {kind}\n")
        at += len(z)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((ARCHIVE, body.getvalue()), (INDEX, "".join(lines).encode())):
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def index_entries(data: str) -> list[tuple[str | None, int, int]] | None:
    """Archive (None: not named), offset and length of each line of an index; None if a line is of no known form."""
    out, columns = [], None
    for line in data.splitlines():
        if not line.strip() or line.startswith(("!", "#")):
            continue
        if line.split()[0] == "CDX":
            columns = line.split()[1:]
            continue
        fields = line.split()
        try:
            if line.rstrip().endswith("}"):
                entry = json.loads(line[line.index("{") :])
                out.append((entry.get("filename"), int(entry["offset"]), int(entry["length"])))
            elif columns:
                entry = dict(zip(columns, fields, strict=True))
                out.append((entry.get("g"), int(entry["V"]), int(entry["S"])))
            else:
                out.append((None, int(fields[0]), int(fields[1])))
        except (ValueError, KeyError, IndexError, TypeError):
            return None
    return out


def indexed_places(source, members: list[Member], archives: list[Member]) -> dict[str, list[tuple[int, int]]]:
    """By archive, offsets and lengths of the records that the package's indexes name; none for archives that are to be read through."""
    places: dict[str, list[tuple[int, int]]] = {}
    for m in members:
        if not m.name.startswith("indexes/") or not m.name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            continue
        data = read_member(source, m)
        entries = index_entries((gzip.decompress(data) if m.name.endswith(".gz") else data).decode("utf-8", "replace"))
        if entries is None:
            return {}
        for name, offset, length in entries:
            own = [a for a in archives if name is None or a.name == name or a.name.rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1]]
            if len(own) != 1:
                return {}
            places.setdefault(own[0].name, []).append((offset, length))
    return places


def records_of(source, size: int) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """Archive, offset, headers and block of every record in a package."""
    members = central_directory(source, size)
    archives = [m for m in members if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))]
    places = indexed_places(source, members, archives)
    for m in archives:
        if m.method:
            raise ValueError(f"{m.name} isn't stored")
        begin = data_offset(source, m)
        zipped = m.name.endswith(".gz")
        if m.name in places:
            for at, length in places[m.name]:
                raw = read_at(source, begin + at, length)
                headers, block, _ = parse_record(gunzipped(raw)[0] if zipped else raw)
                yield m.name, at, headers, block
            continue
        at, room = 0, 1 << 16
        while at < m.stored:
            raw = read_at(source, begin + at, min(room, m.stored - at))
            try:
                text, used = gunzipped(raw) if zipped else (raw, None)
                headers, block, length = parse_record(text)
                if len(text) < length:
                    raise ValueError("cut short")
            except ValueError:
                if room >= m.stored - at:
                    raise
                room *= 4
                continue
            yield m.name, at, headers, block
            at, room = at + (used or length), 1 << 16


# --- tables ---


def mark_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and refers_to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    first = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1 and first is not null").drop("n")
    joined = rows.join(first, "payload_digest", "left")
    same = F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("refers_to", F.when(~same, F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 100, package_bytes: int = 64 << 20) -> DataFrame:
    """Write pages' records into packages below folder; returns the table of packages: path, size, records."""
    rows = mark_revisits(pages, least_bytes).select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: list[tuple[bytes, str]] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            data = package(held)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(data)], pa.int64()), pa.array([len(held)], pa.int64())], names=["path", "size", "records"])

        for batch in batches:
            for page_id, url, html, n, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = "response" if refers is None else "revisit"
                headers = {"X-Payload-Length": str(n)}
                if page_id is not None:
                    headers["X-Page-ID"] = str(page_id)
                if refers is not None:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(refers)}
                record = warc_record(kind, url, html.encode("utf-8", "surrogatepass"), headers=headers, digest=digest)
                held.append((record, kind))
                size += len(record)
                if size >= package_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return written(rows.mapInArrow(run, "path string, size long, records long"), "packages")


def read_archives(packages: DataFrame) -> DataFrame:
    """packages: path, size. A row for each record, with the payload's length and digest (recomputed where it has one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "archive", "record_offset", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_file(at) as source:
                    for archive, offset, h, block in records_of(source, size):
                        kind, named = h["warc-type"], h.get("warc-payload-digest", "")
                        digest = named.removeprefix("sha256:")
                        n = int(h.get("x-payload-length", 0))
                        if kind == "response":
                            body = payload_of(block)
                            n, found = len(body), hashlib.sha256(body).hexdigest()
                            # Other writers' digests may be of another kind or form: only bare hexadecimal ones are compared.
                            if named.startswith("sha256:") and len(digest) == 64 and digest.lower() != found:
                                raise ValueError(f"{path}: the payload at {offset} doesn't match its digest")
                            digest = found
                        number = lambda k: int(h[k]) if k in h else None
                        rows.append((path, archive, offset, number("x-page-id"), h.get("warc-target-uri"), kind, n, digest, number("x-refers-to-page")))
                        if len(rows) == 2000:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    schema = "path string, archive string, record_offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    parts = packages.sparkSession.sparkContext.defaultParallelism
    return packages.select("path", "size").repartition(max(parts, int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, schema)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one, with its store's name before it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: SQL for the rows of a round trip of the table pages.
SQL = """
WITH r AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM r
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""

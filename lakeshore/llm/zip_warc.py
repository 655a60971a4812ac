"""WARC records in ZIP-packaged archives, written and read back by ranges (operator 8).

An archive is a ZIP file with three stored (uncompressed) members: ``archive/data.warc.gz`` holds one
gzip member per WARC record, ``indexes/index.cdxj`` a line per record with its offset and length in
that member, ``datapackage.json`` names both.  The reader never extracts: it finds the end-of-directory
record (ZIP64 too), reads the central directory, turns each stored member into a byte range of the
archive, and deals the index out as ranges of records that any task can read by themselves.

Files are opened through ``pyarrow.fs`` by URI, so archives lie in the shared folder whatever store that
is.  Every attempt of a task writes files of its own name; the manifest, committed by Spark, names the
ones that count, so retried or speculative tasks leave nothing double.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.llm.common import shared_path, text_batches, written
from lakeshore.session import qualified

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: an archive is closed after so many bytes of records, a range of records after so many
ARCHIVE_BYTES, RANGE_BYTES = 128 << 20, 2 << 20
#: payloads shorter than this are never revisits
LEAST_REVISIT = 100
MANIFEST = "archive string, records long, bytes long"
RANGES = "archive string, start long, lengths array<long>"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_length long, payload_digest string, payload binary"


# ------------------------------------------------------------------ records

def _header_value(text: str) -> str:
    """Header text on one line: control characters and the percent sign are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) == 127 else c for c in text)


def _plain_value(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        if text[i] == "%":
            out.append(chr(int(text[i + 1:i + 3], 16)))
            i += 3
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def _page(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(value: str) -> int | None:
    digits = value.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head only, and what its payload was."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_page(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """The columns of RECORDS from one record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and len(payload) != length:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} has {len(payload)} bytes, not {length}")
    url = fields.get("WARC-Target-URI")
    return (_page_id(fields["WARC-Record-ID"]), None if url is None else _plain_value(url), fields["WARC-Type"],
            _page_id(fields["WARC-Refers-To"]) if revisit else None, length,
            fields["WARC-Payload-Digest"].partition(":")[2], None if revisit else payload)


# ------------------------------------------------------------------ writing

class _Forward(io.RawIOBase):
    """A write-only, forward-only view of an output stream, for zipfile."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self):
        return True

    def write(self, data):
        self.stream.write(bytes(data))
        return len(data)


class ArchiveWriter:
    """Streams records into one archive; the index is kept until the end (a line per record)."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.stream = uri, fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Forward(self.stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
        self.index, self.size, self.records = io.BytesIO(), 0, 0

    def add(self, page_id, url, data: bytes) -> None:
        packed = gzip.compress(data, 1, mtime=0)
        self.member.write(packed)
        line = json.dumps({"page_id": page_id, "offset": self.size, "length": len(packed)})
        self.index.write(f"{line}\n".encode())
        self.size += len(packed)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), self.index.getvalue())
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"),
                          json.dumps({"resources": [{"path": WARC_MEMBER}, {"path": INDEX_MEMBER}]}))
        self.zip.close()
        self.stream.close()
        return self.uri, self.records, self.size


def record_kinds(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit for every page.

    Of equal payloads of LEAST_REVISIT bytes or more the smallest page_id is the response (each row of
    that id, should it repeat); the others revisit it.  Null ids come after all others.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    # combined on the map side; only digests that repeat are kept, and their size is known before the join
    shared = written(base.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest")
                     .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).filter("n > 1")
                     .select(F.col("digest").alias("d"), "first"), "warc-shared")
    both = base.join(shared, F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"),
                       revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a WARC record for every row of pages (page_id, url, html); returns the manifest, already written.

    Null html is an empty payload, a null url leaves its header out, a null id has an empty record name.
    An empty table writes no archive.  Other columns are not read.
    """
    spark = pages.sparkSession
    text_batches(spark)
    folder = folder or shared_path(spark, "warc")
    if "://" not in folder:       # a path lies in Spark's default store, whichever that is
        folder = re.sub("^file:/(?!/)", "file:///", qualified(spark, folder))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get()
        out, done = None, []
        for b in batches:
            for page_id, url, payload, digest, refers_to, revisit in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if out is None:
                    name = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.wacz"
                    out = ArchiveWriter(f"{folder}/{name}")
                out.add(page_id, url, record_bytes(page_id, url, payload, digest, refers_to, revisit))
                if out.size >= archive_bytes:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()),
                                          pa.array([x[2] for x in done], pa.int64())], names=["archive", "records", "bytes"])

    return written(record_kinds(pages).mapInArrow(write, MANIFEST), "warc-manifest")


# ------------------------------------------------------------------ reading

EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def stored_members(file, others: list[str] | None = None) -> dict[str, tuple[int, int]]:
    """name -> (offset of its data in the archive, size) of the stored members of an open ZIP file.

    The names of all other members are added to ``others``.
    """
    size = file.size()
    back = min(size, 22 + 65535 + 20)
    tail = file.read_at(back, size - back)
    at = tail.rfind(EOCD)
    while at >= 0:  # the signature may also occur in the comment
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(EOCD, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut off")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20:at - 16] == LOCATOR64:
        end64 = struct.unpack_from("<Q", tail, at - 20 + 8)[0]
        record = file.read_at(56, end64)
        if record[:4] != EOCD64:
            raise ValueError("the ZIP64 locator points at no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, pos, members = file.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[pos:pos + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, pos + 8)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", directory, pos + 20)
        offset = struct.unpack_from("<I", directory, pos + 42)[0]
        name = directory[pos + 46:pos + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[pos + 46 + n:pos + 46 + n + m], 0
        while e + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # ZIP64: 8-byte values for the fields that are all ones, in this order
                v = e + 4
                if plain == 0xFFFFFFFF:
                    plain, v = struct.unpack_from("<Q", extra, v)[0], v + 8
                if packed == 0xFFFFFFFF:
                    packed, v = struct.unpack_from("<Q", extra, v)[0], v + 8
                if offset == 0xFFFFFFFF:
                    offset = struct.unpack_from("<Q", extra, v)[0]
            e += 4 + width
        if method == 0 and not flags & 1:
            head = file.read_at(30, offset)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            a, b = struct.unpack_from("<HH", head, 26)
            members[name] = (offset + 30 + a + b, packed)
        elif others is not None:
            others.append(name)
        pos += 46 + n + m + k
    return members


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def record_ranges(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of whole records of about ``range_bytes``, as byte ranges of the archives, by their indexes."""
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                out = []
                with _open(uri) as file:
                    others: list[str] = []
                    members = stored_members(file, others)
                    at, size = members[INDEX_MEMBER]
                    indexed: dict[str, list[tuple[int, int]]] = {}
                    for line in file.read_at(size, at).splitlines():
                        entry = json.loads(line)
                        name = "archive/" + entry.get("filename", WARC_MEMBER).removeprefix("archive/")
                        indexed.setdefault(name, []).append((int(entry["offset"]), int(entry["length"])))
                archived = {n for n in (*members, *others) if n.startswith("archive/") and not n.endswith("/")}
                wrong = (indexed.keys() - members.keys()) | (archived - indexed.keys())
                if wrong:
                    raise ValueError(f"{uri}: not stored or not in the index: {', '.join(sorted(wrong))}")
                for name, entries in indexed.items():
                    base, start, lengths, total = members[name][0], 0, [], 0
                    for offset, length in sorted(entries):
                        if lengths and (total >= range_bytes or offset != start + total):
                            out.append((uri, base + start, lengths))
                            lengths, total = [], 0
                        if not lengths:
                            start = offset
                        lengths.append(length)
                        total += length
                    out.append((uri, base + start, lengths))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["archive", "start", "lengths"])

    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("archive").repartition(spread).mapInArrow(plan, RANGES)


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives (the columns of RECORDS); payload is null for revisits.

    The index's ``filename`` names the member under archive/, data.warc.gz where it is missing.

    A broken archive, record or payload raises an error; nothing is skipped.  An empty manifest gives an
    empty result.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [f.strip().split(" ")[0] for f in RECORDS.split(",")]
        for b in batches:
            for uri, start, lengths in zip(*[b.column(i).to_pylist() for i in range(3)]):
                with _open(uri) as file:
                    data = memoryview(file.read_at(sum(lengths), start))
                rows, at = [], 0
                for length in lengths:
                    rows.append(parse_record(gzip.decompress(data[at:at + length])))
                    at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return record_ranges(manifest, range_bytes).repartition(spread).mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` and read them back: one row per page, digests from the payloads read."""
    rows = read_archives(write_archives(pages))
    revisit = F.col("record_type") == "revisit"
    return rows.select(
        "page_id", F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type", "refers_to")

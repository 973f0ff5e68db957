"""WARC records kept in ZIP archives, read back by byte ranges.

Write: each task streams its records into ZIP archives on the shared folder, one
stored member ``data.warc`` and one index member; a retried task writes a new
archive, and only archives named in the stored manifest count.  Read: a task gets an
archive and a range of its index, parses the end record, the ZIP64 end record and
the central directory itself, locates the stored members and reads each record by
its range; nothing is extracted.

The shared folder is reached from the executors through pyarrow's file systems
(local and shared mounts, HDFS, object stores).
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakes.llm.common import new_path, store, table

DATA, INDEX = "data.warc", "index.u64"
ARCHIVE_BYTES = 128 << 20  # an archive is closed past this size
RANGE = 4000  # index entries a reading task takes at a time
MOST_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, head) -> bytes:
    """One record; ``head`` is the page that holds the payload if this one revisits it."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    revisit = head is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page", json.dumps([page_id, url, head])),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", name(head)),
        ]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("payload does not match its digest")
    page_id, url, head = json.loads(fields["X-Page"])
    return {
        "page_id": page_id, "url": url, "payload_bytes": length, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": head, "payload": payload if fields["WARC-Type"] == "response" else None,
    }


# --- ZIP directories -----------------------------------------------------------


class ZipReader:
    """Members of a ZIP file by random access."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        tail = self._read(max(0, size - 65557), min(size, 65557))
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        end = size - len(tail) + at
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            mark, _, where, _ = struct.unpack("<4sIQI", self._read(end - 20, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            big = self._read(where, 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", big, 32)
        self.members = self._directory(self._read(start, length), count)

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        data = self.f.read(n)
        if len(data) != n:
            raise ValueError("archive is cut short")
        return data

    @staticmethod
    def _directory(data: bytes, count: int) -> dict[str, tuple[int, int, int]]:
        out, at = {}, 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            method, packed, size = struct.unpack_from("<10xH8xII", data, at)[0:3]
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, at + 28)
            local = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode()
            extra, k = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while k + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, k)
                if tag == 1:
                    wide, j = struct.unpack_from(f"<{n // 8}Q", extra, k + 4), 0
                    if size == 0xFFFFFFFF:
                        size, j = wide[j], j + 1
                    if packed == 0xFFFFFFFF:
                        packed, j = wide[j], j + 1
                    if local == 0xFFFFFFFF:
                        local = wide[j]
                k += 4 + n
            out[name] = (method, size, local)
            at += 46 + n_name + n_extra + n_comment
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """First byte and size of a stored member."""
        method, size, local = self.members[name]
        if method != 0:
            raise ValueError("member is compressed, so it has no ranges")
        n_name, n_extra = struct.unpack_from("<HH", self._read(local, 30), 26)
        return local + 30 + n_name + n_extra, size

    def range(self, start: int, at: int, n: int) -> bytes:
        return self._read(start + at, n)


# --- tasks ---------------------------------------------------------------------


def _write(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        rows = (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
        row = next(rows, None)
        while row is not None:
            name, index, at = f"{uuid.uuid4().hex}.zip", [], 0
            with fs.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                with z.open(DATA, "w", force_zip64=True) as f:
                    while row is not None and at < limit:
                        data = record(row["page_id"], row["url"], row["payload"], row["head"])
                        f.write(data)
                        index.append((at, len(data)))
                        at += len(data)
                        row = next(rows, None)
                with z.open(INDEX, "w", force_zip64=True) as f:
                    f.write(struct.pack(f"<{2 * len(index)}Q", *(x for e in index for x in e)))
            yield pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(index)], pa.int64())})

    return run


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(folder: str, with_payload: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for frame in frames:
            for name, first, last in frame.itertuples(index=False):
                path = f"{root}/{name}"
                with fs.open_input_file(path) as f:
                    z = ZipReader(f, f.size())
                    start, _ = z.locate(DATA)
                    index, _ = z.locate(INDEX)
                    own = struct.unpack(f"<{2 * (last - first)}Q", z.range(index, 16 * first, 16 * (last - first)))
                    out = []
                    for at, n in zip(own[::2], own[1::2], strict=True):
                        r = parse_record(z.range(start, at, n))
                        payload = r.pop("payload")
                        out.append(r | {"payload": payload} if with_payload else r)
                        if len(out) == 500:
                            yield _frame(out)
                            out = []
                    if out:
                        yield _frame(out)

    return run


def _frame(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame(rows)
    for c in ("page_id", "payload_bytes", "refers_to"):
        df[c] = df[c].astype("Int64")
    return df


def archive_pages(
    pages: DataFrame, least_bytes: int = 0, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES
) -> tuple[str, DataFrame]:
    """Write the pages; returns the folder and the stored manifest (name, records).

    Null html is an empty payload, null url an empty target (read back as null).  Of
    equal payloads (by SHA-1 and length) of ``least_bytes`` or more, the largest
    page_id is the response; rows that repeat its id are responses too.  A null
    page_id revisits like any other and is the response only where no other is.  An
    empty table gives an empty manifest."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    heads = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    shared = store(heads.where("n > 1").select("digest", "size", "top"), "heads")
    head = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("head")
    out = rows.join(shared, ["digest", "size"], "left").select("page_id", "url", "payload", head)
    folder = folder or new_path(pages.sparkSession, "warc")
    return folder, store(out.mapInArrow(_write(folder, archive_bytes), "name string, records long"), "manifest")


def read_archives(folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives in ``manifest``."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(RANGE).cast("long"))).alias("first")
    parts = manifest.where("records > 0").select("name", first, "records")
    parts = parts.select("name", "first", F.least(F.col("first") + RANGE, F.col("records")).alias("last"))
    # a count of its own: the rows are few and small, what they stand for is not
    ranges = manifest.agg(F.sum(F.ceil(F.col("records") / RANGE))).first()[0] or 1
    parts = parts.repartition(min(ranges, MOST_TASKS), "name", "first")
    return parts.mapInPandas(_read(folder, with_payload), READ + (", payload binary" if with_payload else ""))


def op6_warc_zip(spark, sf_dir: str) -> DataFrame:
    folder, manifest = archive_pages(table(spark, sf_dir, "pages"))
    return read_archives(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

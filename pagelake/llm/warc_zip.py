"""WARC (2): archives packed in ZIP files, read by ranges and without extraction.

Writing: every row becomes a WARC/1.1 record, a gzip member of its own, in a stored (uncompressed) ZIP member
`archive/data.warc.gz`; a second stored member, `indexes/index.cdx`, lists offset and length of each record. Of rows with
equal payloads, that with the smallest id is the response and the others revisit it.

Reading: the end record, the ZIP64 locator and record (if any) and the central directory are parsed from ranges at the
file's end; local headers give the data's place; the index is range-read, and runs of records are then read in parallel,
each run by one range, in as many tasks as the archives' bytes ask for. Every response's digest is computed again from its bytes and must agree.

Only rows that may be revisits are dealt with their payloads, to meet what they refer to: a bitmap of hashed (id, digest)
pairs, 16 MB whatever the input, tells them, and all others stay where they are.

Defined results: an id of any type that a string can be cast to is kept; a null payload is empty; repeated rows of one id are records of one capture, so those with the smallest id are
all responses; a null id ranks after all others and is read back as null; a null URL leaves its header out; an empty table
gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import col, fresh, marked, written
from pagelake.llm.stores import Stores

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
BIG = 0xFFFFFFFF
NO_ID = "urn:page"


# ---------------------------------------------------------------- ZIP


class ZipWriter:
    """Writes stored members one after the other to a stream; ZIP64 fields appear where sizes need them, or always."""

    def __init__(self, stream, zip64: bool = False):
        self.stream, self.zip64, self.at, self.entries = stream, zip64, 0, []

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Sizes follow the data (flag bit 3), so nothing has to be known ahead."""
        raw = name.encode()
        self.entry = [raw, self.at, 0, 0]
        self.put(struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)

    def write(self, data: bytes) -> None:
        self.entry[2] = zlib.crc32(data, self.entry[2])
        self.entry[3] += len(data)
        self.put(data)

    def end(self) -> None:
        _, _, crc, size = self.entry
        wide = self.zip64 or size >= BIG
        self.put(b"PK\x07\x08" + struct.pack("<LQQ" if wide else "<LLL", crc, size, size))
        self.entries.append(self.entry)

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.entries:
            wide = self.zip64 or size >= BIG or offset >= BIG
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            small = (BIG, BIG, BIG) if wide else (size, size, offset)
            self.put(struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0x0808, 0, 0, 0x21, crc, *small[:2], len(raw), len(extra), 0, 0, 0, 0, small[2]) + raw + extra)
        length, n = self.at - start, len(self.entries)
        if self.zip64 or start >= BIG or length >= BIG or n >= 0xFFFF:
            record = self.at
            self.put(struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, start))
            self.put(struct.pack("<4sLQL", b"PK\x06\x07", 0, record, 1))
            self.put(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, BIG, BIG, 0))
        else:
            self.put(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, n, n, length, start, 0))


def read_range(file, start: int, length: int) -> bytes:
    file.seek(start)
    got = file.read(length)
    if len(got) != length:
        raise ValueError(f"range {start}+{length} reaches beyond the end of the file")
    return got


def zip_members(file) -> dict[str, tuple[int, int, int]]:
    """Name -> (method, offset of the data, length) by the central directory, ZIP64 or not, and the local headers."""
    total = file.size()
    tail_at = max(0, total - 65557)
    tail = read_range(file, tail_at, total - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP file")
        if len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    n, length, start = struct.unpack_from("<HLL", tail, at + 10)
    if n == 0xFFFF or BIG in (length, start):
        locator = read_range(file, tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = read_range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, members, at = read_range(file, start, length), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, size = struct.unpack_from("<LL", directory, at + 20)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", directory, at + 28)
        offset = struct.unpack_from("<L", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                wide, j = struct.unpack_from(f"<{m // 8}Q", extra, k + 4), 0
                if size == BIG:
                    size, j = wide[j], j + 1
                if packed == BIG:
                    packed, j = wide[j], j + 1
                if offset == BIG:
                    offset = wide[j]
            k += 4 + m
        local = read_range(file, offset, 30)
        members[name] = (method, offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + n_name + n_extra + n_note
    return members


def stored(members: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    method, start, length = members[name]
    if method:
        raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
    return start, length


# ---------------------------------------------------------------- WARC records


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_header(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or c == "\x7f" else c for c in value)


def urn(page_id) -> str:
    return NO_ID if page_id is None else f"urn:page:{quote(str(page_id), safe='')}"


def record_bytes(page_id, url: str | None, payload: bytes, refers_to, date: str = DATE) -> bytes:
    """A response, or a revisit of `refers_to`, whose block has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{urn(page_id)}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {clean_header(url)}"]),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{urn(refers_to)}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; a response whose digest doesn't agree is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"{fields['warc-record-id']}: payload and digest don't agree")

    def page(value: str | None) -> str | None:
        found = (value or "").strip("<>")
        return unquote(found.removeprefix("urn:page:")) if found.startswith("urn:page:") else None

    return {
        "page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": length,
        "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page(fields.get("warc-refers-to")),
    }


# ---------------------------------------------------------------- Spark


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds refers_to to rows of (id, url, payload). Digests meet without their payloads; a payload is dealt only where its row may be a
    revisit, by id, so copies never meet in one task."""
    digest = pages.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    slim = digest.where(F.octet_length("payload") >= min_bytes).select("id", F.col("sha1").alias("of"))
    groups = slim.groupBy("of").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    groups = written(groups.select("of", "first"), "warc-groups")  # a written table, so that a hot digest's join can be split
    revisits = slim.join(groups, "of").where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("_id"), "of", F.col("first").alias("refers_to")).distinct()
    revisits = written(revisits, "warc-revisits")
    rows = marked(digest, F.xxhash64("id", "sha1"), revisits.select(F.xxhash64("_id", "of")))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("of"))
    met = rows.where("maybe").join(revisits.hint("shuffle_hash"), same, "left").select("id", "url", "payload", "refers_to")
    kind = pages.schema["id"].dataType
    return met.unionByName(rows.where("NOT maybe").select("id", "url", "payload", F.lit(None).cast(kind).alias("refers_to")))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = 1 << 30, zip64: bool = False
) -> DataFrame:
    """Writes one or more archives a task below `folder` and returns their paths.

    Each attempt of a task writes files of its own, and the returned manifest names those of the attempts that Spark has taken: a task that runs again, or
    twice at once, changes no file that the manifest knows. What lost attempts have left lies beside, unnamed. No file is moved, which object stores can't do."""
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), F.coalesce(col(payload_col), F.lit("")).alias("payload"))
    rows = with_revisits(rows, min_bytes)
    stores = Stores.of(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt = TaskContext.get(), uuid.uuid4().hex
        store, top = stores.at(folder)
        store.create_dir(top, recursive=True)
        opened, done = None, []

        def close() -> None:
            nonlocal opened
            out, stream, index, name = opened
            out.end()
            out.begin(INDEX)
            out.write("".join(index).encode())
            out.end()
            out.close()
            stream.close()
            done.append((f"{folder}/{name}", len(index), out.at))
            opened = None

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if opened is None:
                    name = f"pages-{task.partitionId():05d}-{len(done):03d}-{attempt}.zip"
                    stream = store.open_output_stream(f"{top}/{name}")
                    opened = (ZipWriter(stream, zip64), stream, [], name)
                    opened[0].begin(DATA)
                    start = opened[0].at
                raw = record_bytes(page_id.as_py(), url.as_py(), payload.as_py().encode("utf-8", "surrogatepass"), refers_to.as_py())
                gzip = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = gzip.compress(raw) + gzip.flush()
                opened[2].append(f"{opened[0].at - start} {len(member)}\n")
                opened[0].write(member)
                if opened[0].at >= archive_bytes:
                    close()
        if opened is not None:
            close()
        columns = [pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "n_records", "n_bytes"])

    return written(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def sized(archives: DataFrame) -> DataFrame:
    """Adds n_bytes, the size of the file at `path`."""
    stores = Stores.of(archives.sparkSession)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [store.get_file_info(at).size for store, at in map(stores.at, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["path", "n_bytes"])

    return written(archives.select("path").mapInArrow(sizes, "path string, n_bytes long"), "warc-sizes")


def read_archives(archives: DataFrame, run_bytes: int = 1 << 20, payloads: bool = False, id_type: T.DataType | str = "long", task_bytes: int = 32 << 20) -> DataFrame:
    """One row a record of the archives at `archives.path`; runs of about `run_bytes` are dealt to tasks of about `task_bytes`.

    The number of tasks follows the bytes that are to be read (`archives.n_bytes`, or else the files' sizes), and no fewer than the cluster's cores, if
    there are as many runs."""
    if "n_bytes" not in archives.columns:
        archives = sized(archives)
    stores = Stores.of(archives.sparkSession)
    total = archives.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_tasks = max(1, -(-total // task_bytes), min(archives.sparkSession.sparkContext.defaultParallelism, -(-total // run_bytes)))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = stores.at(path)
                with store.open_input_file(at) as file:
                    members = zip_members(file)
                    base, _ = stored(members, DATA)
                    lines = read_range(file, *stored(members, INDEX)).decode().splitlines()
                runs, held, size = [], [], 0
                for offset, length in (map(int, x.split()) for x in lines):
                    held.append((base + offset, length))
                    size += length
                    if size >= run_bytes:
                        runs, held, size = [*runs, held], [], 0
                runs += [held] if held else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(runs), pa.string()), pa.array([x[0][0] for x in runs], pa.int64()), pa.array([[n for _, n in x] for x in runs], pa.list_(pa.int64()))],
                    names=["path", "start", "lengths"],
                )

    fields = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, at = stores.at(path)
                with store.open_input_file(at) as file:
                    raw = read_range(file, start, sum(lengths))
                found, k = [], 0
                for n in lengths:
                    found.append(parse_record(zlib.decompress(raw[k : k + n], 31)))
                    k += n
                yield pa.RecordBatch.from_arrays([pa.array([x[name] for x in found], kind) for name, kind in zip(names, kinds, strict=False)], names=names)

    runs = archives.select("path").mapInArrow(locate, "path string, start long, lengths array<long>")
    records = runs.repartition(n_tasks, "path", "start").mapInArrow(read, fields + (", payload binary" if payloads else ""))  # a given number isn't coalesced by the runs' few bytes
    return records.select(*(F.col(n).cast(id_type) if n in ("page_id", "refers_to") else F.col(n) for n in names))


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """Write all pages, then read the archives back; ids have the type that they had."""
    archives = write_archives(pages, folder or fresh(spark, "warc"), id_col, **options)
    return read_archives(archives, id_type=pages.schema[id_col].dataType)

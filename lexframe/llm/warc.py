"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: payload digests and lengths are taken first, copies of larger payloads are found by digest, and every task writes
its records to archives of its own in a shared folder, a new one after ``archive_bytes``. An archive's dictionary is
trained on its first records (at most ``SAMPLE_BYTES``); an archive too small for that has none. File names
are new for every attempt of a task, and only those of successful attempts are in the manifest that is returned, so
a lost executor leaves at worst a file nobody reads.

Reading: an archive is a stream; one record is in memory at a time. The dictionary is loaded from the leading skippable
frame, each frame is decoded by itself, and version line, mandatory headers, lengths, line ends and digests are checked.
What fails is raised, or with ``on_error="row"`` returned as a row whose ``error`` says what and where.

Defined results: a null payload is an empty one; payloads shorter than ``min_revisit`` bytes are never revisits; of equal
ones that with the largest page id is the response, and rows that repeat its id with it; rows without an id revisit an
equal payload that has one and are responses otherwise; a missing URL is ``urn:none``; line ends and blanks in URLs
are percent-encoded; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.session import pin, scratch_path

MIN_REVISIT = 1000
#: Compressed bytes of archives that one task reads.
TASK_BYTES = 128 << 20
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 1 << 15
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
SKIPPABLE_DICTIONARY = 0x184D2A5D
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "urn:none"


def plan_records(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT
) -> DataFrame:
    """(page_id, url, payload, digest, response_id, revisit): what to write, one row per page.

    Only digests and ids are grouped; payloads travel once, to meet those of the groups that have copies.
    """
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    copies = rows.where(F.octet_length("payload") >= min_revisit).groupBy(F.col("digest").alias("copied")).agg(
        F.count("*").alias("n"), F.max("page_id").alias("response_id")
    ).where("n > 1 and response_id is not null").select("copied", "response_id")
    met = rows.join(copies, F.col("digest") == F.col("copied"), "left").drop("copied")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return met.withColumn("revisit", revisit)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:payload:{digest}>"


def _uri(url: str | None) -> str:
    if not url:
        return NO_URL
    return "".join(c if 32 < ord(c) != 127 else f"%{ord(c):02X}" for c in url)


def record(row: dict, date: str = DATE) -> bytes:
    """One WARC record. A revisit keeps the HTTP header with the full length, without the payload."""
    payload, digest = row["payload"], bytes.fromhex(row["digest"])
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if row["revisit"] else http + payload
    headers = [
        ("WARC-Type", "revisit" if row["revisit"] else "response"),
        ("WARC-Record-ID", _record_id(row["page_id"], row["digest"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(row["url"])),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if row["revisit"]:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(row["response_id"], row["digest"])),
        ]
    headers.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples, or nothing when they are too few."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records to an open stream: the dictionary first, then a frame for each."""

    def __init__(self, stream, level: int = LEVEL):
        self.stream, self.level = stream, level
        self.waiting: list[bytes] | None = []
        self.held = self.written = self.records = 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.written += len(data)

    def _start(self) -> None:
        dictionary = train_dictionary(self.waiting)
        if dictionary:
            self._put(struct.pack("<II", SKIPPABLE_DICTIONARY, len(dictionary)) + dictionary)
        self.frames = zstandard.ZstdCompressor(
            level=self.level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
            write_content_size=True, write_checksum=True,
        )
        waiting, self.waiting = self.waiting, None
        for data in waiting:
            self._put(self.frames.compress(data))

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            self._put(self.frames.compress(data))
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES:
            self._start()

    def close(self) -> None:
        if self.waiting is not None:
            self._start()
        self.stream.close()


def write_archives(
    records: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE
) -> DataFrame:
    """Writes what ``plan_records`` planned; returns the manifest (path, records, bytes), itself a written table."""
    folder = folder or scratch_path(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        writer, name, done = None, "", []

        def finish():
            writer.close()
            done.append((f"{folder}/{name}", writer.records, writer.written))

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{len(done):03d}-{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(store.open_output_stream(posixpath.join(base, name), compression=None))
                writer.add(record(row, date))
                if writer.written >= archive_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["path", "records", "bytes"],
        )

    return pin(records.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def frames(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded frame) of an archive; the dictionary comes from its leading skippable frame."""
    held, at, first, dictionary = b"", 0, True, None

    def fill(size: int) -> bool:
        nonlocal held
        while len(held) < size:
            more = stream.read(max(chunk, size - len(held)))
            if not more:
                return False
            held += more
        return True

    while fill(1):
        if not fill(4):
            raise WarcError(f"offset {at}: {len(held)} bytes after the last frame")
        magic = struct.unpack_from("<I", held)[0]
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            if not fill(8) or not fill(8 + struct.unpack_from("<I", held, 4)[0]):
                raise WarcError(f"offset {at}: skippable frame is cut off")
            size = 8 + struct.unpack_from("<I", held, 4)[0]
            if magic == SKIPPABLE_DICTIONARY:
                if not first:
                    raise WarcError(f"offset {at}: dictionary frame is not the first")
                raw = held[8:size]
                if raw[:4] == struct.pack("<I", FRAME):
                    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
                dictionary = zstandard.ZstdCompressionDict(raw)
            held, at, first = held[size:], at + size, False
            continue
        if magic != FRAME:
            raise WarcError(f"offset {at}: no frame starts here")
        first = False
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, used = [], 0
        while True:
            try:
                parts.append(decoder.decompress(held))
            except zstandard.ZstdError as error:
                raise WarcError(f"offset {at}: {error}") from error
            used += len(held)
            if decoder.eof:
                held = decoder.unused_data
                used -= len(held)
                break
            held = stream.read(chunk)
            if not held:
                raise WarcError(f"offset {at}: frame is cut off")
        yield at, b"".join(parts)
        at += used


def _sha1(value: str) -> str:
    kind, _, digest = value.partition(":")
    if kind.lower() != "sha1":
        raise WarcError(f"digest {value!r} is not a sha1")
    return digest.lower() if len(digest) == 40 else base64.b32decode(digest.upper()).hex()


def _page(record_id: str | None) -> int | None:
    head = "<urn:page:"
    return int(record_id[len(head):-1]) if record_id and record_id.startswith(head) else None


def parse_record(data: bytes) -> dict:
    """A validated record: type, ids, URL, payload (None for a revisit), full length and digest of the payload."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no version line or no end of the headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"header {line[:80]!r} has no name")
        if name.strip().lower() in headers:
            raise WarcError(f"header {name.strip()} comes twice")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise WarcError(f"header {name} is missing")
    kind, length = headers["warc-type"], headers["content-length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length} does not fit {len(rest) - 4} bytes")
    block = rest[:-4]
    if "warc-block-digest" in headers and _sha1(headers["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
        raise WarcError("block digest differs")
    out = {
        "record_type": kind, "page_id": _page(headers["warc-record-id"]), "record_id": headers["warc-record-id"],
        "url": headers.get("warc-target-uri"), "refers_to": None, "payload": None, "payload_bytes": None,
        "payload_digest": None,
    }
    if out["url"] == NO_URL:
        out["url"] = None
    if kind not in ("response", "revisit"):
        return out
    http, mark, payload = block.partition(b"\r\n\r\n")
    fields = dict(
        (k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])
    )
    if not mark or not http.startswith(b"HTTP/"):
        raise WarcError("block is not an HTTP response")
    full = fields.get("content-length", "")
    if not full.isdecimal():
        raise WarcError("HTTP Content-Length is missing")
    if "warc-payload-digest" not in headers:
        raise WarcError("payload digest is missing")
    digest = _sha1(headers["warc-payload-digest"])
    if kind == "revisit":
        if not headers.get("warc-refers-to") or headers.get("warc-profile") != REVISIT_PROFILE or payload:
            raise WarcError("revisit without target or profile, or with a payload")
        out["refers_to"] = _page(headers["warc-refers-to"])
    else:
        if len(payload) != int(full):
            raise WarcError(f"HTTP Content-Length {full} does not fit {len(payload)} bytes")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("payload digest differs")
        out["payload"] = payload
    return out | {"payload_bytes": int(full), "payload_digest": digest}


_READ = (
    "path string, offset bigint, record_type string, page_id bigint, record_id string, url string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, error string"
)
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(),
          pa.string(), pa.string()]


def read_archives(
    manifest: DataFrame, with_payload: bool = True, on_error: str = "raise", batch_bytes: int = 8 << 20,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """One row per record of the archives at ``manifest.path``.

    Small archives share a task: as many tasks as hold ``task_bytes`` of ``manifest.bytes`` each, at least one per task
    slot and at most one per archive; without that column an archive per task.
    """
    names = [c.split()[0] for c in _READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            arrays = [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, _TYPES)]
            if with_payload:
                arrays.append(pa.array([r.get("payload") for r in rows], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names=names + ["payload"] * with_payload)

        for paths in batches:
            for path in paths.column(0).to_pylist():
                store, inner = pyarrow.fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(inner, compression=None) as stream:
                    offset = 0
                    try:
                        for offset, data in frames(stream):
                            try:
                                row = parse_record(data)
                            except ValueError as error:
                                if on_error == "raise":
                                    raise WarcError(f"{path}, offset {offset}: {error}") from error
                                row = {"error": str(error)}
                            rows.append(row | {"path": path, "offset": offset})
                            size += 500 + (len(row.get("payload") or b"") if with_payload else 0)
                            if size >= batch_bytes:
                                yield batch(rows)
                                rows, size = [], 0
                    except WarcError as error:
                        if on_error == "raise":
                            raise
                        rows.append({"error": str(error), "path": path, "offset": offset})
                if rows:
                    yield batch(rows)

    size = F.sum("bytes") if "bytes" in manifest.columns else F.lit(None)
    archives, total = manifest.agg(F.count("*"), size).first()
    slots = manifest.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, archives if total is None else min(archives, max(slots, -(-total // task_bytes))))
    return manifest.select("path").repartition(tasks).mapInArrow(run, _READ + ", payload binary" * with_payload)

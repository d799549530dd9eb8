"""WARC archives compressed with Zstandard: one frame per record, the dictionary in the leading skippable frame.

A writing task fills one archive after another in the shared folder: under a name of its attempt first, moved to its final name when
complete, so a task that runs again replaces what it wrote. The reader streams an archive in chunks, loads the dictionary,
decodes frame by frame and checks each record's headers, lengths and digests. Files are reached through ``pyarrow.fs``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import new_folder, scratch, written

# Fixed values of the formats.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528

ARCHIVE_BYTES = 128 << 20
#: The first payloads of an archive that its dictionary is made from, and the dictionary's size.
DICTIONARY_RECORDS, DICTIONARY_SAMPLE, DICTIONARY_BYTES = 64, 1 << 20, 16 << 10
CHUNK = 256 << 10
LEVEL = 3
#: Without a date of capture, records carry this one, so that archives of the same rows are alike.
DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header in a response; the block itself elsewhere."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    named = headers | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in named.items())]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    """The record in a frame; WarcError where its version, headers, lengths or digests don't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise WarcError(f"no WARC record: {data[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"no header: {line[:60]!r}")
        headers[name.strip().decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"content-length {headers['content-length']}, but {len(rest) - 4} bytes")
    record = Record(headers, rest[:-4])
    checks = [("warc-block-digest", record.block)] + [("warc-payload-digest", record.payload)] * (headers["warc-type"] != "revisit")
    for name, held in checks:
        if name in headers and headers[name] != f"sha1:{digest(held)}":
            raise WarcError(f"{name} does not hold")
    return record


class Writer:
    """Writes records to an open binary file."""

    def __init__(self, file, samples: list[bytes]) -> None:
        import zstandard

        self.file, self.size, dictionary = file, 0, None
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
        except (zstandard.ZstdError, ValueError):  # too few or too short samples: an archive without one
            pass
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def write(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))


def read_records(file, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an open binary file, in order; memory holds a chunk and one record."""
    import zstandard

    data, options, first = b"", {}, True

    def more(n: int) -> bool:
        nonlocal data
        while len(data) < n and (got := file.read(max(chunk, n - len(data)))):
            data += bytes(got)
        return len(data) >= n

    while more(4):
        (magic,) = struct.unpack("<I", data[:4])
        if magic in SKIPPABLE:
            if not more(8):
                raise WarcError("cut off in a skippable frame")
            (size,) = struct.unpack("<I", data[4:8])
            if not more(8 + size):
                raise WarcError("cut off in a skippable frame")
            held, data = data[8 : 8 + size], data[8 + size :]
            if first and magic == DICTIONARY_FRAME:
                if held[:4] == struct.pack("<I", FRAME):
                    held = zstandard.ZstdDecompressor().decompress(held)
                options = {"dict_data": zstandard.ZstdCompressionDict(held)}
            first = False
            continue
        if magic != FRAME:
            raise WarcError(f"no frame: {data[:4]!r}")
        first = False
        frame, out = zstandard.ZstdDecompressor(**options).decompressobj(), []
        try:
            while True:
                out.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data
                    break
                data = b""
                if not more(1):
                    raise WarcError("cut off in a record's frame")
        except zstandard.ZstdError as e:
            raise WarcError(str(e)) from e
        yield parse_record(b"".join(out))
    if data:
        raise WarcError("bytes after the last frame")


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """pages with __payload (binary), __refers_to: of equal payloads of at least ``least_bytes`` the smallest id, null in that record itself.

    Only hashes are grouped, summed up before they are shuffled; the few that occur twice are a written table of known size.
    """
    plain = pages.withColumn("__payload", F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary"))
    key = F.sha2("__payload", 256)
    counts = plain.where(F.length("__payload") >= least_bytes).groupBy(key.alias("__key")).agg(F.min(id_col).alias("__least"), F.count("*").alias("__n"))
    repeated = written(counts.where("__n > 1 and __least is not null").select("__key", "__least"), "repeated")
    joined = plain.withColumn("__key", key).join(repeated, "__key", "left")
    return joined.withColumn("__refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("__least")), F.col("__least"))).drop("__key", "__least")


def write_warcs(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of :func:`with_roles` to folder; path, records, bytes of each archive. Done when this returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, root = open_fs(folder)
        rows = ((i.as_py(), u.as_py(), p.as_py(), r.as_py()) for b in batches for i, u, p, r in zip(*b.columns))
        done, waiting, number = [], [], 0
        while True:
            size = sum(len(x[2]) for x in waiting)
            while len(waiting) < DICTIONARY_RECORDS and size < DICTIONARY_SAMPLE and (row := next(rows, None)):
                waiting.append(row)
                size += len(row[2])
            if not waiting:
                break
            name = f"{root}/part-{task:06d}-{number:04d}.warc.zst"
            own, n = f"{name}.{attempt}.tmp", 0
            with fs.open_output_stream(own, compression=None) as file:
                archive = Writer(file, [x[2] for x in waiting])
                while row := waiting.pop(0) if waiting else next(rows, None) if archive.size < archive_bytes else None:
                    archive.write(_page_record(*row))
                    n += 1
            fs.move(own, name)
            done.append((f"{folder}/part-{task:06d}-{number:04d}.warc.zst", n, archive.size))
            number += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    return written(pages.select(id_col, url_col, "__payload", "__refers_to").mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest", keep=True)


def _page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE}
    if url:
        headers["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    headers |= {"Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest(payload)}", "X-Page-Id": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload))}
    if refers_to is None:
        return record_bytes(headers, http + payload)
    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page": str(refers_to)}
    return record_bytes(headers, http)


def read_warcs(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload) of the records in the archives of column path.

    An archive that is cut off, or a record whose headers, lengths or digests don't hold, raises WarcError with the path.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            fs, name = open_fs(path)
            rows, size = [], 0
            with fs.open_input_stream(name, compression=None) as file:
                try:
                    for r in read_records(file):
                        h = r.headers
                        back = h.get("x-refers-to-page")
                        n = int(h.get("x-payload-length", len(r.payload)))
                        if h["warc-type"] == "response" and n != len(r.payload):
                            raise WarcError(f"a payload of {len(r.payload)} bytes, not {n}")
                        rows.append((int(h["x-page-id"]) if h.get("x-page-id") else None, h.get("warc-target-uri"), h["warc-type"], n, h["warc-payload-digest"].removeprefix("sha1:"), int(back) if back else None, *[r.payload] * with_payload))
                        size += len(r.block) if with_payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                except WarcError as e:
                    raise WarcError(f"{path}: {e}") from e
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * with_payload
    return paths.select("path").mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record per page and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Null payloads are empty ones. Of equal payloads the row with the smallest id is the response (so are further rows of that
    very id), others revisit it; rows with a null id revisit it too, and where all ids are null each is a response. Other
    columns are not read; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    with scratch():
        manifest = write_warcs(with_roles(pages.select(F.col(id_col).cast("bigint").alias(id_col), F.col(url_col).cast("string").alias(url_col), payload_col), id_col, payload_col, least_bytes), new_folder(spark, "warc"), id_col, url_col)
    read = read_warcs(manifest.repartition(max(1, manifest.count())))
    return read.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

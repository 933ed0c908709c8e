"""WARC archives with an embedded Zstandard dictionary (operator 11).

1. Pages of equal payload are found by digest: the first by id is archived as a
   ``response``, the others as ``revisit`` records without the payload. Digests
   that occur twice or more are joined back with split keys.
2. Each task writes archives of its own. It trains a dictionary on the first
   records of an archive, embeds it, compressed, in a leading skippable frame,
   and then compresses every record as a frame of its own, so a record can be
   read by its offset and the dictionary alone.
3. A file has a new name in each attempt of a task, and only files that the
   written index names are read, so what a lost executor leaves is not seen.
4. Reading decodes the leading frame, walks over the records, and compares each
   payload with its digest.

Archives go to a folder that driver and executors share, by pyarrow's file
systems (local paths, hdfs, s3, gs). Defined results: a null html is an empty
payload; payloads under MIN_REVISIT bytes are always responses; null ids come
last; of repeated rows of one id and payload one is the response and the others
revisit it; an empty table gives no archive; other columns are not read. An
archive too small to train on has no leading frame.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm.common import drop_path, lookup, materialize, scratch, shared_dir, slices, table

#: Equal payloads of fewer bytes are not worth a reference.
MIN_REVISIT = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: A dictionary has so many bytes, or a DICT_SHARE-th of the records it is trained on; below DICT_LEAST there is none.
DICT_BYTES, DICT_SHARE, DICT_LEAST = 64 << 10, 20, 512
#: Bytes of the records at an archive's start that its dictionary is trained on, and of one record in that.
SAMPLE_BYTES, SAMPLE_PART = 4 << 20, 128 << 10
LEVEL = 6

#: Fixed values of the WARC and Zstandard formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:docloom"

INDEX = "path string, offset bigint, length bigint, record_id string"
RECORDS = "path string, record_type string, record_id string, page_id string, url string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"


def record(kind: str, record_id: str, url: str | None, digest: str, size: int, payload: bytes, date: str, refers_to: str | None = None) -> bytes:
    """A WARC record that holds an HTTP response; that of a revisit has its header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples, or None if they are too few or too small for one."""
    size = min(DICT_BYTES, sum(map(len, samples)) // DICT_SHARE)
    if size < DICT_LEAST:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


class Archive:
    """One archive file: holds the first records back until there are enough to train on."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        self.files, path = arrow_fs.FileSystem.from_uri(self.uri)
        self.files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = self.files.open_output_stream(path, compression=None)  # by the name, it would compress again
        self.held: list[tuple[str, bytes]] = []
        self.held_bytes, self.written = 0, 0
        self.encoder: zstandard.ZstdCompressor | None = None
        self.index: list[tuple[str, int, int, str]] = []

    def add(self, record_id: str, data: bytes) -> None:
        if self.encoder is not None:
            self._write(record_id, data)
            return
        self.held.append((record_id, data))
        self.held_bytes += len(data)
        if self.held_bytes >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        trained = dictionary([data[:SAMPLE_PART] for _, data in self.held])
        if trained is not None:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
            self._put(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
        for record_id, data in self.held:
            self._write(record_id, data)
        self.held = []

    def _write(self, record_id: str, data: bytes) -> None:
        packed = self.encoder.compress(data)
        self.index.append((self.uri, self.written, len(packed), record_id))
        self._put(packed)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def close(self) -> list[tuple[str, int, int, str]]:
        if self.encoder is None:
            self._begin()
        self.out.close()
        return self.index


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive every page below ``folder`` (a shared path); returns the stored index: path, offset, length, record_id of each record."""
    with scratch(pages.sparkSession) as stored:
        html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
        keyed = stored(pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{id_col}`").alias("order"), F.col(f"`{url_col}`").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")))
        first = F.min(F.struct(F.col("order").isNull().alias("last"), "order", "row", "id"))
        known = stored(keyed.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.row").alias("first_row"), F.col("first.id").alias("first_id")))
        again = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
        rows = lookup(keyed.drop("order"), known, ["digest"], "left").select("id", "url", "digest", "size", again.alias("again"), "first_id", F.when(~again | F.col("first_row").isNull(), F.col("html")).otherwise("").alias("html"))

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            archive, serial = None, uuid.uuid4().hex
            schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())])
            written = lambda index: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), schema.types, strict=True)], schema=schema)
            n = 0
            for whole in batches:
                for batch in slices(whole, "html"):
                    for row in batch.to_pylist():
                        n += 1
                        own = "" if row["id"] is None else row["id"]
                        name = f"{URN}:{own}:{row['digest']}"
                        payload = row["html"].encode()
                        if row["again"]:
                            name += f":{serial}-{n}"
                            refers = f"{URN}:{'' if row['first_id'] is None else row['first_id']}:{row['digest']}"
                            data = record("revisit", name, row["url"], row["digest"], row["size"], b"", date, refers)
                        else:
                            name += f":{serial}-{n}" if row["size"] < MIN_REVISIT else ""
                            data = record("response", name, row["url"], row["digest"], row["size"], payload, date)
                        archive = archive or Archive(folder)
                        archive.add(name, data)
                        if archive.written >= ARCHIVE_BYTES:
                            yield written(archive.close())
                            archive = None
            if archive is not None:
                yield written(archive.close())

        return materialize(rows.mapInArrow(write, INDEX))


def open_frames(uri: str) -> tuple[io.BufferedIOBase, zstandard.ZstdDecompressor]:
    """An archive's file, placed behind its leading frame, and a decoder with its dictionary."""
    files, path = arrow_fs.FileSystem.from_uri(uri)
    file = files.open_input_file(path)
    head = file.read(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        data = file.read(struct.unpack("<I", head[4:])[0])
        if data[:4] == struct.pack("<I", FRAME):
            data = zstandard.ZstdDecompressor().decompress(data)
        return file, zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    file.seek(0)
    return file, zstandard.ZstdDecompressor()


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each WARC record of a stream."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(": ")
            headers[name.lower()] = value
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut off")
        yield headers, block


def read_record(uri: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    file, decoder = open_frames(uri)
    with file:
        file.seek(offset)
        return next(parse(io.BytesIO(decoder.decompress(file.read(length)))))


def _row(uri: str, headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    kind, digest, name = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-record-id"].strip("<>")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"the payload of {name} does not have its digest")
    of = lambda urn: urn[len(URN) + 1 :].rsplit(f":{digest}", 1)[0] or None
    url = headers.get("warc-target-uri")
    refers = headers.get("warc-refers-to")
    return uri, kind, name, of(name), None if url is None else re.sub(r"%([0-7][0-9A-F])", lambda m: chr(int(m[1], 16)), url), size, digest, None if refers is None else of(refers.strip("<>")), payload if with_payload and kind == "response" else None


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives that ``index`` names: path, record_type, record_id, page_id, url, payload_bytes, payload_digest, refers_to (a page_id), payload."""
    paths = index.select("path").distinct()
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                file, decoder = open_frames(uri)
                rows, size = [], 0
                with file, decoder.stream_reader(file, read_across_frames=True) as frames:
                    for headers, block in parse(io.BufferedReader(frames, 1 << 20)):
                        rows.append(_row(uri, headers, block, with_payload))
                        size += len(block) if with_payload else 400
                        if size >= 4 << 20:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    files = paths.count()
    # a given number of partitions is not merged again, though the paths are few bytes
    return paths.repartition(max(1, min(files, 10_000))).mapInArrow(read, RECORDS)


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every row of ``pages``, read the archives back, and tell what each record holds."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = shared_dir(spark)
    try:
        index = write_archives(pages, folder)
        found = read_archives(index, with_payload=False)
        kind = pages.schema["page_id"].dataType
        return materialize(found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")))
    finally:
        drop_path(spark, folder)


OP11_SQL = f"""
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT page_id, h, strlen(h) >= {MIN_REVISIT} AND row_number() OVER w > 1 AS again, first_value(page_id) OVER w AS first
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages) WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
"""

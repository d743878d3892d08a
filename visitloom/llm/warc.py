"""WARC records in seekable Zstandard bundles, and reading them back.

Each task writes its pages to bundles of some MB in the shared folder. Records are grouped into independent Zstandard frames;
a last, skippable frame is the seek table of the seekable format (compressed and decompressed size of every frame, and their
count), so any Zstandard reader can read a bundle and a seeking reader can open one frame. The index, a Parquet table, maps
each record to bundle, frame and place within the frame. Bundles have names of their own for each attempt of a task, and
the index holds only what successful attempts wrote; :func:`remove_orphans` deletes the rest.

Records are those of WARC 1.1: a bundle begins with a warcinfo record, every record has its mandatory fields, and its identifier
is made of the archive, the page id and the row's place in the table, so that no two records share one. The date is a
parameter, or the time of the call, for all records; attempts that run again write the same.

Of pages with equal payloads (SHA-1 and length), that with the smallest id is a response record; the others are revisit
records that refer to it and hold no payload, only its length and digest. A hot payload costs one id per page, as the group
is formed from digests and its smallest id is found by a partial aggregate.

Defined results: null html is an empty payload; rows that repeat the smallest id of a payload are responses all; a null id
is no smallest id unless all ids of the payload are null, then all are responses; a null or blank url is ``about:blank``;
payloads may have any length, and one above a frame's size fills a frame of its own; an empty table writes no bundle and gives no
rows; extra columns are not read. The pages should be a stored table, whose rows have the same places each time it is read.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import whole_text
from visitloom.sources.workspace import materialize, new_path

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes before compression: of a frame, and of a bundle.
FRAME, BUNDLE = 1 << 18, 1 << 26
INDEX = "page_id long, record_id string, bundle string, frame int, record int, start long, length long"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, page_id: int | None, place: int) -> str:
    return f"<urn:page:{archive}:{'' if page_id is None else page_id}:{place}>"


def _written(head: list[tuple[str, str]], block: bytes) -> bytes:
    head = [*head, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def information(archive: str, name: str, date: str) -> bytes:
    """The warcinfo record at the begin of a bundle."""
    return _written([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:page:{archive}:bundle:{name}>"), ("WARC-Date", date),
                     ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                    b"software: visitloom\r\nformat: WARC File Format 1.1\r\n")


def record(name: str, date: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC 1.1 record. ``refers_to``, the identifier of another, makes it a revisit."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date),
            ("WARC-Target-URI", "%20".join((url or "").split()) or "about:blank"), ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
            ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Refers-To", refers_to),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _written(head, block)


def parse(data: bytes) -> dict:
    """Headers, HTTP headers and payload of a record; ``payload`` is None in a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_headers = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"headers": headers, "http": http_headers, "payload": payload if headers["WARC-Type"] == "response" else None}


def open_file(path: str, mode: str):
    """A file of any store that Arrow knows, or of the shared folder as mounted here."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "r":
        return store.open_input_file(place)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    return store.open_output_stream(place, compression=None)


class Bundle:
    """Writes frames and, at the end, the seek table. A frame is held in memory until it is full."""

    def __init__(self, path: str, level: int = 3):
        self.path, self._file, self._zstd = path, open_file(path, "w"), zstandard.ZstdCompressor(level=level)
        self._frame, self._sizes, self._records, self.written = bytearray(), [], 0, 0

    def add(self, data: bytes) -> tuple[int, int, int, int]:
        """Frame, place in the order of its records, first byte within the frame, length."""
        if self._frame and len(self._frame) + len(data) > FRAME:
            self._flush()
        place = len(self._sizes), self._records, len(self._frame), len(data)
        self._frame += data
        self._records += 1
        self.written += len(data)
        return place

    def _flush(self) -> None:
        compressed = self._zstd.compress(bytes(self._frame))
        self._file.write(compressed)
        self._sizes.append((len(compressed), len(self._frame)))
        self._frame, self._records = bytearray(), 0

    def close(self) -> None:
        if self._frame:
            self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, SEEKABLE)
        self._file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self._file.close()


class BundleReader:
    """Opens single frames by the seek table at the end of the file."""

    def __init__(self, path: str):
        self._file = open_file(path, "r")
        size = self._file.size()
        count, _, magic = struct.unpack("<IBI", self._file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        table = self._file.read_at(8 * count, size - 9 - 8 * count)
        self.sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(count)]
        self.starts = [0]
        for compressed, _ in self.sizes:
            self.starts.append(self.starts[-1] + compressed)

    def frame(self, n: int) -> bytes:
        data = self._file.read_at(self.sizes[n][0], self.starts[n])
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=self.sizes[n][1])

    def close(self) -> None:
        self._file.close()


def write_archives(pages: DataFrame, path: str | None = None, date: str | None = None) -> DataFrame:
    """Writes all pages and returns the index (written, so that nothing is archived twice). ``date``: as ``2024-01-31T00:00:00Z``."""
    path = path or new_path(pages.sparkSession, "archives")
    date = date or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    archive, payload = hashlib.md5(f"{path} {date}".encode()).hexdigest(), whole_text(pages, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                        payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n"),
                        F.monotonically_increasing_id().alias("place"))
    narrow = materialize(rows.select("page_id", "sha", "n", "place"), "payload-digests")
    # Smallest id, and of its rows one: both from partial aggregates of numbers.
    smallest = narrow.groupBy("sha", "n").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    met = narrow.join(smallest, ["sha", "n"])
    firsts = met.where(F.col("page_id").eqNullSafe(F.col("first_id"))).groupBy("sha", "n").agg(F.min("place").alias("first_place"))
    # Only revisits are looked up again, by place: no key of this join is hot.
    revisits = met.where(~F.col("page_id").eqNullSafe(F.col("first_id"))).join(firsts, ["sha", "n"]).select(
        F.col("place").alias("to_place"), "first_id", "first_place")
    decided = rows.join(revisits, F.col("place") == F.col("to_place"), "left")

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for b in batches:
            index = []
            for page_id, place, url, html, first_id, first_place in zip(*(b.column(c).to_pylist() for c in range(6))):
                if bundle is not None and bundle.written >= BUNDLE:
                    bundle.close()
                    bundle = None
                if bundle is None:
                    bundle = Bundle(f"{path}/{uuid.uuid4().hex}.warc.zst")
                    bundle.add(information(archive, bundle.path.rpartition("/")[2], date))
                name = record_id(archive, page_id, place)
                refers_to = None if first_place is None else record_id(archive, first_id, first_place)
                index.append((page_id, name, bundle.path, *bundle.add(record(name, date, url, html.encode(), refers_to))))
            columns = list(zip(*index)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in INDEX.split(", ")])
        if bundle is not None:
            bundle.close()

    return materialize(decided.select("page_id", "place", "url", "html", "first_id", "first_place").mapInArrow(archived, INDEX), "archive-index")


def remove_orphans(index: DataFrame, path: str) -> int:
    """Deletes the bundles under ``path`` that the index doesn't hold, which attempts that failed left behind; returns how many."""
    spark = index.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [(s.getPath().getName(),) for s in (system.listStatus(folder) if system.exists(folder) else [])]
    known = index.select(F.substring_index("bundle", "/", -1).alias("name")).distinct()
    orphans = spark.createDataFrame(names, "name string").where(F.col("name").endswith(".warc.zst")).join(known, "name", "left_anti").collect()
    for r in orphans:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{r.name}"), False)
    return len(orphans)


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Reads each record at its place in the index: page_id, payload_bytes, payload_digest (of the payload itself where the
    record holds it), record_type, refers_to and, if asked for, payload (null in revisits)."""
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if with_payload:
        fields, kinds = fields + ", payload binary", [*kinds, pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader, number, frame = None, None, None, b""
        for b in batches:
            out = []
            for bundle, n, start, length in zip(*(b.column(c).to_pylist() for c in range(4))):
                if bundle != path:
                    if reader:
                        reader.close()
                    path, reader, number = bundle, BundleReader(bundle), None
                if n != number:
                    number, frame = n, reader.frame(n)
                found = parse(frame[start: start + length])
                head, payload = found["headers"], found["payload"]
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if payload is None else _digest(payload)
                refers = head.get("WARC-Refers-To")
                out.append((_page(head["WARC-Record-ID"]), int(found["http"]["Content-Length"]), digest, head["WARC-Type"],
                            refers and _page(refers), payload))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in fields.split(", ")])
        if reader:
            reader.close()

    return index.select("bundle", "frame", "start", "length").mapInArrow(read, fields)


def _page(name: str) -> int | None:
    number = name.split(":")[3]
    return int(number) if number else None

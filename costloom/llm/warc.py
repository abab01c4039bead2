"""WARC archives as seekable Zstandard bundles, with a record index, and revisit records for repeated payloads."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from costloom.llm.storage import stored
from costloom.operators import joins

FRAME_BYTES = 256 << 10  # of records, uncompressed, before a frame ends; a larger record has a frame of its own
BUNDLE_BYTES = 256 << 20  # compressed, before the next bundle begins
READ_BYTES = 4 << 20  # packed bytes of the frames that one task reads
REVISIT_BYTES = 100  # payloads below are always written in full

# Fixed values of the seekable Zstandard format and of WARC 1.1.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_FOOTER, _FOOTER_BYTES = "<IBI", 9  # frames, descriptor, magic number
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = "page_id long, record_id string, bundle string, frame long, frame_at long, frame_size long, record_at long, record_size long"
RECORDS = "page_id long, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"


def _open(place: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(place)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> tuple[str, bytes]:
    """Identifier and bytes of a response record or, if ``first`` names an earlier page, of a revisit record."""
    name = record_id(page_id, digest)
    block = _HTTP + (payload if first is None else b"")
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if first is not None:
        fields += [("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page", str(first)), ("WARC-Profile", _PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return name, head.encode() + block + b"\r\n\r\n"


def _parsed(data: bytes) -> Iterator[tuple]:
    """The records of a frame as rows of ``RECORDS``. A wrong length or digest raises."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines)
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut")
        at = end + 8 + size
        payload, digest = block[len(_HTTP) :], head["WARC-Payload-Digest"].removeprefix("sha256:")
        response = head["WARC-Type"] == "response"
        if response and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
        page, first, url = head.get("X-Page-ID"), head.get("X-Refers-To-Page"), head.get("WARC-Target-URI")
        yield (
            None if page is None else int(page), head["WARC-Record-ID"], head["WARC-Type"], None if first is None else int(first),
            int(head["X-Payload-Length"]), digest,
            None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            payload if response else None,
        )


class Bundle:
    """One file: independent frames, then a seek table in a skippable frame at its end."""

    def __init__(self, folder: str) -> None:
        import zstandard

        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"  # of this attempt; only the index says which bundles count
        self.place, self.out = f"{folder}/{name}", files.open_output_stream(f"{path}/{name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.written, self.open, self.open_size, self.rows = 0, [], 0, []

    def add(self, page_id: int | None, name: str, data: bytes) -> None:
        self.rows.append((page_id, name, self.open_size, len(data)))
        self.open.append(data)
        self.open_size += len(data)

    def end_frame(self) -> list[tuple]:
        """Write the open records as a frame; their index rows."""
        if not self.open:
            return []
        packed = self.packer.compress(b"".join(self.open))
        self.out.write(packed)
        frame, at = len(self.sizes), self.written
        index = [(page, name, self.place, frame, at, len(packed), start, size) for page, name, start, size in self.rows]
        self.sizes.append((len(packed), self.open_size))
        self.written += len(packed)
        self.open, self.open_size, self.rows = [], 0, []
        return index

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        table = entries + struct.pack(_FOOTER, len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])


def _kinds(schema: str) -> list[tuple[str, pa.DataType]]:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return [(n, types[k]) for n, k in (x.split() for x in schema.split(", "))]


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row below ``folder``, which all executors reach, and return the stored index of ``INDEX``.

    Payloads are UTF-8, null is empty. Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the
    least id holds the payload and those with larger ids revisit it; rows with a null id are always responses, and rows
    that repeat the least id too. Digests that occur again are found by an aggregation without payloads; while they are
    few enough to broadcast, no payload is shuffled, and beyond that a digest that many rows share is split over tasks.
    Each task attempt writes bundles of its own, from one Arrow batch and one open frame in memory; the index is
    committed by Spark and names the bundles of successful attempts alone. An empty table gives an empty index and no
    bundle. Payloads of any length are written whole, those above ``FRAME_BYTES`` in a frame of their own; other columns
    are not looked at, whatever their names.
    """
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    long = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = stored(long.where("n > 1").select("digest", "first"), "digests")
    typed = joins.lookup(rows, again, ["digest"], spread_by=["page_id", "url"])
    typed = typed.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("first"))
    kinds = _kinds(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            index: list[tuple] = []
            for page_id, url, data, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                bundle = bundle or Bundle(folder)
                name, text = record(page_id, url, data, digest, first, date)
                bundle.add(page_id, name, text)
                if bundle.open_size >= FRAME_BYTES:
                    index += bundle.end_frame()
                if bundle.written >= BUNDLE_BYTES:
                    index += bundle.end_frame()
                    bundle.close()
                    bundle = None
            yield _batch(index, kinds)
        if bundle:
            yield _batch(bundle.end_frame(), kinds)
            bundle.close()

    return stored(typed.mapInArrow(run, INDEX), "index")


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seek table of each bundle, read from its end."""
    kinds = _kinds("bundle string, frame_at long, frame_size long")
    for batch in batches:
        for place in batch.column(0).to_pylist():
            files, path = _open(place)
            with files.open_input_file(path) as file:
                size = file.size()
                n, _, magic = struct.unpack(_FOOTER, file.read_at(_FOOTER_BYTES, size - _FOOTER_BYTES))
                if magic != _SEEKABLE:
                    raise ValueError(f"{place} has no seek table")
                entries = struct.unpack(f"<{2 * n}I", file.read_at(8 * n, size - _FOOTER_BYTES - 8 * n))
            at, rows = 0, []
            for packed in entries[::2]:
                rows.append((place, at, packed))
                at += packed
            yield _batch(rows, kinds)


def _unpacked(place: str, at: int, size: int) -> bytes:
    import zstandard

    files, path = _open(place)
    with files.open_input_file(path) as file:
        return zstandard.ZstdDecompressor().decompress(file.read_at(size, at))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = _kinds(RECORDS)
    for batch in batches:
        for place, at, size in zip(*(c.to_pylist() for c in batch.columns)):
            yield _batch(list(_parsed(_unpacked(place, at, size))), kinds)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of the bundles named in the column ``bundle``, as rows of ``RECORDS``, in no order.

    The footers give the frames, which are dealt out to a task for each ``READ_BYTES`` packed bytes: tasks read byte
    ranges, whatever the size of a bundle. The number is given, because rows that only name a frame are few bytes, and
    adaptive execution would merge them into one task.
    Each response's digest is verified; damage raises. The payload of a revisit is null, its length and digest are not.
    """
    fields = "bundle string, frame_at long, frame_size long"
    frames = stored(bundles.select("bundle").distinct().mapInArrow(_frames, fields), "frames")
    tasks = max(1, -(-(frames.agg(F.sum("frame_size")).first()[0] or 0) // READ_BYTES))
    return frames.repartition(tasks, "bundle", "frame_at").mapInArrow(_records, RECORDS)


def fetch_records(index: DataFrame) -> DataFrame:
    """The records of some rows of an index, each cut out of its frame by its offset."""
    kinds = _kinds(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, at, size, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                yield _batch(list(_parsed(_unpacked(place, at, size)[start : start + length])), kinds)

    return index.select("bundle", "frame_at", "frame_size", "record_at", "record_size").mapInArrow(run, RECORDS)

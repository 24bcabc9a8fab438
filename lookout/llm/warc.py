"""Seekable Zstandard bundles of WARC records.

A bundle is a file of independent Zstandard frames, each with the records of a
group; behind them a skippable frame maps record ids to (frame, offset within
the decompressed frame, length), and a seek table in the seekable format's
footer gives every frame's sizes. A reader decompresses any frame by itself.

Bundles are written and read by Spark's own file sources, so any store that
Spark reaches will do: a bundle is one row, written as one file whose "line
separator" is the footer's magic number, the bundle's last four bytes.
"""

from __future__ import annotations

import hashlib
import json
import struct
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.llm.common import scratch_path, written

# FIXED VALUES of the formats
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
MAGIC_TEXT = struct.pack("<I", SEEKABLE_MAGIC).decode("latin-1")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    min_revisit: int = 1000         # bytes from which equal payloads are written once
    frame_bytes: int = 256 << 10    # decompressed size at which a frame ends
    bundle_bytes: int = 8 << 20     # compressed size at which a bundle ends
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"  # of records of tables that have no capture time


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                 params: WarcParams = WarcParams()) -> DataFrame:
    """Each row's record: ``page_id``, ``url``, ``payload``, ``digest``, ``record_type``, ``refers_to``.

    Of rows with equal payloads of at least ``min_revisit`` bytes, that with the
    largest id (and repeats of it) is the response, others revisit it; a group
    whose ids are all null has responses only. A null html is an empty payload.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        F.encode(F.coalesce(html, F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= params.min_revisit).groupBy("digest") \
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    planned = rows.join(written(groups, "warc-groups"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return planned.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                          F.when(again, F.col("first")).alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:sha1:{digest}>"


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class _Bundle:
    """A bundle in the making."""

    def __init__(self, params: WarcParams):
        self.params, self.frames, self.index, self.sizes = params, [], [], []
        self.group, self.group_size = [], 0

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.group_size, len(record)))
        self.group.append(record)
        self.group_size += len(record)
        if self.group_size >= self.params.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.group:
            frame = zstandard.ZstdCompressor(level=self.params.level, write_checksum=True).compress(b"".join(self.group))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.group_size))
            self.group, self.group_size = [], 0

    @property
    def size(self) -> int:
        return sum(c for c, _ in self.sizes)

    def finish(self) -> bytes:
        self.end_frame()
        index = _skippable(SKIPPABLE_INDEX, zstandard.ZstdCompressor(level=self.params.level).compress(json.dumps(self.index).encode()))
        entries = [*self.sizes, (len(index), 0)]
        table = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, SEEKABLE_MAGIC)
        return b"".join([*self.frames, index, _skippable(SKIPPABLE_SEEK_TABLE, table)])


def _bundles(batches, params: WarcParams):
    bundle = None

    def row(b: _Bundle):
        return pa.RecordBatch.from_arrays([pa.array([b.finish()], pa.binary())], names=["bundle"])

    for batch in batches:
        for page_id, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
            bundle = bundle or _Bundle(params)
            bundle.add(_record_id(page_id, digest), _record(page_id, url, payload, digest, kind, refers_to, params.date))
            if bundle.size >= params.bundle_bytes:
                yield row(bundle)
                bundle = None
    if bundle:
        yield row(bundle)


def write_bundles(records: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Write planned records as bundles, one file each, into ``path``."""
    made = records.select("page_id", "url", "payload", "digest", "record_type", "refers_to") \
        .mapInArrow(lambda it: _bundles(it, params), "bundle binary")
    body = F.expr(f"substring(bundle, 1, octet_length(bundle) - {len(MAGIC_TEXT)})")
    made.select(body.cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", MAGIC_TEXT) \
        .option("maxRecordsPerFile", 1).text(path)


# ---------------------------------------------------------------------------
# reading
# ---------------------------------------------------------------------------
def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, the record index last."""
    count, _, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    at, out = 0, []
    for i in range(count):
        packed, full = struct.unpack_from("<II", bundle, len(bundle) - 9 - 8 * (count - i))
        out.append((at, packed, full))
        at += packed
    return out


def record_index(bundle: bytes) -> list[list]:
    """[record id, frame, offset within the frame, length] of each record."""
    at, packed, _ = seek_table(bundle)[-1]
    return json.loads(zstandard.ZstdDecompressor().decompressobj().decompress(bundle[at + 8:at + packed]))


def read_frame(bundle: bytes, frame: int) -> bytes:
    at, packed, full = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at:at + packed], max_output_size=full)


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record; a response's payload is checked against its digest."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda urn: int(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length,
            "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")),
            "payload": payload if fields["WARC-Type"] == "response" else None}


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
RECORD_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the bundles in ``path``, frame by frame; without ``payload`` that column is null."""
    def run(batches):
        for batch in batches:
            for bundle in batch.column(0):
                bundle = bundle.as_py()
                for frame, places in groupby(record_index(bundle), lambda place: place[1]):
                    data = read_frame(bundle, frame)
                    found = [parse_record(data[at:at + n]) for _, _, at, n in places]
                    if not payload:
                        found = [r | {"payload": None} for r in found]
                    yield pa.RecordBatch.from_pylist(found, RECORD)

    return _files(spark, path).select("content").mapInArrow(run, RECORD_DDL)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Where every record lies: ``path``, ``record_id``, ``frame``, ``frame_at``, ``frame_bytes``, ``offset``, ``length``."""
    def run(batches):
        for batch in batches:
            for name, bundle in zip(batch.column(0).to_pylist(), batch.column(1)):
                bundle = bundle.as_py()
                table = seek_table(bundle)
                rows = [(name, r, f, table[f][0], table[f][1], at, n) for r, f, at, n in record_index(bundle)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                                 names=["path", "record_id", "frame", "frame_at", "frame_bytes", "offset", "length"])

    return _files(spark, path).select("path", "content").mapInArrow(
        run, "path string, record_id string, frame long, frame_at long, frame_bytes long, offset long, length long")


def fetch(spark: SparkSession, path: str, record_ids: DataFrame) -> DataFrame:
    """The records of given ids (column ``record_id``): only the frames that hold them are decompressed."""
    wanted = read_index(spark, path).join(record_ids.select("record_id").distinct(), "record_id", "left_semi") \
        .groupBy("path").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))

    def run(batches):
        for batch in batches:
            for bundle, places in zip(batch.column(0), batch.column(1).to_pylist()):
                bundle, places = bundle.as_py(), sorted(places, key=lambda p: (p["frame"], p["offset"]))
                for frame, here in groupby(places, lambda p: p["frame"]):
                    data = read_frame(bundle, frame)
                    yield pa.RecordBatch.from_pylist(
                        [parse_record(data[p["offset"]:p["offset"] + p["length"]]) for p in here], RECORD)

    return _files(spark, path).join(wanted, "path").select("content", "places").mapInArrow(run, RECORD_DDL)


def archive(pages: DataFrame, path: str | None = None, params: WarcParams = WarcParams()) -> str:
    """Plan and write the records of all pages; returns the folder, by default a new one in the shared folder."""
    path = path or scratch_path(pages, "warc")
    write_bundles(plan_records(pages, params=params), path, params)
    return path

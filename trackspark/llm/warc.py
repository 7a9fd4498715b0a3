"""WARC archives as a PySpark Python data source: one gzip member for each record.

Reader options: ``path``; ``payload`` ("false": payloads are not decoded). Filters on
``record_type`` and on header columns are pushed down and tested on the header block;
only then is a payload decoded. Members carry their lengths in gzip's extra field
``sl`` (skip lengths of the WARC format), so unwanted ones are passed over in the file.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, page_id long, refers_to_page_id long, payload_length long, payload binary"
#: Column by header.
HEADERS = {
    "warc-type": "record_type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-date": "date",
    "warc-payload-digest": "payload_digest", "warc-refers-to": "refers_to", "x-page-id": "page_id", "x-refers-to-page-id": "refers_to_page_id",
    "x-payload-length": "payload_length",
}
_LONGS = {"page_id", "refers_to_page_id", "payload_length"}
#: A revisit of an identical payload, as the WARC format names it.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def member(record: bytes) -> bytes:
    """One gzip member with its own and the record's length in the extra field."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    total = 24 + len(body) + 8  # 12 of header and extra length, 12 of the field
    if max(total, len(record)) >= 1 << 32:
        raise ValueError("a record has to be shorter than 4 GiB")
    extra = b"sl" + struct.pack("<HII", 8, total, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record))


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record; header values lose control characters (as %XX), null ones are left out."""
    lines = ["WARC/1.1"]
    for name, value in headers:
        if value is not None:
            lines.append(f"{name}: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value)))
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _digest(sha1: str | None) -> str | None:
    return sha1 and "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def parse_headers(head: bytes) -> dict[str, object]:
    row: dict[str, object] = {"content_length": 0}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "content-length":
            row["content_length"] = int(value)
        elif column := HEADERS.get(name):
            row[column] = int(value) if column in _LONGS else value
    digest = str(row.get("payload_digest", ""))
    if digest.startswith("sha1:") and len(digest) == 37:
        row["payload_digest"] = base64.b32decode(digest[5:]).hex()
    return row


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.per_task = int(options.get("bytes_per_task", 64 << 20))
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS.values() and isinstance(f, EqualTo):
                self.wanted.append((column, {f.value}))
            elif column in HEADERS.values() and isinstance(f, In):
                self.wanted.append((column, set(f.value)))
            elif not (column in HEADERS.values() and isinstance(f, IsNotNull)):
                yield f
            else:
                self.wanted.append((column, None))

    def partitions(self) -> Sequence[InputPartition]:
        """Archives in order of name, put together up to ``bytes_per_task``."""
        from pyarrow import fs

        store, root = _store(self.path)
        found = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.path.endswith(".warc.gz")]
        out, now, size = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            if now and size + x.size > self.per_task:
                out.append(Files(tuple(now)))
                now, size = [], 0
            now.append(x.path)
            size += x.size
        return [*out, Files(tuple(now))]

    def read(self, partition: Files) -> Iterator[tuple]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                at, end = 0, f.size()
                while at < end:
                    f.seek(at)
                    front = f.read(4096)
                    if front[:4] != b"\x1f\x8b\x08\x04" or front[12:14] != b"sl":
                        raise ValueError(f"{path}: no member with skip lengths at {at}")
                    total = struct.unpack("<I", front[16:20])[0]
                    inflate = zlib.decompressobj(-15)
                    head, taken = inflate.decompress(front[24:total], 2048), len(front)
                    while b"\r\n\r\n" not in head:
                        if inflate.unconsumed_tail:
                            head += inflate.decompress(inflate.unconsumed_tail, 2048)
                        elif taken < total:
                            more = f.read(min(4096, total - taken))
                            taken += len(more)
                            head += inflate.decompress(more, 2048)
                        else:
                            raise ValueError(f"{path}: no end of headers in the record at {at}")
                    head, _, body = head.partition(b"\r\n\r\n")
                    row = parse_headers(head)
                    if all(row.get(c) in v if v is not None else row.get(c) is not None for c, v in self.wanted):
                        if self.payload and row.get("record_type") != "revisit":
                            body += inflate.decompress(inflate.unconsumed_tail + f.read(max(0, total - taken)))
                            row["payload"] = body[: row["content_length"]]
                        yield tuple(row.get(c) for c in columns)
                    at += total


class WarcWriter(DataSourceWriter):
    """Writes an archive for each task under a name of its own; the driver names those of tasks that count ``.warc.gz``."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.names = options["path"], schema.names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        path, out = f"{root}/part-{uuid.uuid4().hex}.open", None
        for row in rows:
            if out is None:
                out = store.open_output_stream(path)
                info = b"software: trackspark\r\nformat: WARC File Format 1.1\r\n"
                out.write(member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], info)))
            r = dict(zip(self.names, row))
            kind = r["record_type"]
            block = b"" if kind == "revisit" else bytes(r["payload"] or b"")
            headers = [
                ("WARC-Type", kind), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["target_uri"]),
                ("WARC-Payload-Digest", _digest(r["payload_digest"])), ("WARC-Profile", PROFILE if kind == "revisit" else None), ("WARC-Refers-To", r["refers_to"]),
                ("X-Page-ID", r["page_id"]), ("X-Refers-To-Page-ID", r["refers_to_page_id"]), ("X-Payload-Length", r["payload_length"]),
            ]
            out.write(member(record(headers, block)))
        if out is not None:
            out.close()
        return Written(path if out is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.path:
                store.move(m.path, m.path.removesuffix(".open") + ".warc.gz")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None and m.path:
                store.delete_file(m.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known, with push-down of filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows of ``SCHEMA`` from ``page_id``, ``url``, ``html`` (null html: empty).

    Of records with one payload of at least ``least`` bytes that with the largest ``page_id`` is the
    response (each of them, if several rows share that id; null ids are least) and the others
    revisit it; smaller payloads are responses. Digests are counted before payloads move, and only
    digests and ids take part in that count.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"sha1": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    groups = ids.where(F.octet_length("payload") >= least).groupBy(F.sha1("payload").alias("sha1_")).agg(F.count("*").alias("n"), F.max("page_id").alias("newest"))
    # Payloads that come once are their own responses and meet no one here.
    p = p.join(groups.where("n > 1"), (F.col("sha1") == F.col("sha1_")) & (F.col("payload_length") >= least), "left")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    name = lambda c: F.concat(F.lit("<urn:trackspark:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return p.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"), "target_uri", F.lit(date).alias("date"),
        F.col("sha1").alias("payload_digest"), F.when(revisit, name(F.col("newest"))).alias("refers_to"), "page_id",
        F.when(revisit, F.col("newest")).alias("refers_to_page_id"), "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackspark.llm import shared

    register(spark)
    path = shared.scratch(spark, "warc")
    records(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))

    return back.select(
        "page_id", F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", F.col("refers_to_page_id").alias("refers_to"),
    )

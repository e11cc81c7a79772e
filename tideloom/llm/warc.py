"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition per archive file, and the writer starts a new file in time. Predicates
on the record type and other header columns are pushed down. A record's headers are parsed first; the block of
a record that isn't wanted, or whose payload isn't, is passed over without decoding. Compressed archives hold
one gzip member per record with its length in an extra field ("sl"), so they can be passed over as well; those
of other writers can't and are decompressed through.

Written files count only once they are in a manifest that the driver commits. So tasks that ran twice or
died with their executor leave nothing that a reader sees.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import new_path, written

SCHEMA = """record_id string, record_type string, date string, target_uri string, payload_digest string,
    refers_to string, content_length bigint, headers map<string,string>, payload binary"""
# fixed values of the format
VERSION = b"WARC/1.1"
NAMES = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
         "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
MEMBER = "<4s4sBBHccHII"  # gzip header with the extra field: compressed and plain length
MEMBER_SIZE = struct.calcsize(MEMBER)
# parameters
DATE = "2024-01-01T00:00:00Z"
ROLL = 32 << 20  # bytes after which the writer starts a new file
LEVEL = 2
CHUNK = 1 << 16
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# reading


def parse_headers(raw: bytes) -> dict[str, str]:
    """The named fields of a header block; its first line is the version."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}


def _plain(f) -> Iterator[tuple[dict, Callable[[], bytes]]]:
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        raw = b""
        while END not in raw:
            more = f.read(CHUNK // 16)
            if not more:
                raise ValueError("a record ends in its headers")
            raw += more
        headers = parse_headers(raw[: raw.index(END)])
        start, length = at + raw.index(END) + 4, int(headers["Content-Length"])

        def block(start=start, length=length) -> bytes:
            f.seek(start)
            return f.read(length)

        yield headers, block
        at = start + length + 4


def _compressed(f) -> Iterator[tuple[dict, Callable[[], bytes]]]:
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        held = f.read(CHUNK)
        known = None
        if len(held) >= MEMBER_SIZE and held[3] & 4 and held[12:14] == b"sl":
            known = struct.unpack(MEMBER, held[: MEMBER_SIZE])[8]
        inflate, plain, ended = zlib.decompressobj(31), b"", at + len(held)
        while END not in plain:
            plain += inflate.decompress(held, CHUNK // 16)
            held = inflate.unconsumed_tail or (b"" if inflate.eof else f.read(CHUNK))
            ended = f.tell()
            if not held and END not in plain:
                raise ValueError("a record ends in its headers")
        head = plain.index(END)
        headers = parse_headers(plain[:head])
        state = {"over": False}

        def rest(keep: bool, inflate=inflate, plain=plain, head=head, held=held, state=state) -> bytes:
            parts = [plain[head + 4 :]]
            while not inflate.eof:
                part = inflate.decompress(held)
                parts += [part] * keep
                held = b"" if inflate.eof else f.read(CHUNK)
                if not held and not inflate.eof:
                    raise ValueError("a record ends in its block")
            state |= {"over": True, "end": f.tell() - len(inflate.unused_data)}
            return b"".join(parts)

        def block(headers=headers, rest=rest, ended=ended) -> bytes:
            f.seek(ended)
            return rest(True)[: int(headers["Content-Length"])]

        yield headers, block
        if known:
            at += known
        else:
            if not state["over"]:
                f.seek(ended)
                rest(False)
            at = state["end"]


def records(f, compressed: bool) -> Iterator[tuple[dict, Callable[[], bytes]]]:
    """(headers, block) of each record; a block is read and decoded only when it is called for."""
    return _compressed(f) if compressed else _plain(f)


def payload_of(headers: dict, block: bytes) -> bytes:
    """The body of an HTTP message; any other block is the payload itself."""
    http = headers.get("Content-Type", "").startswith("application/http")
    return block.partition(END)[2] if http else block


@dataclass
class ArchiveFile(InputPartition):
    path: str


class Reader(DataSourceReader):
    """Options: path; payload = false leaves all payloads null and undecoded; verify = false skips digests."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.verify = options.get("verify", "true").lower() != "false"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for x in filters:
            if isinstance(x, (EqualTo, In)) and len(x.attribute) == 1 and x.attribute[0] in NAMES:
                values = {x.value} if isinstance(x, EqualTo) else set(x.value)
                name = x.attribute[0]
                self.wanted[name] = values & self.wanted.get(name, values)
            else:
                yield x

    def partitions(self):
        system, path = store(self.path)
        files = system.get_file_info(fs.FileSelector(path, recursive=False))
        manifests = [x.path for x in files if x.base_name.startswith("_manifest")]
        if manifests:
            names = [n for m in manifests for n in json.loads(system.open_input_file(m).read())]
        else:
            names = [x.base_name for x in files if x.base_name.endswith((".warc", ".warc.gz"))]
        return [ArchiveFile(f"{self.path.rstrip('/')}/{n}") for n in sorted(names)] or [ArchiveFile("")]

    def read(self, partition):
        if not partition.path:
            return
        system, path = store(partition.path)
        held, size = [], 0
        with system.open_input_file(path) as f:
            for headers, block in records(f, path.endswith(".gz")):
                row = {k: headers.get(name) for k, name in NAMES.items()}
                if any(row[k] not in values for k, values in self.wanted.items()):
                    continue
                payload = None
                if self.payload and row["record_type"] != "revisit":
                    payload = payload_of(headers, block())
                    said = (row["payload_digest"] or "").removeprefix("sha1:")
                    if self.verify and said and digest(payload) != said:
                        raise ValueError(f"{row['record_id']} doesn't have its digest")
                held.append({**row, "content_length": int(headers["Content-Length"]), "headers": list(headers.items()), "payload": payload})
                size += len(payload or b"")
                if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


ARROW = pa.schema([*[(k, pa.string()) for k in NAMES], ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, ARROW)


# writing


def record(fields: dict[str, str], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member that tells its length."""
    named = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    plain = VERSION + b"\r\n" + named.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + END
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    total = MEMBER_SIZE + len(body) + 8
    head = struct.pack(MEMBER, b"\x1f\x8b\x08\x04", bytes(4), 0, 255, 12, b"s", b"l", 8, total, len(plain) % (1 << 32))
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) % (1 << 32))


def http_response(payload: bytes, length: int) -> bytes:
    """A response message; the body may be left out."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + payload


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceArrowWriter):
    """Columns: record_id, record_type, date, target_uri, payload_digest, refers_to (may be null), payload."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll = int(options.get("roll", ROLL))

    def write(self, iterator):
        system, path = store(self.path)
        system.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for b in iterator:
            for row in b.to_pylist():
                if out is None or size > self.roll:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                size += out.write(self.encoded(row)) or 0
                size = out.tell()
        if out is not None:
            out.close()
        return Files(names)

    def encoded(self, row: dict) -> bytes:
        payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
        fields = {NAMES[k]: row[k] for k in ("record_id", "record_type", "date", "target_uri")}
        fields |= {"WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "X-Payload-Bytes": len(payload), "Content-Type": "application/http; msgtype=response"}
        if revisit:
            fields |= {"WARC-Refers-To": row["refers_to"], "WARC-Profile": REVISIT_PROFILE}
        if fields["WARC-Target-URI"]:
            fields["WARC-Target-URI"] = " ".join(fields["WARC-Target-URI"].split())
        return record(fields, http_response(b"" if revisit else payload, len(payload)))

    def commit(self, messages):
        system, path = store(self.path)
        system.create_dir(path, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        with system.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        system, path = store(self.path)
        for n in (n for m in messages if m is not None for n in m.names):
            system.delete_file(f"{path}/{n}")


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under ``path``; filters on header columns reach the source."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload)).load(path)


def record_id(page_id: str):
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">"))


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, sha1, and refers_to: the page that a page repeats, or null.

    Of pages with equal payloads of at least ``least`` bytes the largest page_id stays, the others refer to
    it. Repeated rows of that page_id all stay; a page without page_id is never referred to, and stays
    where no equal page has one. A null html is the empty payload.
    """
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload"))
    same = own.filter(F.length("payload") >= least).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    same = written(same.filter("n > 1").select(F.col("sha1").alias("same"), "last"), "same")
    joined = own.join(same, own["sha1"] == same["same"], "left")
    other = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "sha1", F.when(other, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """One record per page: response, or revisit of the page that has the same payload."""

    def base32(batches):
        for b in batches:
            hashed = [base64.b32encode(bytes.fromhex(x)).decode() for x in b.column("payload_digest").to_pylist()]
            yield b.set_column(b.schema.names.index("payload_digest"), "payload_digest", pa.array(hashed, pa.string()))

    spark = pages.sparkSession
    spark.dataSource.register(Warc)
    rows = planned(pages, least).select(
        record_id("page_id").alias("record_id"),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.lit(DATE).alias("date"),
        F.col("url").alias("target_uri"),
        F.col("sha1").alias("payload_digest"),
        F.when(F.col("refers_to").isNotNull(), record_id("refers_to")).alias("refers_to"),
        "payload",
    )
    rows.mapInArrow(base32, rows.schema).write.format("warc").mode("append").save(path)


def archived(pages: DataFrame) -> DataFrame:
    """Writes the archives of all pages, reads them back, and tells what each record says of its page."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    back = read(pages.sparkSession, path)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-page:(.*)>$", 1), F.lit("")).cast("bigint")
    return back.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.length("payload").cast("bigint"), F.col("headers")["X-Payload-Bytes"].cast("bigint")).alias("payload_bytes"),
        F.substring("payload_digest", 6, 64).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )

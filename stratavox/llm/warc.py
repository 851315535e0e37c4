"""WARC archives: a deduplicating writer and a splittable reader.

Writer: one gzip member per record.  Records of equal payload digest (and at least
`min_bytes` of payload) keep the payload once, in a `response`; the others are
`revisit` records that refer to it.  The digest's response is found by an
aggregate with map-side combine; the pages then join it on the digest, where Spark
splits a hot digest (the other side has one row each).  A task writes its rows to files
of bounded size in the shared folder under names of its own and reports them; only reported files
count, so a retried or speculative task leaves nothing that is read.

Reader: files are cut into byte ranges.  A task scans its range for the gzip magic,
and accepts a candidate if the member decodes to a WARC version line and a header; it
then owns every member that starts inside its range, following members from end to
start and scanning again after damage.  Records that run past the end are read on.  Any type
of record comes back (warcinfo, request, metadata, foreign responses without lengths or in
chunks, several records in a member); lengths come from the WARC header, payload length
and digest are computed, and what is no record is given out as rejected.
A round trip stores what it read and fails if a file gave more or fewer records than
its manifest says.

Edge cases: null html is an empty payload; a null url leaves the target out; a null page_id
counts as the smallest (its record has no page_id when read, and no other refers to it unless all of
its payload have none); repeated
page_ids make a record each; an empty table makes no file and no row; line ends in a
url are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import scratch

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
FEED = 16 << 10
RECORD = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, "
    "refers_to_id string, date string, headers map<string,string>, digest_ok boolean, place bigint, payload binary"
)
_OWN, _NAMELESS = 0x57A7C000 << 32, (0x57A7C000 << 32) | 1


def record_urn(page_id: int | None) -> str:
    """A UUID that carries the page_id in its low 64 bits; without page_id, a random one."""
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(int=(_NAMELESS << 64) | (uuid.uuid4().int & (2**64 - 1)))}>"
    return f"<urn:uuid:{uuid.UUID(int=(_OWN << 64) | (page_id & (2**64 - 1)))}>"


def page_of(urn: str | None) -> int | None:
    """The page_id in a record_urn(); null for other names."""
    try:
        name = uuid.UUID((urn or "").strip("<> ").rpartition(":")[2]).int
    except ValueError:
        return None
    low = name & (2**64 - 1)
    return None if name >> 64 != _OWN else low - 2**64 if low >= 2**63 else low


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzip member.  A revisit holds the HTTP headers only, with the full length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a space goes on from the one before."""
    out, name = {}, None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _unchunked(body: bytes) -> bytes:
    """The content of a body in chunks; the body itself if it is not in chunks."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return body
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _payload(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int | None]:
    """(payload, its length) of a record's block; a revisit has only the length its HTTP header states."""
    http = "http" in fields.get("content-type", "").lower() and block[:5] == b"HTTP/" or fields["warc-type"] == "request"
    if not http:
        return (None, None) if fields["warc-type"] == "revisit" else (block, len(block))
    head, _, body = block.partition(b"\r\n\r\n")
    said = _fields(head.split(b"\r\n")[1:])
    if fields["warc-type"] == "revisit":
        length = said.get("content-length", "")
        return None, int(length) if length.isdecimal() else None
    if "chunked" in said.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    return body, len(body)


def decode_records(raw: bytes) -> Iterator[dict]:
    """Fields of RECORD for each record in a member's content; ValueError where none begins or it is cut."""
    at = 0
    while True:
        while raw[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(raw):
            return
        cut = raw.find(b"\r\n\r\n", at)
        lines = raw[at:cut].split(b"\r\n")
        if cut < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC header")
        fields = _fields(lines[1:])
        length = fields.get("content-length", "")
        if not length.isdecimal() or "warc-type" not in fields:
            raise ValueError("no length or type")
        block = raw[cut + 4 : cut + 4 + int(length)]
        if len(block) < int(length):
            raise ValueError("short record")
        at = cut + 4 + int(length)
        payload, size = _payload(fields, block)
        algorithm, _, said = fields.get("warc-payload-digest", "").partition(":")
        own = digest(payload) if payload is not None else None
        known = algorithm.lower() == "sha1" and own is not None
        yield {
            "page_id": page_of(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": own or said or None,
            "record_type": fields["warc-type"], "refers_to": page_of(fields.get("warc-refers-to")), "record_id": fields.get("warc-record-id"),
            "refers_to_id": fields.get("warc-refers-to"), "date": fields.get("warc-date"), "headers": list(fields.items()),
            "digest_ok": own == said.upper() if known else None, "payload": payload,
        }


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark names it."""
    scheme, cut, rest = path.partition(":")
    if cut and scheme in ("s3a", "s3n"):
        path = "s3:" + rest
    elif cut and scheme == "dbfs":
        path = "file:///dbfs/" + rest.lstrip("/")
    elif cut and scheme == "file":
        path = "file:///" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(path)


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, date: str | None = None, file_bytes: int = 512 << 20) -> DataFrame:
    """Writes pages(page_id, url, html) as WARC files of about file_bytes at most under folder; returns the
    manifest (path, n_records, n_bytes), itself stored there.  date: of the records (now)."""
    spark = pages.sparkSession
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload"))
    shared = (
        keyed.filter(F.length("payload") >= min_bytes)
        .groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
        .filter("copies > 1").select("digest", "response")
    )
    joined = keyed.join(shared, "digest", "left").select(
        "page_id", "url", "payload", F.when((F.length("payload") >= min_bytes) & ~F.col("response").eqNullSafe(F.col("page_id")), F.col("response")).alias("refers_to")
    )
    files, manifest = f"{folder}/archive", f"{folder}/manifest"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rows = (row for batch in batches for row in zip(*(batch.column(i) for i in range(4)), strict=True))
        for row in rows:
            path = f"{files}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
            fs, local = _open(path)
            fs.create_dir(local.rpartition("/")[0], recursive=True)
            n = size = 0
            with fs.open_output_stream(local, compression=None) as out:
                for page_id, url, payload, refers in itertools.chain([row], rows):
                    member = encode_record(page_id.as_py(), url.as_py(), payload.as_py(), refers.as_py(), date)
                    out.write(member)
                    n, size = n + 1, size + len(member)
                    if size >= file_bytes:
                        break
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])

    joined.mapInArrow(run, "path string, n_records bigint, n_bytes bigint").write.parquet(manifest)
    return spark.read.schema("path string, n_records bigint, n_bytes bigint").parquet(manifest)


class _Window:
    """Random reads of a file through a buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, at: int, n: int = READ, least: int = 1) -> memoryview:
        """Some bytes from place `at`, at least `least` unless the file ends; empty at the end."""
        self._hold(at, n, least)
        return memoryview(self.held)[at - self.at :]

    def _hold(self, at: int, n: int, least: int) -> None:
        if not self.at <= at or at + min(least, self.size - at) > self.at + len(self.held) or at >= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(n)

    def magic(self, at: int) -> int:
        """The place of the gzip magic in the bytes held from `at` on; else the first place not ruled out."""
        self._hold(at, READ, len(MAGIC))
        found = self.held.find(MAGIC, at - self.at)
        if found >= 0:
            return self.at + found
        return max(at + 1, self.at + len(self.held) - len(MAGIC) + 1)


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The content and end of the gzip member at a place, or None if there is no sound one."""
    unpack, out, where, size = zlib.decompressobj(31), [], at, 0
    try:
        while not unpack.eof:
            data = window.get(where)[:FEED]
            if not len(data):
                return None
            out.append(unpack.decompress(data))
            where += len(data)
            size += len(out[-1])
            if size - len(out[-1]) < 5 <= size and not b"".join(out).startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    return b"".join(out), where - len(unpack.unused_data)


def read_range(window: _Window, start: int, stop: int) -> Iterator[dict]:
    """Records whose member starts in [start, stop); with record_type null, what stands in a record's
    place (after a sound member, or in one) and is none."""
    at, follows = start, start == 0
    while at < stop:
        data = window.get(at, least=len(MAGIC))
        if len(data) < len(MAGIC):
            if follows and len(data):
                yield {"record_type": None, "place": at}
            return
        got = _member(window, at) if data[: len(MAGIC)] == MAGIC else None
        if got is None:
            if follows:
                yield {"record_type": None, "place": at}
            at, follows = window.magic(at + 1), False
            continue
        try:
            for record in decode_records(got[0]):
                yield record | {"place": at}
        except ValueError:
            yield {"record_type": None, "place": at}
        at, follows = got[1], True


def read_warc(manifest: DataFrame, split_bytes: int = 8 << 20, payload: bool = True) -> DataFrame:
    """Records (RECORD) of the files in manifest(path, n_bytes), read by byte ranges of split_bytes."""
    return _read(manifest, split_bytes, payload).filter("record_type IS NOT NULL").drop("path")


def rejected(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """(path, n): places of each file that hold no record where one should be."""
    return _read(manifest, split_bytes, False).filter("record_type IS NULL").groupBy("path").agg(F.count("*").alias("n"))


def _read(manifest: DataFrame, split_bytes: int, payload: bool) -> DataFrame:
    ranges = manifest.select("path", "n_bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    spread = ranges.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path", "start")
    schema = "path string, " + (RECORD if payload else RECORD.rpartition(", ")[0])
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, local = _open(path)
                with fs.open_input_file(local) as file:
                    held, bytes_held = [], 0
                    for record in read_range(_Window(file, size), start, min(start + split_bytes, size)):
                        if not payload:
                            record.pop("payload", None)
                        held.append({"path": path, **record})
                        bytes_held += len(record.get("payload") or b"") + 500
                        if bytes_held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, target)
                            held, bytes_held = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, target)

    return spread.mapInArrow(run, schema)


def check_counts(manifest: DataFrame, records: DataFrame) -> None:
    """ValueError if the records (with path) of a file are not as many as its manifest says."""
    found = records.groupBy("path").agg(F.count("record_type").alias("n_read"), F.count_if(F.col("record_type").isNull()).alias("n_rejected"))
    wrong = manifest.join(found, "path", "left").filter("coalesce(n_read, 0) <> n_records OR n_rejected > 0").limit(5).collect()
    if wrong:
        raise ValueError("records read differ from the manifest: " + "; ".join(f"{r.path}: {r.n_read or 0} of {r.n_records}, {r.n_rejected or 0} rejected" for r in wrong))


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and returns the records read back, all of
    them by the manifest's counts."""
    manifest = write_warc(pages, scratch(spark, "warc"), min_bytes)
    path = scratch(spark, "warc-records")
    narrow = ["path", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    _read(manifest, 8 << 20, False).select(narrow).write.parquet(path)
    records = spark.read.parquet(path)
    check_counts(manifest, records)
    return records.drop("path")

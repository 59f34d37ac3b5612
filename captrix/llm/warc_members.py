"""WARC archives: one gzip stream a file, normalised into one member a record with a sidecar offset index.

``write_archives`` writes each task's records as monolithic gzip files, as crawlers' naive compression does.
``normalise`` inflates such a file once, in pieces, rewrites every record as its own gzip member and writes a sidecar
index (one JSON line a record: offset, length, type, uri, digest). ``read_archives`` seeks to each member by the index,
inflates it alone and parses the record. Any record is then read without what is before it.

Equal payloads of at least ``min_revisit_bytes`` are stored once: the largest page_id keeps the payload, the others are
revisit records (profile identical-payload-digest) with the HTTP headers, whose Content-Length is that of the payload.

Edge cases: null html is an empty payload; a null url becomes ``urn:page:<id>``; control characters and spaces in a url
are percent-encoded; rows of equal page_id and payload are all responses if that id is the largest of their payload; a null
page_id counts as smallest; an empty table writes no archive; other columns are ignored; payloads are copied in pieces when
normalised, so a record may be larger than memory there; writing and reading hold one whole record at a time (one row of html,
at most 2 GB in Spark).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrix.llm.common import read, remove, shared_folder

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
PIECE = 1 << 20
LEVEL = 6


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _uri(url: str | None, page_id) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def record(page_id, url: str | None, payload: bytes, sha1: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """The bytes of one record with its two trailing line ends."""
    digest = base64.b32encode(sha1).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url, page_id)}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Named fields of a record's head, names in lower case; the version is at ''."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex), refers_to and revisit of every page.

    Narrow rows decide: the largest page_id per digest is aggregated before it moves, and joined to the digests of pages.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")).withColumn("sha1", F.sha1("payload"))
    narrow = rows.where(F.length("payload") >= min_revisit_bytes).select("page_id", "sha1")
    groups = narrow.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    links = narrow.distinct().join(groups, "sha1").where("NOT page_id <=> keeper").select(F.col("page_id").alias("l_id"), F.col("sha1").alias("l_sha1"), F.col("keeper").alias("refers_to"))
    joined = rows.join(links, F.col("page_id").eqNullSafe(F.col("l_id")) & (F.col("sha1") == F.col("l_sha1")), "left")
    return joined.select("page_id", "url", "payload", "sha1", "refers_to", F.col("l_sha1").isNotNull().alias("revisit"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write monolithic gzip archives; returns one row a file: file, n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = _filesystem(folder)
        out, name, size, n, roll = None, "", 0, 0, 0

        def finish() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            system.move(f"{path}/.{name}.{context.taskAttemptId()}", f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

        for b in batches:
            for page_id, url, payload, sha1, refers_to, revisit in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    system.create_dir(path, recursive=True)
                    name, size, n = f"pages-{context.partitionId():06d}-{roll:04d}.warc.gz", 0, 0
                    out, packer = system.open_output_stream(f"{path}/.{name}.{context.taskAttemptId()}"), zlib.compressobj(LEVEL, wbits=31)
                data = record(page_id, url, payload, bytes.fromhex(sha1), refers_to, revisit)
                out.write(packer.compress(data))
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    yield finish()
                    out, roll = None, roll + 1
        if out is not None:
            yield finish()

    return rows.mapInArrow(run, "file string, n_records long")


class _Inflated:
    """A gzip file of one or many members as one stream of bytes, inflated in pieces."""

    def __init__(self, source):
        self.source, self.unpack, self.held, self.ended = source, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        if self.ended:
            return False
        data = self.unpack.unconsumed_tail or (self.unpack.unused_data if self.unpack.eof else b"") or self.source.read(PIECE)
        if not data:
            self.ended = True
            if not self.unpack.eof:
                raise EOFError("the gzip stream is cut off")
            return False
        if self.unpack.eof:
            self.unpack = zlib.decompressobj(31)
        self.held += self.unpack.decompress(data, PIECE)
        return True

    def head(self) -> bytes | None:
        """Bytes up to the empty line that ends a record's head; None at the end."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("bytes behind the last record")
                return None
        found = bytes(self.held[: at + 4])
        del self.held[: at + 4]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self._more():
                raise EOFError("the record is cut off")
            part = bytes(self.held[: min(n, PIECE)])
            del self.held[: len(part)]
            n -= len(part)
            if part:
                yield part


def normalise_file(source: str, target: str, attempt: str = "") -> int:
    """Rewrite one archive as a member a record, and its index beside it; returns the number of records."""
    system, path = _filesystem(source)
    to, out_path = _filesystem(target)
    n, at = 0, 0
    temp, index_temp = f"{out_path}.tmp{attempt}", f"{out_path}.idx.tmp{attempt}"
    with system.open_input_stream(path, compression=None) as raw, to.open_output_stream(temp, compression=None) as out, to.open_output_stream(index_temp, compression=None) as index:
        stream = _Inflated(raw)
        while (head := stream.head()) is not None:
            fields = parse_head(head)
            packer, length = zlib.compressobj(LEVEL, wbits=31), 0
            for part in chain([head], stream.take(int(fields["content-length"]) + 4), [None]):
                data = packer.flush() if part is None else packer.compress(part)
                out.write(data)
                length += len(data)
            entry = {"offset": at, "length": length, "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
            index.write((json.dumps(entry) + "\n").encode())
            at += length
            n += 1
    to.move(temp, out_path)
    to.move(index_temp, out_path + ".idx")
    return n


def normalise(files: DataFrame, folder: str, n_files: int | None = None) -> DataFrame:
    """Normalise every archive of the column ``file`` into ``folder``: file, index, n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for b in batches:
            for source in b.column(0).to_pylist():
                target = f"{folder}/{source.rpartition('/')[2]}"
                system, path = _filesystem(folder)
                system.create_dir(path, recursive=True)
                n = normalise_file(source, target, str(TaskContext.get().taskAttemptId()))
                yield pa.RecordBatch.from_pydict({"file": [target], "index": [f"{target}.idx"], "n_records": pa.array([n], pa.int64())})

    spread = files.select("file").repartition(n_files, "file") if n_files else files.select("file")
    return spread.mapInArrow(run, "file string, index string, n_records long")


def read_record(handle, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of the member at an offset."""
    handle.seek(offset)
    data = zlib.decompress(handle.read(length), 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = parse_head(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, parse_head(http), payload


def read_archives(files: DataFrame, n_files: int | None = None, payloads: bool = False) -> DataFrame:
    """Every record, by the index: page_id, payload_bytes, payload_digest, record_type, refers_to (and uri, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, path = _filesystem(name)
                with system.open_input_stream(_filesystem(index)[1], compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                rows: list[tuple] = []
                with system.open_input_file(path) as handle:
                    for e in entries:
                        fields, http, payload = read_record(handle, e["offset"], e["length"])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        kind, size = fields["warc-type"], int(http["content-length"])
                        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{name}: the record at {e['offset']} is not what its head says")
                        number = lambda k, fields=fields: int(fields[k]) if k in fields else None
                        rows.append((number("x-page-id"), size, digest, kind, number("x-refers-to-page-id"), fields["warc-target-uri"], payload if payloads and kind == "response" else None))
                        if len(rows) >= 1000:
                            yield table(rows)
                            rows = []
                if rows:
                    yield table(rows)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    spread = files.select("file", "index").repartition(n_files, "file") if n_files else files.select("file", "index")
    out = spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary")
    return out if payloads else out.drop("payload")


def op7(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = shared_folder(spark)
    write_archives(with_revisits(pages), f"{folder}/monolithic").write.parquet(f"{folder}/written")
    written = spark.read.schema("file string, n_records long").parquet(f"{folder}/written")
    n = max(1, written.count())
    normalise(written, f"{folder}/members", n).write.parquet(f"{folder}/normalised")
    remove(spark, f"{folder}/monolithic")
    done = spark.read.schema("file string, index string, n_records long").parquet(f"{folder}/normalised")
    return read_archives(done, n).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """SQL of op7. Base32: four letters for each five hexadecimal digits."""
    value = "list_sum(list_transform(range(0, 5), lambda j: (strpos('0123456789abcdef', substr(d, k * 5 + j + 1, 1)) - 1) * (1 << (4 * (4 - j)))))::BIGINT"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v // {1 << s}) % 32 + 1)::INT, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
b AS (SELECT d, string_agg({letters}, '' ORDER BY k) AS digest FROM (SELECT d, k, {value} AS v FROM (SELECT DISTINCT d FROM p), (SELECT unnest(range(0, 8)) AS k)) GROUP BY d)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN b USING (d)
"""

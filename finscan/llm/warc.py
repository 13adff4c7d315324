"""Deterministic sharded WARC writer and its reader.

Writing: records are range-sorted by id into shards. Their number follows from the bytes of all
payloads (one for each ``shard_bytes``, at most one for 16 ids of the sample) and their cuts are
quantiles of a bounded sample of ids drawn by hash, so names and bytes depend on the rows alone, not
on how Spark read or dealt them. One task writes a shard: records in id order, each its own gzip
member, and a new file begins once the compressed size passes ``roll_bytes``. Headers and digests
are made anew from the payload. A file is written under a temporary name and renamed when it is
complete; a task that runs again makes the same bytes and the same name, and leaves a complete file
of that name where it is. Its name, size, number of records and digest go into a manifest table;
only files that the manifest lists are read back, and each must agree with its line.

Equal payloads of at least ``revisit_bytes`` are stored once: the smallest id is the response, the
others are revisit records that refer to it.

Defined results: a null payload is an empty one; a null url leaves out the target header; rows of a
null id are written first, never refer to others; of repeated rows with one id and one payload the
first is the response and the rest revisit it; an empty table gives no files and no records. A file
that was cut, changed or lost is an error. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscan.llm.shared import interval_of, partitions, placed, scratch, settled, table

SAMPLE = 1 << 17
IDS_PER_SHARD = 16
SHARD_BYTES = 8 << 20
ROLL_BYTES = 64 << 20
REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, shard int, part int, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, path string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _clean(url: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    headers = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha256:" + digest), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    if refers_to is None:
        return record("response", headers, HTTP + payload)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return record("revisit", headers, HTTP)


class _File:
    """One archive under its temporary name."""

    def __init__(self, folder: str, shard: int, part: int, level: int):
        self.fs, at = pafs.FileSystem.from_uri(folder)
        self.shard, self.part, self.level = shard, part, level
        self.name = f"{folder}/shard-{shard:06d}-{part:04d}.warc.gz"
        self.path = f"{at}/shard-{shard:06d}-{part:04d}.warc.gz"
        self.tmp = f"{at}/_temporary-{uuid.uuid4().hex}"
        self.fs.create_dir(at, recursive=True)
        self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.tmp, compression=None), 0, 0, hashlib.sha256()
        info = f"software: finscan\r\nformat: WARC File Format 1.1\r\nshard: {shard}\r\npart: {part}\r\n".encode()
        self.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, f'info:{shard}:{part}')}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info))
        self.records = 0

    def write(self, raw: bytes) -> None:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = z.compress(raw) + z.flush()
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1

    def commit(self) -> tuple:
        """Give the file its name; one of that name and size is the same file, from another run of the task."""
        self.out.close()
        there = self.fs.get_file_info(self.path)
        if there.type == pafs.FileType.File and there.size == self.size:
            self.fs.delete_file(self.tmp)
        else:
            self.fs.move(self.tmp, self.path)
        return self.name, self.shard, self.part, self.records, self.size, self.sha.hexdigest()

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.tmp)


def _writer(folder: str, roll_bytes: int, revisit_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        file: _File | None = None
        key, refers, seen = None, {}, set()
        try:
            for batch in batches:
                shards, ids, kinds, urls, payloads, firsts = (batch.column(c) for c in ("shard", "id", "kind", "url", "payload", "first"))
                for i in range(batch.num_rows):
                    shard, page_id = shards[i].as_py(), ids[i].as_py()
                    if key != (shard, page_id):
                        key, refers, seen = (shard, page_id), {}, set()
                    payload = payloads[i].as_py() or b""
                    if kinds[i].as_py() == 0:
                        refers[payload.hex()] = firsts[i].as_py()
                        continue
                    if file is not None and (file.shard != shard or file.size >= roll_bytes):
                        done.append(file.commit())
                        part, file = (file.part + 1 if file.shard == shard else 0), None
                    else:
                        part = 0
                    if file is None:
                        file = _File(folder, shard, part, level)
                    digest = hashlib.sha256(payload).hexdigest()
                    first = refers.get(digest)
                    if first is None and page_id is not None and len(payload) >= revisit_bytes and digest in seen:
                        first = page_id
                    seen.add(digest)
                    file.write(page_record(page_id, urls[i].as_py(), payload, digest, first))
            if file is not None:
                done.append(file.commit())
                file = None
        finally:
            if file is not None:
                file.drop()
        names = ("path", "shard", "part", "records", "bytes", "sha256")
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], kinds[j]) for j in range(6)], list(names))

    return run


def cuts_of(rows: DataFrame, *, shards: int | None = None, shard_bytes: int = SHARD_BYTES, sample: int = SAMPLE) -> list[int]:
    """The smallest ids of all shards but the first, from rows (id, payload); about ``sample`` ids come to the driver."""
    size = F.sum(F.octet_length("payload").cast("long"))
    total, n = rows.agg(size, F.count("id")).first()
    if not n:
        return []
    shards = shards or max(1, min(-(-(total or 0) // shard_bytes), sample // IDS_PER_SHARD))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < min(1 << 40, sample * (1 << 40) // n)
    ids = rows.where(F.col("id").isNotNull() & drawn).select("id").toArrow().column("id").to_numpy()
    ids = sorted(ids.tolist())
    return sorted({ids[len(ids) * j // shards] for j in range(1, shards)}) if ids else []


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shards: int | None = None,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
    sample: int = SAMPLE,
    level: int = 1,
) -> DataFrame:
    """Write one record for each row below folder; returns the manifest: a row for each file.

    About ``sample`` ids come to the driver, to cut the range into shards.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    cuts = cuts_of(rows, shards=shards, shard_bytes=shard_bytes, sample=sample)
    n = len(cuts) + 1
    keys = placed(n)
    shard = F.coalesce(interval_of(F.col("id"), cuts), F.lit(0))
    digests = rows.where((F.octet_length("payload") >= revisit_bytes) & F.col("id").isNotNull()).select("id", F.unhex(F.sha2("payload", 256)).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    later = digests.join(firsts, "digest").where(F.col("id") > F.col("first"))
    marks = later.select(shard.alias("shard"), "id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("digest").alias("payload"), "first")
    bodies = rows.select(shard.alias("shard"), "id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first"))
    # A partition for each shard: key is the number that Spark's hash deals to it.
    key = F.get(F.array(*(F.lit(int(k)) for k in keys)), F.col("shard"))
    dealt = marks.unionAll(bodies).withColumn("key", key).repartition(n, "key").sortWithinPartitions("shard", "id", "kind", F.xxhash64("payload"), "url")
    return settled(dealt.mapInArrow(_writer(folder, roll_bytes, revisit_bytes, level), MANIFEST), "manifest")


def shard_of(page_id: int, cuts: list[int]) -> int:
    """The shard that a page goes to; for readers that look up one page."""
    return bisect.bisect_right(cuts, page_id)


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    z, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(z.decompress(chunk))
            chunk = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends inside a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, whose block digest is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if headers["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"record {headers['warc-record-id']}: block digest differs")
    return headers, block


def _chunks(path: str, size: int, sha256: str, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file that has the size and digest of the manifest's line."""
    fs, at = pafs.FileSystem.from_uri(path)
    sha, n = hashlib.sha256(), 0
    with fs.open_input_stream(at, compression=None) as f:
        while data := f.read(step):
            sha.update(data)
            n += len(data)
            yield data
    if n != size or sha.hexdigest() != sha256:
        raise ValueError(f"{path} is not the file that the manifest lists: {n} bytes in place of {size}, or other ones")


def _reader(want_payload: bool):
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(8)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for line in b.to_pylist():
                path, rows, held, seen = line["path"], [], 0, 0
                for raw in members(_chunks(path, line["bytes"], line["sha256"])):
                    h, block = parse(raw)
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    n = int(h["x-payload-length"])
                    if h["warc-type"] == "response":
                        digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
                        if "sha256:" + digest != h["warc-payload-digest"]:
                            raise ValueError(f"record {h['warc-record-id']}: payload digest differs")
                    seen += 1
                    number = lambda k: int(h[k]) if k in h else None
                    rows.append((number("x-page-id"), h.get("warc-target-uri"), payload if want_payload else None, n, digest, h["warc-type"], number("x-refers-to-page-id"), path))
                    held += len(payload) if want_payload else 0
                    if len(rows) >= 4096 or held >= 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if seen != line["records"]:
                    raise ValueError(f"{path} holds {seen} records in place of {line['records']}")
                if rows:
                    yield batch(rows)

    return run


def read_archives(manifest: DataFrame, *, payload: bool = False) -> DataFrame:
    """One row for each response or revisit record of the files that a manifest lists, which are verified against it."""
    files = manifest.repartitionByRange(partitions(manifest.sparkSession), "shard", "part")
    return files.mapInArrow(_reader(payload), RECORD)


def op2_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back and describe each record."""
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, payload_digest,
         min(page_id) OVER (PARTITION BY payload_digest) AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM g
"""

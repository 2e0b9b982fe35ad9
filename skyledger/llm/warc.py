"""WARC archives compressed record by record with a Zstandard dictionary built from the archived records.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record follows as a frame of
its own, so any record can be read from its offset with nothing but the dictionary. A task fills archives of about
``archive_bytes`` of payload, builds each one's dictionary from records spread evenly over it, and gives the file its
name only when it is complete; the index (one row per record) names the files of successful attempts alone.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import atomic_file, file_system, one_task_each, shared_path, spread, whole_text, written
from .bpe import slices

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are never revisits.
LEAST = 100
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: Records that a dictionary is built from hold this many bytes together, at most; of each its first bytes count, as a dictionary holds 64 KiB in all.
SAMPLE_BYTES, SAMPLE_RECORD = 3 << 20, 128 << 10
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _record(record_id: str, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    revisit = refers_to is not None
    block = b"" if revisit else _HTTP.format(len(payload)).encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _uri(url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + _uri(refers_url))
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES):
    """A Zstandard dictionary from records spread evenly over ``records``; their plain bytes where there are too few to train one."""
    import zstandard

    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    sample = [r[:SAMPLE_RECORD] for r in records[::step]]
    try:
        return zstandard.train_dictionary(size, sample, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-size:].rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(path: str, records: list[bytes], level: int = 3) -> list[tuple[int, int]]:
    """The offset and length of each record's frame in the archive."""
    import zstandard

    dictionary = build_dictionary(records)
    dictionary.precompute_compress(level=level)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
    content, places = dictionary.as_bytes(), []
    with atomic_file(path) as out:
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
        at = 8 + len(content)
        for r in records:
            frame = compressor.compress(r)
            out.write(frame)
            places.append((at, len(frame)))
            at += len(frame)
    return places


def _dictionary(stream):
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't start with its dictionary")
    return zstandard.ZstdCompressionDict(stream.read(size))


def read_record(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record, by its place in the index."""
    import zstandard

    files, at = file_system(path)
    with files.open_input_file(at) as f:
        dictionary = _dictionary(f)
        f.seek(offset)
        return _parse(zstandard.ZstdDecompressor(dict_data=dictionary).decompress(f.read(length)))


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of every record, one at a time."""
    import zstandard

    files, at = file_system(path)
    with files.open_input_file(at) as f:
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(f))
        left = b""
        while left or (left := f.read(1 << 16)):
            frame = decompressor.decompressobj()
            record = [frame.decompress(left)]
            while not frame.eof:
                if not (more := f.read(1 << 16)):
                    raise ValueError(f"{path}: its last record is cut off")
                record.append(frame.decompress(more))
            left = frame.unused_data
            yield _parse(b"".join(record))


def plan_records(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, body, payload_digest, payload_bytes, first and first_url: the page that a revisit refers to, else null.

    Only digests that occur more than once are joined back, so the payloads move just if those digests are too many to broadcast.
    """
    body = whole_text(text_col)
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("body"), F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    again = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))["url"].alias("first_url"), F.count(F.lit(1)).alias("n"))
    again = written(again.filter("n > 1 AND first IS NOT NULL").select(F.col("payload_digest").alias("_digest"), "first", "first_url"), "warc-digests")
    rows = rows.join(again, F.col("payload_digest") == F.col("_digest"), "left").drop("_digest")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.withColumn("first_url", F.when(revisit, F.col("first_url"))).withColumn("first", F.when(revisit, F.col("first")))


def write_archives(df: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, level: int = 3, date: str | None = None) -> DataFrame:
    """Writes a record for every row and returns the index, itself a table in the shared folder: page_id, path, offset, length.

    The payload is the text in UTF-8 (null: empty). Of equal payloads of at least ``least`` bytes the one with the smallest id
    is a response and the others are revisits of it; smaller payloads are responses, and so are rows that repeat a response's
    id and payload. A null id is larger than any other here. A null URL or id leaves its header out. Each record has an id of
    its own; a revisit names the page and URL of its response. ``date`` (now, if none is given) is that of all records, in
    UTC. No rows: no archives.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = folder or shared_path(df.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        records: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            places = write_archive(path, records, level)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([path] * len(ids), pa.string()), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())], ["page_id", "path", "offset", "length"])

        for part in (p for b in batches for p in slices(b)):
            columns = [part.column(c).to_pylist() for c in ("page_id", "url", "body", "payload_bytes", "payload_digest", "first", "first_url")]
            for page_id, url, body, n, digest, first, first_url in zip(*columns, strict=True):
                records.append(_record(str(uuid.uuid4()), page_id, url, body.encode(), n, digest, first, first_url, date))
                ids.append(page_id)
                size += len(records[-1])
                if size >= archive_bytes:
                    yield close()
                    ids, records, size = [], [], 0
        if records:
            yield close()

    rows = plan_records(spread(df), id_col=id_col, url_col=url_col, text_col=text_col, least=least)
    rows = rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("first", F.col("first").cast("long"))
    return written(rows.mapInArrow(run, "page_id long, path string, offset long, length long"), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """One row per record of the index's archives: record_id, page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and size are those of the payload as read; a record that contradicts its header is an error. A
    revisit's are those of its header: resolved() holds them against the response that it names.
    """
    names = ["record_id", "page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            rows, size = [], 0
            for head, payload in read_archive(path):
                n, digest, kind = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].partition(":")[2], head["WARC-Type"]
                if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
                    raise ValueError(f"{path}: {head['WARC-Record-ID']} isn't what was archived")
                rows.append((head["WARC-Record-ID"].strip("<>"), number(head.get("X-Page-ID")), head.get("WARC-Target-URI"), payload if kind == "response" else None, n, digest, kind, number(head.get("X-Refers-To-Page-ID"))))
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    paths = one_task_each(index.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path"))
    return paths.mapInArrow(run, "record_id string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def resolved(records: DataFrame) -> DataFrame:
    """Rows of read_archives() without payloads, in which size and digest of a revisit are those of its response as read. A revisit whose response isn't there, or is another than its header says, is an error."""
    records = written(records.drop("payload"), "warc-records")
    responses = records.filter("record_type = 'response'").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    revisits = records.filter("record_type = 'revisit'")
    # only pages that a revisit names are looked at, each once, so their number is that of the groups of copies
    named = revisits.select(F.col("refers_to").alias("_page"), F.col("payload_digest").alias("_digest")).distinct()
    responses = written(responses.join(named, ["_page", "_digest"], "left_semi"), "warc-responses")
    joined = revisits.join(responses, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    wrong = F.raise_error(F.concat(F.col("record_id"), F.lit(" refers to a response that isn't there"))).cast("bigint")
    joined = joined.withColumn("payload_bytes", F.when(F.col("_bytes") == F.col("payload_bytes"), F.col("_bytes")).otherwise(wrong))
    joined = joined.withColumn("payload_digest", F.col("_digest")).drop("_page", "_digest", "_bytes")
    return records.filter("record_type = 'response'").unionByName(joined)

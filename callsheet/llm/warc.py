"""WARC archives: writing, normalising monolithic gzip files, reading back by offset.

Many writers compress a whole archive as one gzip stream, from which no record can be
read alone. The normaliser inflates such a stream once, writes every record as a gzip
member of its own and puts an index of offsets beside the archive. Archives and
indexes are files in a folder that all executors share; tasks stream them, so their
memory does not depend on an archive's size. A repeated payload is stored once; the
other records of it are revisits that name the first.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.llm.common import stored, with_small_batches

#: Least payload, in bytes, that is worth a revisit record.
REVISIT_BYTES = 1000
#: An archive is closed once it holds so many bytes before compression.
ARCHIVE_BYTES = 32 << 20
#: Revisits, of some 100 bytes each, that are broadcast at most.
BROADCAST_ROWS = 100_000
_CHUNK = 1 << 20
_END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """`id`, `url`, `html`, `digest` (SHA-1, hex), `record_type` and `refers_to` of every page.

    Null pages are empty. Of pages with equal payloads of at least `revisit_bytes`
    bytes the largest id is a response, the others are revisits that refer to it; a
    null id is smaller than all others. Rows equal in id and payload are alike: all
    responses, or all revisits. Payloads without an id at all are responses.
    """
    rows = pages.select(
        F.col(id_column).alias("id"),
        F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    narrow = rows.select("id", "digest", F.octet_length("html").alias("bytes"))
    repeated = (
        narrow.where(F.col("bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.max("id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL")
        .drop("n")
    )
    revisits = (
        # Stored, so that the join can split a payload that very many pages have.
        narrow.join(stored(repeated), "digest")
        .where(~F.col("id").eqNullSafe(F.col("refers_to")))
        .select(F.col("id").alias("v_id"), F.col("digest").alias("v_digest"), "refers_to")
        .distinct()
    )
    # The pages meet their revisits by id, so that no group of copies meets in one task;
    # few revisits go to the pages instead, which then stay where they are.
    revisits = stored(revisits)
    few = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(
        F.broadcast(revisits) if few else revisits.hint("shuffle_hash"),
        F.col("id").eqNullSafe(F.col("v_id")) & (F.col("digest") == F.col("v_digest")),
        "left",
    ).select(
        "id",
        "url",
        "html",
        "digest",
        F.when(F.col("v_digest").isNull(), "response").otherwise("revisit").alias("record_type"),
        "refers_to",
    )


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of `with_record_types` as WARC files, each one gzip stream.

    Returns `archive` (its path) and `records`. A task that runs again writes files of
    other names; only the files that are returned count.
    """
    _open(folder)  # fails before the job if no task could

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        out = squeeze = path = None
        size = records = 0

        def close():
            out.write(squeeze.flush())
            out.close()
            return _batch({"archive": ([path], pa.string()), "records": ([records], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, size, records = system.open_output_stream(path, compression=None), 0, 0
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                record = record_bytes(row, date)
                out.write(squeeze.compress(record))
                size, records = size + len(record), records + 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return stored(with_small_batches(rows).mapInArrow(run, "archive string, records long"))


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC record of a page: response with the page, or revisit without it."""
    payload = row["html"].encode()
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"Payload-Length: {len(payload)}",
    ]
    # Header values hold no line breaks or other control characters.
    for name, value in (("WARC-Target-URI", row["url"]), ("Page-ID", row["id"])):
        if value is not None:
            lines.append(f"{name}: {quote(str(value), safe=_SAFE)}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
        lines.append(f"Refers-To-Page-ID: {quote(str(row['refers_to']), safe=_SAFE)}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + _END + block + _END


_SAFE = "/:?#[]@!$&'()*+,;=-._~"


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives with a gzip member per record and an index beside each.

    `archives` has a column `archive` with paths of WARC files, compressed as one gzip
    stream or several. Returns `archive`, `index` (paths) and `records`. The index has
    a JSON object per record and line: its offset and length in the file, type, page
    id and digest. An archive that ends within a record is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                with (
                    system.open_input_stream(source, compression=None) as raw,
                    system.open_output_stream(name, compression=None) as out,
                    system.open_output_stream(name + ".idx", compression=None) as index,
                ):
                    offset = records = 0
                    for header, content in split_records(_inflated(raw)):
                        member = zlib.compressobj(6, zlib.DEFLATED, 31)
                        length = out.write(member.compress(header))
                        for chunk in content:
                            length += out.write(member.compress(chunk))
                        length += out.write(member.flush())
                        fields = headers(header)
                        entry = {
                            "offset": offset,
                            "length": length,
                            "type": fields.get("warc-type"),
                            "page_id": fields.get("page-id"),
                            "digest": fields.get("warc-payload-digest"),
                        }
                        index.write(json.dumps(entry).encode() + b"\n")
                        offset, records = offset + length, records + 1
                yield _batch(
                    {
                        "archive": ([name], pa.string()),
                        "index": ([name + ".idx"], pa.string()),
                        "records": ([records], pa.int64()),
                    }
                )

    each = archives.select("archive").repartition(max(archives.rdd.getNumPartitions(), 1), "archive")
    return stored(each.mapInArrow(run, "archive string, index string, records long"))


def read_records(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Reads every record of normalised archives by its place in the index.

    Returns `page_id`, `url` (as texts), `payload_bytes`, `payload_digest` (hex), of the
    full payload also for revisits, `record_type`, `refers_to` and, on request,
    `payload`. A payload that does not have the digest of its record is an error.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    if with_payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(folder)
        rows, held = [], 0
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(archive) as file, system.open_input_stream(index, compression=None) as entries:
                    for line in _lines(entries):
                        entry = json.loads(line)
                        file.seek(entry["offset"])
                        row = parse_record(zlib.decompress(file.read(entry["length"]), 31))
                        rows.append(row if with_payload else row[:6])
                        held += len(row[6] or b"") if with_payload else 100
                        if held >= 8 << 20:
                            yield _batch({n: (c, k) for n, c, k in zip(names, zip(*rows), kinds)})
                            rows, held = [], 0
        if rows:
            yield _batch({n: (c, k) for n, c, k in zip(names, zip(*rows), kinds)})

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    each = archives.select("archive", "index")
    return each.mapInArrow(run, schema + ", payload binary" * with_payload)


def parse_record(record: bytes) -> tuple:
    """Page id, url, payload bytes, digest, type, refers-to and payload of one record."""
    head, _, rest = record.partition(_END)
    fields = headers(head)
    block = rest[: int(fields["content-length"])]
    payload = block.partition(_END)[2]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(fields["payload-length"])
    revisit = fields["warc-type"] == "revisit"
    if not revisit:
        digest, said, size = hashlib.sha1(payload).hexdigest(), digest, len(payload)
        if digest != said:
            raise ValueError(f"payload of {fields.get('page-id')} has digest {digest}, not {said}")
    get = lambda name: unquote(fields[name]) if name in fields else None
    return (
        get("page-id"), get("warc-target-uri"), size, digest, fields["warc-type"],
        get("refers-to-page-id") if revisit else None, None if revisit else payload,
    )


def headers(head: bytes) -> dict[str, str]:
    """Header fields of a record by lower-case name; folded lines are joined."""
    text = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace"))
    fields = (line.partition(":") for line in text.split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, sep, value in fields if sep}


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """Header (with its blank line) and content chunks (with the end marks) of each record.

    The chunks of a record must be used before the next record is asked for.
    """
    buffer = bytearray()

    def fill() -> bool:
        chunk = next(chunks, None)
        if chunk is not None:
            buffer.extend(chunk)
        return chunk is not None

    while True:
        while buffer[:2] == b"\r\n" or len(buffer) < 2:
            # Blank lines between records, more than the format asks for.
            if buffer[:2] == b"\r\n":
                del buffer[:2]
            elif not fill():
                if buffer.strip():
                    raise ValueError("the archive ends within a record")
                return
        looked = 0
        while (end := buffer.find(_END, max(0, looked - 3))) < 0:
            looked = len(buffer)
            if not fill():
                raise ValueError("the archive ends within a header")
        header = bytes(buffer[: end + 4])
        del buffer[: end + 4]
        left = int(headers(header[:-4])["content-length"]) + 4

        def content(left: int = left) -> Iterator[bytes]:
            while left:
                if not buffer and not fill():
                    raise ValueError("the archive ends within a record")
                part = bytes(buffer[:left])
                del buffer[: len(part)]
                left -= len(part)
                yield part

        yield header, content()


def _inflated(raw) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or several, in chunks of a bounded size."""
    inflate = zlib.decompressobj(31)
    while data := raw.read(_CHUNK):
        while data:
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            if out := inflate.decompress(data, 4 * _CHUNK):
                yield out
            data = inflate.unconsumed_tail or inflate.unused_data
    if not inflate.eof and (rest := inflate.flush()):
        yield rest


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(_CHUNK):
        *lines, rest = (rest + chunk).split(b"\n")
        yield from lines
    if rest:
        yield rest


#: Schemes of Spark's paths that the file systems here know by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def folder_uri(folder: str) -> str:
    """The folder's URI as `pyarrow.fs` takes it; unknown schemes are an error.

    Known are local paths, `file`, `hdfs`, `viewfs`, `s3` (also as `s3a`), `gs` and `abfs`.
    """
    uri = re.sub(r"^file:/+", "file:///", folder)
    scheme, colon, rest = uri.partition("://")
    if not colon:
        return uri
    scheme = _SCHEMES.get(scheme, scheme)
    if scheme not in ("file", "hdfs", "viewfs", "s3", "gs", "abfs"):
        raise ValueError(f"cannot keep files in {folder}: set spark.checkpoint.dir to a folder of HDFS or an object store")
    return f"{scheme}://{rest}"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder, by its URI; the folder is made if need be."""
    uri = folder_uri(folder)
    if uri.startswith("/"):
        system, path = fs.LocalFileSystem(), uri
    else:
        system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


def _batch(columns: dict) -> pa.RecordBatch:
    arrays = [pa.array(values, kind) for values, kind in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))

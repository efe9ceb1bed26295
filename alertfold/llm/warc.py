"""WARC archives of pages: a writer that stores equal payloads once, and a reader that splits files anywhere.

Every record is a gzip member of its own. A reading task gets a range of bytes, looks for the gzip magic, and
takes a candidate for a member if it decodes to a record header, its checksum holds and another member or the
end of the file follows. It owns the records that start inside its range and reads the last of them to its end.
Files are opened with ``pyarrow.fs``, so a folder is a local path or a URI of a file system known to it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertfold.llm.small_side import joined

SPLIT_BYTES = 8 << 20
MIN_REVISIT_BYTES = 100
_MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 18
_LEVEL = 6
# fixed values: names and forms of the WARC 1.1 standard
_VERSION = b"WARC/1.1"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def record_types(pages: DataFrame) -> DataFrame:
    """``pages`` with payload, payload_digest, payload_bytes, record_type and refers_to.

    Of the rows with equal payloads of at least MIN_REVISIT_BYTES, those with the smallest page_id are responses,
    the others revisit it. Rows without page_id come last; if all rows of a payload lack one, they are all
    responses. A null html is an empty payload.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    hashed = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    copied = (
        hashed.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 AND _first IS NOT NULL")
        .drop("_n")
    )
    revisits = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return (
        joined(hashed, copied, ["payload_digest"], "left")
        .withColumn("record_type", F.when(revisits, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisits, F.col("_first")))
        .drop("_first")
    )


def _record(row: dict) -> bytes:
    """One record as a gzip member."""
    revisit = row["record_type"] == "revisit"
    block = _HTTP_HEAD if revisit else _HTTP_HEAD + row["payload"]
    number = "" if row["page_id"] is None else row["page_id"]
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<urn:page:{number}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": None if row["url"] is None else re.sub(r"[\x00-\x20\x7f]", _escaped, row["url"]),
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Refers-To": f"<urn:page:{row['refers_to']}>" if revisit else None,
        "WARC-Profile": _REVISIT_PROFILE if revisit else None,
        "X-Payload-Bytes": row["payload_bytes"],
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items() if value is not None)
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"%s\r\n%s\r\n%s\r\n\r\n" % (_VERSION, head.encode(), block)) + packer.flush()


def _escaped(found: re.Match) -> str:
    return f"%{ord(found[0]):02X}"


def write_warc(pages: DataFrame, folder: str) -> int:
    """Write a record per row of ``pages`` (page_id, url, html) and return their number.

    Each task writes one file under a name of its own and moves it to its place at the end, so a task that is
    run again replaces its file.
    """
    opened, path = _opened(folder)
    opened.create_dir(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _opened(folder)
        context = TaskContext.get()
        name = f"{place}/part-{context.partitionId():06d}.warc.gz"
        draft, count, out = f"{place}/_{context.taskAttemptId()}.tmp", 0, None
        for batch in batches:
            for row in range(batch.num_rows):
                out = out or files.open_output_stream(draft, compression=None)
                out.write(_record(batch.slice(row, 1).to_pylist()[0]))
                count += 1
        if out:
            out.close()
            files.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["records"])

    return record_types(pages).mapInArrow(run, "records bigint").agg(F.sum("records")).first()[0] or 0


class _Bytes:
    """Any part of a file, through one window that moves forward."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        self.at, self.data = 0, b""

    def get(self, at: int, count: int) -> bytes:
        if at < self.at or at + count > self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(count, _CHUNK))
        return self.data[at - self.at : at - self.at + count]

    def find(self, pattern: bytes, at: int, end: int) -> int:
        """The first place of the pattern from ``at`` that lies before ``end``, or -1."""
        while at < end:
            data = self.get(at, _CHUNK)
            found = data.find(pattern)
            if found >= 0:
                return at + found if at + found < end else -1
            if len(data) < len(pattern):
                return -1
            at += len(data) - len(pattern) + 1
        return -1


def _member(data: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at a place and the place behind it; None if there is no such member."""
    unpacker, parts, place = zlib.decompressobj(31), [], at
    seen = b""
    try:
        while not unpacker.eof:
            chunk = data.get(place, _CHUNK)
            if not chunk:
                return None
            part = unpacker.decompress(chunk)
            place += len(chunk)
            parts.append(part)
            if len(seen) < 5:
                seen += part[:5]
                if not b"WARC/".startswith(seen[:5]):
                    return None
    except zlib.error:
        return None
    place -= len(unpacker.unused_data)
    whole = b"".join(parts)
    follows = data.get(place, len(_MAGIC))
    if not whole.startswith(b"WARC/") or b"\r\n\r\n" not in whole or follows not in (b"", _MAGIC):
        return None
    return whole, place


def records_in(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records whose members start in [start, end)."""
    data = _Bytes(file)
    at = start
    while (at := data.find(_MAGIC, at, end)) >= 0:
        member = _member(data, at)
        if member is None:
            at += 1
            continue
        whole, behind = member
        head, _, rest = whole.partition(b"\r\n\r\n")
        pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        fields = {name.strip().lower(): value.strip() for name, _, value in pairs}
        yield at, fields, rest[: int(fields.get("content-length", 0))]
        at = behind


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)
_READ_DDL = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string,"
    " payload binary"
)


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = fields.get("warc-type")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    known = fields.get("warc-payload-digest", "").removeprefix("sha256:"), int(fields.get("x-payload-bytes", 0))
    digest, size = known if payload is None else (hashlib.sha256(payload).hexdigest(), len(payload))
    uri, refers = fields.get("warc-target-uri"), _page(fields.get("warc-refers-to"))
    return _page(fields.get("warc-record-id")), uri, kind, refers, size, digest, payload if payloads else None


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records below a folder: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Digest and size of a response come from its payload, those of a revisit from its header. Tasks read ranges
    of ``split_bytes``, not files. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))
    ranges = files.filter("length > 0").select("path", F.explode(starts).alias("start"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                opened, path = _opened(part["path"])
                rows, held = [], 0
                with opened.open_input_file(path) as file:
                    for _, fields, block in records_in(file, part["start"], part["start"] + split_bytes):
                        rows.append(_row(fields, block, payloads))
                        held += len(block) if payloads else 200
                        if held > _CHUNK:
                            yield pa.RecordBatch.from_arrays(list(_columns(rows)), schema=_READ)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(list(_columns(rows)), schema=_READ)

    return ranges.repartition(tasks, "path", "start").mapInArrow(run, _READ_DDL)


def _columns(rows: list[tuple]) -> Iterator[pa.Array]:
    for values, field in zip(zip(*rows), _READ):
        yield pa.array(values, field.type)

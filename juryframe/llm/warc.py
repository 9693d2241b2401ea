"""WARC archives: written with segments, revisits and chunked framing, and read back by segment reassembly.

Records longer than a segment are cut: the first record has segment number 1, continuation records carry the first
one's id as their origin, and the last states the total length. Reading groups continuations by archive and origin, orders
them by number, checks the total length and decodes the chunked transfer framing of the HTTP block.

Archives are WARC files in a shared folder, each record a gzip member of its own. They are written by Spark's own file
writer, a row for some records; files are bounded by bytes, as a row is and a file has a limit of rows. Record ids are
new for each write, so archives may be read together.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juryframe.llm.common import cut, maybe_among, shared_dir

SEGMENT, CHUNK_BYTES = 32_768, 8_192
#: Bytes of records in a row of the writer, and rows in a file.
ROW_BYTES, ROWS_A_FILE = 1 << 20, 32
END = b"\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> tuple[bytes, bool]:
    """(payload, whole): what the chunks hold, and whether the last chunk was reached."""
    parts, at = [], 0
    while (line := framed.find(b"\r\n", at)) >= 0:
        size = _number(framed[at:line].split(b";")[0].decode("latin-1"), 16)
        if size is None:
            break
        if not size:
            return b"".join(parts), True
        part = framed[line + 2 : line + 2 + size]
        parts.append(part)
        if len(part) < size:
            break
        at = line + 2 + size + 2
    return b"".join(parts), False


def _number(text: str | None, base: int = 10) -> int | None:
    """A natural number, or None where the text is none."""
    try:
        return n if text is not None and (n := int(text, base)) >= 0 else None
    except ValueError:
        return None


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def record_id(write: uuid.UUID, name: str) -> str:
    """The record id of a name within one write; a task that runs again makes the same ids."""
    return f"<{uuid.uuid5(write, name).urn}>"


def page_records(write: uuid.UUID, page_id: int | None, name: str, url: str | None, kind: str, refers_to: int | None, payload: bytes, segment: int) -> Iterator[bytes]:
    """The WARC records, without their separators, of one page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    page, own = "" if page_id is None else str(page_id), record_id(write, name)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    fields.append(("WARC-Target-URI", f"urn:page:{page}" if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("X-Page-ID", page)] * (page_id is not None) + [("X-Page-URL", "none")] * (url is None)
    if kind == "revisit":
        fields += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
        yield _record(fields, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _record(fields, block)
        return
    yield _record([*fields, ("WARC-Segment-Number", "1")], block[:segment])
    last = -(-len(block) // segment)
    for k in range(2, last + 1):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(write, f"{name}-{k}")), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k))]
        if k == last:
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(more, block[(k - 1) * segment : k * segment])


def _members(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The contents of an archive's gzip members, one at a time; a broken one gives what could be read of it."""
    at, view = 0, memoryview(data)
    while 0 <= at < len(data):
        inflate, out = zlib.decompressobj(31), []
        start = at
        try:
            while at < len(data) and not inflate.eof:
                out.append(inflate.decompress(view[at : at + step]))
                at = min(at + step, len(data))
            at -= len(inflate.unused_data)
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", start + 1)
        yield b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields with lower-case names, block) of each record of an archive, which may be compressed.

    The block is None where the record's length is malformed or the archive ends before it; reading goes on at the next record.
    """
    if data[:2] == b"\x1f\x8b":
        for member in _members(data):
            yield from parse_records(member)
        return
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0 and (stop := data.find(END, at)) >= 0:
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = _number(fields.get("content-length"))
        block = None if size is None else data[stop + 4 : stop + 4 + size]
        if block is None or len(block) < size:
            yield fields, None
            at = stop + 4
        else:
            yield fields, block
            at = stop + 4 + size


def mark_revisits(pages: DataFrame, *, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """``pages`` with __kind and __refers: of equal payloads the smallest id's rows are responses, the others revisit it.

    Payloads under ``least_bytes`` are all responses. Null ids come after all others: they revisit the smallest id, and
    are responses if there is none. Payloads are compared by SHA-256. Their digests are counted first; only rows whose digest
    occurs twice, by a filter of fixed size that lets all of these and by chance some others pass, are shuffled with
    their payloads.
    """
    payload = F.coalesce(pages[payload_col], F.lit(""))
    keyed = pages.withColumn("__key", F.sha2(payload, 256))
    # Written first, so that the join's sides are plain shuffles: a payload of very many pages can then be split.
    firsts = keyed.filter(F.octet_length(payload) >= least_bytes).groupBy("__key").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("n"))
    firsts = cut(firsts.filter("n > 1 and __first is not null").select("__key", "__first"))
    flagged = maybe_among(keyed, F.xxhash64("__key"), firsts.select(F.xxhash64("__key").alias("h")), "__maybe")
    revisit = F.col("__first").isNotNull() & (F.octet_length(payload) >= least_bytes) & ~F.col(id_col).eqNullSafe(F.col("__first"))
    again = flagged.filter("__maybe").join(firsts, "__key", "left")
    sole = flagged.filter("not __maybe").withColumn("__first", F.lit(None).cast("long"))
    columns = [*pages.columns, F.when(revisit, "revisit").otherwise("response").alias("__kind"), F.when(revisit, F.col("__first")).alias("__refers")]
    return again.select(columns).union(sole.select(columns))


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, segment: int = SEGMENT, compressed: bool = True) -> None:
    """Writes a response or revisit record for each row; null payloads are empty, and a null url becomes a name of the page.

    Rows that repeat get records of their own; an empty table gives archives without records. Payloads may be of any length: a task
    holds one row's records at a time. Ids are cast to long, and a text that is no number raises. Other columns are not
    read, whatever their names. ``segment`` is below 2**24.
    """
    if not 0 < segment < 1 << 24:
        raise ValueError("segment must be positive and below 2**24")
    columns = [pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), pages[payload_col].alias("payload")]
    marked, write = mark_revisits(pages.select(columns), id_col="id", payload_col="payload", least_bytes=least_bytes), uuid.uuid4()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, some, size = TaskContext.get().partitionId(), 0, [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([joined(some)], pa.binary())], names=["value"])
        for batch in batches:
            for page, url, payload, kind, refers in zip(*batch.columns, strict=True):
                number += 1
                for record in page_records(write, page.as_py(), f"{part}-{number}", url.as_py(), kind.as_py(), refers.as_py(), (payload.as_py() or "").encode(), segment):
                    some.append(gzip.compress(record + END, 5, mtime=0) if compressed else record)
                    size += len(some[-1])
                    if size > ROW_BYTES:
                        yield row()
                        some, size = [], 0
        if some:
            yield row()

    # The writer ends each row by a separator. A gzip member ends with the number of its bytes, whose last one is 0.
    joined = (lambda some: b"".join(some)[:-1]) if compressed else END.join
    records = marked.select("id", "url", "payload", "__kind", "__refers").mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\0" if compressed else END.decode()).option("compression", "none").option("maxRecordsPerFile", ROWS_A_FILE).text(path)


_FIELDS = "origin string, number int, total long, page_id long, url string, record_type string, refers_to long, digest string, sound boolean, block binary"
_PAGE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, whole boolean"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _long(text: str) -> int | None:
    """The number that a field holds, if it is one of 64 bits."""
    number = int(text) if re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def _parsed(f: dict[str, str], block: bytes | None) -> tuple | None:
    kind, stated = f.get("warc-type"), f.get("warc-segment-number")
    if kind not in ("response", "revisit", "continuation"):
        return None
    number, total = _number(stated), f.get("warc-segment-total-length")
    sound = block is not None and (stated is None or number is not None) and (total is None or _number(total) is not None)
    url = None if f.get("x-page-url") == "none" else f.get("warc-target-uri")
    page, refers = f.get("x-page-id", ""), f.get("x-refers-to-page-id", "")
    ids = [_long(x) for x in (page, refers)]
    if kind == "continuation" and number is None:
        number = 0
    return (f.get("warc-segment-origin-id", f.get("warc-record-id")), number, _number(total), ids[0], url, kind, ids[1], f.get("warc-payload-digest"), sound, block)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    make = lambda folder, rows: pa.RecordBatch.from_arrays([pa.array([folder] * len(rows)), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=["archive", *_names(_FIELDS)])
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            folder, rows, size = path.as_py().rpartition("/")[0], [], 0
            for f, block in parse_records(content.as_py()):
                if (row := _parsed(f, block)) is not None:
                    rows.append(row)
                    size += len(block or b"")
                if size > 8 * ROW_BYTES:
                    yield make(folder, rows)
                    rows, size = [], 0
            if rows:
                yield make(folder, rows)


def _decode(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * with_payload
        for batch in batches:
            rows = []
            for page, url, kind, refers, digest, segments in zip(*batch.columns, strict=True):
                parts = segments.as_py()
                parts = [p for i, p in enumerate(parts) if not i or p != parts[i - 1]]  # the same file may be there twice
                block = b"".join(p["block"] or b"" for p in parts)
                numbers, total = [p["number"] for p in parts], parts[-1]["total"]
                whole = all(p["sound"] for p in parts) and (numbers == [None] or (numbers == [*range(1, len(parts) + 1)] and total == len(block)))
                head, _, body = block.partition(END)
                stated = (digest.as_py() or "").removeprefix("sha1:")
                if kind.as_py() == "revisit":
                    length = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", head)
                    payload, size, found = None, int(length[1]) if length else None, stated
                else:
                    payload = body
                    if re.search(rb"(?im)^transfer-encoding:\s*chunked", head):
                        payload, ended = dechunked(body)
                        whole = whole and ended
                    size, found = len(payload), payload_digest(payload)
                    whole = whole and found == stated
                rows.append((page.as_py(), url.as_py(), kind.as_py(), refers.as_py(), size, found, whole, payload)[: len(types)])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[*_names(_PAGE), *["payload"] * with_payload])

    return run


def read_warc(spark: SparkSession, path: str | list[str], *, with_payload: bool = True) -> DataFrame:
    """One row for each response or revisit record of the archives under ``path``, a folder or several.

    page_id, url, record_type, refers_to, payload_bytes and payload_digest (of a revisit as stated in its record),
    whole (every segment there, total length, last chunk and digest right), and with ``with_payload`` the payload of
    responses. A record with a malformed length or segment number is a row that is not whole, and reading goes on after it;
    a damaged gzip member is passed over. Continuations without their first record are left out. Folders without
    records give no row. Segments are sought within an archive's folder. Only records in segments move between tasks; a
    page of any length is put together in one row, so its segments have to fit into one task together, and a file into another.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    records = files.mapInArrow(_parse, "archive string, " + _FIELDS)
    part = F.struct("number", "total", "sound", "block")
    single = records.filter("number is null and record_type <> 'continuation'").select("page_id", "url", "record_type", "refers_to", "digest", F.array(part).alias("segments"))
    first = lambda c: F.max_by(c, F.col("record_type") != "continuation").alias(c)
    joined = (
        records.filter("number is not null")
        .groupBy("archive", "origin")
        .agg(*[first(c) for c in ("page_id", "url", "record_type", "refers_to", "digest")], F.sort_array(F.collect_list(part)).alias("segments"))
        .filter("record_type <> 'continuation'")
        .drop("archive", "origin")
    )
    return single.union(joined).mapInArrow(_decode(with_payload), _PAGE + (", payload binary" if with_payload else ""))


def fresh_path(spark: SparkSession) -> str:
    """A new folder for archives in the folder that the cluster shares."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

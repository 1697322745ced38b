"""WARC archives: a rolling writer with deduplicated revisits, and a reader that salvages what it can.

The reader walks an archive from record to record. When a check fails (gzip member, version line, headers, length,
record end or digest) it searches for the next byte at which a gzip member or a version line begins and parses, goes
on there, and logs the bytes in between as a quarantined gap. A member may hold several records; its content is walked in
the same way. Files are read in blocks, so memory follows the largest member or record and not the archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, table

#: An archive is closed when it has grown beyond this many bytes.
ROLL_BYTES = 64 << 20
#: Archives that a reading task takes one after the other, where there are more than cores.
PER_TASK = 4
VERSION, MAGIC = b"WARC/1.", b"\x1f\x8b\x08"
BLOCK = 1 << 18
#: Headers are looked at in steps from this many bytes on, and checked line by line as far as they have come.
HEADER_STEP = 1 << 16
#: A value of a table's cell has less than 2 GiB, so no headers or block of a page are longer; what claims to be is damaged.
MOST_HEADER = MOST_RECORD = 1 << 31
#: Parts that the rows of one payload are dealt to when they meet the page that holds it.
SALTS = 16


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str, payload: bytes, response: int | None) -> bytes:
    """A record of a page: its response, or a revisit of the page ``response``. Both name the full payload's length."""
    kind = b"revisit" if response is not None else b"response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if response is not None else http + payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + kind,
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>".encode(),
        b"WARC-Target-URI: " + " ".join((url or "").split()).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}".encode(),
        f"WARC-Block-Digest: sha1:{payload_digest(body)}".encode(),
        f"X-Payload-Length: {len(payload)}".encode(),
        b"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}".encode(),
    ]
    if response is not None:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{response}>".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


class Damaged(ValueError):
    """A check that failed."""


class Source:
    """Random access to a file through blocks; keeps the bytes from the last ``forget`` on."""

    def __init__(self, file):
        self.file, self.base, self.held, self.ended = file, 0, bytearray(), False

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from at, fewer at the end."""
        while not self.ended and self.base + len(self.held) < at + n:
            more = self.file.read(max(BLOCK, at + n - self.base - len(self.held)))
            self.ended = not more
            self.held += more
        return bytes(self.held[at - self.base : at - self.base + n])

    def forget(self, at: int) -> None:
        del self.held[: max(0, at - self.base)]
        self.base = max(self.base, at)

    def find_next(self, at: int, members: bool) -> int | None:
        """The next place from at on where a member or a version line may begin."""
        while True:
            piece = self.get(at, BLOCK + 16)
            hits = [k for k in (piece.find(MAGIC) if members else -1, piece.find(VERSION)) if k >= 0]
            if hits:
                return at + min(hits)
            if len(piece) < BLOCK + 16:
                return None
            at += BLOCK
            self.forget(at)


def _inflated(src: Source, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place, and its length in the file."""
    d, out, total, used = zlib.decompressobj(31), [], 0, 0
    try:
        while not d.eof:
            piece = src.get(at + used, BLOCK)
            if not piece:
                raise Damaged("member is cut off")
            out.append(d.decompress(piece))
            total += len(out[-1])
            used += len(piece)
            if total > MOST_RECORD:
                raise Damaged("member is too large")
    except zlib.error as e:
        raise Damaged(f"member: {e}"[:80]) from None
    return b"".join(out), used - len(d.unused_data)


def _parsed(get) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record that get(at, n) gives from 0 on."""
    size = HEADER_STEP
    while True:
        head = get(0, size)
        if not head.startswith(VERSION):
            raise Damaged("no version line")
        end = head.find(b"\r\n\r\n")
        headers = {}
        for line in head[: end if end >= 0 else max(0, head.rfind(b"\r\n"))].split(b"\r\n")[1:]:
            name, colon, value = line.partition(b":")
            if not colon or not name.strip():
                raise Damaged("header line without a name")
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        if end >= 0:
            break
        if len(head) < size or size >= MOST_HEADER:
            raise Damaged("headers do not end")
        size *= 8
    n = headers.get("content-length", "")
    if not n.isascii() or not n.isdigit() or int(n) > MOST_RECORD:
        raise Damaged("no valid length")
    block = get(end + 4, int(n))
    if len(block) < int(n):
        raise Damaged("block is cut off")
    if get(end + 4 + int(n), 4) != b"\r\n\r\n":
        raise Damaged("record does not end where it should")
    if headers.get("warc-block-digest", "").startswith("sha1:") and headers["warc-block-digest"][5:] != payload_digest(block):
        raise Damaged("block digest differs")
    if headers.get("warc-type") != "revisit":  # a revisit's digest and length are those of the payload it leaves out
        payload = payload_of(headers, block)
        if headers.get("warc-payload-digest", "").startswith("sha1:") and headers["warc-payload-digest"][5:] != payload_digest(payload):
            raise Damaged("payload digest differs")
        if headers.get("x-payload-length", str(len(payload))) != str(len(payload)):
            raise Damaged("payload length differs")
    return headers, block, end + 8 + int(n)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What a block holds behind its HTTP head, if it has one."""
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def salvage(file) -> Iterator[tuple]:
    """("record", offset, length, headers, block) and ("gap", offset, length, reason, b"") of an archive, in its order.

    Together they cover all bytes of the file. Of a member with several records the first row has the member's length, the
    others 0; a damaged stretch between them is a gap of its own. An empty file gives nothing.
    """
    yield from _walk(Source(file), True)


def _member(content: bytes, at: int, size: int) -> Iterator[tuple]:
    """The records and gaps of a member's content, at the member's place in the file."""
    for kind, _, _, what, block in list(_walk(Source(io.BytesIO(content)), False)):
        yield kind, at, size, what, block
        size = 0


def _walk(src: Source, members: bool) -> Iterator[tuple]:
    at, gap, reason = 0, None, ""
    while True:
        start = src.get(at, len(VERSION))
        if not start:
            break
        try:
            if members and start.startswith(MAGIC):
                content, size = _inflated(src, at)
                found = [*_member(content, at, size)]
                if not any(x[0] == "record" for x in found):
                    raise Damaged(found[0][3] if found else "empty member")
            elif start == VERSION:
                headers, block, size = _parsed(lambda p, n, a=at: src.get(a + p, n))
                found = [("record", at, size, headers, block)]
            else:
                raise Damaged("neither a member nor a version line")
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = src.find_next(at + 1, members)
            if at is None:
                break
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason, b""
            gap = None
        yield from found
        at += size
        src.forget(at)
    if gap is not None:
        yield "gap", gap, src.base + len(src.held) - gap, reason, b""


def _filesystem(uri: str):
    """A file system and path for a URI of the shared folder."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with ``response``: the page that a revisit refers to, null for responses.

    Of pages with equal payloads of at least min_bytes bytes the largest page_id is the response.
    """
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    keyed = pages.select("page_id", "url", "html", digest.alias("digest"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    long_enough = keyed.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes)
    holders = long_enough.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1 and holder is not null")
    holders = holders.select("digest", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = keyed.join(holders, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("response"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 1, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record per page into archives in ``folder`` and returns their (archive, n_records, n_bytes).

    A task writes its archives under names of its own attempt; only those whose tasks succeeded are in the returned
    table, so what lost or repeated attempts leave is never read. The table is computed once, by this call. A null
    html is an empty payload, a null url an empty one; runs of blanks in urls become one. Urls and payloads may have any
    length that a table's cell can. Repeated rows make a record each (all of them responses, if theirs is the largest
    page_id); a null page_id is never a holder. Other columns are not looked at; an empty table makes no archive.
    """

    def run(batches):
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, name, n, size, k, done = None, "", 0, 0, 0, []
        for batch in batches:
            for page_id, url, html, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size, k = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz", 0, 0, k + 1
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                c = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = c.compress(record_bytes(page_id, url, (html or "").encode(), response)) + c.flush()
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= roll_bytes:
                    out.close()
                    out = None
                    done.append((name, n, size))
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "n_records", "n_bytes"])

    from .common import cut

    return cut(with_roles(pages, min_bytes).mapInArrow(run, "archive string, n_records bigint, n_bytes bigint"))


RECORD_DDL = "archive string, offset bigint, length bigint, reason string, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length bigint, payload binary"


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives named in column ``archive``, one at a time, PER_TASK to a task or fewer.

    A row is a record (reason null) or a quarantined gap (reason says which check failed first, record columns are
    null). offset and length are in bytes of the file. An empty list of archives, or an empty archive, gives no rows; other
    columns of ``archives`` are not looked at, and an archive named twice is read twice.
    """

    def run(batches):
        system, base = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for kind, at, size, what, block in salvage(f):
                        if kind == "gap":
                            rows.append((name, at, size, what, *[None] * 7))
                        else:
                            payload = payload_of(what, block)
                            said = what.get("x-payload-length", "")
                            n = int(said) if said.isascii() and said.isdigit() else len(payload)
                            digest = what.get("warc-payload-digest", "").removeprefix("sha1:") or payload_digest(payload)
                            rows.append((name, at, size, None, what.get("warc-type"), what.get("warc-record-id"), what.get("warc-target-uri"), what.get("warc-refers-to"), digest, n, payload if with_payload else None))
                            held += len(payload) * with_payload
                        if len(rows) >= 2048 or held > BLOCK * 16:
                            yield _records(rows)
                            rows, held = [], 0
                yield _records(rows)

    n, cores = archives.count(), archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("archive").repartition(max(1, min(n, max(2 * cores, -(-n // PER_TASK))))).mapInArrow(run, RECORD_DDL)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD_DDL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)


def op1_warc_salvage(spark, sf_dir: str) -> DataFrame:
    """The contract: every page written to archives in the shared folder, and read back. A gap there is an error."""
    folder = fresh_path(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    sound = "if(reason is null, true, cast(raise_error(concat('gap in ', archive, ' at ', offset, ': ', reason)) as boolean))"
    records = read_archives(archives, folder, with_payload=False).filter(sound)
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("bigint")
    return records.select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


OP1_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex,
    max(page_id) over (partition by coalesce(html, '')) as holder from pages
), d as (
  select *, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + cast((cast('0x' || substr(hex, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1), '' order by i)
    from range(32) t(i)) as digest from p
)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, digest as payload_digest,
  case when page_id = holder then 'response' else 'revisit' end as record_type,
  case when page_id = holder then null else holder end as refers_to
from d
"""

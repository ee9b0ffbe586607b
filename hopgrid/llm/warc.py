"""WARC writing, and a salvage reader for damaged archives.

The writer makes one gzip member per record. Of records with equal payloads of at least
``min_bytes`` bytes, that with the largest page_id is the response and the others are revisits
that refer to it. Files are named by task attempt and listed in a manifest of successful tasks.

The reader takes plain and gzipped archives, and files that hold both: the bytes at each place tell
which. Every record is checked (member checksum, version line, headers, length, trailing lines,
payload digest). Where a check fails, it searches for the next gzip member or version line that
starts a valid record, goes on there, and logs the bytes between as a quarantined gap. The next place
of each mark is remembered until it is passed, so a file is searched once, however much of it is
damaged. Members are inflated as their records are read: records of a damaged member whose payload
digest holds are kept, others wait for the member's checksum. Memory is bounded by the largest record
(MAX_RECORD; a longer one counts as damaged), not by the archive or its members.

Defined cases: null html is an empty payload (a response); null page_id counts as smaller than
any; equal rows that tie for the largest page_id are all responses; a null url gives no target
header; an empty table or archive gives no rows; a cut archive ends with a gap; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, open_fs, shared_dir

MIN_REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_STEP = 1 << 14
MAX_RECORD = 1 << 31
_HEADER_LIMIT = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# --------------------------------------------------------------------------- writing


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    lines.append(f"X-Payload-Length: {len(payload)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the manifest (file, bytes, records)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    # Written, so that the join below can split a payload with very many copies.
    twice = materialize(rows.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("k")).filter("k > 1").select("digest", "top"), "warc-copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        stem, k, out, name, size, n, done = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "top"))):
                page_id, url, html, digest, top = (x.as_py() for x in row)
                if out is None:
                    name, k, size, n = f"{stem}-{k}.warc.gz", k + 1, 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                again = top is not None and page_id != top
                data = gzip_member(record("revisit" if again else "response", page_id, url, html.encode(), digest, top, date))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((name, size, n))
        if out is not None:
            out.close()
            done.append((name, size, n))
        cols = list(zip(*done)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["file", "bytes", "records"])

    return materialize(rows.join(twice, "digest", "left").select("page_id", "url", "html", "digest", "top").mapInArrow(run, "file string, bytes long, records long"), "warc-manifest")


# --------------------------------------------------------------------------- reading


class Damaged(Exception):
    """A check failed; the message says which."""


class _Window:
    """Reads of a file through one buffer, mostly forward."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.buf = f, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.buf):
            if at >= self.size:
                return b""
            self.f.seek(at)
            self.at, self.buf = at, self.f.read(max(n, 1 << 20))
        return self.buf[at - self.at : at - self.at + n]


class _Inflated:
    """The bytes of the gzip member at ``at``, inflated as they are asked for; what lies before ``forget`` is dropped."""

    def __init__(self, win: "_Window", at: int):
        self.win, self.place, self.z = win, at, zlib.decompressobj(31)
        self.base, self.buf, self.error, self.done = 0, bytearray(), None, False

    @property
    def size(self) -> float:
        return self.base + len(self.buf) if self.done else float("inf")

    @property
    def end(self) -> int:
        """Place in the file up to which the member has been read; its end once it is done."""
        return self.place - len(self.z.unused_data) - len(self.z.unconsumed_tail)

    def get(self, at: int, n: int) -> bytes:
        while not self.done and self.base + len(self.buf) < at + n:
            chunk = self.z.unconsumed_tail or self.win.get(self.place, _STEP)
            if not self.z.unconsumed_tail:
                self.place += len(chunk)
            if not chunk:
                self.error, self.done = "cut gzip member", True
                break
            try:
                self.buf += self.z.decompress(chunk, 1 << 20)
            except zlib.error as e:
                self.error, self.done = f"gzip: {e}", True
            self.done = self.done or self.z.eof
        return bytes(self.buf[at - self.base : at - self.base + n])

    def forget(self, at: int) -> None:
        cut = min(at - self.base, len(self.buf))
        if cut > 1 << 16 or cut == len(self.buf):
            del self.buf[:cut]
            self.base += cut


def parse(win: _Window, at: int, verify: bool = True) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; raises Damaged."""
    head, n = win.get(at, 2048), 2048
    if not head.startswith(_VERSION):
        raise Damaged("no version line")
    while (end := head.find(b"\r\n\r\n")) < 0:
        if n >= _HEADER_LIMIT or len(head) < n:
            raise Damaged("headers do not end")
        n *= 4
        head = win.get(at, n)
    headers = {}
    for line in head[:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    start = at + end + 4
    if int(length) > MAX_RECORD:
        raise Damaged("record is too long")
    if start + int(length) > win.size:
        raise Damaged("record is cut")
    block = win.get(start, int(length) + 4)
    if len(block) != int(length) + 4 or block[-4:] != b"\r\n\r\n":
        raise Damaged("length does not match")
    block = block[:-4]
    if verify and headers.get("warc-type") == "response" and (want := headers.get("warc-payload-digest", "")).startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(payload_of(block)).digest()).decode() != want[5:]:
            raise Damaged("payload digest does not match")
    return headers, block, start + int(length) + 4


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message; the block itself where it is none."""
    if not block.startswith(b"HTTP/"):
        return block
    return block.partition(b"\r\n\r\n")[2]


class _Marks:
    """The next place of each mark in a file, searched for once."""

    def __init__(self, win, *marks: bytes):
        self.win, self.next = win, {m: -1 for m in marks}

    def after(self, at: int) -> int:
        """The next place of any mark from ``at`` on; the end of the file if there is none."""
        for mark, found in self.next.items():
            if found < at:
                self.next[mark] = _find(self.win, at, mark)
        return min(self.next.values())


def _find(win, at: int, mark: bytes) -> int:
    """Place of the next ``mark`` from ``at`` on; where the bytes end if there is none."""
    while piece := win.get(at, 1 << 20):
        if (k := piece.find(mark)) >= 0:
            return at + k
        if len(piece) < len(mark):
            return at + len(piece)
        at += len(piece) - len(mark) + 1
        if isinstance(win, _Inflated):
            win.forget(at)
    return at


def _checked(headers: dict[str, str]) -> bool:
    """Whether ``parse`` has checked the payload against a digest."""
    return headers.get("warc-type") == "response" and headers.get("warc-payload-digest", "").startswith("sha1:")


def _member(win: _Window, at: int, verify: bool) -> Iterator[tuple]:
    """Records and inner gaps of the gzip member at ``at``, then ("end", place in the file, error or None)."""
    inner, waiting, k, lost = _Inflated(win, at), [], 0, None
    while inner.get(k, 1):
        try:
            headers, block, end = parse(inner, k, verify)
        except Damaged as e:
            if inner.error and inner.size == inner.base + len(inner.buf) and _find(inner, k + 1, _VERSION) >= inner.size:
                break  # the damage itself
            lost = lost or (k, str(e))
            k = _find(inner, k + 1, _VERSION)
            continue
        if lost:
            waiting.append(("gap", at, inner.end, f"inside member, bytes {lost[0]}-{k}: {lost[1]}", None))
            lost = None
        item = ("record", at, inner.end, headers, block)
        if verify and _checked(headers):
            yield item
        else:
            waiting.append(item)
        k = end
        inner.forget(k)
    if inner.error is None:
        if lost:
            waiting.append(("gap", at, inner.end, f"inside member, bytes {lost[0]}-{k}: {lost[1]}", None))
        yield from waiting
    yield "end", inner.end, inner.error, None, None


def salvage(win: _Window, verify: bool = True) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason, None), in file order."""
    at, bad, why = 0, None, ""
    marks = _Marks(win, _MAGIC, _VERSION)

    def gap(end: int) -> tuple:
        return "gap", bad, end, why, None

    while at < win.size:
        error = None
        if win.get(at, 3) == _MAGIC:
            found = 0
            for item in _member(win, at, verify):
                if item[0] == "end":
                    end, error = item[1], item[2]
                    continue
                if item[0] == "gap" and not found:
                    error = item[3]  # so far no record: the member may be one gap
                    continue
                if bad is not None:
                    yield gap(at)
                    bad = None
                found, error = found + 1, None
                yield item
            if not found and error is None:
                error = "empty member"
            if error and found:
                error = f"{error}, after {found} records of the member"
        else:
            try:
                headers, block, end = parse(win, at, verify)
            except Damaged as e:
                error = str(e)
            else:
                if bad is not None:
                    yield gap(at)
                    bad = None
                yield "record", at, end, headers, block
        if error:
            if bad is None:
                bad, why = at, error
            at = marks.after(at + 1)
        else:
            at = end
    if bad is not None:
        yield gap(win.size)


_READ = "file string, kind string, start long, end long, reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(files: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records (kind "record") and quarantined gaps (kind "gap") of the files listed in ``files.file``."""

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isdigit() else None

    def row(name: str, item: tuple) -> tuple:
        kind, start, end, x, block = item
        if kind == "gap":
            return (name, kind, start, end, x, *[None] * 7)
        typ, payload = x.get("warc-type"), payload_of(block)
        if typ == "revisit":
            want = x.get("warc-payload-digest", "").removeprefix("sha1:")
            digest, size, payload = base64.b32decode(want).hex() if want else None, number(x.get("x-payload-length")), None
        else:
            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        return name, kind, start, end, None, number(x.get("x-page-id")), x.get("warc-target-uri"), typ, size, digest, number(x.get("x-refers-to-page")), payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in _READ.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                path, rows, size = f"{root}/{name}", [], 0
                total = fs.get_file_info(path).size
                with fs.open_input_file(path) as f:
                    for item in salvage(_Window(f, total)):
                        rows.append(row(name, item))
                        size += len(item[4] or b"")
                        if len(rows) >= 2000 or size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    n = max(1, files.count())
    return files.select("file").repartition(min(n, 100_000)).mapInArrow(run, _READ)


def checked_revisits(read: DataFrame) -> DataFrame:
    """``read`` with ``refers_ok``: whether a revisit's digest is that of the response it refers to; null where that isn't in the archives."""
    response = read.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("_page")).agg(F.collect_set("payload_digest").alias("_digests"))
    both = read.join(response, F.when(F.col("record_type") == "revisit", F.col("refers_to")) == F.col("_page"), "left")
    return both.withColumn("refers_ok", F.array_contains("_digests", F.col("payload_digest"))).drop("_page", "_digests")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = shared_dir(spark, "warc")
    manifest = write_archives(pages, folder)
    read = read_archives(manifest, folder, with_payload=False)
    return read.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

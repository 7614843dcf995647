"""WARC archives: a writer with revisit records and a salvage reader (operator 9).

The writer makes each record a gzip member of its own. The reader takes gzip
members of one or more records and plain records, and checks framing and digests
of each. After a failed check it looks for the next version line within the
member, or the next member or version line of the archive, where a whole record
is valid, goes on from there, and logs the bytes between as a quarantined gap.
Records are read in pieces, so their length has no limit of the reader's own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import ship, written
from sextant.llm.token_counts import open_store

#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/\d\.\d{1,2}\r?\n")
#: The longest version line, which marks at the end of a piece may lack.
MARK = 12
#: A task starts another archive beyond this many bytes.
ROLL = 16 << 20
READ = 1 << 18
#: Inflated bytes that stay in memory; going back further inflates the member again.
KEPT = 8 << 20
#: Payloads from this many bytes on are stored once.
LEAST = 1000


def sha1_field(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str | None) -> str:
    return "<urn:x-page-without-id>" if key is None else f"<urn:x-page:{quote(key, safe='')}>"


def key_of(uri: str | None) -> str | None:
    m = re.fullmatch(r"<urn:x-page:(.*)>", uri or "")
    return unquote(m[1]) if m else None


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One response record, or the revisit record of a payload that another record holds."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~' + chr(39))}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: {sha1_field(payload)}", f"WARC-Block-Digest: {sha1_field(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Found:
    """A record that was read, or a gap (reason set) that was quarantined.

    start and end are the archive's bytes: of the record, of the gap, or of the
    member that holds it; within a member, inner says where in its content it
    starts and inner_end where it ends."""

    start: int
    end: int
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    payload_bytes: int = 0
    payload_digest: str | None = None
    inner: int | None = None
    inner_end: int | None = None
    proven: bool = False


class Damaged(ValueError):
    pass


class Plain:
    """Bytes of the archive itself."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size

    def at(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        return self.handle.read_at(n, offset) if n > 0 else b""


class Member:
    """The content of one gzip member, as far as it inflates."""

    def __init__(self, plain: Plain, start: int):
        self.plain, self.start, self.end, self.fault = plain, start, None, None
        self._restart()

    def _restart(self) -> None:
        self.unzip, self.next, self.base, self.held, self.over = zlib.decompressobj(wbits=31), self.start, 0, bytearray(), False
        self.raw = b""

    def _more(self) -> None:
        """Inflate another piece, or find the end or the fault."""
        try:
            if not self.raw:
                self.raw = self.plain.at(self.next, READ if self.next > self.start else 1 << 12)
                self.next += len(self.raw)
            made = self.unzip.decompress(self.raw, READ)
            if not (self.raw or made or self.unzip.eof):
                raise Damaged("cut off")
            self.held += made
            self.raw = self.unzip.unconsumed_tail
        except (zlib.error, Damaged) as e:
            self.over, self.fault = True, "gzip" if isinstance(e, zlib.error) else "cut off"
        if self.unzip.eof:
            self.over, self.end = True, self.next - len(self.unzip.unused_data)

    def at(self, offset: int, n: int) -> bytes:
        if offset < self.base:
            self._restart()
        while not self.over and self.base + len(self.held) < offset + n:
            if offset - self.base > KEPT:
                drop = min(offset - self.base, len(self.held))
                del self.held[:drop]
                self.base += drop
            self._more()
        return bytes(self.held[max(0, offset - self.base) : max(0, offset - self.base + n)])

    def whole(self) -> bool:
        """Whether the member inflates to its end and its checksum holds; what is held stays."""
        if self.end is None and self.fault is None:
            other = Member(self.plain, self.start)
            while not other.over:
                other.held.clear()
                other._more()
            self.end, self.fault = other.end, other.fault
        return self.fault is None


def read_headers(view, at: int) -> tuple[dict[str, str], int]:
    """The headers that start at a version line (or a status line), by lower-cased name, and where their block begins.

    Lines may end in CRLF or LF; a line that starts with a blank continues the one before."""
    out: dict[str, str] = {}
    name, held, first = "", b"", True
    while True:
        while (cut := held.find(b"\n")) < 0:
            more = view.at(at + len(held), max(4096, len(held)))
            if not more:
                raise Damaged("headers")
            held += more
        line, held, at = held[:cut].rstrip(b"\r"), held[cut + 1 :], at + cut + 1
        if first:
            first = False
            continue
        if not line:
            return out, at
        if line[:1] in b" \t" and name:
            out[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        label, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        name = label.decode("latin-1").strip().lower()
        out[name] = value.decode("utf-8", "replace").strip()


class Check:
    """A digest that a header states, against the bytes that come by."""

    def __init__(self, stated: str):
        kind, _, self.value = stated.partition(":")
        self.hash = hashlib.new(kind.lower()) if kind.lower() in ("md5", "sha1", "sha256") and self.value else None

    def fails(self) -> bool:
        if self.hash is None:
            return False
        return self.value.lower() not in (self.hash.hexdigest(), base64.b32encode(self.hash.digest()).decode().lower())


def http_end(view, at: int, end: int) -> int:
    """Where the payload of an HTTP message begins: past its first empty line, or at its end."""
    seen, pos = b"", at
    while pos < end:
        piece = view.at(pos, min(4096, end - pos))
        if not piece:
            break
        m = re.search(rb"\r\n\r\n|\n\n", seen + piece)
        if m:
            return pos - len(seen) + m.end()
        pos, seen = pos + len(piece), piece[-3:]
    return end


def closing(view, end: int) -> int:
    """How long the empty lines are that close a record whose block ends here."""
    tail = view.at(end, 4)
    if not tail:
        raise Damaged("cut off")
    if tail != b"\r\n\r\n" and tail[:2] != b"\n\n":
        raise Damaged("length")
    return 4 if tail[:1] == b"\r" else 2


def parse_record(view, at: int, with_payload: bool = True) -> tuple[Found, int]:
    """The record at a place of a view, with framing and digests checked, and where it ends.

    The block is read in pieces; only the payload stays, if it is wanted."""
    if not VERSION.match(view.at(at, MARK)):
        raise Damaged("version line")
    headers, begin = read_headers(view, at)
    length = headers.get("content-length", "")
    if not length.isdecimal():
        raise Damaged("length")
    end = begin + int(length)
    found = Found(at, end, headers=headers)
    http = headers.get("content-type", "").lower().startswith("application/http")
    body = http_end(view, begin, end) if http else begin
    block, payload, own = Check(headers.get("warc-block-digest", "")), Check(headers.get("warc-payload-digest", "")), hashlib.sha1()
    revisit, pos, kept = headers.get("warc-type") == "revisit", begin, []
    closed = closing(view, end) if isinstance(view, Plain) else 0  # a false length shows before the block is read
    while pos < end:
        piece = view.at(pos, min(READ, end - pos))
        if not piece:
            raise Damaged("cut off")
        part = piece[max(0, body - pos) :]
        own.update(part)
        for check, data in ((block, piece), (payload, part)):
            if check.hash is not None:
                check.hash.update(data)
        if with_payload and not revisit:
            kept.append(part)
        pos += len(piece)
    closed = closed or closing(view, end)
    if block.fails():
        raise Damaged("block digest")
    found.proven = block.hash is not None
    if revisit:
        try:
            size = read_headers(view, begin)[0].get("content-length", "") if body > begin else ""
        except Damaged:
            size = ""
        found.payload_bytes = int(size) if size.isdecimal() else 0
        stated = payload.value if payload.hash is not None and payload.hash.name == "sha1" else ""
        try:
            found.payload_digest = stated.lower() if len(stated) == 40 else base64.b32decode(stated.upper()).hex() or None
        except ValueError as e:
            raise Damaged("payload digest") from e
    else:
        if payload.fails():
            raise Damaged("payload digest")
        found.payload, found.payload_bytes, found.payload_digest = b"".join(kept), end - body, own.hexdigest()
    return found, end + closed


class Archive:
    """A random-access archive: gzip members and plain records, or plain records only."""

    def __init__(self, handle, size: int, gzipped: bool, with_payload: bool = True):
        self.plain, self.size, self.gzipped, self.with_payload = Plain(handle, size), size, gzipped, with_payload

    def marks(self, view, pos: int, zipped: bool) -> Iterator[int]:
        """Where a member or a record could start, from pos on."""
        mark = re.compile(rb"\x1f\x8b\x08|" + VERSION.pattern) if zipped else VERSION
        while raw := view.at(pos, READ):
            yield from (pos + m.start() for m in mark.finditer(raw) if m.start() <= len(raw) - MARK or len(raw) < READ)
            pos += len(raw) - MARK + 1 if len(raw) == READ else len(raw)

    def _records_at(self, pos: int) -> Iterator[Found]:
        """What starts at a place of the archive; Damaged if no valid record is there."""
        if not (self.gzipped and self.plain.at(pos, 3) == MAGIC):
            found, end = parse_record(self.plain, pos, self.with_payload)
            found.end = end
            return iter([found])
        member = Member(self.plain, pos)
        first = self._inside(member, 0)
        try:
            return chain([next(first)], first)
        except StopIteration:
            raise Damaged(member.fault or "version line") from None

    def _inside(self, member: Member, at: int) -> Iterator[Found]:
        """Records of a member and gaps between them; nothing if it holds no valid record.

        A record counts if its block's digest holds or else the whole member's
        checksum. The end is -1 where the member has none."""
        gap: tuple[int, str] | None = None
        some = False
        while member.at(at, 1):
            try:
                found, end = parse_record(member, at, self.with_payload)
                more = member.at(end, 1)  # the member's checksum comes after its last record
                if not (found.proven or member.whole()):
                    raise Damaged(member.fault)
            except Damaged as e:
                gap = gap or (at, str(e))
                at = next(self.marks(member, at + 1, False), -1)
                if at < 0:
                    break
                continue
            member.whole()
            place = (member.start, -1 if member.end is None else member.end)
            if gap:
                yield Found(*place, gap[1], inner=gap[0], inner_end=at)
            found.start, found.end, found.inner, found.inner_end = *place, at, end
            some, gap, at = True, None, end
            yield found
            if not more:
                break
        if some and (gap or not member.whole()):
            yield Found(member.start, -1 if member.end is None else member.end, gap[1] if gap else member.fault, inner=gap[0] if gap else at)

    def records(self) -> Iterator[Found]:
        """Every valid record in order, and a gap for all that lies between.

        A place without a valid record costs a look at its first bytes, or one
        pass over what claims to be a record there."""
        pos = 0
        while pos < self.size:
            start, reason, found = pos, None, None
            for mark in self._places(pos):
                try:
                    found, pos = self._records_at(mark), mark
                    break
                except Damaged as e:
                    reason = reason or str(e)
            if found is None:
                yield Found(start, self.size, reason)
                return
            if pos > start:
                yield Found(start, pos, reason)
            end = None
            for x in found:
                if x.end < 0:  # of a member without an end, which then reaches to the next valid place
                    end = self._next_valid(x.start + 1) if end is None else end
                    x.end = end
                pos = x.end
                yield x

    def _next_valid(self, pos: int) -> int:
        for mark in self.marks(self.plain, pos, self.gzipped):
            try:
                self._records_at(mark)
                return mark
            except Damaged:
                continue
        return self.size

    def _places(self, pos: int) -> Iterator[int]:
        yield pos
        yield from self.marks(self.plain, pos + 1, self.gzipped)


def revisits(pages: DataFrame, id_col: str, payload: Column, least: int = LEAST) -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload another row holds.

    Of equal payloads of at least `least` bytes the row with the largest id is
    the response; rows that repeat that id are responses too. A group of null
    ids only has no revisits."""
    digests = written(pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest"), F.length(payload).alias("n")), "page-digests")
    groups = written(digests.where(F.col("n") >= least).groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("k")).where("k > 1 AND refers_to IS NOT NULL"), "page-groups")
    met = digests.where(F.col("n") >= least).join(groups, "digest").where("NOT (id <=> refers_to)")
    return written(met.select("id", "digest", "refers_to").distinct(), "page-revisits")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Write one record for each row of pages to .warc.gz archives in folder; (archive, records, bytes).

    Null payloads count as empty, null urls leave out the target header, null
    ids get a record id of their own kind, which reads back as null; repeated
    rows repeat. Each task attempt writes files of its own, and only archives in
    the result count. No rows make no archive."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    others = revisits(pages, id_col, payload, least).withColumnsRenamed({"id": "_id", "digest": "_digest"})
    decided = rows.join(others, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    decided = decided.select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []

        def close() -> None:
            out.close()
            done.append((name, n, size))

        for batch in batches:
            for key, url, data, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                zipper = zlib.compressobj(wbits=31)
                member = zipper.compress(record(key, url, data, refers_to, date)) + zipper.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "records", "bytes"])

    return written(decided.mapInArrow(run, "archive string, records bigint, bytes bigint"), "archives")


def read_archives(spark: SparkSession, folder: str, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records and gaps of the named archives in folder.

    (archive, start, end, inner, inner_end, reason, record_type, key, url,
    refers_to, payload_bytes, payload_digest, payload); reason is null for a
    record and says for a gap which check failed. A revisit's payload_bytes and
    digest are those of the payload it stands for. An empty archive has no rows;
    repeated names count once."""
    ship(spark)
    schema = "archive string, start bigint, end bigint, inner bigint, inner_end bigint, reason string, record_type string, key string, url string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                size = store.get_file_info(f"{base}/{name}").size
                with store.open_input_file(f"{base}/{name}") as handle:
                    rows, held = [], 0
                    for x in Archive(handle, size, name.endswith(".gz"), with_payload).records():
                        h = x.headers
                        rows.append((name, x.start, x.end, x.inner, x.inner_end, x.reason, h.get("warc-type"), key_of(h.get("warc-record-id")), h.get("warc-target-uri"), key_of(h.get("warc-refers-to")), x.payload_bytes, x.payload_digest, x.payload if with_payload else None))
                        held += len(x.payload) + 500
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows, strict=True), schema.split(", "), strict=True)], names)

    listed = archives.select("archive").distinct()
    return listed.repartition(max(1, min(listed.count(), 10_000)), "archive").mapInArrow(run, schema)


def salvage(spark: SparkSession, folder: str, archives: DataFrame, with_payload: bool = False) -> tuple[DataFrame, DataFrame]:
    """What read_archives finds, written: the records, and the log of quarantined gaps."""
    both = written(read_archives(spark, folder, archives, with_payload), "warc-salvage")
    gaps = both.where("reason IS NOT NULL").select("archive", "start", "end", "inner", "inner_end", "reason")
    return both.where("reason IS NULL"), gaps

"""WARC archives with revisit records, and a reader that salvages what is left of a damaged one.

Writing: of pages with equal payloads (by SHA-1) the one with the largest page_id becomes a response record, the others
revisit records that hold the HTTP head alone. Tasks write archives of one gzip member per record, close them at
`ARCHIVE_BYTES`, and list them in a manifest.

Reading: every record is checked (gzip checksum, version line, head, length, end mark, block and payload digests). After a
failed check the reader looks for the next gzip member or version line that begins a valid record, goes on from there, and
logs the bytes in between as a quarantined gap with the reason. Within a member it does the same on the inflated bytes, as
far as they can be inflated: later records of a member outlive a damaged one, and earlier ones a member that breaks off. The
last record before a member's failed gzip check stays quarantined, as nothing follows that vouches for it, and the others must
have a block digest and a clean head. A Page-ID must agree with the record id, which is derived from it. Gaps inside a
member are offsets of its inflated bytes and name the member; all others are offsets of the file.

Nulls: null html is an empty payload, a null url is left out; a page with a null page_id ranks below all others, and where
a payload has no other all its pages are responses. Rows that repeat the largest page_id of a payload are all responses.
An empty table gives no archive and no rows. Other columns of the input are left out.

Recovery: archives get their final names, made of partition and number, once they are whole; a task that runs again
replaces its own. Only archives of the manifest are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcseq.llm import files
from arcseq.session import stage

#: Payloads of fewer bytes are always written in full.
MIN_REVISIT_BYTES = 0
#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arcseq:pages")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
STEP = 1 << 16


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id: int | str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response record, or a revisit record of the page `refers_to`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
    head += [
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = LEVEL) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


class Damaged(Exception):
    """A check failed; the message says which."""


@dataclass
class Record:
    head: dict[str, str]
    block: bytes
    at: int

    @property
    def http_head(self) -> dict[str, str]:
        lines = self.block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass
class Gap:
    start: int
    end: int
    reason: str
    #: Where the member begins in whose inflated bytes the gap lies; None for a gap of the file.
    member: int | None = None


@dataclass
class Salvage:
    """Records of an archive in order; `gaps` fills as they are read."""

    raw: bytes
    gaps: list[Gap] = field(default_factory=list)

    def __iter__(self) -> Iterator[Record]:
        at, bad, reason = 0, None, ""
        while at < len(self.raw):
            try:
                found, inner, end, broken = self.records_at(at)
            except Damaged as e:
                if bad is None:
                    bad, reason = at, str(e)
                at = self.next_start(at + 1)
                continue
            if bad is not None:
                self.gaps.append(Gap(bad, at, reason))
                bad = None
            self.gaps += inner
            yield from found
            at = end
            if broken:
                bad, reason = at, broken
                at = self.next_start(at)
        if bad is not None:
            self.gaps.append(Gap(bad, len(self.raw), reason))

    def next_start(self, at: int) -> int:
        """The next place where a member or a record may begin."""
        found = [k for k in (self.raw.find(GZIP, at), self.raw.find(VERSION, at)) if k >= 0]
        return min(found, default=len(self.raw))

    def records_at(self, at: int) -> tuple[list[Record], list[Gap], int, str]:
        """The member at `at`, or the plain record there: records, gaps inside, the place up to which they reach in the
        file, and the failed check of a member that breaks off there."""
        if self.raw.startswith(VERSION, at):
            one, end = self.parsed(self.raw, at, at)
            return [one], [], end, ""
        if not self.raw.startswith(GZIP, at):
            raise Damaged("neither a member nor a version line")
        data, end, broken = self.inflated(at)
        found, inner, reach = self.records_inside(data, at, broken)
        if not found:
            raise Damaged(broken or (inner[0].reason if inner else "empty member"))
        if broken:
            return found, [g for g in inner if g.end <= reach], self.place_of(at, reach), broken
        return found, inner, end, ""

    def records_inside(self, data: bytes, member: int, broken: str) -> tuple[list[Record], list[Gap], int]:
        """Valid records of inflated bytes, the gaps between them, and where the last record ends."""
        found, gaps, at, reach = [], [], 0, 0
        bad, reason = None, ""
        while at < len(data):
            try:
                one, end = self.parsed(data, at, member, strict=bool(broken))
                if broken and not data.startswith(VERSION, end):
                    raise Damaged(broken)
            except Damaged as e:
                if bad is None:
                    bad, reason = at, str(e)
                at = data.find(VERSION, at + 1)
                at = len(data) if at < 0 else at
                continue
            if bad is not None:
                gaps.append(Gap(bad, at, reason, member))
                bad = None
            found.append(one)
            at = reach = end
        if bad is not None:
            gaps.append(Gap(bad, len(data), reason, member))
        return found, gaps, reach

    def inflated(self, at: int) -> tuple[bytes, int, str]:
        """The bytes of a member as far as they can be inflated, where it ends, and the check that fails there."""
        d, out = zlib.decompressobj(31), []
        while not d.eof and at < len(self.raw):
            before, part = d.copy(), self.raw[at : at + STEP]
            try:
                out.append(d.decompress(part))
            except zlib.error as e:
                try:
                    for k in range(len(part)):
                        out.append(before.decompress(part[k : k + 1]))
                except zlib.error:
                    pass
                return b"".join(out), at + k, f"gzip: {e}"
            at += len(part) - len(d.unused_data)
        return b"".join(out), at, "" if d.eof else "gzip: member not ended"

    def place_of(self, at: int, length: int) -> int:
        """The place in the file by which `length` bytes of the member at `at` are inflated."""
        d, n = zlib.decompressobj(31), 0
        while True:
            before, part = d.copy(), self.raw[at : at + STEP]
            try:
                more = len(d.decompress(part))
            except zlib.error:
                more = length
            if n + more >= length:
                break
            n, at = n + more, at + len(part)
        for k in range(len(part)):
            if n >= length:
                return at + k
            n += len(before.decompress(part[k : k + 1]))
        return at + len(part)

    @staticmethod
    def parsed(data: bytes, at: int, place: int, strict: bool = False) -> tuple[Record, int]:
        """The record at `at` and where it ends; `strict` where no gzip checksum covers its head."""
        if not data.startswith(VERSION, at):
            raise Damaged("no version line")
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            raise Damaged("head not ended")
        if data.find(VERSION, at + 1, stop) >= 0:
            raise Damaged("a version line within a head")
        if strict and re.search(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", data[at:stop]):
            raise Damaged("control characters in a head")
        head = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            k, colon, v = line.partition(b":")
            if not colon:
                raise Damaged("head line without a colon")
            head[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        if not re.fullmatch(r"\d{1,18}", head.get("content-length", ""), re.ASCII):
            raise Damaged("no content length")
        for name, of in (("warc-record-id", "page-id"), ("warc-refers-to", "refers-to-page-id")):
            if of in head and head.get(name) != record_id(head[of]):
                raise Damaged(f"{name} does not belong to {of}")
        if strict and not head.get("warc-block-digest", "").startswith("sha1:"):
            raise Damaged("no block digest")
        first = stop + 4
        end = first + int(head["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise Damaged("record not ended")
        one = Record(head, data[first:end], place)
        for name, raw in (("warc-block-digest", one.block), ("warc-payload-digest", one.payload)):
            if name == "warc-payload-digest" and head.get("warc-type") != "response":
                continue
            if head.get(name, "").startswith("sha1:") and head[name][5:] != digest(raw):
                raise Damaged(f"{name} differs")
        return one, end + 4


def marked(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, first (page_id of the response with the same payload, where there are more such pages)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "UTF-8"))))
    groups = rows.where("sha IS NOT NULL").groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    several = stage(groups.where("n > 1").select("sha", "first"), "warc-payloads")
    return rows.join(several, "sha", "left").select("page_id", "url", "html", "first")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of `marked`; one row for each archive: its file and number of records."""

    def write(batches):
        partition = TaskContext.get().partitionId()
        parts, held, records, number = [], 0, 0, 0

        def close():
            nonlocal parts, held, records, number
            name = f"{folder}/pages-{partition:06d}-{number:06d}.warc.gz"
            files.put(name, parts)
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["file", "records"])
            parts, held, records, number = [], 0, 0, number + 1
            return row

        for b in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                again = first is not None and page_id != first
                raw = record(page_id, url, html.encode("utf-8", "replace"), first if again else None, again)
                parts.append(member(raw))
                held, records = held + len(raw), records + 1
                if held >= archive_bytes:
                    yield close()
        if parts:
            yield close()

    return rows.mapInArrow(write, "file string, records long")


def _long(v: str | None) -> int | None:
    return int(v) if v is not None else None


def read_archives(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of the archives in `manifest`: a row for each record recovered, and one for each gap quarantined.

    The archives are read once, into a written table.
    """
    kinds = (
        "file string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "gap_start long, gap_end long, reason string, gap_member long"
    )

    def read(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                archive, rows = Salvage(files.get(name)), []
                for r in archive:
                    kind = r.head.get("warc-type")
                    size = len(r.payload) if kind == "response" else int(r.http_head.get("content-length", 0))
                    told = digest(r.payload) if kind == "response" else r.head.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((name, _long(r.head.get("page-id")), size, told, kind, _long(r.head.get("refers-to-page-id")), None, None, None, None))
                rows += [(name, None, None, None, None, None, g.start, g.end, g.reason, g.member) for g in archive.gaps]
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in kinds.split(", ")])

    spread = manifest.select("file").repartition(4 * manifest.sparkSession.sparkContext.defaultParallelism, "file")
    found = stage(spread.mapInArrow(read, kinds), "warc-records")
    records = found.where("reason IS NULL").select("file", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return records, found.where("reason IS NOT NULL").select("file", "gap_start", "gap_end", "reason", "gap_member")


def lost(manifest: DataFrame, records: DataFrame, gaps: DataFrame) -> DataFrame:
    """file, written, read, gaps of the archives from which not exactly the records written were read, or that have gaps."""
    read = records.groupBy("file").agg(F.count(F.lit(1)).alias("read"))
    held = gaps.groupBy("file").agg(F.count(F.lit(1)).alias("gaps"))
    each = manifest.select("file", F.col("records").alias("written")).join(read, "file", "left").join(held, "file", "left")
    return each.na.fill(0, ["read", "gaps"]).where("read <> written OR gaps > 0")


def round_trip(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Digest of every page, from the archives; raises where an archive does not give back what was written."""
    folder = files.shared_folder(pages.sparkSession, "warc")
    manifest = stage(write_archives(marked(pages, least), folder), "warc-manifest")
    records, gaps = read_archives(manifest)
    if short := lost(manifest, records, gaps).head(5):
        raise RuntimeError(f"archives do not give back their records: {short}")
    return records.drop("file")


_GROUPS = ", ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT sha, max(page_id) AS first, count(*) AS n FROM p GROUP BY sha)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, concat({_GROUPS}) AS payload_digest,
       CASE WHEN n > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id <> first THEN first END AS refers_to
FROM p JOIN g USING (sha)
"""

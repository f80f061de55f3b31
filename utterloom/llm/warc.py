"""WARC 1.1 archives: one gzip member per record, written to and salvaged from the shared folder.

Each page becomes a ``response`` record or, where an equal payload of at least ``min_revisit`` bytes has a larger page id, a
``revisit`` record that names it. Records hold the payload as an HTTP-less resource block.

The reader takes one member after the other. When a member fails its checks (bad gzip data, bad version line, wrong length,
wrong digest), it searches for the next place where a valid member or a plain ``WARC/1.`` line starts, goes on from there and
logs the skipped bytes as a quarantined gap.

Nulls: a null html is an empty payload, a null url an empty target, a null page id is written and read back as null.
Ties and repeats: of equal page ids with equal payloads all are ``response`` of themselves (none is larger).
An empty table gives no archive and no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, new_path, stored

ROLL = 256 << 20
READ = 4 << 20
MAGIC = b"\x1f\x8b\x08"
_PLAIN = re.compile(rb"WARC/1\.[01]\r\n")

RECORD = "path string, offset long, gap boolean, length long, reason string, page_id long, url string, record_type string, payload binary, refers_to long, payload_digest string, payload_bytes long"


def sha1_hex(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def record_bytes(page_id: int | None, url: str, kind: str, payload: bytes, digest: str, n: int, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit carries no payload, only its digest and length."""
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def parse_record(raw: bytes) -> dict:
    """Fields of one whole record; ValueError says which check failed."""
    if not _PLAIN.match(raw):
        raise ValueError("no version line")
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError("header does not end")
    lines = raw[:cut].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    n = int(head["content-length"])
    body = raw[cut + 4 : cut + 4 + n]
    if len(body) != n or raw[cut + 4 + n : cut + 8 + n] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = head.get("warc-type", "")
    if kind != "revisit" and digest and sha1_hex(body) != digest:
        raise ValueError("payload digest differs")
    ident = re.compile(r"<urn:page:(-?\d+)>").search
    page, refers = ident(head.get("warc-record-id", "")), ident(head.get("warc-refers-to", ""))
    return {
        "page_id": int(page[1]) if page else None,
        "url": head.get("warc-target-uri", ""),
        "record_type": kind,
        "payload": body,
        "refers_to": int(refers[1]) if refers else None,
        "payload_digest": digest or sha1_hex(body),
        "payload_bytes": int(head.get("x-payload-length", n)),
        "size": cut + 8 + n,
    }


class _Window:
    """A forward window over a byte stream; only what is still needed is kept."""

    def __init__(self, stream):
        self.stream, self.data, self.base, self.over = stream, b"", 0, False

    def more(self) -> bool:
        got = b"" if self.over else self.stream.read(READ)
        self.over = self.over or not got
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.base = self.data[n:], self.base + n

    def need(self, n: int) -> bool:
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n


def _take(w: _Window) -> tuple[dict, int]:
    """The record at the window's start and its stored length."""
    if w.data[:3] == MAGIC:
        z, out, at = zlib.decompressobj(31), [], 0
        while not z.eof:
            if at >= len(w.data) and not w.more():
                raise ValueError("member is cut short")
            chunk = w.data[at:]
            at = len(w.data)
            try:
                out.append(z.decompress(chunk))
            except zlib.error as e:
                raise ValueError(f"bad member: {e}") from None
        return parse_record(b"".join(out)), at - len(z.unused_data)
    while b"\r\n\r\n" not in w.data and len(w.data) < 1 << 20 and w.more():
        pass
    cut = w.data.find(b"\r\n\r\n")
    n = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", w.data[: max(cut, 0)] + b"\r\n")
    if not _PLAIN.match(w.data) or cut < 0 or not n:
        raise ValueError("neither a member nor a version line")
    w.need(cut + 8 + int(n[1]))
    got = parse_record(w.data[: cut + 8 + int(n[1])])
    return got, got["size"]


def salvage(stream) -> Iterator[tuple[int, dict | None, int, str]]:
    """(offset, record, length, reason) of each record, and with record None of each quarantined gap, in file order."""
    w, gap, why = _Window(stream), None, ""
    while w.need(1):
        w.need(12)
        try:
            rec, n = _take(w)
        except ValueError as e:
            if gap is None:
                gap, why = w.base, str(e)
            # the next place that can start a record; the last bytes stay, a mark may be split there
            at = 1
            while True:
                found = [x for x in (w.data.find(MAGIC, at), w.data.find(b"WARC/1.", at)) if x >= 0]
                if found:
                    w.drop(min(found))
                    break
                keep = max(at, len(w.data) - 8)
                w.drop(keep)
                at = 0
                if not w.more():
                    w.drop(len(w.data))
                    break
            continue
        if gap is not None:
            yield gap, None, w.base - gap, why
            gap = None
        yield w.base, rec, n, ""
        w.drop(n)
    if gap is not None:
        yield gap, None, w.base - gap, why


def planned(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Pages with the payload's digest and the page that each revisits, if any.

    Equal payloads are counted before they are shuffled; the join back meets a hot payload on the large side only, where
    Spark splits it.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = F.col("payload_bytes") >= min_revisit
    keys = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("b"))
    keys = keys.filter(F.octet_length("b") >= min_revisit).select(F.col("page_id").cast("long").alias("page_id"), F.sha1("b").alias("payload_digest"))
    first = keys.groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = p.filter(large).join(first, "payload_digest", "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    joined = joined.withColumn("refers_to", F.when(again, F.col("kept"))).drop("kept")
    cols = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
    return joined.select(cols).unionByName(p.filter(~large).withColumn("refers_to", F.lit(None).cast("long")).select(cols))


def write(plan: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write the archives; returns the manifest (path, records, bytes), stored, with the files of successful tasks only.

    Each try of a task writes files of its own name, so a repeated task never touches another's file.
    """

    def run(batches):
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, out, files = TaskContext.get().partitionId(), None, []
        try:
            for b in batches:
                for r in b.to_pylist():
                    kind = "response" if r["refers_to"] is None else "revisit"
                    raw = member(record_bytes(r["page_id"], r["url"] or "", kind, r["payload"], r["payload_digest"], r["payload_bytes"], r["refers_to"]))
                    if out is None or files[-1][2] + len(raw) > roll:
                        if out is not None:
                            out.close()
                        path = f"{root}/part-{part:05d}-{len(files):03d}-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(path)
                        files.append([path, 0, 0])
                    out.write(raw)
                    files[-1][1] += 1
                    files[-1][2] += len(raw)
        finally:
            if out is not None:
                out.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], ["path", "records", "bytes"])

    return stored(plan.mapInArrow(lean(run), "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the manifest's archives."""
    schema = RECORD

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in schema.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        fields = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])
        rows, held = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path) as stream:
                    for offset, rec, n, why in salvage(stream):
                        row = {"path": path, "offset": offset, "gap": rec is None, "length": n, "reason": why} | (rec or {})
                        if not with_payload:
                            row["payload"] = None
                        rows.append({k: row.get(k) for k in names})
                        held += len(row.get("payload") or b"") + 200
                        if held > READ:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(lean(run), schema)


def round_trip(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Write all pages as archives and read them back; a quarantined gap fails the query."""
    folder = new_path(pages.sparkSession, "warc")
    got = read(write(planned(pages, min_revisit), folder), folder, with_payload=False)
    return got.select(
        F.when(F.col("gap"), F.raise_error(F.concat(F.lit("unreadable bytes in "), F.col("path")))).otherwise(F.col("page_id")).cast("long").alias("page_id"),
        "payload_bytes", "payload_digest", "record_type", "refers_to",
    )

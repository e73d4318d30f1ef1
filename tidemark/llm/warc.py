"""WARC archives: a writer, and a reader that salvages what damaged files still hold."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shared_dir, ship

RECORDS = (
    "archive string, position long, length long, status string, reason string, record_type string,"
    " record_id string, page_id long, refers_to long, payload_length long, payload_digest string, payload binary, inner_position long, inner_length long"
)
#: Up to this many digests are broadcast.
BROADCAST_ROWS = 1_000_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def mark_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Add payload, payload_digest, record_type and refers_to to (page_id, html).

    A null html is an empty payload.  Of equal payloads of at least
    ``min_bytes`` the smallest page_id is the response; rows that repeat that
    page_id are responses too, and so are all rows of a group whose ids are
    all null.  The smallest id comes from a partial aggregate.  Digests that
    repeat are sent to all tasks if they are few, so payloads stay where they
    are; beyond BROADCAST_ROWS they are joined by a shuffle.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    first = cut(
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "payload_digest", "left").select(
        "page_id",
        "payload",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def record_id(page_id, digest: str, record_type: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}/{record_type}')}>"


def encode_record(page_id, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    block = _HTTP + (payload if record_type == "response" else b"")
    head = {
        "WARC-Type": record_type,
        "WARC-Record-ID": record_id(page_id, digest, record_type),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if record_type == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to, digest, "response")
        head["X-Refers-To-Page"] = str(refers_to)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, archive_mb: int = 16, level: int = 3) -> DataFrame:
    """Write one gzip member per row of :func:`mark_revisits`; returns the manifest.

    Each task writes its own archives, each closed at ``archive_mb``, under
    names that no other attempt uses.  The manifest holds those of the attempts
    that Spark committed, so what a lost executor or a second attempt leaves
    behind is never read.  An empty table gives an empty manifest.
    """
    ship(rows.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held, size, number, done = [], 0, 0, []

        def close():
            nonlocal held, size, number
            name = f"part-{part:05d}-{number:04d}-{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for member in held:
                    out.write(member)
            done.append((name, len(held), size))
            held, size, number = [], 0, number + 1

        for batch in batches:
            for r in batch.itertuples(index=False):
                page = None if pd.isna(r.page_id) else int(r.page_id)
                refers = None if pd.isna(r.refers_to) else int(r.refers_to)
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = encode_record(page, bytes(r.payload), r.payload_digest, r.record_type, refers)
                held.append(gz.compress(raw) + gz.flush())
                size += len(held[-1])
                if size >= archive_mb << 20:
                    close()
        if held:
            close()
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    # ids travel as strings: pandas would turn a column with nulls into doubles
    plain = rows.select(
        F.col("page_id").cast("string").alias("page_id"), "payload", "payload_digest", "record_type",
        F.col("refers_to").cast("string").alias("refers_to"),
    )
    return cut(plain.mapInPandas(write, "archive string, records long, bytes long"))


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and the place after it; ValueError names the failed check."""
    m = _VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0 or stop - at > 1 << 16:
        raise ValueError("header does not end")
    head = {}
    for line in data[m.end() : stop].decode("utf-8", "replace").split("\r\n"):
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError("malformed header line")
        head[k.strip().lower()] = v.strip()
    if not {"warc-type", "warc-record-id", "content-length"} <= head.keys() or not head["content-length"].isdigit():
        raise ValueError("mandatory header missing")
    first, size = stop + 4, int(head["content-length"])
    last = first + size
    if last > len(data):
        raise ValueError("block is cut short")
    block = data[first:last]
    if data[last : last + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    want = head.get("warc-block-digest", "")
    if want.startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
        raise ValueError("block digest differs")
    payload = block
    if head.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha256(payload).hexdigest()
    want = head.get("warc-payload-digest", "")
    if head["warc-type"] == "revisit":
        digest = want.removeprefix("sha256:")
    elif want.startswith("sha256:") and digest != want[7:]:
        raise ValueError("payload digest differs")
    number = lambda s: int(s) if s and re.fullmatch(r"-?\d+", s) else None
    return {
        "record_type": head["warc-type"],
        "record_id": head["warc-record-id"],
        "page_id": number(head.get("x-page-id")),
        "refers_to": number(head.get("x-refers-to-page")),
        "payload_length": number(head.get("x-payload-length")) if head["warc-type"] == "revisit" else len(payload),
        "payload_digest": digest,
        "payload": payload,
        "block": block,
        "digests": (head.get("warc-block-digest", ""), head.get("warc-payload-digest", "")),
    }, last + 4


def _verified(record: dict, digests: tuple[str, ...]) -> bool:
    """Whether one of the header's ``digests`` proves the block or payload of ``record``."""
    for want, body in zip(digests, (record["block"], record["payload"]), strict=True):
        kind, _, value = want.partition(":")
        if kind == "sha256" and hashlib.sha256(body).hexdigest() == value:
            return True
        if kind == "sha1" and value.upper() in (hashlib.sha1(body).hexdigest().upper(), base64.b32encode(hashlib.sha1(body).digest()).decode()):
            return True
    return False


def _records(raw: bytes, damaged: bool) -> list[dict]:
    """Rows of the records in ``raw`` and of the gaps between them, with their inner places.

    After a failed check the search goes on at the next version line.  In
    ``damaged`` data only records whose digest proves them count.
    """
    at, gap, why, out = 0, None, "", []
    while at < len(raw):
        try:
            record, after = parse_record(raw, at)
            if damaged and not _verified(record, record["digests"]):
                raise ValueError("no digest proves the record")
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            m = _VERSION.search(raw, at + 1)
            at = m.start() if m else len(raw)
            continue
        if gap is not None:
            out.append({"status": "gap", "reason": why, "inner_position": gap, "inner_length": at - gap})
            gap = None
        out.append(record | {"status": "ok", "reason": None, "inner_position": at, "inner_length": after - at})
        at = after
    if gap is not None:
        out.append({"status": "gap", "reason": why, "inner_position": gap, "inner_length": len(raw) - gap})
    return out


def _inflate(data: bytes, at: int, want: int | None = None) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` holds, the place after it, and the error that ended it.

    On an error the bytes of the last step are fed one by one, so all that
    decompresses before it is kept.  With ``want`` it stops at the byte that
    completes so much output.
    """
    gz, out, size, place = zlib.decompressobj(31), [], 0, at
    while not gz.eof:
        if place >= len(data):
            return b"".join(out), len(data), "gzip member is cut short"
        before = gz.copy()
        try:
            part = gz.decompress(data[place : place + 65536])
            slow = want is not None and size + len(part) >= want
        except zlib.error:
            slow = True
        if slow:
            gz = before
            for i in range(place, min(place + 65536, len(data))):
                try:
                    part = gz.decompress(data[i : i + 1])
                except zlib.error as e:
                    return b"".join(out), i, f"gzip: {e}"
                out.append(part)
                size += len(part)
                if gz.eof or want is not None and size >= want:
                    return b"".join(out), i + 1, None
            place += 65536
            continue
        out.append(part)
        size += len(part)
        place += 65536
    return b"".join(out), min(place, len(data)) - len(gz.unused_data), None


def _member(data: bytes, at: int) -> tuple[list[dict], int, str | None]:
    """The rows of what starts at ``at``, a gzip member or a plain record, the
    place after it, and the error if it is damaged; the place is then the one
    after its last good record.  ValueError if no record passes."""
    if data[at : at + 2] != b"\x1f\x8b":
        record, after = parse_record(data, at)
        return [record | {"status": "ok", "reason": None}], after, None
    raw, after, error = _inflate(data, at)
    rows = _records(raw, error is not None and error.startswith("gzip:"))
    good = [r for r in rows if r["status"] == "ok"]
    if not good:
        raise ValueError(error or (rows[0]["reason"] if rows else "empty gzip member"))
    if error:
        end = good[-1]["inner_position"] + good[-1]["inner_length"]
        after = _inflate(data, at, end)[1]
        rows = [r for r in rows if r["inner_position"] < end]
    return rows, after, error


def salvage(data: bytes) -> Iterator[dict]:
    """Every record that passes its checks, and a row for each byte gap between them.

    When a check fails, the search goes on from the next byte for a gzip magic
    or a version line at which a record passes; what was skipped is one
    quarantined gap with the first reason.  Inside a gzip member the same
    search runs over the decompressed bytes, as far as they decompress:
    its rows have the member's position and length, and their own place in
    inner_position and inner_length.  A damaged member ends at its last good
    record, and what follows is a gap.  An empty file gives nothing.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            found, after, error = _member(data, at)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield {"position": gap, "length": at - gap, "status": "gap", "reason": why}
            gap = None
        for row in found:
            yield {k: v for k, v in row.items() if k not in ("block", "digests")} | {"position": at, "length": after - at}
        at = after
        if error and at < len(data):
            gap, why = at, error
            m = _START.search(data, at)
            at = m.start() if m else len(data)
            if at == gap:
                gap = None
    if gap is not None:
        yield {"position": gap, "length": len(data) - gap, "status": "gap", "reason": why}


def _rows(archives: Iterator[tuple[str, bytes]]) -> Iterator[pd.DataFrame]:
    """Frames of ``RECORDS`` of about 8 MB from (name, bytes) of archives."""
    columns = [c.split()[0] for c in RECORDS.split(",")]
    for name, data in archives:
        held, size = [], 0
        for row in salvage(data):
            held.append(row | {"archive": name})
            size += len(row.get("payload") or b"")
            if size > 8 << 20:
                yield _frame(held, columns)
                held, size = [], 0
        if held:
            yield _frame(held, columns)


def read_archives(spark: SparkSession, folder: str, names: str = "*.warc*") -> DataFrame:
    """Rows of ``RECORDS`` from all archives in ``folder``, by any store Spark can read.

    Archives are the unit of work: a task holds one at a time, so foreign ones
    should be of bounded size, as crawls write them.
    """
    ship(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rows((path.rsplit("/", 1)[1], bytes(data)) for batch in batches for path, data in zip(batch.path, batch.content, strict=True))

    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder).select("path", "content")
    return files.mapInPandas(read, RECORDS)


def read_manifest(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows of ``RECORDS`` from the archives that a manifest of :func:`write_archives` names, and from no other file."""
    ship(manifest.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(folder)

        def archives():
            for batch in batches:
                for name in batch.archive:
                    with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                        yield name, file.read()

        return _rows(archives())

    tasks = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("archive").repartition(tasks, "archive").mapInPandas(read, RECORDS)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="object") for c in columns})
    for c in ("position", "length", "page_id", "refers_to", "payload_length", "inner_position", "inner_length"):
        out[c] = out[c].astype("Int64")
    return out


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, html, further columns ignored) as archives and read them back.

    One row per recovered record.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return read_manifest(write_archives(mark_revisits(pages), folder), folder)

"""Operator 10: WARC archives that are written with deduplicated payloads and read back by a salvaging reader.

Records are gzip members of their own inside archive blobs of bounded size; a blob is one row of a table in the shared
folder, so any store that Spark writes to will do. Of records with equal payloads the one of smallest page_id is the response, the others are
revisits that name it and carry no payload.

The reader checks each record (gzip check sum, block length, payload digest). After a failed check it looks for the next
gzip member or version line from which a record can be read, goes on there and logs the gap; within what a member holds it looks for
version lines alike. Of a member that is cut off the records before the last one count, of one whose check sum or
coding fails those whose payload digest confirms them.

An archive is a row, so that single archives of over 2 GB have to be cut before (at any bytes: salvage finds the next record).

Edge cases: a null html is an empty payload; a null url leaves out the target; a row without page_id is a revisit if any equal payload has an id, else a
response; rows that repeat the smallest page_id are responses too; an empty table gives empty archives and records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_text, attach, bounded_batches, saved

#: Bytes of an archive blob, but for a single record that is larger.
BLOB_BYTES = 4 << 20
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Compressed bytes that are inflated at once; after a failure within them, ever fewer, so that little output is lost.
INFLATED = (65536, 1024, 32, 1)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
              ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "text/html"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~-._%")))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zipped.compress(head.encode() + block + b"\r\n\r\n") + zipped.flush()


def payload_of(fields: dict, block: bytes) -> bytes:
    """What a record's payload digest is of: the body of an HTTP message, else the block."""
    if fields.get("content-type", "").lower().startswith("application/http"):
        head = re.search(rb"\r?\n\r?\n", block)
        return block[head.end():] if head else b""
    return block


def holds(told: str, data: bytes) -> bool | None:
    """Whether a digest field is that of the data; None for algorithms other than SHA-1, which nothing is known of."""
    kind, colon, value = told.partition(":")
    if not colon or kind.strip().lower() != "sha1":
        return None
    return value.strip().upper() in (payload_digest(data), hashlib.sha1(data).hexdigest().upper())


def parse_record(data: bytes, at: int, confirmed: bool = False) -> tuple[dict, bytes, int]:
    """Fields, block and end of the plain record at ``at``; ValueError if it fails a check or, where it must be
    ``confirmed``, has no digest that holds for its block or payload. Digests of algorithms other than SHA-1 are taken on trust, and where the block's
    holds, so is the payload's (transfer encodings are kept as they are)."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    split = data.find(b"\r\n\r\n", at)
    if split < 0:
        raise ValueError("headers end early")
    fields = {}
    for line in data[at:split].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
        raise ValueError("no length")
    end = split + 4 + int(fields["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("block length doesn't hold")
    block = data[split + 4:end]
    whole = holds(fields.get("warc-block-digest", ""), block)
    # a revisit's payload digest is that of another record's payload
    payload = None if fields.get("warc-type") == "revisit" else holds(fields.get("warc-payload-digest", ""), payload_of(fields, block))
    if whole is False:
        raise ValueError("block digest doesn't hold")
    if payload is False and not whole:
        raise ValueError("payload digest doesn't hold")
    if confirmed and not whole and not payload:
        raise ValueError("nothing confirms the record")
    return fields, block, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the gzip member at ``at`` gives, its end and no reason, or no end and the reason why it fails."""
    member, out, view = zlib.decompressobj(31), [], memoryview(data)
    start, step = at, 0
    while at < len(data):
        before = member.copy()
        try:
            piece = view[at:at + INFLATED[step]]
            out.append(member.decompress(piece))
        except zlib.error as e:
            if step == len(INFLATED) - 1:
                return b"".join(out), None, f"member at {start}: {e}"
            member, step = before, step + 1
            continue
        at += len(piece)
        if member.eof:
            return b"".join(out), at - len(member.unused_data), ""
    return b"".join(out), None, "member ends early"


def records_in(plain: bytes, end: int | None, reason: str) -> tuple[list[tuple[dict, bytes]], list[str]]:
    """Records of a member's content, and why and where (bytes of the content) there are gaps."""
    found, gaps, k, bad = [], [], 0, None
    cut = end is None and reason == "member ends early"
    while k < len(plain):
        try:
            fields, block, after = parse_record(plain, k, confirmed=end is None and not cut)
            if cut and after == len(plain):
                raise ValueError(reason)
            if bad:
                gaps.append(f"{bad[1]} (bytes {bad[0]} to {k} of the member)")
                bad = None
            found.append((fields, block))
            k = after
        except ValueError as e:
            bad = bad or (k, str(e))
            line = VERSION.search(plain, k + 1)
            k = line.start() if line else len(plain)
    if bad:
        gaps.append(f"{bad[1]} (bytes {bad[0]} to {len(plain)} of the member)")
    return found, gaps


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """('record', start, end, (fields, block)) for each readable record and ('gap', start, end, reason) between."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        gaps: list[str] = []
        if data.startswith(MEMBER, at):
            plain, end, trouble = inflate(data, at)
            found, gaps = records_in(plain, end, trouble)
            if not found and gaps:
                trouble = trouble or gaps[0]
        else:
            try:
                fields, block, end = parse_record(data, at)
                found, trouble = [(fields, block)], ""
            except ValueError as e:
                found, end, trouble = [], None, str(e)
        if gap is not None and (found or not trouble):
            yield "gap", gap, at, reason
            gap = None
        if found:
            for x in found:
                yield "record", at, len(data) if end is None else end, x
            if end is not None:
                for x in gaps:
                    yield "gap", at, end, x
                trouble = ""
        if trouble and gap is None:
            gap, reason = at, trouble
        if end is not None:
            at = end
            continue
        member, line = data.find(MEMBER, at + 1), VERSION.search(data, at + 1)
        at = min([x for x in (member, line.start() if line else -1) if x >= 0], default=len(data))
    if gap is not None:
        yield "gap", gap, len(data), reason


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with payload_bytes and refers_to (null: a response)."""
    rows = bounded_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("__sha", F.sha1(F.col("html").cast("binary"))).withColumn("__bytes", F.octet_length("html").cast("long"))
    first = saved(rows.groupBy("__sha", "__bytes").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")), "payloads")
    total = first.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    out = attach(rows, first, ["__sha", "__bytes"], "__n", total)
    again = (F.col("__bytes") >= min_bytes) & F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "html", F.col("__bytes").alias("payload_bytes"), F.when(again, F.col("__first")).alias("refers_to"))


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive blobs (archive string, part long, content binary) of all pages, written to the shared folder."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name, part, held, size = f"part-{TaskContext.get().partitionId():05d}.warc.gz", 0, [], 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in ("page_id", "url", "html", "refers_to"))):
                payload = html.encode()
                record = record_bytes(None if page_id is None else int(page_id), url, payload, payload_digest(payload), None if refers is None else int(refers))
                held.append(record)
                size += len(record)
                if size >= BLOB_BYTES:
                    yield pd.DataFrame({"archive": [name], "part": [part], "content": [b"".join(held)]})
                    part, held, size = part + 1, [], 0
        if held:
            yield pd.DataFrame({"archive": [name], "part": [part], "content": [b"".join(held)]})

    return saved(decide(pages, min_bytes).withColumns({c: as_text(c) for c in ("page_id", "refers_to")}).mapInPandas(pack, "archive string, part long, content binary"), "archives")


SCHEMA = "archive string, start long, end long, gap string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record and, with ``gap`` telling why, for each quarantined range of bytes.

    ``archives`` has archive and content, as from write_archives or (renamed) from Spark's binaryFile source.
    """
    def number(urn: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn)
        return int(m[1]) if m else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["archive"], batch["content"]):
                rows = []
                for kind, start, end, x in salvage(bytes(content)):
                    if kind == "gap":
                        rows.append((name, start, end, x, *[None] * 7))
                        continue
                    fields, block = x[0], payload_of(*x)
                    refers = number(fields.get("warc-refers-to", ""))
                    length = fields.get("x-payload-length", str(len(block)))
                    uri = fields.get("warc-target-uri")
                    rows.append((name, start, end, None, number(fields.get("warc-record-id", "")), None if uri is None else unquote(uri), int(length) if fields.get("warc-type") == "revisit" else len(block), fields.get("warc-payload-digest", "").removeprefix("sha1:") if fields.get("warc-type") == "revisit" else payload_digest(block), fields.get("warc-type"), refers, block if payloads else None))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")], dtype=object)
                for c in ("start", "end", "page_id", "payload_bytes", "refers_to"):
                    out[c] = out[c].astype("Int64")
                yield out

    return archives.select("archive", "content").mapInPandas(read, SCHEMA)

"""WARC archives: writing captures, reading records, assembling transactions.

A capture is three records: a response (or a revisit of an equal payload), and a request and a
metadata record that name it in ``WARC-Concurrent-To``. Records are gzip members of bounded
archive segments, kept as binary values of a shared table. Reading parses any such segment to
record rows without payloads; the assembly joins requests and metadata to responses by those
identifiers, revisits to the capture that ``WARC-Refers-To`` names, and gives one nested row
per capture.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import bounded_if_small, checkpointed, map_rows, stored

#: Bytes of a segment, least payload that is revisited, time written (it is no input).
SEGMENT_BYTES, LEAST_PAYLOAD, DATE = 1 << 18, 100, "2020-01-01T00:00:00Z"
# Names of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KINDS = ("response", "revisit", "request", "metadata")
#: Parts over which the captures that refer to one record are dealt.
REFER_PARTS = 16


def record_id(kind: str, page_id: int | None, uri: str | None, digest: str) -> str:
    """A version 8 UUID from what the record is about: kind, page, address, payload digest."""
    named = "\x00".join("" if x is None else f"={x}" for x in ("response" if kind == "revisit" else kind, page_id, uri, digest))
    bits = int.from_bytes(hashlib.sha256(named.encode()).digest()[:16], "big")
    return f"urn:uuid:{uuid.UUID(int=bits & ~(15 << 76 | 3 << 62) | 8 << 76 | 2 << 62)}"


def record(kind: str, identifier: str, uri: str | None, fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{identifier}>", "WARC-Date": DATE}
    if uri is not None:
        head["WARC-Target-URI"] = quote(uri, safe="!#$%&'()*+,/:;=?@[]~")
    head |= fields | {"Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def capture(page_id: int | None, uri: str | None, payload: bytes, first: tuple[int, str | None] | None) -> bytes:
    """The records of a page; ``first`` is the page (id and address) that has the payload
    already, if another."""
    digest = hashlib.sha256(payload).hexdigest()
    main = record_id("response", page_id, uri, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    about = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    if first is None:
        out = record("response", main, uri, about, http + payload)
    else:
        out = record("revisit", main, uri, about | {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{record_id('response', *first, digest)}>"}, http)
    target = urlsplit(quote(uri or "", safe="!#$%&'()*+,/:;=?@~"))
    ask = f"GET {target.path or '/'}{'?' + target.query if target.query else ''} HTTP/1.1\r\nHost: {target.netloc}\r\n\r\n".encode()
    tie = {"WARC-Concurrent-To": f"<{main}>"}
    out += record("request", record_id("request", page_id, uri, digest), uri, tie | {"Content-Type": "application/http; msgtype=request"}, ask)
    notes = f"pageId: {page_id}\r\n" if page_id is not None else ""
    return out + record("metadata", record_id("metadata", page_id, uri, digest), uri, tie | {"Content-Type": "application/warc-fields"}, notes.encode())


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a segment, one at a time; data that is not gzip is one piece."""
    if data[:2] != b"\x1f\x8b":
        if data:
            yield data
        return
    while data:
        unpack = zlib.decompressobj(31)
        yield unpack.decompress(data) + unpack.flush()
        data = unpack.unused_data


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a segment."""
    for member in members(data):
        at = 0
        while at < len(member):
            end = member.find(b"\r\n\r\n", at)
            if end < 0 or not member.startswith(b"WARC/", at):
                raise ValueError(f"no WARC record at {at}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in member[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
            size = int(head["content-length"])
            yield head, member[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def _described(head: dict[str, str], block: bytes) -> dict:
    """A record's row: HTTP blocks give payload size and digest, field blocks their page id."""
    kind = head.get("warc-type", "")
    out = {"kind": kind, "record_id": head.get("warc-record-id", "").strip("<>"), "concurrent_to": None, "uri": head.get("warc-target-uri"), "payload_bytes": None, "digest": None, "refers_to": None, "page_id": None, "line": None}
    if "warc-concurrent-to" in head:
        out["concurrent_to"] = head["warc-concurrent-to"].strip("<>")
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        out["digest"] = head.get("warc-payload-digest", "").rpartition(":")[2]
        if kind == "response":
            out["payload_bytes"] = len(payload)
            found = hashlib.sha256(payload).hexdigest()
            if out["digest"] not in ("", found):
                raise ValueError(f"{out['record_id']}: the payload does not have the digest {out['digest']}")
            out["digest"] = found
        else:
            lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            out["payload_bytes"] = int(lengths[0]) if lengths else None
            out["refers_to"] = head.get("warc-refers-to", "").strip("<>") or None
    elif kind == "metadata":
        fields = dict(x.partition(": ")[::2] for x in block.decode("utf-8", "replace").split("\r\n"))
        out["page_id"] = int(fields["pageId"]) if "pageId" in fields else None
    elif kind == "request":
        out["line"] = block.partition(b"\r\n")[0].decode("utf-8", "replace")
    return out


RECORD = "kind string, record_id string, concurrent_to string, uri string, payload_bytes bigint, digest string, refers_to string, page_id bigint, line string"


def read_records(archives: DataFrame, column: str = "content") -> DataFrame:
    """A row per record of a column of archive segments (as ``binaryFile`` gives, too).

    Null and empty segments give no rows; repeated segments give theirs again; other columns
    are not read. What is no WARC record, or has a payload that is not its digest's, raises.
    """

    def rows(batch: Iterator[dict]) -> Iterator[dict]:
        for r in batch:
            for head, block in records(r["content"] or b""):
                yield _described(head, block)

    return map_rows(archives.select(F.col(column).alias("content")), rows, RECORD)


def write_archives(pages: DataFrame) -> DataFrame:
    """Stored segments (column ``content``) with the records of all pages.

    Payloads of ``LEAST_PAYLOAD`` bytes or more that several pages share are stored for the
    least page id alone (of its rows, that with the least url). Their digests are grouped by
    partial aggregation and joined back: by broadcast where they are counted to be few, so that
    bodies stay where they are read, else by a shuffle, where a payload that very many pages
    share splits over tasks (an outer join's large side). Null html is an empty payload; a null
    page_id is never the first; repeated rows are written as often; a segment ends after the
    record that fills it, however long that is; an empty table gives no segments.
    """
    d = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary")).alias("body"))
    d = d.withColumn("digest", F.sha2("body", 256))
    alike = d.where(F.octet_length("body") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
    shared = checkpointed(alike.where("n > 1 and first is not null").select("digest", "first"))
    d = d.join(bounded_if_small(shared, F.octet_length("digest") + F.coalesce(F.octet_length("first.url"), F.lit(0)) + 64), "digest", "left")

    def rows(batch: Iterator[dict]) -> Iterator[dict]:
        held = bytearray()
        for r in batch:
            first = (r["first"]["page_id"], r["first"]["url"]) if r["first"] and r["first"]["page_id"] != r["page_id"] else None
            held += capture(r["page_id"], r["url"], r["body"], first)
            if len(held) >= SEGMENT_BYTES:
                yield {"content": bytes(held)}
                held.clear()
        if held:
            yield {"content": bytes(held)}

    return stored(map_rows(d.select("page_id", "url", "body", "first"), rows, "content binary"), "warc")


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture of record rows: ``capture`` (response or revisit),
    ``request`` and ``metadata`` (null where there is none; the least by identifier where
    several records name one capture, with their number in ``n_requests, n_metadata``), and
    ``referred`` (page id and address of the capture that a revisit refers to, null if no such
    record was read).

    Requests and metadata that name no capture give no row; a record that is read twice is one
    capture twice. Captures that refer to one record are dealt over ``REFER_PARTS`` keys. An
    empty table gives no rows; other columns are not read.
    """
    captures = found.where(F.col("kind").isin("response", "revisit")).select("record_id", F.struct("kind", "record_id", "uri", "payload_bytes", "digest", "refers_to").alias("capture"))
    tied = found.where("concurrent_to is not null")

    def side(kind: str, name: str, *columns: str) -> DataFrame:
        own = tied.where(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("record_id"))
        return own.agg(F.min(F.struct("record_id", *columns)).alias(name), F.count("*").alias(f"n_{name}s" if name == "request" else f"n_{name}"))

    about = side("metadata", "metadata", "page_id")
    out = captures.join(side("request", "request", "uri", "line"), "record_id", "left").join(about, "record_id", "left")
    # what is referred to: one row a record, with its metadata's page
    wanted = found.where("kind = 'revisit' and refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    target = found.where("kind = 'response'").select("record_id", "uri").join(wanted, "record_id", "left_semi").join(about, "record_id", "left")
    target = target.groupBy(F.col("record_id").alias("to")).agg(F.min(F.struct("metadata.page_id", "uri")).alias("referred"))
    target = target.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(REFER_PARTS - 1))))
    part = F.pmod(F.xxhash64("record_id"), F.lit(REFER_PARTS)).cast("int")
    out = out.withColumn("__part", part).join(target, (F.col("capture.refers_to") == F.col("to")) & (F.col("__part") == F.col("part")), "left")
    return out.select("record_id", "capture", "request", "metadata", "referred", F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def page_captures(pages: DataFrame) -> DataFrame:
    """One row per page, from archives written, read back and assembled.

    Null html is an empty payload; a null page_id is written without one, and comes back null;
    a null url has no target. Repeated rows are one capture written as often; of pages with
    one id and payload all are responses if that id is the least. ``refers_to`` is the page of
    the record that the revisit names. An empty table gives no rows.
    """
    captures = assemble(checkpointed(read_records(write_archives(pages))))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.digest").alias("payload_digest"), F.col("capture.kind").alias("record_type"),
        F.col("referred.page_id").alias("refers_to"), F.col("n_requests"), F.col("n_metadata"),
    )


#: The same in DuckDB SQL (page ids without repeats).
ORACLE = f"""WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
 f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST_PAYLOAD} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN first <> page_id THEN first END AS refers_to, CAST(1 AS BIGINT) AS n_requests, CAST(1 AS BIGINT) AS n_metadata
FROM p LEFT JOIN f ON p.d = f.d"""

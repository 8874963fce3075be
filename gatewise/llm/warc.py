"""WARC archives: written as segmented records, read back by segment reassembly.

``write_pages`` writes one record per page with Spark's text writer: a row is a
record without its closing blank lines, which are the writer's line separator,
so every part file is a valid WARC file.  A response's block is an HTTP message
with chunked transfer framing; a block longer than ``segment_bytes`` goes on in
``continuation`` records.  Pages with equal payloads of at least
``least_revisit`` bytes are written once; the others are ``revisit`` records.

``read_records`` splits files at ``\\nWARC/1.``, a separator without a border of
its own, so that one file is read by many tasks.  Segments are grouped by the
record identifier of their origin, ordered by number, checked for gaps and for
their total length, joined, and only then is the HTTP message opened and its
chunked framing decoded.  The writer's chunks never hold the separator; an
archive of another writer may.  Such a record does not have the length that
its header states, and a file with one is read again as a whole, by lengths.

Nothing but the group of one record's segments is ever brought together.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.llm.batches import bound_batches
from gatewise.llm.store import hold, hot_join

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
LEAST_REVISIT = 1000
#: Separator of records for the reader, and the rest of the two closing line ends before it.
BORDER = "\nWARC/1."
END = "\r\n\r\n"
#: One archive date for all records: results of a job do not depend on its clock.
DATE = "2024-01-01T00:00:00Z"

_PIECE = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("stated_digest", pa.string()),
        ("origin", pa.string()),
        ("segment", pa.int64()),
        ("total", pa.int64()),
        ("block", pa.binary()),
    ]
)
PIECE = "record_id string, record_type string, page_id long, target_uri string, refers_to string, stated_digest string, origin string, segment long, total long, block binary"
_OPEN = pa.schema([*list(_PIECE)[:6], ("payload", pa.binary()), ("problem", pa.string())])
OPEN = "record_id string, record_type string, page_id long, target_uri string, refers_to string, stated_digest string, payload binary, problem string"


# ---- framing (plain functions on bytes) ------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; a chunk also ends inside every start of a record that the payload holds."""
    cuts = {*range(size, len(payload), size), *(m.start() + 1 for m in re.finditer(rb"WARC/1\.", payload)), len(payload)}
    out, at = [], 0
    for cut in sorted(cuts):
        if cut > at:
            out += [b"%x\r\n" % (cut - at), payload[at:cut], b"\r\n"]
            at = cut
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload behind chunked framing (extensions and trailers are skipped); None if it is damaged."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        digits = body[at:line].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", digits):
            return None
        size, at = int(digits, 16), line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines belong to the field before."""
    found: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def opened(block: bytes) -> tuple[bytes | None, str | None]:
    """(payload, problem) of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return None, "no HTTP message"
    said = fields(head)
    if said.get("transfer-encoding", "").lower() == "chunked":
        payload = dechunked(body)
        return (payload, None) if payload is not None else (None, "damaged chunks")
    stated = said.get("content-length", "")
    if stated.isdigit() and int(stated) != len(body):
        return None, "body length"
    return body, None


def joined(segments: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, str | None]:
    """(block, problem) of (number, total length, bytes) segments in any order; equal repeats count once."""
    by_number: dict[int, bytes] = {}
    totals = set()
    for number, total, block in segments:
        if by_number.setdefault(number, block) != block:
            return None, "segments differ"
        totals |= {total} - {None}
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        return None, "segment missing"
    whole = b"".join(by_number[n] for n in sorted(by_number))
    if totals != {len(whole)}:
        return None, "total length"
    return whole, None


def digest_of(payload: bytes) -> str:
    """The usual form of a payload digest in a WARC header."""
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing -----------------------------------------------------------------------------


def _record(kind: str, record_id: str, uri: str | None, page_id: int | None, block: bytes, extra: list[str]) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {re.sub('[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m.group().encode()), uri)}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head += [*extra, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def page_records(record_id: str, uri: str | None, page_id: int | None, payload: bytes, response: str | None, segment_bytes: int) -> list[bytes]:
    """The records of one page: a revisit of ``response``, or a response and its continuations."""
    digest = f"WARC-Payload-Digest: {digest_of(payload)}"
    if response is not None:
        extra = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{response}>", digest]
        return [_record("revisit", record_id, uri, page_id, b"", extra)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    extra = ["Content-Type: application/http; msgtype=response", digest]
    if len(parts) == 1:
        return [_record("response", record_id, uri, page_id, block, extra)]
    out = [_record("response", record_id, uri, page_id, parts[0], [*extra, "WARC-Segment-Number: 1"])]
    for n, part in enumerate(parts[1:], 2):
        own = [f"WARC-Segment-Origin-ID: <{record_id}>", f"WARC-Segment-Number: {n}"]
        if n == len(parts):
            own.append(f"WARC-Segment-Total-Length: {len(block)}")
        out.append(_record("continuation", f"{record_id}-{n}", None, None, part, own))
    return out


def write_pages(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, least_revisit: int = LEAST_REVISIT) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files under ``path``; other columns are left out.

    One record per row.  Of the rows with equal payloads of at least
    ``least_revisit`` bytes the one with the largest page_id (null: least) is
    the response and the others revisit it; of repeated rows with that page_id
    one is.  A null html is an empty payload; a null url or page_id leaves its
    header field out; an empty table writes no record.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("content", F.when(F.octet_length("payload") >= least_revisit, F.sha2("payload", 256)))
    last = F.struct(F.coalesce(F.col("page_id"), F.lit(-(2**63))).alias("p"), F.col("row").alias("r"))
    groups = rows.where("content is not null").groupBy("content").agg(F.max(last).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    known = hot_join(rows, groups.select("content", "kept"), "content")
    is_kept = F.col("kept").isNull() | (last == F.col("kept"))
    mark = lambda *c: F.concat(F.lit("urn:gatewise:"), F.md5(F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("-")) for x in c])))
    kept_id = mark(F.lit("kept"), F.col("content"))
    named = known.select(
        F.when(F.col("kept").isNotNull() & is_kept, kept_id).otherwise(mark(F.lit("row"), F.col("page_id"), F.col("row"))).alias("record_id"), "url", "page_id", "payload", F.when(~is_kept, kept_id).alias("response")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in page_records(*row, segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    named.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("record")).write.option("lineSep", END).text(path)


# ---- reading -----------------------------------------------------------------------------


def _parsed(record: bytes) -> dict | None:
    """A record (version line to end of block) as a row of PIECE; None if it is no record."""
    version, _, rest = record.partition(b"\r\n")
    head, gap, block = rest.partition(b"\r\n\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        return None
    said = fields(head)
    stated = said.get("content-length", "")
    if not stated.isdigit():
        return None
    number = lambda name: int(said[name]) if said.get(name, "").lstrip("-").isdigit() else None
    name = lambda field: said[field].strip("<>") if field in said else None
    own, segment = name("warc-record-id"), number("warc-segment-number")
    return {
        "record_id": own,
        "record_type": said.get("warc-type", "").lower(),
        "page_id": number("page-id"),
        "target_uri": said.get("warc-target-uri"),
        "refers_to": name("warc-refers-to"),
        "stated_digest": said.get("warc-payload-digest"),
        "origin": name("warc-segment-origin-id") or (own if segment is not None else None),
        "segment": segment,
        "total": number("warc-segment-total-length"),
        "block": block[: int(stated)],
    }


def records_of(archive: bytes) -> Iterator[dict]:
    """Records of a whole file, one after another by their stated lengths."""
    at = 0
    while 0 <= (at := archive.find(b"WARC/1.", at)):
        head = archive.find(b"\r\n\r\n", at)
        if head < 0:
            return
        stated = fields(archive[at:head]).get("content-length", "")
        end = head + 4 + (int(stated) if stated.isdigit() else 0)
        row = _parsed(archive[at:end])
        if row:
            yield row
        at = end


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files under ``path``, each file split among tasks where that is safe."""
    text = spark.read.option("lineSep", BORDER).text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("value <> ''")
    lead = F.octet_length(F.substring_index("value", END, 1)) + 4
    stated = F.regexp_extract("value", r"(?i)\r\nContent-Length:[ \t]*([0-9]+)", 1).try_cast("long")
    spare = F.octet_length("value") - lead - stated
    files = hold(text.where(F.coalesce(~spare.between(3, 4), F.lit(True))).select("file").distinct())
    odd = files.count()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_parsed(r if r.startswith(b"WARC/1.") else b"WARC/1." + r) for r in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([r for r in rows if r], schema=_PIECE)

    if not odd:
        return text.select(F.col("value").cast("binary").alias("value")).mapInArrow(split, PIECE)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                part: list[dict] = []
                for row in records_of(content):
                    part.append(row)
                    if len(part) == 256:
                        yield pa.RecordBatch.from_pylist(part, schema=_PIECE)
                        part = []
                yield pa.RecordBatch.from_pylist(part, schema=_PIECE)

    sound = text.join(files, "file", "left_anti").select(F.col("value").cast("binary").alias("value")).mapInArrow(split, PIECE)
    # a file with a record of another length than stated: the separator stands inside a payload
    again = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "content").join(files, "file", "left_semi").select("content").mapInArrow(whole, PIECE)
    return sound.unionAll(again)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page_id, target_uri, refers_to, stated_digest, payload, problem) of response and revisit records.

    Other record types are left out.  ``payload`` is null for revisits and
    where ``problem`` says why a record is damaged (a segment missing or
    repeated with other bytes, a wrong total length, damaged chunks, a wrong
    digest); such records stay in the result.  Files without records give no
    rows.  A split file's records are at most 2 GB each, as any value in Spark.
    """
    bound_batches(spark)
    pieces = _pieces(spark, path)
    parts = F.sort_array(F.collect_list(F.struct("segment", "total", "block")))
    first = F.struct("record_id", "record_type", "page_id", "target_uri", "refers_to", "stated_digest")
    grouped = pieces.where("origin is not null").groupBy("origin").agg(F.max(F.when(F.col("segment") == 1, first)).alias("f"), parts.alias("parts")).select("origin", "f.*", "parts")

    def rows(b: pa.RecordBatch, block: Iterator[tuple[bytes | None, str | None]]) -> pa.RecordBatch:
        payloads, problems = [], []
        for kind, stated, (body, problem) in zip(b.column("record_type").to_pylist(), b.column("stated_digest").to_pylist(), block, strict=True):
            payload = None
            if problem is None and kind == "response":
                payload, problem = opened(body)
                if payload is not None and stated and digest_of(payload) != stated:
                    payload, problem = None, "digest"
            payloads.append(payload)
            problems.append(problem)
        return pa.RecordBatch.from_arrays([*(b.column(f.name) for f in list(_OPEN)[:6]), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())], schema=_OPEN)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows(b, ((x, None) for x in b.column("block").to_pylist()))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows(b, (joined([(p["segment"], p["total"], p["block"]) for p in parts]) for parts in b.column("parts").to_pylist()))

    alone = pieces.where("origin is null and record_type in ('response', 'revisit')").drop("origin", "segment", "total").mapInArrow(single, OPEN)
    # segments whose first one is lost still say so
    known = grouped.select(F.coalesce("record_id", "origin").alias("record_id"), F.coalesce("record_type", F.lit("response")).alias("record_type"), "page_id", "target_uri", "refers_to", "stated_digest", "parts")
    return alone.unionAll(known.mapInArrow(several, OPEN))


def page_digests(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id), problem.

    Revisits take bytes and digest from the response that they refer to; one
    that refers to nothing in the archive, or to a damaged record, keeps nulls
    and the problem.
    """
    narrow = hold(records.select("record_id", "record_type", "page_id", F.col("refers_to").alias("response"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "problem"))
    full = narrow.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "problem")
    wanted = narrow.where("record_type = 'revisit'").select("response", F.col("page_id").alias("own_id"), "record_type")
    named = narrow.where("record_type = 'response'").join(wanted.select(F.col("response").alias("record_id")).distinct(), "record_id", "left_semi").groupBy(F.col("record_id").alias("response")).agg(F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("r"))
    back = hot_join(wanted, named, "response").select(
        F.col("own_id").alias("page_id"), "r.payload_bytes", "r.payload_digest", "record_type", F.col("r.page_id").alias("refers_to"), F.when(F.col("r.payload_digest").isNull(), "no response").alias("problem")
    )
    return full.unionAll(back)

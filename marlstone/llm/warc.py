"""WARC archives: writing pages as (segmented, chunk-framed) records, and reading them back with reassembly.

Writing: a page's record holds an HTTP response whose body has chunked transfer framing. Blocks of over `segment_bytes`
become a first record and continuation records (WARC-Segment-Number, -Origin-ID, and on the last -Total-Length). Spark's
text writer lays the records into files, as a WARC record ends with two line ends; so archives go wherever Spark writes.
Reading: archives named .gz, of one member or of one a record, go through Spark's text reader, cut where a record may
begin, so that a task holds a record and never an archive; pieces are put together until they have the Content-Length, as
a payload may hold such a place, too. Archives of another name are read file by file. A record in one piece is decoded
there and then; only segments are shuffled, grouped by origin, ordered by number and checked against the total length.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, new_path, written

#: Fixed values of the formats.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def frame(payload: bytes, chunk: int) -> bytes:
    """payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + chunk]), payload[i : i + chunk]) for i in range(0, len(payload), chunk)]
    return b"".join(parts) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    """The payload of a chunk-framed body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def unhttp(block: bytes) -> bytes:
    """The body of an HTTP message, its transfer framing removed."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unframe(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to: who is a response and who revisits whom.

    Of equal payloads of min_bytes or more, the rows of the least page_id are responses (rows that repeat it, all of them);
    the others revisit it. Smaller payloads are responses. Payloads of null page_ids alone are responses. Only digests and
    ids are grouped; the pages themselves move once, and only if some payload repeats. Small ones don't move to one place,
    as they look for no other.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    pages = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = pages.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.min_by("url", "page_id").alias("_url"), F.count("*").alias("_n")).where("_n > 1")
    sought = F.when(F.col("payload_bytes") >= min_bytes, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    out = pages.join(first.select(F.col("payload_digest").alias("_digest"), "_first", "_url"), sought == F.col("_digest"), "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.withColumns({"refers_to": F.when(other, F.col("_first")), "refers_url": F.when(other, F.col("_url"))}).drop("_digest", "_first", "_url")


def write_archives(planned: DataFrame, path: str, segment_bytes: int = 1 << 14, chunk_bytes: int = 1 << 12, records_per_file: int = 4096) -> None:
    """Writes plan_records' rows as WARC files (gzip) under path."""

    def run(batches):
        for batch in batches:
            out = []
            for page, url, payload, digest, refers, refers_url, uid in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                body = payload if payload is not None else b""
                block = HTTP_HEAD + (frame(body, chunk_bytes) if refers is None else b"0\r\n\r\n")
                target = _target(url)
                own = f"<urn:uuid:{uid}>"
                heads = [f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", *([] if page is None else [f"X-Page-ID: {quote(str(page), safe='')}"])]
                if refers is not None:
                    heads += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Target-URI: {_target(refers_url)}", "WARC-Refers-To-Date: 1970-01-01T00:00:00Z", f"X-Refers-To-Page-ID: {quote(str(refers), safe='')}"]
                pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                for k, piece in enumerate(pieces):
                    lines = list(heads)
                    if len(pieces) > 1:
                        if k:
                            lines = ["WARC-Type: continuation", f"WARC-Record-ID: <urn:uuid:{uid}:{k + 1}>", f"WARC-Segment-Origin-ID: {own}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z"]
                        lines.append(f"WARC-Segment-Number: {k + 1}")
                        if k and k + 1 == len(pieces):
                            lines.append(f"WARC-Segment-Total-Length: {len(block)}")
                    out.append("\r\n".join([VERSION, *lines, f"Content-Length: {len(piece)}", "", ""]).encode() + piece)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows = planned.select("page_id", "url", F.col("payload").cast("binary"), "payload_digest", "refers_to", "refers_url", F.expr("uuid()").alias("uid"))
    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:page:unknown"


def _headers(lines: bytes) -> dict[str, str]:
    """The named fields of a record's head after its first line; names are lower-case."""
    return {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}


#: Where a record may begin; the text reader cuts there.
CUT = b"\r\n\r\nWARC/"


def joined(pieces):
    """(headers, block) of each record from (file, piece) in order, as cut; Content-Length says what belongs together.

    The reader can pass over a cut where line ends before it straddle its buffers; a piece then holds several records.
    """
    name, heads, parts, size = None, None, [], 0
    for file, piece in pieces:
        if file != name:
            if parts:
                raise ValueError(f"the last record of {name} is cut short")
            name = file
            piece = piece.removeprefix(b"WARC/")
        if parts:
            parts.append(CUT)
            size += len(CUT)
        parts.append(piece)
        size += len(piece)
        while parts:
            if heads is None:  # the head may lie in several pieces, too
                held = b"".join(parts)
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    parts = [held]
                    break
                heads = _headers(held[:end])
                if "content-length" not in heads:
                    raise ValueError(f"no WARC record in {name}")
                parts = [held[end + 4 :]]
                size = len(parts[0])
            length = int(heads["content-length"])
            if size < length:
                break
            block = b"".join(parts)
            yield heads, block[:length]
            rest = block[length:].lstrip(b"\r\n")
            if rest and not rest.startswith(b"WARC/"):
                raise ValueError(f"a record of {name} is longer than it says")
            heads, parts = None, [rest[5:]] if rest else []
            size = len(rest[5:])
    if parts:
        raise ValueError(f"the last record of {name} is cut short")


def records_of(raw: bytes):
    """(headers, block) of each record of an archive's bytes; names are lower-case. Raises on bytes that are no record."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        heads = _headers(raw[at:end])
        size = int(heads["content-length"])
        if len(raw) < end + 4 + size:
            raise ValueError(f"the record at byte {at} is cut short")
        yield heads, raw[end + 4 : end + 4 + size]
        at = end + 4 + size
        while raw.startswith(b"\r\n", at):
            at += 2


PARSED = "origin string, segment int, total long, record_type string, page_id string, refers_to string, payload_digest string, url string, block binary"


def parse_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row a record: its origin (its own id, or a continuation's), segment number (0: in one piece) and block."""

    def rows_of(records):
        rows: list[tuple] = []
        held = 0
        text = lambda x: None if x is None else unquote(x)
        for h, block in records:
            origin = h.get("warc-segment-origin-id") or h.get("warc-record-id")
            rows.append((origin, int(h.get("warc-segment-number", 0)), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, h.get("warc-type"), text(h.get("x-page-id")), text(h.get("x-refers-to-page-id")), (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None, h.get("warc-target-uri"), block))
            held += len(block)
            if held > 1 << 22:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def streamed(batches):
        pieces = ((f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from rows_of(joined(pieces))

    def whole(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield from rows_of(records_of(raw))

    bounded_batches(spark)
    files = spark.read.option("recursiveFileLookup", "true")
    packed = files.option("pathGlobFilter", "*.gz").option("lineSep", CUT.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary"))
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").endswith(".gz") & ~F.substring_index("path", "/", -1).rlike("^[._]"))
    return packed.mapInArrow(streamed, PARSED).union(plain.select("content").mapInArrow(whole, PARSED))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 5, pa.binary()]
    names = [x.split()[0] for x in PARSED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row a whole record: record_type, page_id, refers_to, payload_digest (as its header says), url, payload.

    The archives are parsed once, into a work table.

    Segments are grouped by origin; a group must have the numbers 1 to its count once each and, in all, the bytes that its
    last record states, or the job fails. payload is the HTTP body without its transfer framing; a revisit's is empty.
    """
    parsed = written(parse_archives(spark, path), "warc-records")
    names = ["record_type", "page_id", "refers_to", "payload_digest", "url"]

    def decode(batches):
        for batch in batches:
            payload = [unhttp(b) for b in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(payload, pa.binary())], names=[*names, "payload"])

    schema = ", ".join(f"{n} string" for n in names) + ", payload binary"
    single = parsed.where("segment = 0").select(*names, "block").mapInArrow(decode, schema)
    groups = parsed.where("segment > 0").groupBy("origin").agg(*[F.max(F.when(F.col("segment") == 1, F.col(n))).alias(n) for n in names], F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    block = F.expr("aggregate(transform(parts, p -> p.block), cast('' as binary), (x, y) -> concat(x, y))")
    numbers = F.transform("parts", lambda p: p["segment"])
    sound = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (F.octet_length("block") == F.col("total"))
    checked = groups.withColumn("block", block).select(*names, F.when(F.coalesce(sound, F.lit(False)), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing, doubled or cut short: "), F.col("origin"))).cast("binary")).alias("block"))
    return single.unionByName(checked.mapInArrow(decode, schema))


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """Writes pages to archives (under the shared folder, if no path is given) and gives what reading them back yields.

    One row a page: page_id, payload_bytes, payload_digest, record_type, refers_to. Both figures are of the payload as
    decoded; a revisit's come from the response it refers to, whose digest its own header must equal. A null html is
    empty; null and repeated page_ids keep a record each; of equal payloads the least page_id is the response; a payload of
    any length is segmented and comes back whole; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(plan_records(pages, id_col, **options), path)
    kind = pages.schema[id_col].dataType
    back = read_archives(spark, path).select(F.col("page_id").cast(kind).alias("page_id"), F.col("refers_to").cast(kind).alias("refers_to"), "record_type", F.col("payload_digest").alias("stated"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("decoded"))
    sizes = back.where("record_type = 'response'").groupBy(F.col("decoded").alias("_digest")).agg(F.min("payload_bytes").alias("_bytes"))
    whole = back.where("record_type = 'response'").select("page_id", "payload_bytes", F.when(F.col("decoded") == F.col("stated"), F.col("decoded")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_digest"), "record_type", "refers_to")
    again = back.where("record_type = 'revisit'").join(sizes, F.col("stated") == F.col("_digest")).select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("stated").alias("payload_digest"), "record_type", "refers_to")
    return whole.unionByName(again)

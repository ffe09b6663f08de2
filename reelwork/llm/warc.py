"""WARC archives of captures: written as record streams, read back and assembled.

A capture is three records: a request, a response (or a revisit, where an equal payload is already
kept by another capture) and metadata. The request and the metadata name the response they belong
to by WARC-Concurrent-To; assembly joins the records on those identifiers and gives one nested row
per capture.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_folders, new_path, stage, table

#: Payloads of fewer bytes are always kept.
LEAST_REVISIT = 1000
#: Bytes of payload in one archive file, at most, unless one record alone has more: readers hold one
#: file at a time. Records are written in classes by size, each with as many records to a file; requests
#: and metadata are as long as their urls make them, so those of large captures aren't alone in theirs.
FILE_BYTES = 64 << 20
SIZES = [2 << 10, 32 << 10, 1 << 20]
#: Bytes of a request or metadata record besides twice its url, about.
SMALL_RECORD = 600
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def _id(kind: str) -> Column:
    """A record id that is always the same for one row and kind."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("_url"), F.col("_digest")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        lines.append(F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Writes the records of ``pages`` (page_id, url, html, anything else) as gzipped archives:
    ``path``/(size class)/kind=capture, kind=request and kind=metadata.

    Of captures with equal payloads of at least ``least`` bytes, that with the largest page_id is
    the response and the others revisit it; of a null page_id, or where all are null, each is a
    response. A null html is an empty payload, a null url is empty; line ends and spaces in a url
    are escaped. No pages give a folder without archives. Repeated rows are captures of their own
    with equal identifiers.
    """
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20]", "%20")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("_url"), html.alias("_html"), F.sha1(html.cast("binary")).alias("_digest"), F.octet_length(html).cast("long").alias("_bytes"))
    shared = own.where(F.col("_bytes") >= least).groupBy("_digest").agg(F.max(F.struct("page_id", "_url")).alias("_kept"), F.count("*").alias("_n")).where("_n > 1")
    shared = stage(shared.select(F.col("_digest").alias("_d"), F.col("_kept.page_id").alias("_kept_id"), F.col("_kept._url").alias("_kept_url")), "payloads")
    rows = own.join(shared, F.col("_digest") == F.col("_d"), "left").withColumn("_revisit", F.coalesce(F.col("page_id") < F.col("_kept_id"), F.lit(False)))
    kept_id = F.md5(F.concat_ws("|", F.lit("capture"), F.col("_kept_id").cast("string"), F.col("_kept_url"), F.col("_digest")))
    kept_parts = [F.substring(kept_id, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    kept = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *kept_parts), F.lit(">"))
    digest = F.concat(F.lit("sha1:"), "_digest")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", F.col("_url"))]
    capture = F.when(
        F.col("_revisit"),
        _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _id("capture")), *common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", kept), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], http),
    ).otherwise(_record([("WARC-Type", "response"), ("WARC-Record-ID", _id("capture")), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], F.concat(http, F.col("_html"))))
    path_query = F.regexp_extract("_url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(F.startswith(path_query, F.lit("/")), path_query).otherwise(F.concat(F.lit("/"), path_query)), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("_url", r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit("\r\n\r\n"))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _id("request")), *common, ("WARC-Concurrent-To", _id("capture")), ("Content-Type", "application/http; msgtype=request")], get)
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _id("metadata")), *common, ("WARC-Concurrent-To", _id("capture")), ("Content-Type", "application/warc-fields")], fields)
    lengths = {"capture": F.col("_bytes"), "request": F.col("_small"), "metadata": F.col("_small")}
    small = F.octet_length("_url") * 2 + SMALL_RECORD
    sizes = pages.select(F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).alias("_bytes"), (F.octet_length(url) * 2 + SMALL_RECORD).alias("_small"))
    fits = lambda c, low, high: F.coalesce((c > low) & (c <= high), F.lit(False))
    used = sizes.agg(*[F.count_if(fits(F.col("_bytes"), low, high) | fits(F.coalesce("_small", F.lit(SMALL_RECORD)), low, high)).alias(f"c{k}") for k, (low, high) in enumerate(_classes())]).first()
    rows = rows.withColumn("_small", small)
    for k, (low, high) in enumerate(_classes()):
        if used[k] or not k:
            own_class = {kind: fits(c, low, high) for kind, c in lengths.items()}
            each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.when(own_class[kind], v).alias("value")) for kind, v in (("capture", capture), ("request", request), ("metadata", metadata))])
            out = rows.where(own_class["capture"] | own_class["request"]).select(F.explode(each).alias("r")).select("r.kind", "r.value").where("value is not null")
            # A record ends with two line ends, which the text writer puts after each row.
            most = max(1, FILE_BYTES // high)
            out.write.partitionBy("kind").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/size={k}")
    make_folders(pages.sparkSession, *[f"{path}/size=0/kind={k}" for k in ("capture", "request", "metadata")])


def _classes() -> list[tuple[int, int]]:
    return list(zip([-1, *SIZES], [*SIZES, 1 << 40], strict=True))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive, gzipped by file or by
    record or not at all. What can't be read, a record that breaks off or a damaged member, ends the
    reading and is given as a last record of the type 'broken' with what is left of it."""
    broken = False
    while data[:2] == b"\x1f\x8b":
        out, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                out.append(member.decompress(rest))
            except zlib.error:
                broken = True
                break
            broken = not member.eof
            rest = member.unused_data
        data = b"".join(out)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        headers = {}
        for line in data[start : max(start, end)].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        size = headers.get("content-length", "0")
        if end < 0 or not size.isdecimal() or end + 4 + int(size) > len(data):
            yield headers | {"warc-type": "broken"}, data[start:]
            return
        yield headers, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
    if broken:
        yield {"warc-type": "broken"}, b""


RECORD = "record_id string, type string, url string, concurrent_to string, refers_to string, digest string, http string, payload_bytes long, payload_sha1 string, payload binary"


def read_records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """One row per record of the archives below ``path``, or of those of one kind. http: the head of
    an HTTP block; payload: what follows it, or the whole block of other records, with its length and
    SHA-1. A record that can't be read is a row of the type 'broken'. A folder without archives gives
    no rows."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for h, block in parse_records(content.as_buffer().to_pybytes()):
                    head, payload = "", block
                    if h.get("content-type", "").startswith("application/http"):
                        top, _, payload = block.partition(b"\r\n\r\n")
                        head = top.decode("utf-8", "replace")
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-payload-digest"), head, len(payload), sha1(payload).hexdigest(), payload))
                    held += len(payload)
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    types = {"payload": pa.binary(), "payload_bytes": pa.int64()}

    def batch(rows):
        names = [c.split()[0] for c in RECORD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/size=*/kind={kind}" if kind else path)
    return files.select("content").mapInArrow(run, RECORD)


def captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One nested row per capture: capture_id, request, response and metadata structs.

    Requests and metadata are joined through the identifier they are concurrent to; a capture
    without one has null there, and of several with one identifier the first by record id counts.
    The response has its payload's length and SHA-1, and the payload itself unless ``payloads`` is
    false: then it goes through no join. Broken records are left out (``read_records`` gives them); a
    folder without archives gives no rows.
    """
    of = lambda kind: read_records(spark, path, kind).where("type <> 'broken'")
    first = lambda rows, name, *cols: rows.groupBy("concurrent_to").agg(F.min(F.struct("record_id", *cols)).alias(name)).withColumnRenamed("concurrent_to", f"_{name}")
    field = F.regexp_extract(F.col("payload").cast("string"), r"(?m)^page-id: *(-?\d+)", 1)
    request = first(of("request"), "request", "url", "http")
    metadata = first(of("metadata").withColumn("page_id", F.when(field != "", field.cast("long"))), "metadata", "page_id")
    length = F.regexp_extract("http", r"(?mi)^content-length: *(\d+)", 1).cast("long").alias("http_length")
    kept = lambda c: F.when(F.col("type") == "response", F.col(c)).alias(c)
    parts = ["type", "url", "http", length, "digest", "refers_to", kept("payload_bytes"), kept("payload_sha1"), *([kept("payload")] if payloads else [])]
    response = of("capture").select(F.col("record_id").alias("capture_id"), F.struct(*parts).alias("response"))
    return response.join(request, F.col("capture_id") == F.col("_request"), "left").join(metadata, F.col("capture_id") == F.col("_metadata"), "left").select("capture_id", "request", "response", "metadata")


def op6_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    is_response = F.col("response.type") == "response"
    size = F.when(is_response, F.col("response.payload_bytes")).otherwise(F.col("response.http_length"))
    digest = F.when(is_response, F.col("response.payload_sha1")).otherwise(F.regexp_replace("response.digest", "^sha1:", ""))
    rows = captures(spark, path, payloads=False).select("capture_id", F.col("metadata.page_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("_to"))
    rows = stage(rows, "captures")
    named = rows.where("record_type = 'response'").groupBy(F.col("capture_id").alias("_id")).agg(F.max("page_id").alias("refers_to"))
    return rows.join(named, F.col("_to") == F.col("_id"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with sized as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
kept as (select payload_digest, max(page_id) as kept_id from sized where payload_bytes >= 1000 group by payload_digest)
select s.page_id, s.payload_bytes, s.payload_digest,
  case when s.page_id < k.kept_id then 'revisit' else 'response' end as record_type,
  case when s.page_id < k.kept_id then k.kept_id end as refers_to
from sized s left join kept k on s.payload_digest = k.payload_digest
"""

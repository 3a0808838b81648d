"""WARC archives: writing captures, reading records, and assembling records into captures."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import land, salted_left_join, shared_path

DATE = "2000-01-01T00:00:00Z"
RECORD = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, fields map<string,string>, payload binary"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
#: Bytes of payloads in one batch from a reader.
PORTION = 8_000_000
#: Records in one archive at most; three make a capture.
RECORDS_PER_FILE = 30_000


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, payload_hash: str, kind: str, copy: int = 0) -> str:
    """An id that a revisit can name without seeing its response: from page, URL and payload, and the number among rows equal in these."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page_id} {payload_hash} {url}' + f' copy {copy}' * (copy > 0))}>"


def _record(kind: str, own_id: str, headers: list[tuple[str, str]], block: bytes, content_type: str, date: str) -> bytes:
    """One record without its last line end, which the sink adds."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), *headers, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {re.sub(r'[\r\n]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in lines)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n"


def captured(page_id: int | None, url: str | None, html: str | None, size: int, sha1: str, sha256: str, refers: dict | None, copy: int = 0, date: str = DATE) -> list[bytes]:
    """The records of one capture: response or revisit, then request and metadata, both concurrent to it."""
    own = record_id(page_id, url, sha256, "response", copy)
    uri = [("WARC-Target-URI", url)] if url else []
    digest = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers:
        more = [("WARC-Refers-To", record_id(refers["page_id"], refers["url"], sha256, "response")), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        first = _record("revisit", own, [*uri, *digest, *more], http, "application/http;msgtype=response", date)
    else:
        first = _record("response", own, [*uri, *digest], http + (html or "").encode("utf-8", "surrogatepass"), "application/http;msgtype=response", date)
    host, path = re.match(r"(?:[^:]*://)?([^/?#]*)([^#]*)", url or "").groups()
    ask = f"GET {re.sub(r'\s', '%20', path) or '/'} HTTP/1.1\r\nHost: {re.sub(r'\s', '', host)}\r\n\r\n".encode("utf-8", "surrogatepass")
    told = b"" if page_id is None else f"page_id: {page_id}\r\n".encode()
    link = [("WARC-Concurrent-To", own)]
    return [
        first,
        _record("request", record_id(page_id, url, sha256, "request", copy), [*uri, *link], ask, "application/http;msgtype=request", date),
        _record("metadata", record_id(page_id, url, sha256, "metadata", copy), [*uri, *link], told, "application/warc-fields", date),
    ]


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``copy``: 0, and 1, 2 ... for further rows equal in ``page_id``, ``url`` and payload.

    Repeated rows are found by narrow keys and added up before they are shuffled, so a row may repeat any number of times.
    """
    key = F.xxhash64("page_id", F.col("page_id").isNull(), "url", F.col("url").isNull(), "sha256")
    keyed = rows.withColumn("key", key)
    repeated = land(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    if repeated.isEmpty():
        return rows.withColumn("copy", F.lit(0))
    alone = keyed.join(repeated, "key", "left_anti").drop("key").withColumn("copy", F.lit(0))
    several = keyed.join(repeated, "key", "left_semi").groupBy("page_id", "url", "sha256").agg(F.any_value("html").alias("html"), F.count("*").cast("int").alias("n"))
    each = several.select("page_id", "url", "html", "sha256", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    return alone.unionByName(each)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a capture for each page to gzipped WARC files.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the largest id is a
    response; others are revisits that refer to it. Groups are added up by payload hash before they
    are shuffled, and the join back is salted, so copies that make up a third of all pages are spread.
    Spark's text sink ends each record with CR LF and commits files by task, in any file system. A task begins a new
    file after ``records_per_file`` records, as a reader takes a file whole.

    Defined cases: null html is an empty payload; a null id is never the response of a group that has
    another; of rows equal in id, URL and payload one is the response and each other a revisit of its own; a null URL leaves the target out; an
    empty table writes no records; other columns are ignored.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("sha256", F.sha2(F.col("html").cast("binary"), 256))
    chosen = (
        rows.where(F.octet_length("html") >= least_bytes)
        .groupBy("sha256")
        .agg(F.max(F.struct(F.coalesce("page_id", F.lit(1 - 2**63)).alias("known"), "page_id", "url")).alias("chosen"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha256", F.struct("chosen.page_id", "chosen.url").alias("chosen"))
    )
    own = F.col("page_id").eqNullSafe(F.col("chosen.page_id")) & F.col("url").eqNullSafe(F.col("chosen.url")) & (F.col("copy") == 0)
    again = F.col("chosen").isNotNull() & ~own
    joined = salted_left_join(_numbered(rows), chosen, "sha256", ["page_id", "url", "copy"]).select(
        "copy", "page_id", "url", F.when(~again, F.col("html")).alias("html"), F.octet_length("html").alias("size"), F.sha1(F.col("html").cast("binary")).alias("sha1"), "sha256", F.when(again, F.col("chosen")).alias("refers")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r for row in rows for r in captured(**row)], pa.binary())], ["value"])

    joined.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _inflated(data: bytes) -> bytes:
    """``data``, unpacked if it is gzip of one or more members."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def _headers(data: bytes) -> list[tuple[str, str]]:
    lines = re.sub(r"\r?\n[ \t]+", " ", data.decode("utf-8", "replace")).splitlines()
    return [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if v or k.strip()]


def records_of(data: bytes) -> Iterator[dict]:
    """The records of one file, by their declared lengths."""
    data, at = _inflated(data), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        listed = _headers(data[data.index(b"\r\n", at) : end])
        head = dict(reversed(listed))
        begin, stop = end + 4, end + 4 + int(head["content-length"])
        block, at = data[begin:stop], stop
        if len(block) < stop - begin:
            raise ValueError(f"a record of {stop - begin} bytes ends after {len(block)}")
        http = "application/http" in head.get("content-type", "")
        top, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        fields = dict(reversed(_headers(top.partition(b"\r\n")[2]))) if http else dict(_headers(block)) if head.get("content-type", "").startswith("application/warc-fields") else {}
        kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        size = int(fields["content-length"]) if kind == "revisit" and fields.get("content-length", "").isdigit() else len(body)
        yield {
            "record_id": head.get("warc-record-id"), "type": kind, "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "concurrent_to": [v for k, v in listed if k == "warc-concurrent-to"], "refers_to": head.get("warc-refers-to"), "payload_digest": digest,
            "payload_bytes": size, "digest_ok": base32_sha1(body) == digest if kind == "response" and digest else None, "fields": list(fields.items()), "payload": body,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files in ``path`` (plain, or gzip of a file or of each record).

    HTTP heads are split off payloads and listed in ``fields``, as are warc-fields. A file is read by one
    task, so write files of bounded size, as :func:`write_warc` does. A cut-off record is an error, not a short payload.
    """
    text = pa.string()
    schema = pa.schema(zip(_NAMES, [text, text, text, text, pa.list_(text), text, text, pa.int64(), pa.bool_(), pa.map_(text, text), pa.binary()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in records_of(content.as_py()):
                    rows.append(record)
                    size += len(record["payload"])
                    if size >= PORTION:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture_id``, ``response`` (response or revisit), ``request``, ``metadata``.

    Requests and metadata join their response through concurrent-to identifiers, whichever of the two
    names the other. Identifiers are unique, so no key is hot; of several requests or metadata records
    of one capture the one with the smallest id is taken, and a record that comes twice counts once; of responses of one
    id with other contents the one with the least columns in their order (maps left out) is taken.
    A capture may lack either; requests and metadata without a response are left out. Columns of
    ``records`` beyond ``record_id, type, concurrent_to`` travel along, so select what is needed first.
    """
    ordered = F.struct(*(f.name for f in records.schema if f.dataType.typeName() not in ("map", "variant")))
    responses = records.where(F.col("type").isin("response", "revisit")).groupBy(F.col("record_id").alias("capture_id")).agg(F.min_by(F.struct(*records.columns), ordered).alias("response"))
    others = records.where(F.col("type").isin("request", "metadata"))
    named = others.select(F.explode("concurrent_to").alias("capture_id"), F.struct(*records.columns).alias("other"))
    naming = (
        records.where(F.col("type").isin("response", "revisit"))
        .select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("other_id"))
        .join(others.select(F.col("record_id").alias("other_id"), F.struct(*records.columns).alias("other")), "other_id")
        .select("capture_id", "other")
    )
    by_id = lambda kind: F.min_by("other", F.when(F.col("other.type") == kind, F.col("other.record_id"))).alias(kind)
    gathered = named.unionByName(naming).groupBy("capture_id").agg(by_id("request"), by_id("metadata"))
    none = lambda kind: F.when(F.col(f"{kind}.type") == kind, F.col(kind)).alias(kind)
    return responses.join(gathered, "capture_id", "left").select("capture_id", "response", none("request"), none("metadata"))


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Add ``referred`` to captures: the metadata fields of the capture that a revisit refers to.

    Only responses that are referred to travel, each once, and the join back is salted: one response
    may have a third of all captures as revisits.
    """
    refs = found.select(F.col("response.refers_to").alias("ref")).where(F.col("ref").isNotNull()).distinct()
    targets = found.join(refs, F.col("capture_id") == F.col("ref")).select("ref", F.col("metadata.fields").alias("referred"))
    return salted_left_join(found.withColumn("ref", F.col("response.refers_to")), targets, "ref", ["capture_id"]).drop("ref")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    # Landed, as archives are dear to parse and captures read their records three times.
    records = land(read_warc(spark, path).select("record_id", "type", "concurrent_to", "refers_to", "payload_digest", "payload_bytes", "digest_ok", "fields"), "records")
    found = resolve_revisits(captures(records))
    page = lambda fields: F.col(fields)["page_id"].cast("long")
    digest = F.when(F.coalesce("response.digest_ok", F.lit(True)), F.col("response.payload_digest")).otherwise(F.raise_error(F.lit("a payload does not have its digest")))
    return found.select(page("metadata.fields").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), digest.alias("payload_digest"), F.col("response.type").alias("record_type"), page("referred").alias("refers_to"))

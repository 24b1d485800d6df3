"""WARC archives (operator 2): write captures as records, read them back, assemble transactions.

A capture is three records, each with an id of its own: the request, the response (or a revisit
that refers to an earlier response with the same payload) and metadata. Request and metadata name
the response's record by ``WARC-Concurrent-To``. Nothing else ties them together: they may stand
anywhere in any archive. ``assemble`` joins them again and emits one nested row per capture.

Archives are gzip files that Spark's text sink writes to the shared scratch folder, one record a
line of the sink, ended by the two line breaks that end a WARC record. They are read as binary
files and cut by Content-Length, so a payload may hold anything, record headers included.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import ceil_div, only, stored
from churnlens.session import scratch_path

#: Payloads shorter than this are stored again rather than referred to.
REVISIT_BYTES = 100
#: Payload bytes that one archive holds, about.
ARCHIVE_BYTES = 8 << 20
#: One date for all records: the pages have none.
WARC_DATE = "2000-01-01T00:00:00Z"

_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = ("type string, record_id string, concurrent_to string, refers_to string, target string, "
                 "payload_digest string, payload_bytes long, payload binary, fields map<string,string>")


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds ``refers_to``: the row whose response a row revisits, or null.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` that with the smallest id has the response. Counts per
    digest are aggregated before they are shuffled; rows are joined only to digests that occur twice or more.
    """
    known = pages.withColumn("digest", F.sha2(F.col("payload"), 256)).withColumn("bytes", F.length("payload").cast("long"))
    copies = (known.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest")
              .agg(F.min(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select("digest", "first"))
    return (known.join(copies, "digest", "left")
            .withColumn("refers_to", F.when((F.col("bytes") >= REVISIT_BYTES) & (F.col("first.row") != F.col("row")), F.col("first")))
            .drop("first"))


def _uuid(kind: str, row: Column) -> Column:
    """A record id made from the row's number: the same if a task is run again."""
    h = F.md5(F.concat(F.lit(kind + ":"), row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """Text of a record without the two line breaks after it. Null fields are left out."""
    line = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(_END))) for k, v in fields]
    head = F.concat(F.lit(f"WARC/1.1{_END}WARC-Type: {kind}{_END}"), *[F.coalesce(x, F.lit("")) for x in line])
    return F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END + _END), block)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write every row's capture; returns the folder of archives (in the shared scratch folder).

    A null page is an empty payload. Rows are told apart by their place in the table, which has to be the same in
    every scan, as it is for stored files.
    """
    spark = pages.sparkSession
    rows = only(pages, page_id=id_col, url=url_col, html=html_col).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    plan = stored(with_revisits(rows).select("page_id", "row", "digest", "bytes", F.col("refers_to.row").alias("first_row"),
                                             F.col("refers_to.page_id").alias("first_id")), "warc-plan")
    total = plan.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, ceil_div(total, ARCHIVE_BYTES))
    # both sides dealt out by row, so that the pages are shuffled once and each partition is an archive
    full = plan.repartition(parts, "row").join(rows.select("row", "url", "html").repartition(parts, "row"), "row")
    # a URL is one header line: white space and controls in it are percent-encoded
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    body = F.coalesce("html", F.lit(""))
    rid, digest = _uuid("response", F.col("row")), F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: ")
    base = [("WARC-Target-URI", url), ("WARC-Date", F.lit(WARC_DATE))]
    both = [("WARC-Record-ID", rid), *base, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))]
    head = F.concat(http, F.col("bytes").cast("string"), F.lit(_END + _END))
    answer = F.when(F.col("first_row").isNull(), _record("response", both, F.concat(head, body))).otherwise(_record(
        "revisit", [*both, ("WARC-Profile", F.lit(_PROFILE)), ("WARC-Refers-To", _uuid("response", F.col("first_row")))], head))
    request = _record("request", [("WARC-Record-ID", _uuid("request", F.col("row"))), *base, ("WARC-Concurrent-To", rid),
                                  ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{_END}{_END}")))
    notes = F.concat_ws(_END, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")),
                        F.concat(F.lit("first-page-id: "), F.col("first_id").cast("string")))
    metadata = _record("metadata", [("WARC-Record-ID", _uuid("metadata", F.col("row"))), *base, ("WARC-Concurrent-To", rid),
                                    ("Content-Type", F.lit("application/warc-fields"))], F.concat(notes, F.lit(_END)))
    path = scratch_path(spark, "warc")
    (full.select(F.explode(F.array(request, answer, metadata)).alias("value"))
     .write.option("lineSep", _END + _END).option("compression", "gzip").text(path))
    return path


def _headers(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """Header fields up to the empty line; None at the end of the archive."""
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    out: dict[str, str] = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip()] = v.strip()
    return out


def parse(stream: io.BufferedIOBase, payloads: bool) -> Iterator[tuple]:
    """Records of one archive, as rows of ``RECORD_SCHEMA``; payloads are left out on wish, their digests never."""
    while (h := _headers(stream)) is not None:
        block = stream.read(int(h.get("Content-Length", 0)))
        kind = h.get("WARC-Type")
        http, _, payload = block.partition(b"\r\n\r\n") if h.get("Content-Type", "").startswith("application/http") else (b"", b"", block)
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if kind == "response" and f"sha256:{digest}" != h.get("WARC-Payload-Digest"):
            raise ValueError(f"payload digest of {h.get('WARC-Record-ID')} does not match")
        if kind == "revisit":
            digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), _http_length(http)
        if kind == "metadata":
            h |= {"field:" + k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(_END)) if k}
        yield (kind, h.get("WARC-Record-ID"), h.get("WARC-Concurrent-To"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"),
               digest, size, payload if payloads and kind == "response" else None, list(h.items()))


def _http_length(head: bytes) -> int:
    for line in head.split(b"\r\n"):
        k, _, v = line.partition(b":")
        if k.lower() == b"content-length":
            return int(v)
    return 0


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under ``path`` (``RECORD_SCHEMA``). A payload that does not match its digest is an error."""
    kinds = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
                       ("target", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                stream, rows, held = gzip.open(io.BytesIO(archive.as_py())), [], 0
                for row in parse(stream, payloads):
                    rows.append(row)
                    held += len(row[7] or b"") + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id``, ``answer`` (response or revisit), ``requests`` and ``metadata`` (arrays).

    Requests and metadata are joined to the record that they name by concurrent-to. A capture without a request or
    metadata has empty arrays; records that name no known answer, and null ids, belong to no capture and are left
    out. An answer stored twice under one id gives two rows, each with everything that names it.
    """
    parts = [c for c in records.columns if c != "payload"]
    answers = records.filter("type in ('response', 'revisit') and record_id is not null").select(
        F.col("record_id").alias("capture_id"), F.struct(*records.columns).alias("answer"))
    named = (records.filter("type in ('request', 'metadata') and concurrent_to is not null")
             .groupBy(F.col("concurrent_to").alias("capture_id"))
             .agg(*[F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", *[c for c in parts if c not in ("record_id", "fields")],
                                                                                        F.map_entries("fields").alias("fields"))))).alias(name)
                    for kind, name in (("request", "requests"), ("metadata", "metadata"))]))
    return answers.join(named, "capture_id", "left")


def captures(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write all pages, read the archives back and assemble the captures.

    Null pages are empty payloads, null URLs become about:blank, equal ids are each a capture of its own, texts of
    any length are one record, an empty table gives no captures, other columns are ignored.
    """
    return assemble(read(pages.sparkSession, write(pages), payloads))


def transactions(pages: DataFrame) -> DataFrame:
    """Per page: what its capture says of payload and record type."""
    found = captures(pages)
    note = lambda key: F.expr(f"element_at(map_from_entries(metadata[0].fields), 'field:{key}')").cast(pages.schema["page_id"].dataType)
    return found.select(note("page-id").alias("page_id"), F.col("answer.payload_bytes").alias("payload_bytes"),
                        F.col("answer.payload_digest").alias("payload_digest"), F.col("answer.type").alias("record_type"),
                        note("first-page-id").alias("refers_to"))

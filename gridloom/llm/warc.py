"""WARC archives: writing captures, reading records back, and assembling transactions.

Records are composed by DataFrame functions and written as text whose line separator is the blank line that ends a WARC
record, so any file system that Spark knows will do and a lost task is written again. Reading unpacks a file bit by bit and walks
its records by their stated length. A transaction is assembled by joining request, response (or revisit) and metadata records
on the identifier that they name as concurrent, or their own, into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import lean, shared_folder, written

#: Payloads from this size on are stored once.
LEAST = 1000
#: Bytes of payloads in one file, about: a file is held packed by the task that reads it, and its records one by one.
PER_FILE = 64 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: Column | str, name: Column, fields: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """One record without its last two line ends."""
    parts = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: <"), name, F.lit(f">\r\nWARC-Date: {DATE}\r\n")]
    for field, value in fields:
        value = F.lit(value) if isinstance(value, str) else value
        parts.append(F.coalesce(F.concat(F.lit(f"{field}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*parts, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def _rows(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.translate(F.col(url_col).cast("string"), "\r\n", "  ").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    return rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))


def _name(page: Column, digest: Column) -> Column:
    """A capture's identifier, by page and payload."""
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), digest)


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a request, a response or revisit, and a metadata record for every row, as gzipped archives below ``path``.

    Of rows whose payloads of at least 1000 bytes are equal, the one with the largest id is the response and the others
    revisit it, without a payload of their own. Null payloads are empty, null urls name no target; line ends in
    urls become spaces. A row with a null id is a response. Captures are named by id and payload; where these don't tell rows apart (repeated
    rows, null ids) a random part follows, and what refers to such a row names what its copies share. An empty table gives no record.
    """
    rows = _rows(df, id_col, url_col, payload_col)
    # ids and digests alone: a row per id and payload, then those that have a chief or come several times
    light = rows.select("id", F.octet_length("payload").alias("size"), "digest")
    known = written(light.groupBy("id", "digest", "size").agg(F.count("*").alias("copies")), shared_folder(df.sparkSession), "known")
    total = known
    shared = known.filter(F.col("size") >= LEAST).groupBy("digest", "size").agg(F.max("id").alias("chief"), F.min("id").alias("first"))
    shared = shared.filter("first < chief").select("digest", "size", "chief")
    known = known.join(shared, ["digest", "size"], "left").withColumn("chief", F.when(F.col("id") < F.col("chief"), F.col("chief")))
    rows = rows.join(known.filter("id is not null and (chief is not null or copies > 1)").select("id", "digest", "chief", "copies"), ["id", "digest"], "left")
    alike = F.col("id").isNull() | (F.coalesce("copies", F.lit(1)) > 1)
    main = F.concat(_name(F.col("id"), F.col("digest")), F.when(alike, F.concat(F.lit(":"), F.uuid())).otherwise(""))
    rows = rows.withColumn("name", main)
    size = total.agg(F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("bytes")).first()
    per_file = 3 * max(10, int(PER_FILE * size["n"] / max(size["bytes"] or 0, 1))) if size["n"] else 3
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    main, url = F.col("name"), F.col("url")
    sha = F.concat(F.lit("sha1:"), F.col("digest"))
    target = ("WARC-Target-URI", url)
    revisit = _record("revisit", main, [target, ("WARC-Profile", REVISIT), ("WARC-Refers-To", F.concat(F.lit("<"), _name(F.col("chief"), F.col("digest")), F.lit(">"))), ("WARC-Payload-Digest", sha), ("Content-Type", "application/http; msgtype=response")], http)
    response = _record("response", main, [target, ("WARC-Payload-Digest", sha), ("Content-Type", "application/http; msgtype=response")], F.concat(http, F.col("payload")))
    concurrent = ("WARC-Concurrent-To", F.concat(F.lit("<"), main, F.lit(">")))
    request = _record("request", F.concat(main, F.lit(":request")), [target, concurrent, ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record("metadata", F.concat(main, F.lit(":metadata")), [target, concurrent, ("Content-Type", "application/warc-fields")], F.concat(F.lit("payloadLength: "), F.octet_length("payload").cast("string"), F.lit("\r\n")))
    records = F.array(request, F.when(F.col("chief").isNull(), response).otherwise(revisit), metadata)
    rows.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", min(per_file, 100_000)).mode("overwrite").text(path)


_END = b"\r\n\r\n"


def _unpacked(data: bytes, step: int) -> Iterator[bytes]:
    """The bytes of an archive, gzip members one after another, in parts of about ``step``; damage ends it."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[k : k + step] for k in range(0, len(data), step))
        return
    while data[:2] == b"\x1f\x8b":
        member, rest = zlib.decompressobj(31), data
        while not member.eof:
            try:
                part = member.decompress(rest, step)
            except zlib.error:
                return
            rest = member.unconsumed_tail
            if part:
                yield part
            elif not rest and not member.eof:
                return  # cut off
        data = member.unused_data


def parse(data: bytes, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-cased name, block) of each record of an archive; what is held is one record and ``step`` bytes."""
    parts, held, ended = _unpacked(data, step), bytearray(), False

    def more() -> bool:
        nonlocal ended
        part = next(parts, b"")
        held.extend(part)
        ended = not part
        return not ended

    while True:
        while (begin := held.find(b"WARC/")) < 0:
            del held[: max(len(held) - 4, 0)]
            if not more():
                return
        del held[:begin]
        while (end := held.find(_END)) < 0:
            if not more():
                return
        headers = {}
        for line in bytes(held[:end]).split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "0")
        size = int(size) if re.fullmatch(r"\d+", size, re.A) else 0
        start = end + len(_END)
        while len(held) < start + size and more():
            pass
        yield headers, bytes(held[start : start + size])
        del held[: start + size]


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _hex(value: str | None) -> str | None:
    """A SHA-1 digest header as bare lower-case hex, whether written in hex or base 32."""
    text = value.partition(":")[2] if value and value.lower().startswith("sha1:") else None
    if text and len(text) == 32:
        try:
            return base64.b32decode(text.upper()).hex()
        except ValueError:
            return None
    return text.lower() if text else None


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, digest string, payload_length long, payload binary, fields map<string,string>"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives below ``path``. ``digest`` and ``payload_length`` are of the payload as stored (the HTTP
    body where the block is an HTTP message), for revisits the stated digest and no length. ``payloads`` false leaves payloads out."""
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for data in batch.column(0):
                out: list[tuple] = []
                held = 0
                for h, block in parse(data.as_py()):
                    kind = h.get("warc-type")
                    body = block
                    if h.get("content-type", "").startswith("application/http"):
                        body = block.partition(_END)[2]
                    fields = {}
                    if h.get("content-type") == "application/warc-fields":
                        fields = dict(tuple(y.strip() for y in x.split(":", 1)) for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x)
                    own = kind != "revisit"
                    digest = hashlib.sha1(body).hexdigest() if own else _hex(h.get("warc-payload-digest"))
                    out.append((_bare(h.get("warc-record-id")), kind, _bare(h.get("warc-concurrent-to")), _bare(h.get("warc-refers-to")), h.get("warc-target-uri"), h.get("warc-date"), digest, len(body) if own else None, body if payloads else None, list(fields.items())))
                    held += len(body) * payloads
                    if held > 8 << 20 or len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(lean(run), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """A nested row per capture: ``capture_id``, ``request``, ``capture`` (the response or revisit) and ``metadata`` (an array).

    Records meet by the record that they are concurrent to, or by their own name. Of several requests or responses of
    one capture the one with the smallest record id is taken; captures without a request, response or metadata have
    null, or an empty array, there. Records without an identifier are left out.
    """
    rows = records.select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), F.struct(*records.columns).alias("r")).filter("capture_id is not null")
    one = lambda *kinds: F.min_by("r", F.when(F.col("r.type").isin(*kinds), F.col("r.record_id")))
    is_kind = lambda *kinds: F.max(F.col("r.type").isin(*kinds))
    found = rows.groupBy("capture_id").agg(
        F.when(is_kind("request"), one("request")).alias("request"),
        F.when(is_kind("response", "revisit"), one("response", "revisit")).alias("capture"),
        F.collect_list(F.when(F.col("r.type") == "metadata", F.col("r"))).alias("metadata"),
    )
    return found


def captures(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes archives of ``df``, reads them back and assembles them: ``page_id, payload_bytes, payload_digest, record_type, refers_to``,
    and then ``capture_id, request, capture, metadata``, the nested records (without payloads, dates and other fields, which ``read`` gives).

    A row per row: null ids, repeated rows and repeated ids with other payloads included; see ``write``. Null payloads are empty; an
    empty table gives an empty result; other columns are not read, whatever their names; a very long payload is one record.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/warc"
    write(df, path, id_col, url_col, payload_col)
    page = lambda name: F.regexp_extract(name, r"^urn:page:(-?\d+):", 1)
    number = lambda name: F.nullif(page(name), F.lit("")).cast("long")
    records = read(spark, path, payloads=False).withColumn("stated_length", F.col("fields")["payloadLength"].cast("long"))
    found = transactions(records.drop("payload", "date", "fields"))
    stated = F.get("metadata", F.lit(0))["stated_length"]
    return found.select(
        number(F.coalesce(F.col("request.concurrent_to"), "capture_id")).alias("page_id"),
        F.coalesce(F.col("capture.payload_length"), stated).alias("payload_bytes"),
        F.col("capture.digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.when(F.col("capture.type") == "revisit", number(F.col("capture.refers_to"))).alias("refers_to"),
        "capture_id",
        "request",
        "capture",
        "metadata",
    )

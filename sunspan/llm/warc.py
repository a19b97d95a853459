"""WARC as a content-addressed archive.

An archive is a folder of two Parquet tables: ``payloads`` holds each payload once by its SHA-256, verified when it is
read, and ``headers`` holds the exact header bytes of every record with the digest of its payload. Original records
come back through a join of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: ten hex digits are eight base32 digits, four times."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_FROM, BASE32_TO)


def _record_id(page: Column, sha256: Column) -> Column:
    """A name-based identifier of the record of a page with a payload: equal pages have equal ones."""
    h = F.sha2(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("null")), sha256), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12))


def header_field(name: str, header: str = "header") -> Column:
    """The value of a named field of the header bytes; null where the header is null or has none, of several the first."""
    found = F.regexp_extract(F.col(header).cast("string"), rf"\r\n(?i:{name}): ([^\r]*)", 1)
    return F.when(F.col(header).cast("string").rlike(rf"\r\n(?i:{name}): "), found)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> None:
    """Writes a record per row of ``pages``.

    Of the records with equal payloads of at least ``least_bytes`` bytes, that with the smallest id is the response
    and the others revisit it; smaller payloads are all responses. Null bodies are empty payloads, null addresses
    empty strings; rows that repeat the smallest id are responses too, and a null id is never the smallest. Very long
    bodies are one payload each. Other columns of the table are not archived. An empty table gives an archive without
    records.
    """
    body = F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.regexp_replace(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"[\r\n]", "%0A").alias("url"),
        body.alias("payload"),
        F.sha2(body, 256).alias("sha256"),
    )
    one = rows.groupBy("sha256").agg(
        F.first("payload").alias("payload"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("response"),
        F.min(F.octet_length("payload")).alias("least"), F.max(F.octet_length("payload")).alias("most"),
    )
    same = F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(F.raise_error(F.lit("payloads of one digest differ")).cast("binary"))
    one.select("sha256", same.alias("payload"), "response").write.option("compression", "zstd").parquet(f"{path}/payloads")

    store = pages.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "response")
    size = F.octet_length("payload").cast("long")
    narrow = rows.select("id", "url", "sha256", size.alias("n"), sha1_base32(F.col("payload")).alias("sha1"))
    joined = narrow.join(store, "sha256", "left")
    revisit = (F.col("n") >= least_bytes) & F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response.id"))
    refers = F.concat(
        F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <"), _record_id(F.col("response.id"), F.col("sha256")),
        F.lit(">\r\nWARC-Refers-To-Target-URI: "), F.col("response.url"), F.lit(f"\r\nWARC-Refers-To-Date: {EPOCH}"),
    )
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <"), _record_id(F.col("id"), F.col("sha256")),
        F.lit(f">\r\nWARC-Date: {EPOCH}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(F.col("revisit"), refers).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("n").cast("string")), F.lit("\r\n\r\n"),
    )
    headers = joined.withColumn("revisit", revisit).select("id", "sha256", lines.cast("binary").alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """id, sha256, the exact header bytes of every record, and what is parsed from these.

    Parsed are record_id, url, record_type, refers_id (the record that a revisit refers to, else null), digest and
    length (of the record's own block). An archive without records gives no row; each record is a row, repeated ids too.
    """
    identifier = lambda name: F.regexp_extract(header_field(name), "<(.*)>", 1)
    return spark.read.parquet(f"{path}/headers").select(
        "id", "sha256", "header", identifier("WARC-Record-ID").alias("record_id"), header_field("WARC-Target-URI").alias("url"),
        header_field("WARC-Type").alias("record_type"), identifier("WARC-Refers-To").alias("refers_id"),
        F.regexp_replace(header_field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), header_field("Content-Length").cast("long").alias("length"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload, payload_bytes and payload_digest; a payload that does not match its sha256 raises.

    Each payload is one row whatever its length, an empty one too; an archive without records gives no row.
    """
    found = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    return found.select("sha256", checked.alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))


def read_records(spark: SparkSession, path: str, full_revisits: bool = False) -> DataFrame:
    """The original records: what read_headers() gives, refers_to, payload_bytes, payload_digest, payload and record.

    record holds the bytes of a record as a WARC file has them: header, block and two line ends. refers_to is the id
    of the page whose response a revisit refers to. A revisit's own block is empty; with ``full_revisits`` its payload
    column holds the payload that it refers to. A record raises an error where its payload is missing, does not match
    the digest in its header, or has another length, and a revisit where its response is missing. Payloads are
    digested once each, however many records share them.
    """
    headers = read_headers(spark, path)
    responses = headers.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.min("id").alias("refers_to"))
    rows = headers.join(read_payloads(spark, path), "sha256", "left")
    revisits = rows.where("record_type = 'revisit'").join(responses, "refers_id", "left")
    rows = rows.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast(responses.schema["refers_to"].dataType)).unionByName(revisits)
    response = F.col("record_type") == "response"
    wrong = F.col("payload").isNull() | (F.col("digest") != F.col("payload_digest")) | (F.col("length") != F.when(response, F.col("payload_bytes")).otherwise(0))
    wrong = wrong | (~response & F.col("refers_to").isNull())
    block = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    record = F.when(wrong, F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))).cast("binary")).otherwise(F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")))
    return rows.withColumn("record", record).withColumn("payload", F.col("payload") if full_revisits else block)

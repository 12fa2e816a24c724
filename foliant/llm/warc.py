"""WARC as a content-addressed archive: payload bytes once by verified digest, exact record headers apart, records by joins.

An archive is a folder with two tables. payloads: (digest, n_bytes, payload), each distinct payload once, under its
SHA-256. headers: (page_id, digest, http, header), the exact bytes of each record's WARC and HTTP headers. A record is
header + http + payload + CRLF CRLF; a revisit has no block. read_records() joins them back to whole records and
parse_records() reads those as any WARC reader would; the digest of every payload read is compared with its address.

Of equal payloads of at least min_bytes, the row of the smallest page_id is the response and the others revisit it;
smaller payloads are all responses. The owner of each digest is a pre-aggregated minimum. Only DataFrame functions.

Defined results: null html is an empty payload. Rows that repeat the smallest page_id with the same payload are all
responses. A null page_id sorts after every other; where all are null, all are responses. Null urls leave out the
header. Line ends in a url are percent-encoded. An empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import picked, scratch, written

MIN_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _uri(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _line(name: str, *value: Column | str) -> Column:
    """A header line, or null if its value is null."""
    return F.concat(F.lit(f"{name}: "), *[F.lit(v) if isinstance(v, str) else v.cast("string") for v in value], F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write the archive of pages to path."""
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), "UTF-8")
    base = picked(pages, id_col, url_col, payload_col).select(F.col(f"`{id_col}`").alias("page_id"), _uri(F.col(f"`{url_col}`").cast("string")).alias("url"), payload.alias("payload"))
    base = base.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})

    once = base.select("digest", "n_bytes", "payload").groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("payload").alias("payload"))
    once.write.parquet(f"{path}/payloads", compression="zstd")

    rows = base.drop("payload")
    owners = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1 and owner is not null")
    owners = written(owners.select("digest", "owner"), "owners")  # so that the rows of a digest with many copies can be split
    joined = rows.join(owners, "digest", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    http = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2)))
    typed = joined.withColumns({"revisit": revisit, "http": http})
    length = F.when(F.col("revisit"), F.lit(0)).otherwise(F.octet_length("http") + F.col("n_bytes"))
    header = F.concat_ws(
        "",
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", "<urn:page:", F.coalesce(F.col("page_id").cast("string"), F.lit("")), ">"),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", "sha256:", F.col("digest")),
        F.when(F.col("revisit"), _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("revisit"), _line("WARC-Refers-To", "<urn:page:", F.col("owner"), ">")),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", length),
        F.lit(CRLF),
    )
    typed.select("page_id", "digest", "http", header.alias("header")).write.parquet(f"{path}/headers", compression="zstd")


def _field(name: str, pattern: str = "([^\r\n]*)") -> Column:
    return F.nullif(F.regexp_extract("header", f"\r\n{name}: {pattern}\r\n", 1), F.lit(""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the exact bytes of each record. A payload that is missing or doesn't have its digest raises an error."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    joined = headers.where("http <> ''").join(payloads, "digest", "left")
    sound = F.sha2("payload", 256) == F.col("digest")
    payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload missing or damaged: "), F.col("digest"))).cast("binary"))
    end = F.lit((CRLF * 2).encode())
    whole = joined.select(F.concat(F.encode("header", "UTF-8"), F.encode("http", "UTF-8"), payload, end).alias("record"))
    return whole.unionByName(headers.where("http = ''").select(F.concat(F.encode("header", "UTF-8"), end).alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """(record_id, uri, record_type, refers_to, digest, payload) read from the bytes of WARC records."""
    text = F.decode("record", "UTF-8")
    parts = records.select("record", F.concat(F.substring_index(text, CRLF * 2, 1), F.lit(CRLF)).alias("header"), F.octet_length(F.substring_index(text, CRLF * 2, 1)).alias("at"), F.octet_length(F.substring_index(text, CRLF * 2, 2)).alias("body"))
    kind = _field("WARC-Type")
    length = _field("Content-Length").cast("int")
    payload = F.when(kind == "revisit", F.lit(None).cast("binary")).otherwise(F.substring(F.col("record"), F.col("body") + 5, F.col("at") + 4 + length - F.col("body") - 4))
    return parts.select(_field("WARC-Record-ID", "<urn:page:([^\r\n]*)>").alias("record_id"), _field("WARC-Target-URI").alias("uri"), kind.alias("record_type"), _field("WARC-Refers-To", "<urn:page:([^\r\n]*)>").alias("refers_to"), _field("WARC-Payload-Digest", "sha256:([0-9a-f]*)").alias("digest"), payload.alias("payload"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the whole records; a revisit's payload is that of the address it names."""
    read = parse_records(read_records(spark, path)).select(F.col("record_id").cast("long").alias("page_id"), "record_type", F.col("refers_to").cast("long").alias("refers_to"), "digest", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("actual"))
    stored = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("address"), "n_bytes")
    revisit = F.col("record_type") == "revisit"
    both = read.join(stored, revisit & (F.col("digest") == F.col("address")), "left")
    return both.select("page_id", F.when(revisit, F.col("n_bytes")).otherwise(F.col("n")).alias("payload_bytes"), F.when(revisit, F.col("address")).otherwise(F.col("actual")).alias("payload_digest"), "record_type", "refers_to")


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    path = f"{scratch(spark)}/foliant/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), o AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> owner THEN owner END AS refers_to
FROM o
"""

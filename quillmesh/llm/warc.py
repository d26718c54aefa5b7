"""Content-addressed web archive.

Payload bytes are stored once, under their SHA-256, verified by a second digest and the length when they are written
and by the first when they are read. Exact WARC record headers are a table of their own. Records come back byte for byte
by joining the two on the digest; what a query says of them is parsed from those bytes, and a revisit's payload is that of
the response it refers to.

A null html is the empty payload, and the empty payload is a payload like any other. Of records with equal payloads
the smallest page_id is the response and the others revisit it; payloads under `least_bytes` are all responses. A null
page_id sorts after all others: its record is a revisit unless every record of that payload lacks an id. Repeated
rows of the response's page_id are responses too. Other columns of pages are ignored. No pages, empty archive.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, skew_join

#: Fixed values of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: pages has no capture time.
DATE = "1970-01-01T00:00:00Z"


class Archive(NamedTuple):
    """headers: page_id, record_type, refers_to, sha256, header, http_header. store: sha256, payload."""

    headers: DataFrame
    store: DataFrame


def base32_sha1(payload: Column) -> Column:
    """20 bits, 5 hexadecimal digits, are 4 letters; the 160 bits need no padding."""
    hexed = F.sha1(payload)
    letters = []
    for k in range(8):
        v = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def archive(pages: DataFrame, least_bytes: int = 0, date: str = DATE) -> Archive:
    """Write pages (page_id, url, html) as an archive in the shared folder."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    facts = pages.select("page_id", "url", payload.alias("payload"))
    facts = facts.withColumns({"sha256": F.sha2("payload", 256), "sha1": base32_sha1(F.col("payload")), "n": F.octet_length("payload").cast("long")})
    # One row for each payload and map task is shuffled, however often it occurs.
    same = F.first("payload").alias("payload"), F.min("sha1").alias("a"), F.max("sha1").alias("b"), F.min("n").alias("c"), F.max("n").alias("d")
    verified = F.when((F.col("a") == F.col("b")) & (F.col("c") == F.col("d")), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256")))
    store = cut(facts.groupBy("sha256").agg(*same).select("sha256", verified.alias("payload")), "payloads")

    narrow = facts.select("page_id", "url", "sha256", "sha1", "n")
    firsts = narrow.groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("many"))
    revisit = (F.col("n") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    told = skew_join(narrow, firsts, ["sha256"], "many").select("*", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))
    length = F.lit(len(HTTP_HEADER)) + F.when(revisit, 0).otherwise(F.col("n"))
    lines = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        # A line break inside a url would end its header line.
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
        F.lit("\r\n"),
    ]
    headers = told.select("page_id", "record_type", "refers_to", "sha256", F.concat_ws("\r\n", *lines).alias("header"), F.lit(HTTP_HEADER).alias("http_header"))
    return Archive(cut(headers, "headers"), store)


def read_store(store: DataFrame) -> DataFrame:
    """The stored payloads, each checked against its name."""
    good = F.sha2("payload", 256) == F.col("sha256")
    return store.select("sha256", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))).alias("payload"))


def records(a: Archive) -> DataFrame:
    """The original WARC records, byte for byte: page_id, record. Revisits carry no payload and need no join."""
    end, text = F.encode(F.lit("\r\n\r\n"), "UTF-8"), F.encode(F.concat("header", "http_header"), "UTF-8")
    full = a.headers.where("record_type = 'response'").join(read_store(a.store), "sha256").select("page_id", F.concat(text, "payload", end).alias("record"))
    return full.unionByName(a.headers.where("record_type = 'revisit'").select("page_id", F.concat(text, end).alias("record")))


def payloads(a: Archive) -> DataFrame:
    """The full payload of every record, revisits resolved: page_id, payload."""
    return a.headers.join(read_store(a.store), "sha256").select("page_id", "payload")


def parsed(found: DataFrame) -> DataFrame:
    """What the bytes of records (record) say: ids and type from the header lines, length and digest from the payload itself."""
    head = lambda block: F.substring_index(block.cast("string"), "\r\n\r\n", 1)
    line = lambda name, value: F.regexp_extract("header", f"(?m)^{name}: {value}\r?$", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    rows = found.select(head(F.col("record")).alias("header"), "record")
    block = F.substring(F.col("record"), F.octet_length("header") + 5, line("Content-Length", "(\\d+)").cast("int"))
    rows = rows.select("header", block.alias("block"))
    payload = F.substring(F.col("block"), F.octet_length(head(F.col("block"))) + 5, F.octet_length("block"))
    said = rows.select(
        number(line("WARC-Record-ID", "<urn:page:(-?\\d*)>")).alias("page_id"),
        line("WARC-Type", "(\\w+)").alias("record_type"),
        number(line("WARC-Refers-To", "<urn:page:(-?\\d*)>")).alias("refers_to"),
        line("WARC-Payload-Digest", "sha1:(\\w+)").alias("said"),
        payload.alias("payload"),
    )
    return said.select("page_id", "record_type", "refers_to", "said", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def payload_facts(a: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every rebuilt record; revisits take the first two from their response."""
    rows = cut(parsed(records(a)), "parsed")
    wrong = F.raise_error(F.concat(F.lit("a payload does not match its record's digest: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = rows.where("record_type = 'response'").withColumn("payload_digest", F.when(F.col("said") == F.col("payload_digest"), F.col("payload_digest")).otherwise(wrong))
    again = rows.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "said")
    # A page_id may have several records; the digest tells which of them is meant.
    facts = responses.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), F.col("said")).agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    many = again.groupBy("refers_to", "said").agg(F.count(F.lit(1)).alias("many"))
    # A revisit whose response is missing would be lost here; its payload is lost, so that is an error.
    facts = many.join(facts, ["refers_to", "said"], "left").withColumn("payload_bytes", F.when(F.col("payload_bytes").isNull(), F.raise_error(F.lit("a revisit has no response"))).otherwise(F.col("payload_bytes")))
    return responses.select(columns).unionByName(skew_join(again, facts, ["refers_to", "said"], "many").select(columns))


def op3_warc_archive(spark, sf_dir: str) -> DataFrame:
    return payload_facts(archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hx, min(page_id) OVER (PARTITION BY sha256(html)) AS first_id FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hx, CAST(5 * (k // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""

"""A content-addressed WARC archive: payload bytes once by SHA-256, record headers exactly as written, records by join.

Tables under the archive's path: payloads (sha256, n_bytes, payload), one row a distinct payload, and headers (sha256,
has_block, warc_header, http_header), one row a record.  A record is its WARC header, the HTTP header and, for responses,
the payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import small, stash

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: eight groups of 20 bits, four letters each."""
    digest = F.sha1(data)
    letters = []
    for g in range(8):
        group = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(BASE32), F.shiftright(group, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row.

    Rows whose payloads are equal and have at least `min_bytes` bytes: the one with the largest key is a response, the
    others are revisits of it; a null key is smaller than any, and rows that tie for the largest are all responses.
    Smaller payloads are always responses.  A null payload is empty, a null url is an empty address.  Equality is by
    SHA-256, held against length and CRC-32: a clash fails the write.  An empty table writes empty tables.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    raw = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("b"))
    facts = raw.select("id", "url", F.sha2("b", 256).alias("sha256"), base32_sha1(F.col("b")).alias("sha1"), F.octet_length("b").cast("long").alias("n_bytes"), F.crc32("b").alias("crc"))
    rows = stash(facts, "warc-rows")
    groups = rows.groupBy("sha256").agg(F.max("id").alias("response"), *[f(c).alias(f"{n}_{c}") for c in ("n_bytes", "crc") for n, f in (("lo", F.min), ("hi", F.max))])
    clash = (F.col("lo_n_bytes") != F.col("hi_n_bytes")) | (F.col("lo_crc") != F.col("hi_crc"))
    firsts = stash(groups.select("sha256", F.when(clash, F.raise_error(F.concat(F.lit("unequal payloads of digest "), "sha256"))).otherwise(F.col("response")).cast("long").alias("response")), "warc-firsts")
    count, ids = firsts.count(), rows.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    named = rows.join(small(firsts, count), "sha256")
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("response"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = F.regexp_replace("url", r"[\r\n]", "")
    with_http = named.withColumn("http", http).withColumn("revisit", revisit)
    length = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("n_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn(F.col("response"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit("\r\n"),
    )
    with_http.select("sha256", (~F.col("revisit")).alias("has_block"), F.encode(header, "UTF-8").alias("warc_header"), F.encode("http", "UTF-8").alias("http_header")).write.parquet(f"{path}/headers")
    bodies = raw.select("id", F.sha2("b", 256).alias("sha256"), "b")
    once = bodies.join(small(firsts, count), (bodies["sha256"] == firsts["sha256"]) & F.col("id").eqNullSafe(F.col("response"))).select(bodies["sha256"], F.octet_length("b").cast("long").alias("n_bytes"), F.col("b").alias("payload"))
    if ids[0] != ids[1]:  # a key that repeats may store its payload more than once
        once = once.dropDuplicates(["sha256"])
    once.write.parquet(f"{path}/payloads")


def archive_parts(spark: SparkSession, path: str, headers: DataFrame | None = None) -> DataFrame:
    """The headers of all records, or of those given, beside their payload (has_block: whether the payload belongs into the record)."""
    headers = spark.read.parquet(f"{path}/headers") if headers is None else headers
    return headers.join(spark.read.parquet(f"{path}/payloads"), "sha256")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): every record's bytes as a WARC file has them, with the two line ends that close it."""
    headers = spark.read.parquet(f"{path}/headers")
    whole = archive_parts(spark, path, headers.filter("has_block")).select(F.concat("warc_header", "http_header", "payload", F.lit(b"\r\n\r\n")).alias("record"))
    return whole.unionByName(headers.filter("not has_block").select(F.concat("warc_header", "http_header", F.lit(b"\r\n\r\n")).alias("record")))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields by lower-case name, the HTTP header and the payload of one record; ValueError when its length is wrong."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length is not what its header says")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return fields, http, payload


def _page(urn: str) -> int | None:
    name = urn.rpartition(":")[2].rstrip(">")
    return None if name == "null" else int(name)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record, rebuilt and parsed.

    Responses are rebuilt with their payload, which is held against both digests; a damaged one fails.  A revisit has no
    payload of its own: it takes size and digest from the response of the same stored payload, so however many revisits
    a payload has, its bytes are read once.  A revisit whose payload no response has, or whose digest differs, fails.
    """
    schema = "sha256 string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    names = [x.split()[0] for x in schema.split(", ")]

    def row(sha256: str, record: bytes) -> tuple:
        fields, _, found = parse_record(record)
        refers = _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
        return sha256, _page(fields["warc-record-id"]), len(found), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], refers, fields["warc-target-uri"], found

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([x[:7] for x in rows], columns=names)
        for at, c in ((1, "page_id"), (5, "refers_to")):
            out[c] = pd.array([x[at] for x in rows], "Int64")
        return out

    def responses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row(h, b"".join((warc, http, payload, b"\r\n\r\n"))) for h, warc, http, payload in zip(batch["sha256"], batch["warc_header"], batch["http_header"], batch["payload"], strict=True)]
            for sha256, _, _, digest, *_, found in rows:
                if hashlib.sha256(found).hexdigest() != sha256 or base64.b32encode(hashlib.sha1(found).digest()).decode() != digest:
                    raise ValueError(f"damaged payload {sha256}")
            yield frame(rows)

    def revisits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield frame([row(h, b"".join((warc, http, b"\r\n\r\n"))) for h, warc, http in zip(batch["sha256"], batch["warc_header"], batch["http_header"], strict=True)])

    headers = spark.read.parquet(f"{path}/headers")
    own = stash(archive_parts(spark, path, headers.filter("has_block")).select("sha256", "warc_header", "http_header", "payload").mapInPandas(responses, schema), "warc-responses")
    facts = own.select("sha256", F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("__digest")).dropDuplicates(["sha256"])
    others = headers.filter("not has_block").select("sha256", "warc_header", "http_header").mapInPandas(revisits, schema).join(facts, "sha256", "left")
    sound = F.when(F.col("__digest") == F.col("payload_digest"), F.col("__bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256")).cast("long"))
    return own.drop("sha256").unionByName(others.withColumn("payload_bytes", sound).select(*names[1:]))

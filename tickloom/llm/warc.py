"""Content-addressed WARC archive.

Writing: every page becomes a WARC record.  Its header block is kept exactly,
in one table, with the strong digest (SHA-256) of its payload; the payload
bytes are kept once per digest, in another.  Reading: headers join payloads by
digest, the payload is hashed again and held against its address, and header
plus block are the record again, byte for byte: the block of a response is its
payload, that of a revisit is empty (profile identical-payload-digest), and
its payload is the joined one.  What is reported of a record is parsed from
those bytes.

Spark does all of it with built-in expressions.  The choice of the record that
carries a payload is a partially aggregated minimum per digest, so a payload
that a third of all pages share costs one row per task; the joins that follow
have one row per digest on one side and are split by adaptive execution.

Defined results: null html is the empty payload, which is shared like any
other; pages with a null page_id are archived (their record id is empty) and
lose to any other page as carrier of a payload; repeated page_ids stay
separate records; a null url leaves the target header empty; other columns are
ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table

#: Fixed values of WARC: RFC 4648 base32 digits, and those conv() writes.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
LEAST_SHARED_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits as four times 40 bits of eight digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), CONV32, BASE32)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, least_bytes: int = LEAST_SHARED_BYTES) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), lazily.

    headers: page_id, address, header (string); payloads: address, payload
    (binary), one row per address.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select("page_id", "url", payload.alias("payload"))
    described = base.select(
        "page_id", "url", F.sha2("payload", 256).alias("address"), F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1")
    )
    carriers = described.groupBy("address").agg(F.min("page_id").alias("carrier"))
    known = described.join(carriers, "address")
    revisit = (F.col("n_bytes") >= least_bytes) & F.col("carrier").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("carrier"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("carrier"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    headers = known.select("page_id", "address", header.alias("header"))
    payloads = base.select(F.sha2("payload", 256).alias("address"), "payload").groupBy("address").agg(F.first("payload").alias("payload"))
    return headers, payloads


def write_archive(pages: DataFrame, place: Workspace, least_bytes: int = LEAST_SHARED_BYTES) -> Workspace:
    headers, payloads = records(pages, least_bytes)
    place.write(headers, "headers")
    place.write(payloads, "payloads")
    return place


def read_archive(place: Workspace) -> DataFrame:
    """page_id, record (binary: the WARC record) and payload (binary: the full one, also of a revisit).

    Fails on a payload that does not have the digest by which it is kept, and
    on a header whose payload is missing.
    """
    joined = place.read("headers").join(place.read("payloads"), "address", "left")
    sound = F.sha2("payload", 256) == F.col("address")
    payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("archive: no sound payload at "), F.col("address"))).cast("binary"))
    read = joined.select("page_id", "header", payload.alias("payload"))
    block = F.when(F.col("header").contains("\r\nWARC-Type: revisit\r\n"), F.lit("").cast("binary")).otherwise(F.col("payload"))
    return read.select("page_id", F.concat(F.encode("header", "UTF-8"), block, F.lit(END).cast("binary")).alias("record"), "payload")


def parse_records(archive: DataFrame) -> DataFrame:
    """What the bytes of the records say of themselves.

    The payload is cut out of a response's bytes by its Content-Length, that of
    a revisit is the joined one; its digest is held against the header's."""
    # Latin-1 has a character for each byte, so that a place in it is a place in the bytes.
    end = F.instr(F.decode("record", "ISO-8859-1"), END)
    cut = archive.select("record", F.col("payload").alias("full"), end.alias("end")).withColumn("header", F.decode(F.substring("record", F.lit(1), F.col("end") + 3), "UTF-8"))
    length = F.regexp_extract("header", r"\r\nContent-Length: ([0-9]+)\r\n", 1).cast("int")
    whole = F.octet_length("record") == F.col("end") + 3 + length + len(END)
    block = F.when(whole, F.substring("record", F.col("end") + 4, length)).otherwise(F.raise_error(F.lit("archive: a record has another length than it says")).cast("binary"))
    revisit = F.col("header").contains("\r\nWARC-Type: revisit\r\n")
    archive = cut.select("header", F.when(revisit, F.col("full")).otherwise(block).alias("payload"))

    def field(name: str) -> Column:
        value = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
        return F.when(value != "", value)

    id_in = r"^<urn:page:(.*)>$"
    read = archive.select(
        F.regexp_extract(field("WARC-Record-ID"), id_in, 1).alias("own"), field("WARC-Type").alias("record_type"), field("WARC-Payload-Digest").alias("said"),
        F.regexp_extract(field("WARC-Refers-To"), id_in, 1).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    agrees = F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    return read.select(
        F.when(F.col("own") != "", F.col("own")).cast("long").alias("page_id"),
        "payload_bytes",
        F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.lit("archive: header and payload disagree"))).alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to") != "", F.col("refers_to")).cast("long").alias("refers_to"),
    )


def op3_warc(spark, sf_dir: str) -> DataFrame:
    place = write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), Workspace(spark, "warc"))
    return parse_records(read_archive(place))


OP3_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, h,
         list_reduce(list_transform(range(4), lambda k: list_reduce(list_transform(range(8), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * k AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * i AS INTEGER)) & 31) AS INTEGER), 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS carrier
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = carrier THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> carrier THEN carrier END AS refers_to
FROM d
"""

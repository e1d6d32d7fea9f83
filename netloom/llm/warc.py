r"""WARC records in a content-addressed archive.

The archive is two tables in one folder. `payloads` holds the bytes of each distinct payload once, under the SHA-256
digest that names it. `headers` holds, for each record, the exact bytes of its WARC header and of the HTTP header that
precedes the payload, and the digest. A record is its headers joined to its payload; a revisit record has no payload of
its own, as in WARC 1.1, but its digest still leads to the bytes.

Equal payloads of at least `least_bytes` are written as one response, the one with the largest identifier, and revisits
that refer to it. Reading verifies every payload: the digest is computed again from the stored bytes, and a row whose
bytes do not give the digest, or that is missing, is an error. Equality itself rests on SHA-256 alone.

All of it runs as column expressions. Payloads are reduced to one for each digest before they are written, in each map
task first, and the largest identifier of a digest is found by a partial aggregation, so a hot payload is no hot task;
the join back is on narrow rows and left to Spark's skew handling.

Defined results: null html is an empty payload; a null identifier sorts below all others and is written as an empty
record name; of repeated rows with equal identifiers and payloads one is the response (each row is a record, and all
with the largest identifier are responses); an empty table gives empty tables; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import work_path

#: Fixed values of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"


def _record_name(doc: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(doc.cast("string"), F.lit("")), F.lit(">"))


def write_archive(df: DataFrame, folder: str | None = None, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes a record for each row of df below `folder` (default: a new one in the shared folder); returns the folder."""
    spark = df.sparkSession
    folder = folder or work_path(spark, "archive")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = df.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    named = base.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    # A payload of no bytes needs no row: it is known from its header.
    named.filter("bytes > 0").select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{folder}/payloads")

    narrow = base.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    first = narrow.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.max(F.struct("page_id", "url"))["url"].alias("response_url"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    r = narrow.join(first.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    # Line ends inside an address would end its header line.
    url = F.regexp_replace("url", r"[\r\n]", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_name(F.col("response_id")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.regexp_replace("response_url", r"[\r\n]", "%0A"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    header = F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2))
    r.select(header.cast("binary").alias("header"), http.cast("binary").alias("http"), "digest").write.parquet(f"{folder}/headers")
    return folder


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record, from the archive alone: page_id, url, record_type, refers_to, payload_digest, payload,
    record (its exact bytes). Damaged or missing payloads raise an error."""
    headers = spark.read.schema("header binary, http binary, digest string").parquet(f"{folder}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads").withColumnRenamed("digest", "stored")
    empty = F.sha2(F.lit(""), 256)
    rows = headers.join(payloads, F.col("digest") == F.col("stored"), "left")
    payload = F.coalesce("payload", F.lit("").cast("binary"))
    right = (F.sha2(payload, 256) == F.col("digest")) & (F.col("stored").isNotNull() | (F.col("digest") == empty))
    checked = F.when(right, payload).otherwise(F.raise_error(F.concat(F.lit("payload damaged or missing: "), F.col("digest"))).cast("binary"))
    rows = rows.select("header", "http", checked.alias("payload"))
    kind = _field("WARC-Type")
    number = F.nullif(F.regexp_extract(_field("WARC-Record-ID"), r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    refers = F.nullif(F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    body = F.when(kind == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    record = F.concat(F.col("header"), F.col("http"), body, F.lit(_CRLF * 2).cast("binary"))
    return rows.select(number.alias("page_id"), _field("WARC-Target-URI").alias("url"), kind.alias("record_type"), refers.alias("refers_to"), F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("payload_digest"), "payload", record.alias("record"))


def digests(records: DataFrame) -> DataFrame:
    """What the query returns of records that were read back: the payload's own length and digest, not the header's."""
    own = F.sha1("payload")
    checked = F.when(own == F.col("payload_digest"), own).otherwise(F.raise_error(F.lit("digest in the header differs from the payload")).cast("string"))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")

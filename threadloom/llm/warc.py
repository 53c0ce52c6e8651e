"""Content-addressed WARC archive.

An archive is two tables. `payloads` holds each payload's bytes once under its
address, the SHA-256 of the bytes; `headers` holds the exact header bytes of
every record (WARC header and HTTP header), its number and the address.
Joining both on the address gives the original records back, byte for byte.

A stored payload is verified twice: equal addresses must come with equal length
and SHA-1 before they share bytes, and on reading, the address is computed anew
from the bytes that were stored.

Of records with equal payloads of at least `REVISIT_BYTES` bytes the one with
the largest id is a response and the others revisit it; smaller payloads are
stored once too, but all their records are responses.

Defined results: a null payload counts as empty; a record with a null id is
never chosen over one with an id, and if all ids of a group are null all are
responses; rows that share the largest id are all responses (nothing refers to
a row that can't be told from another); a null url leaves the field out, line
ends in a url are percent-encoded; other columns are not read; an empty table
gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .registry import query, table

REVISIT_BYTES = 1000
CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _record_id(id_col: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(id_col.cast("string"), F.lit("none")), F.lit(">"))


def _http_header(length: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _line("Content-Length", length), F.lit(CRLF))


def headers_of(pages: DataFrame, id_col: str, url: str, html: str, date: str) -> DataFrame:
    """`record`, `address`, `stored` (its row is the one whose bytes are kept) and `header`, the exact bytes.

    The bodies are read once for their digests; only narrow rows are shuffled.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    narrow = pages.select(
        F.col(id_col).alias("record"),
        F.regexp_replace(F.regexp_replace(F.col(url).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.sha2(body, 256).alias("address"), F.sha1(body).alias("sha1"), F.length(body).cast("long").alias("bytes"),
    )
    same = ["address", "sha1", "bytes"]
    newest = narrow.groupBy(*same).agg(F.max("record").alias("newest"))
    joined = narrow.join(newest, same)
    revisits = (F.col("bytes") >= REVISIT_BYTES) & F.col("newest").isNotNull() & ~F.col("record").eqNullSafe(F.col("newest"))
    http = _http_header(F.col("bytes"))
    block = F.when(revisits, F.length(http)).otherwise(F.length(http) + F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisits, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("record"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisits, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(revisits, _line("WARC-Refers-To", _record_id(F.col("newest")))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block),
        F.lit(CRLF), http,
    )
    return joined.select("record", "address", header.cast("binary").alias("header"))


def payloads_of(pages: DataFrame, html: str) -> DataFrame:
    """`address` and `payload`, one row for each distinct payload."""
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    # A task keeps one payload of each address before the shuffle, so a hot one moves once per task.
    return pages.select(F.sha2(body, 256).alias("address"), body.alias("payload")).dropDuplicates(["address"])


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write `<path>/headers` and `<path>/payloads`; `date` is the capture date of the crawl."""
    headers_of(pages, id_col, url, html, date).write.option("compression", "zstd").parquet(f"{path}/headers")
    payloads_of(pages, html).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(name: str) -> Column:
    """Value of a header line, null where there is none."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each record, checked against the stored payload.

    `record`, `url`, `payload_bytes`, `payload_digest`, `record_type`,
    `refers_to`. Length and digest come from the stored bytes; if these do not
    hash to their address, or differ from the record's header, reading fails.
    Payloads are digested where they lie; only digests are joined, and a hot
    address is skewed on the header side alone, which adaptive joins split.
    """
    stored = spark.read.parquet(f"{path}/payloads").select("address", F.sha2("payload", 256).alias("found"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("bytes"))
    headers = spark.read.parquet(f"{path}/headers")
    joined = headers.join(stored, "address", "left")
    digest = F.substring_index(_field("WARC-Payload-Digest"), ":", -1)
    sound = F.col("found").eqNullSafe(F.col("address")) & F.col("sha1").eqNullSafe(digest)
    return joined.select(
        "record",
        _field("WARC-Target-URI").alias("url"),
        F.when(sound, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "address"))).alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Refers-To"), "<urn:record:(.*)>", 1).alias("refers_to"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """`record` and `bytes`, the original records in full: header, payload unless revisited, closing line ends."""
    payloads = spark.read.parquet(f"{path}/payloads")
    headers = spark.read.parquet(f"{path}/headers")
    own = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    # Revisits need no bytes: they do not take part in the join.
    address = F.when(_field("WARC-Type") == "response", F.col("address"))
    joined = headers.withColumn("address", address).join(payloads, "address", "left")
    return joined.select("record", F.concat(F.col("header"), own, F.lit(f"{CRLF}{CRLF}".encode())).alias("bytes"))


def export_warc(spark: SparkSession, path: str, target: str, compression: str = "none") -> None:
    """Standard WARC files below `target`, written by Spark's text writer on whatever store `target` names.

    Records end in two line ends; the writer adds the second one.
    """
    records = read_records(spark, path)
    lines = records.select(F.expr(f"substring(bytes, 1, length(bytes) - {len(CRLF)})").cast("string").alias("value"))
    lines.write.option("lineSep", CRLF).option("compression", compression).text(target)


_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
q as (select page_id, strlen(h) payload_bytes, sha1(h) payload_digest, max(page_id) over (partition by h) newest from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> newest then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 1000 and page_id <> newest then newest end refers_to
from q
"""


@query("op9_warc_archive", _SQL)
def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to an archive and read back."""
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_index(spark, path).select(F.col("record").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))

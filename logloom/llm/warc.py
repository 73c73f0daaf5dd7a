"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit of an earlier response with the
same payload) and metadata. Each is a record of its own that names the response
as concurrent; :func:`assembled` joins the three again and gives one nested row per
capture.

*Writing* uses Spark's text writer with a line end of its own: a record is one row,
all built-in expressions, so payloads never leave the JVM and a lost task's files
are written anew. Payload bytes go out unchanged. *Reading* splits files at the
version line that begins each record. A payload that holds this line itself is
sent chunked, with a chunk's end inside the line, so that no payload can be taken
for a record; the reader joins the chunks.

*Revisits.* Of captures with equal payloads (by SHA-1) of at least ``min_bytes``,
that with the smallest ``page_id`` is the response. Digests are counted before the
pages meet them, only those met more than once are joined, and both sides are
salted, so a payload that a third of all pages share is spread over tasks.

Defined results: a null payload is empty; a null URL is written as ``urn:none``;
rows that repeat a page are captures of their own, of which only the first of the
smallest id is the response; a null id sorts after all others; line ends and
other control characters in a URL are escaped; an empty table gives no records.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import replaced

VERSION = "WARC/1.1"
_MARK = f"{VERSION}\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Parts over which a payload shared by many pages is spread.
SALTS = 64
#: Fixed value: digits of base 32 in values and in RFC 4648.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: each 10 hexadecimal digits make 8."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in range(1, 41, 10)]
    return F.translate(F.upper(F.concat(*parts)), _DIGITS, _BASE32)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, record_id, refers_to_id`` (null for responses)."""
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    digest = base32_sha1(F.col("payload"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    page = page.withColumns({"digest": digest, "salt": salt})
    shared = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).where(F.octet_length("payload") >= min_bytes).groupBy(base32_sha1(F.col("payload")).alias("digest")).agg(
        F.min("page_id").alias("first"), F.count("*").alias("copies")
    ).where("copies > 1")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = page.join(shared, ["digest", "salt"], "left")
    # Rows that repeat the first page; few, and of one salt.
    again = Window.partitionBy("digest", "salt", "page_id").orderBy(F.lit(0))
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    met = met.withColumn("_nth", F.when(F.col("copies").isNull(), 1).otherwise(F.row_number().over(again)))
    response = F.col("copies").isNull() | (is_first & (F.col("_nth") == 1))
    named = _uuid(F.lit("response"), F.col("digest"), F.col("first"))
    # Unshared payloads have one page or are too small to revisit; the row tells them apart.
    own = _uuid(F.lit("own"), F.col("digest"), F.col("page_id"), F.monotonically_increasing_id())
    return met.select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("copies").isNotNull() & response, named).otherwise(own).alias("record_id"),
        F.when(~response, named).alias("refers_to_id"),
    )


def _record(kind: Column, record_id: Column, url: Column, content: Column, block: Column, extra: Column) -> Column:
    head = F.concat(
        F.lit(f"{_MARK}WARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id,
        F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"), extra,
        F.lit("Content-Type: "), content, F.lit("\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    # The writer adds the second of the two line ends behind a block.
    return F.concat(head.cast("binary"), block, F.lit("\r\n").cast("binary"))


def _b(text: str) -> Column:
    return F.lit(text).cast("binary")


def records(found: DataFrame) -> DataFrame:
    """Three records (bytes as a string) for each capture."""
    plain_url = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20]", "%20"), r"WARC/1\.1$", "WARC%2F1.1")
    url = F.coalesce(plain_url, F.lit("urn:none"))
    # A line end follows the payload, so the version may also stand at its end.
    text = F.col("payload").cast("string")
    mark = (F.instr(text, _MARK) > 0) | text.endswith(VERSION)
    # Chunks: everything up to the middle of each version line, then the rest.
    half = len(VERSION) // 2
    chunk = lambda part: F.concat(
        F.lower(F.conv(F.octet_length(part).cast("string"), 10, 16)).cast("binary"), _b("\r\n"), part, _b("\r\n"))
    cut = rf"(?<={VERSION[:half]})(?={VERSION[half:]}(?:\r\n|\z))".replace("1.1", r"1\.1")
    pieces = F.split(text, cut, -1)
    chunked = F.aggregate(
        F.transform(F.filter(pieces, lambda p: p != ""), lambda p: chunk(p.cast("binary"))),
        F.lit("").cast("binary"), lambda acc, p: F.concat(acc, p), lambda acc: F.concat(acc, _b("0\r\n\r\n")))
    answer = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    plain = F.concat(_b(f"{answer}Content-Length: "), F.octet_length("payload").cast("string").cast("binary"),
                     _b("\r\n\r\n"), F.col("payload"))
    body = F.when(mark, F.concat(_b(f"{answer}Transfer-Encoding: chunked\r\n\r\n"), chunked)).otherwise(plain)
    revisit = F.col("refers_to_id").isNotNull()
    block = F.when(revisit, _b(f"{answer}\r\n")).otherwise(body)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"))
    refers = F.concat(digest, F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "),
                      F.col("refers_to_id"), F.lit("\r\n"))
    with_it = F.concat(F.lit("WARC-Concurrent-To: "), F.col("record_id"), F.lit("\r\n"))
    asked = F.concat(_b("GET "), url.cast("binary"), _b(" HTTP/1.1\r\n\r\n"))
    about = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    rows = F.array(
        _record(F.lit("request"), _uuid(F.lit("request"), F.col("record_id")), url,
                F.lit("application/http; msgtype=request"), asked, with_it),
        _record(F.when(revisit, "revisit").otherwise("response"), F.col("record_id"), url,
                F.lit("application/http; msgtype=response"), block, F.when(revisit, refers).otherwise(digest)),
        _record(F.lit("metadata"), _uuid(F.lit("metadata"), F.col("record_id")), url,
                F.lit("application/warc-fields"), about.cast("binary"), with_it),
    )
    return found.select(F.explode(rows).alias("value")).select(F.col("value").cast("string"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """Archives of ``pages`` (``page_id, url, html``) in the folder ``path``."""
    records(captures(pages, min_bytes)).write.option("lineSep", "\r\n").option(
        "compression", compression).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``type, record_id, concurrent_to, refers_to, url, digest, block`` of every record.

    ``block`` is null where a record ends before its declared length.
    """
    value = spark.read.option("lineSep", _MARK).text(path).where("value <> ''").select(
        F.col("value").cast("binary").alias("raw"), F.instr("value", "\r\n\r\n").alias("cut"),
        F.substring_index("value", "\r\n\r\n", 1).alias("head"))
    def field(name: str) -> Column:
        # A header's name in any case; an empty match means that it is missing.
        found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1)
        return F.when(found != "", found)

    start = F.octet_length("head") + 5
    length = field("Content-Length").cast("int")
    whole = F.octet_length("raw") - start + 1 >= length
    return value.select(
        F.lower(field("WARC-Type")).alias("type"), field("WARC-Record-ID").alias("record_id"),
        field("WARC-Concurrent-To").alias("concurrent_to"), field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        F.when(whole, F.substring(F.col("raw"), start, length)).alias("block"))


def _unchunked(body: Column) -> Column:
    """Chunks joined; they are met one after the other from the front."""
    as_text = body.cast("string")
    limit = F.size(F.split(as_text, "\r\n"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        line = F.substring_index(rest.cast("string"), "\r\n", 1)
        size = F.conv(line, 16, 10).cast("int")
        data = F.substring(rest, F.octet_length(line) + 3, size)
        after = F.substring(rest, F.octet_length(line) + size + 5, F.octet_length(rest))
        more = size > 0
        return F.struct(
            F.when(more, after).otherwise(F.lit("").cast("binary")).alias("rest"),
            F.when(more, F.concat(acc["out"], data)).otherwise(acc["out"]).alias("out"))

    empty = F.lit("").cast("binary")
    return F.aggregate(
        F.sequence(F.lit(1), limit), F.struct(body.alias("rest"), empty.alias("out")), step, lambda acc: acc["out"])


def payloads(found: DataFrame) -> DataFrame:
    """Records with ``payload``, the body of the HTTP message in a response's block."""
    text = F.col("block").cast("string")
    head = F.substring_index(text, "\r\n\r\n", 1)
    body = F.substring(F.col("block"), F.octet_length(head) + 5, F.octet_length("block"))
    chunked = head.rlike(r"(?i)\r\nTransfer-Encoding:[ \t]*chunked")
    payload = F.when(F.col("type") == "response", F.when(chunked, _unchunked(body)).otherwise(body))
    return replaced(found, {"payload": payload})


def assembled(found: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id`` and the structs ``request, response, metadata``.

    ``response`` is the response or revisit; requests and metadata are joined to it
    by the record they name as concurrent. Every part keeps all columns that
    ``found`` has. A record whose partners are missing is a capture by itself.
    """
    part = F.struct(*[F.col(f"`{c}`") for c in found.columns])
    key = F.coalesce("concurrent_to", "record_id")

    def side(*kinds: str) -> DataFrame:
        # Should a capture have several records of a kind, the smallest id stands for them.
        rows = found.where(F.col("type").isin(*kinds)).select(key.alias("capture_id"), part.alias("_part"), "record_id")
        return rows.groupBy("capture_id").agg(F.min_by("_part", "record_id").alias(kinds[0]))

    answers = found.where(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), part.alias("response"))
    return answers.join(side("request"), "capture_id", "full").join(
        side("metadata"), "capture_id", "full").select("capture_id", "request", "response", "metadata")


def page_id(block: Column) -> Column:
    """The page's id in a metadata record."""
    return F.regexp_extract(block.cast("string"), r"(?im)^pageId:[ \t]*(-?[0-9]+)", 1).try_cast("long")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h,
    min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT
    >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

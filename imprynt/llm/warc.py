"""Operator 1, WARC derivative builder: responses into linked metadata and conversion records.

A response gives two records. The conversion record holds the page's plain text; the metadata
record holds `application/warc-fields` lines about the response (size, digest, title, language,
links, and each HTTP header of the source as `source-header-<name>`). Both refer to the response by
WARC-Refers-To (with its target and date), name each other by WARC-Concurrent-To, keep its
WARC-Target-URI, WARC-Date and payload digest (as WARC-Source-Payload-Digest), and carry a digest of
their own block. Record ids are made from content and are the same on every run.

Responses come from WARC files (read_responses: HTTP status, headers, transfer and content coding,
charset, the source's own ids, dates and digests) or from a table of pages, which has no headers and
no date: there the date is null, and write_warc writes the time of writing.

Extraction is a fixed chain of DataFrame functions: comments, scripts, styles, navigation and the
head go with all they hold (one that is not closed ends where the body or main part begins, or with
the page), block tags become line breaks, other tags go, the five named XML entities, nbsp and
numeric references are decoded, white space is collapsed, empty lines go.

Null html: an empty block, its records still made. Null url: an empty target. Repeated rows give
repeated records with equal ids; ties do not arise. A long page is one row's work, and every pattern
passes over it once. Columns other than page_id, url and html play no part.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imprynt.llm.common import table

NAME = "op1_warc_derivatives"
RECORD = "type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, source_digest string, block string"
RESPONSE = "response_id string, target_uri string, date string, source_digest string, headers map<string,string>, html string"
#: Elements that go with all they hold, and tags that end a line. A tag ends before the next one begins: so no pattern
#: looks further than that from any place, however many tags are left open.
HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|nav\b.*?(?:<(?:/nav\s*>|(?:main|article|/header|/body)\b[^<>]*>)|\z)|head\b.*?(?:<(?:/head\s*>|body\b[^<>]*>)|\z))"
BREAKS = r"(?i)<(?:br|/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|blockquote))\b[^<>]*>"
TAGS = "<[a-zA-Z/!][^<>]*>"


def record_id(kind: str, *parts: Column) -> Column:
    """<urn:uuid:...> of an md5 over kind and parts."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def _decoded(text: Column) -> Column:
    """Numeric references, then named entities; an ampersand is decoded last."""
    parts = F.split(text, "&#")
    code = lambda p: F.when(p.rlike(r"^[xX][0-9a-fA-F]{1,6};"), F.conv(F.regexp_extract(p, "^[xX]([0-9a-fA-F]+);", 1), 16, 10).cast("int")).when(p.rlike(r"^[0-9]{1,7};"), F.regexp_extract(p, "^([0-9]+);", 1).cast("int"))
    fine = lambda c: ((c >= 32) & (c < 0xD800)) | ((c > 0xDFFF) & (c < 0x110000))
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    one = lambda p, i: F.when(i == 0, p).when(fine(code(p)), F.concat(char(code(p)), F.regexp_replace(p, r"^[xX]?[0-9a-fA-F]+;", ""))).otherwise(F.concat(F.lit("&#"), p))
    out = F.when(F.instr(text, "&#") > 0, F.array_join(F.transform(parts, one), "")).otherwise(text)
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def with_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df and `out`, the visible text of its column html, a line for each block. Steps are projections of their
    own, so that what several expressions use is made once; a lone space is never replaced by itself."""
    stripped = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BREAKS, "\n"), TAGS, "")
    spaced = F.regexp_replace("__decoded", r"[ \t\r\f]{2,}|[\t\r\f]", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(spaced, r" ?\n[ \n]*", "\n"), r"^\n|\n\z", ""))
    steps = df.withColumn("__stripped", stripped).withColumn("__decoded", F.when(F.instr("__stripped", "&") > 0, _decoded(F.col("__stripped"))).otherwise(F.col("__stripped")))
    return steps.withColumn(out, text).drop("__stripped", "__decoded")


def title(html: Column) -> Column:
    # what is behind the first title tag, then what is before the first end of one: each is looked for once
    rest = F.regexp_extract(html, r"(?is)<title[^<>]*>(.*)", 1)
    return F.trim(_decoded(F.regexp_replace(F.regexp_extract(rest, r"(?is)^(.*?)</title", 1), r"\s+", " ")))


def responses(pages: DataFrame) -> DataFrame:
    """page_id and RESPONSE of pages(page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", record_id("response", F.col("page_id"), F.col("url"), F.col("html")).alias("response_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(None).cast("string").alias("date"), digest(html).alias("source_digest"), F.lit(None).cast("map<string,string>").alias("headers"), html.alias("html"))


def derivatives(found: DataFrame, keep: list[str]) -> DataFrame:
    """RECORD rows, two for each response, with the columns in keep before them."""
    names = F.array_sort(F.map_keys(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    lines = F.array_join(F.transform(names, lambda k: F.concat(F.lit("source-header-"), k, F.lit(": "), F.regexp_replace(F.coalesce(F.col("headers")[k], F.lit("")), r"[\r\n]+", " "), F.lit("\r\n"))), "")
    made = with_text(found).select(*keep, "response_id", "target_uri", "date", "source_digest", "text", title(F.col("html")).alias("title"), F.regexp_extract("html", r"(?i)<html[^<>]*\blang=[\"']?([a-zA-Z-]+)", 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^<>]*href="), F.lit(0))).alias("links"), F.octet_length("html").alias("size"), F.when(F.col("headers").isNull(), "").otherwise(lines).alias("lines"))
    fields = [("source-content-length", "size"), ("source-digest", "source_digest"), ("title", "title"), ("language", "lang"), ("outlinks", "links"), ("text-length", F.octet_length("text"))]
    about = F.concat(*(F.concat(F.lit(f"{k}: "), (F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("\r\n")) for k, v in fields), F.col("lines"))
    conversion = record_id("conversion", F.col("response_id"))
    metadata = record_id("metadata", F.col("response_id"))
    one = lambda kind, own, mime, block: F.struct(F.lit(kind).alias("type"), own.alias("record_id"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = made.select(*keep, "response_id", "target_uri", "date", "source_digest", F.explode(F.array(one("conversion", conversion, "text/plain; charset=utf-8", F.col("text")), one("metadata", metadata, "application/warc-fields", about))).alias("r"))
    return both.select(*keep, "r.type", "r.record_id", F.col("response_id").alias("refers_to"), "target_uri", "date", "r.content_type", digest(F.col("r.block")).alias("block_digest"), "source_digest", "r.block")


def serialized(records: DataFrame) -> DataFrame:
    """One column `record`: each RECORD row as the text of a WARC/1.1 record, without the two line ends after it."""
    other = F.when(F.col("type") == "conversion", record_id("metadata", F.col("refers_to"))).otherwise(record_id("conversion", F.col("refers_to")))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    heads = [("WARC-Type", F.col("type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("WARC-Refers-To-Date", F.col("date")), ("WARC-Concurrent-To", other), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.coalesce("date", now)), ("WARC-Block-Digest", F.col("block_digest")), ("WARC-Source-Payload-Digest", F.col("source_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.octet_length("block").cast("string"))]
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *(F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in heads), F.lit("\r\n"), F.col("block")).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """RECORD rows as gzip WARC files, one for each partition, by Spark's own writer."""
    serialized(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_warc(data):
    """(headers in lower case, block) of each record of an open WARC file."""
    while line := data.readline():
        if not line.strip():
            continue
        heads = {}
        while (line := data.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            heads[k.strip().lower()] = v.strip()
        yield heads, data.read(int(heads.get("content-length", 0)))


def _opened(content: bytes):
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def parse_http(block: bytes) -> tuple[dict[str, str], bytes, str]:
    """Headers of an HTTP response in lower case (with `status`), its payload as stored, and its text: transfer and
    content coding undone, decoded by the charset of its headers, of the page, or as UTF-8."""
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("iso-8859-1").split("\r\n")
    headers = {"status": " ".join(first.split()[1:])}
    for line in lines:
        k, _, v = line.partition(":")
        k = k.strip().lower()
        headers[k] = f"{headers[k]}, {v.strip()}" if k in headers else v.strip()
    body = _unchunked(payload) if "chunked" in headers.get("transfer-encoding", "").lower() else payload
    if headers.get("content-encoding", "").lower() in ("gzip", "deflate", "x-gzip"):
        try:
            body = zlib.decompressobj(47).decompress(body)
        except zlib.error:
            pass
    told = re.search(r"charset=[\"']?([\w.:-]+)", headers.get("content-type", ""), re.I) or re.search(r"charset=[\"']?([\w.:-]+)", body[:2048].decode("ascii", "replace"), re.I)
    try:
        return headers, payload, body.decode(told[1] if told else "utf-8", "replace")
    except LookupError:
        return headers, payload, body.decode("utf-8", "replace")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """RESPONSE of every HTTP response record in the WARC files under path, with the record's own id, date and payload
    digest (one of the payload as stored where it states none). A file is read by one task; other records are passed over."""

    def read(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse_warc(_opened(content.as_py())):
                    if h.get("warc-type") == "response" and h.get("content-type", "").startswith("application/http"):
                        headers, payload, html = parse_http(block)
                        own = h.get("warc-payload-digest") or f"sha256:{hashlib.sha256(payload).hexdigest()}"
                        rows.append({"response_id": h.get("warc-record-id", ""), "target_uri": h.get("warc-target-uri", ""), "date": h.get("warc-date"), "source_digest": own, "headers": list(headers.items()), "html": html})
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, kind)

    text = pa.string()
    kind = pa.schema([("response_id", text), ("target_uri", text), ("date", text), ("source_digest", text), ("headers", pa.map_(text, text)), ("html", text)])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RESPONSE)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(type, record_id, refers_to, target_uri, date, content_type, block_digest, source_digest, block, intact)
    of every record under path; intact: the block has its stated digest. A file is read by one task."""

    def read(frames):
        for f in frames:
            for content in f["content"]:
                rows = []
                for h, block in parse_warc(_opened(content)):
                    own = [h.get(k, "") for k in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest", "warc-source-payload-digest")]
                    rows.append((*own, block.decode("utf-8", "replace"), own[6] == f"sha256:{hashlib.sha256(block).hexdigest()}"))
                    if len(rows) == 200:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "source_digest", "block", "intact"]
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, RECORD + ", intact boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derivatives(responses(table(spark, sf_dir, "pages")), ["page_id"])
    return out.select("page_id", "type", "record_id", "refers_to", "target_uri", "content_type", "source_digest", "block_digest", F.octet_length("block").cast("long").alias("content_length"))


def _uuid(h: str) -> str:
    return f"('<urn:uuid:' || substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-' || substring({h}, 13, 4) || '-' || substring({h}, 17, 4) || '-' || substring({h}, 21, 12) || '>')"


def _entities(x: str) -> str:
    """SQL that decodes numeric references and named entities as _decoded does."""
    code = "case when regexp_matches(p, '^[xX][0-9a-fA-F]{1,6};') then try_cast('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]+);', 1) as int) when regexp_matches(p, '^[0-9]{1,7};') then try_cast(regexp_extract(p, '^([0-9]+);', 1) as int) end"
    fine = f"(({code}) >= 32 and ({code}) < 55296 or ({code}) > 57343 and ({code}) < 1114112)"
    one = f"case when i = 1 then p when {fine} then chr({code}) || regexp_replace(p, '^[xX]?[0-9a-fA-F]+;', '') else '&#' || p end"
    out = f"array_to_string([{one} for p, i in string_split({x}, '&#')], '')"
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{value}')"
    return out


def _replaced(x: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return x


_STRIPPED = _replaced("html", (HIDDEN, "' '"), (BREAKS, "chr(10)"), (TAGS, "''"))
SQL = f"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
 x as (select *, md5('response' || chr(10) || page_id || chr(10) || url || chr(10) || html) as rh, {_STRIPPED} as stripped,
   regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '\\s+', ' ', 'g') as head from p),
 t as (select *, {_entities("stripped")} as decoded, trim({_entities("head")}, ' ') as title, {_uuid("rh")} as rid from x),
 b as (select *, trim({_replaced("decoded", ("[ \\t\\r\\f]+", "' '"), (" ?\\n[ \\n]*", "chr(10)"), ("^\\n|\\n\\z", "''"))}, ' ') as text, 'sha256:' || sha256(html) as source_digest from t),
 r as (select *, 'conversion' as type, 'text/plain; charset=utf-8' as content_type, text as block from b
   union all select *, 'metadata', 'application/warc-fields', 'source-content-length: ' || strlen(html) || chr(13) || chr(10) || 'source-digest: ' || source_digest || chr(13) || chr(10)
     || 'title: ' || title || chr(13) || chr(10) || 'language: ' || regexp_extract(html, '(?i)<html[^>]*\\blang=["'']?([a-zA-Z-]+)', 1) || chr(13) || chr(10)
     || 'outlinks: ' || len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) || chr(13) || chr(10) || 'text-length: ' || strlen(text) || chr(13) || chr(10) from b)
select page_id, type, {_uuid("md5(type || chr(10) || rid)")} as record_id, rid as refers_to, url as target_uri, content_type, source_digest,
  'sha256:' || sha256(block) as block_digest, cast(strlen(block) as bigint) as content_length
from r
"""

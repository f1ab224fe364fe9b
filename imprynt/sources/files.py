"""Files as a source: listing, bytes to embedded texts, classification, and what an index run has to do."""

from __future__ import annotations

import re
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imprynt.sources.listing import list_library

EXTENSIONS = (".png", ".jpg", ".jpeg")
EXCLUDE = ("**/.*/**",)
MOST_INFLATED = 50 << 20
TEXTS = "file_id string, key string, text string, source string"


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ** crosses directories, * and ? do not."""
    out = ""
    for part in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?]+", glob):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def relevant(path: Column, extensions=EXTENSIONS, exclude=EXCLUDE) -> Column:
    ok = F.lower(path).rlike("(?:" + "|".join(re.escape(e) for e in extensions) + ")$")
    for g in exclude:
        ok = ok & ~path.rlike(glob_regex(g))
    return ok


def scan_library(spark: SparkSession, root: str, extensions=EXTENSIONS, exclude=EXCLUDE, follow_symlinks: bool = False) -> DataFrame:
    """(rel_path, size, mtime_ns) of the files under root, listed without reading them: a mounted folder by the executors
    (see listing), any other store by Spark's listing, which leaves out names that start with "." or "_"."""
    base = root.rstrip("/")
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", base) or base.startswith("file:"):
        return list_library(spark, re.sub(r"^file:/*", "/", base), tuple(extensions), tuple(exclude), follow_symlinks)[0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "/", base)) + "/", "")
    return files.select(rel.alias("rel_path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")).where(relevant(F.col("rel_path"), extensions, exclude))


def with_content_hash(files: DataFrame) -> DataFrame:
    """files(content) with content_hash; '' where the bytes could not be read."""
    return files.withColumn("content_hash", F.coalesce(F.md5("content"), F.lit("")))


def with_image_header(files: DataFrame) -> DataFrame:
    """files(content) with format, width and height: of a PNG from its first bytes in the JVM, of a JPEG from the first
    frame header among its segments; null where there is none."""
    c = F.col("content")
    png = F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A"
    jpeg = F.coalesce(F.hex(F.substring(c, 1, 3)) == "FFD8FF", F.lit(False))
    side = lambda at: F.when(png & (F.octet_length(c) >= 24), F.conv(F.hex(F.substring(c, at, 4)), 16, 10).cast("int"))
    framed = F.pandas_udf(_frame_sizes, "width int, height int")(F.when(jpeg, c))
    sized = files.withColumn("__s", framed)
    return sized.withColumns({"format": F.when(png, "png").when(jpeg, "jpeg"), "width": F.coalesce("__s.width", side(17)), "height": F.coalesce("__s.height", side(21))}).drop("__s")


def _text(raw: bytes) -> str:
    """UTF-8, as programs write it; Latin-1, as the format has it, for what is not."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


class Inflater:
    """zlib data, taken out step by step: text() is None for a damaged stream and for one that gives more than `most`
    bytes, of which no more than a step beyond `most` is ever held. A stream that just ends keeps what it gave."""

    def __init__(self, most: int = MOST_INFLATED, step: int = 1 << 20):
        self.most, self.step = most, step

    def text(self, packed: bytes) -> bytes | None:
        stream, out, size = zlib.decompressobj(), [], 0
        try:
            while packed and not stream.eof:
                part = stream.decompress(packed, min(self.step, self.most + 1 - size))
                packed = stream.unconsumed_tail
                size += len(part)
                if size > self.most:
                    return None
                out.append(part)
        except zlib.error:
            return None
        return b"".join(out)


def _png_text(kind: bytes, body: bytes, inflater: Inflater) -> tuple[str, str] | None:
    """Key and text of one chunk; None where it has no key, is damaged or beyond bounds."""
    key, found, rest = body.partition(b"\0")
    if not found:
        return None
    if kind == b"zTXt":
        raw = inflater.text(rest[1:])
    elif kind == b"iTXt":
        if len(rest) < 2:
            return None
        fields = rest[2:].split(b"\0", 2)
        raw = fields[2] if len(fields) > 2 else b""
        raw = inflater.text(raw) if rest[0] == 1 else raw
    else:
        raw = rest
    return None if raw is None else (key.decode("latin-1"), _text(raw))


def _png_texts(data: bytes, inflater: Inflater):
    """(key, text, source) of the text chunks. A chunk that cannot be read is left out and reading goes on behind it; a
    file that ends early gives a last row without a key."""
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or kind == b"IEND":
            break
        if kind in (b"tEXt", b"zTXt", b"iTXt") and (hit := _png_text(kind, body, inflater)):
            yield *hit, kind.decode()
        at += 12 + size
    if data[at + 4 : at + 8] != b"IEND":
        yield None, None, "truncated"


def _jpeg_segments(data: bytes):
    """(marker, body) up to the scan; any number of FF may stand before a marker. (None, b"") where the file ends early."""
    at = 2
    while True:
        start = at
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at == start or at == len(data):
            break
        marker, at = data[at], at + 1
        if marker in (0x01, *range(0xD0, 0xD9)):
            continue  # stands alone
        if marker == 0xD9:
            return
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            break
        yield marker, data[at + 2 : at + size]
        if marker == 0xDA:
            return
        at += size
    yield None, b""


def _frame_size(data: bytes) -> tuple[int | None, int | None]:
    if data[:2] == b"\xff\xd8":
        for marker, body in _jpeg_segments(data):
            # frame headers are C0 to CF but for tables (C4, CC) and an extension (C8)
            if marker is not None and 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
                height, width = struct.unpack_from(">HH", body, 1)
                return width, height
    return None, None


def _frame_sizes(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_frame_size(bytes(c or b"")) for c in content], columns=["width", "height"], dtype="Int32")


def _jpeg_texts(data: bytes):
    for marker, body in _jpeg_segments(data):
        if marker is None:
            yield None, None, "truncated"
        elif marker == 0xFE:
            yield "Comment", _text(body).rstrip("\0"), "COM"
        elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            yield "XMP", _text(body.split(b"\0", 1)[1]), "XMP"
        elif marker == 0xE1 and body.startswith(b"Exif\0\0"):
            yield from _exif_texts(body[6:])


def _exif_texts(tiff: bytes):
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order:
        return
    tables, seen = [struct.unpack(order + "I", tiff[4:8])[0]], set()
    while tables:
        at = tables.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
            entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, n, value = struct.unpack(order + "HHII", entry)
            body = (entry[8 : 8 + n] if n <= 4 else tiff[value : value + n]) if kind in (1, 2, 7) else b""
            if tag == 0x8769:
                tables.append(value)
            elif tag == 0x9286 and len(body) > 8:
                wide = "utf-16-be" if order == ">" else "utf-16-le"
                yield "UserComment", body[8:].decode(wide if body.startswith(b"UNICODE") else "utf-8", "replace").rstrip("\0"), "EXIF"
            elif tag in (0x010E, 0x010F, 0x0110) and body:
                yield {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model"}[tag], body.decode("utf-8", "replace").rstrip("\0"), "EXIF"


def extract_texts(files: DataFrame, most: int = MOST_INFLATED) -> DataFrame:
    """TEXTS from files(file_id, content): PNG text chunks, JPEG EXIF, XMP and comments. A key that comes again gets
    "#2", "#3"; a truncated file keeps what was read before and a row with source `truncated`. A chunk that is damaged,
    or inflates to more than `most` bytes, is left out: never a part of a text, and the file's other texts stay."""

    def read(frames):
        for f in frames:
            rows = []
            for file_id, data in zip(f["file_id"], f["content"], strict=True):
                data, n = bytes(data or b""), {}
                found = _png_texts(data, Inflater(most)) if data[:4] == b"\x89PNG" else _jpeg_texts(data) if data[:2] == b"\xff\xd8" else ()
                try:
                    for key, text, source in found:
                        n[key] = n.get(key, 0) + 1
                        rows.append((file_id, key if n[key] == 1 or key is None else f"{key}#{n[key]}", text, source))
                except (struct.error, IndexError):
                    rows.append((file_id, None, None, "truncated"))
            yield pd.DataFrame(rows, columns=["file_id", "key", "text", "source"])

    return files.select("file_id", "content").mapInPandas(read, TEXTS)


def classify_blobs(texts: DataFrame) -> DataFrame:
    """texts(file_id, key, text) with kind (api_prompt, workflow, a1111, json, text, oversized), mismatch (the key's
    name claims another kind; the shape decides) and agrees (it claims this one). A prompt has at least one node, and
    80 % of its values look like nodes."""
    g = F.from_json("text", "map<string,variant>")
    base = texts.withColumn("__o", F.coalesce(F.col("text").rlike(r"^\s*\{"), F.lit(False))).withColumn("__g", F.when(F.col("__o") & (F.length("text") <= MOST_INFLATED), g))
    node = lambda v: (F.schema_of_variant(F.try_variant_get(v, "$.class_type", "variant")) == "STRING") & F.schema_of_variant(F.try_variant_get(v, "$.inputs", "variant")).startswith("OBJECT")
    base = base.withColumns({"__n": F.size(F.map_values("__g")), "__k": F.size(F.filter(F.map_values("__g"), lambda v: F.coalesce(node(v), F.lit(False))))})
    is_list = lambda k: F.coalesce(F.schema_of_variant(F.try_element_at("__g", F.lit(k))).startswith("ARRAY"), F.lit(False))
    # The names of keys that claim a kind; "#2" tells repeated keys apart.
    claims = {"prompt": "api_prompt", "workflow": "workflow", "parameters": "a1111"}
    claim = F.create_map(*[F.lit(x) for kv in claims.items() for x in kv])[F.substring_index("key", "#", 1)]
    flat = F.when(F.coalesce(claim == "a1111", F.lit(False)) | F.col("text").rlike(r"(?m)^Steps: \d+, Sampler: "), "a1111").otherwise("text")
    kind = F.when(~F.col("__o"), flat).when(F.length("text") > MOST_INFLATED, "oversized").when((F.col("__k") >= 1) & (F.col("__k") >= 0.8 * F.col("__n")), "api_prompt").when(is_list("nodes") & is_list("links"), "workflow").when(F.col("__g").isNotNull(), "json").otherwise("text")
    named = base.withColumn("kind", kind).withColumn("__c", claim)
    mismatch = F.coalesce((F.col("__c") != F.col("kind")) & (F.col("kind") != "oversized"), F.lit(False))
    return named.withColumn("mismatch", mismatch).withColumn("agrees", F.coalesce(F.col("__c") == F.col("kind"), F.lit(False))).drop("__g", "__n", "__k", "__o", "__c")


def read_warnings(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(file_id, code, node_id, message) of reading: files that end early (extract_texts), keys that hold another kind
    than they claim, and text parameters, which are kept but not parsed (classify_blobs)."""
    code = lambda d, c, m: d.select("file_id", F.lit(c).alias("code"), F.lit(None).cast("string").alias("node_id"), m.alias("message"))
    cut = code(texts.where("source = 'truncated'"), "TRUNCATED", F.lit("the file ends before its last part"))
    other = code(kinds.where("mismatch"), "METADATA_KEY_MISMATCH", F.concat(F.lit("key "), "key", F.lit(" holds "), "kind"))
    flat = code(kinds.where("kind = 'a1111'"), "UNSUPPORTED_FORMAT", F.lit("text parameters are stored but not parsed"))
    return cut.unionByName(other).unionByName(flat).dropDuplicates()


def file_status(kinds: DataFrame) -> DataFrame:
    """(file_id, status): ok with a prompt, partial with a workflow or A1111 text, else no_metadata."""
    has = lambda *k: F.max(F.col("kind").isin(list(k)))
    return kinds.groupBy("file_id").agg(F.when(has("api_prompt"), "ok").when(has("workflow", "a1111"), "partial").otherwise("no_metadata").alias("status"))


def raw_metadata(kinds: DataFrame) -> DataFrame:
    """(file_id, sources, prompt_json, workflow_json, other_json): the first text of each kind, one whose key agrees
    before others; everything else as one object."""
    agrees = (~F.col("agrees")).cast("int")
    pick = lambda k: F.min(F.when(F.col("kind") == k, F.struct(agrees.alias("m"), "key", "text")))["text"]
    other = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("kind").isin("api_prompt", "workflow") & F.col("key").isNotNull(), F.struct("key", "text")))))
    return kinds.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("sources"), pick("api_prompt").alias("prompt_json"), pick("workflow").alias("workflow_json"), F.to_json(other).alias("other_json"))


def diff_catalog(scan: DataFrame, catalog: DataFrame, reread: DataFrame | None = None, full: bool = False) -> DataFrame:
    """(rel_path, change): new, changed, unchanged or deleted, by size and time; reread(rel_path) and full force `changed`."""
    a = scan.select("rel_path", F.struct("size", "mtime_ns").alias("a"))
    b = catalog.select("rel_path", F.struct("size", "mtime_ns").alias("b"))
    both = a.join(b, "rel_path", "full_outer")
    force = F.lit(full)
    if reread is not None:
        both = both.join(reread.select("rel_path").distinct().withColumn("__again", F.lit(True)), "rel_path", "left")
        force = force | F.coalesce("__again", F.lit(False))
    return both.select("rel_path", F.when(F.col("a").isNull(), "deleted").when(F.col("b").isNull(), "new").when(force | (F.col("a") != F.col("b")), "changed").otherwise("unchanged").alias("change"))


def upsert_catalog(old: DataFrame, new: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """old without deleted keys and with new's rows in place of those of equal key."""
    kept = old.join(new.select(key), key, "left_anti")
    kept = kept.join(deleted.select(key), key, "left_anti") if deleted is not None else kept
    return kept.select(old.columns).unionByName(new.select(old.columns))


def reextract_plan(catalog: DataFrame, version: int, config_hash: str) -> DataFrame:
    """(file_id): rows whose extractor version or configuration is not the current one."""
    return catalog.where((F.col("extractor_version") != version) | (F.col("config_hash") != config_hash)).select("file_id")


def missing_artifacts(files: DataFrame, artifacts: DataFrame, failures: DataFrame) -> DataFrame:
    """(content_hash, rel_path): one file, the one with the lowest id, for each content without artifact or failure."""
    want = files.where("content_hash <> ''").join(artifacts.select("content_hash"), "content_hash", "left_anti").join(failures.select("content_hash"), "content_hash", "left_anti")
    return want.groupBy("content_hash").agg(F.min_by("rel_path", "id").alias("rel_path"))


def run_summary(diff: DataFrame, seconds: float, workers: int) -> DataFrame:
    """(metric, value): counts by change and files a second, in all and by worker; null where no time passed."""
    done = F.count_if(F.col("change").isin("new", "changed")).cast("double")
    rate = done / F.nullif(F.lit(float(seconds)), F.lit(0.0))
    counts = [F.struct(F.lit(c).alias("metric"), F.count_if(F.col("change") == c).cast("double").alias("value")) for c in ("new", "changed", "unchanged", "deleted")]
    rates = [F.struct(F.lit("files_per_second").alias("metric"), rate.alias("value")), F.struct(F.lit("files_per_second_per_worker").alias("metric"), (rate / workers).alias("value"))]
    return diff.agg(F.array(*counts, *rates).alias("x")).select(F.explode("x").alias("x")).select("x.metric", "x.value")

"""Operator 5, line dedup: repeated content-defined chunks of lines go, except where they first occur.

A line ends behind a newline or a punctuation mark, or behind a word that ends in one of LETTERS and
the blank after it: so a passage set inside a paragraph has lines of its own, some four words long,
and text without punctuation has lines too. Lines joined give the text back. Each line has the
CRC-32 of its trimmed bytes (without the mark that ends it); r(i) rolls over the hashes of lines
i - 1 and i. A chunk begins where r is smaller than at both neighbours, which depends on four lines
only: inserting or deleting text elsewhere moves no boundary, and no chunk has fewer than two lines.
(Ties: the left one.) A passage of 50 words has about a dozen lines and so whole chunks of its own.

Chunks of two or more lines and LEAST characters that share a hash anywhere, in one document or in
several, are compared byte by byte (their trimmed lines, joined by newlines); of equal ones only
the first, by (doc_id, place), stays. Everything here is DataFrame functions. Hashes travel without
text; groups are aggregated before they meet, so a chunk in a third of all documents is a sum and a
join that Spark can split, never a list.

Null text stays null, with no lines; an empty text has one line. Rows with equal doc_id and text
are one document: a chunk is not a copy of itself, and both rows come out alike. Null doc_ids sort
first. A very long text is one row's work, in arrays of its lines. Other columns stay as they are,
whatever their names, but for one called as the count is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from imprynt.llm.common import table, written

NAME = "op5_line_dedup"
#: What ends a line: these characters, and a blank behind one of LETTERS.
MARKS, LETTERS = ".!?,;:\n\u3002\uff0c\u3001\u0001", "n"
CUT = "\u0001"
#: The marks of more than one byte.
WIDE = "\u3002\uff0c\u3001"
LEAST = 40
KEY = ["__line_id", "__line_hash"]


def _cut(text: Column, keep: bool) -> Column:
    """text split behind each mark, by passes of plain replacement and a split at one character; keep: with the marks."""
    for mark in (*(m for m in MARKS if m != CUT), *(f"{letter} " for letter in LETTERS)):
        text = F.replace(text, F.lit(mark), F.lit(mark + CUT if keep else mark[:-1] + CUT))
    return F.split(text, CUT)


def _near(text: Column, keep: bool) -> Column:
    """As _cut(), of texts without WIDE marks: a class of single-byte characters is one quick pass, which one that also
    holds others is not. With the marks, CUT stands for a blank that ends a line, see shown()."""
    for letter in LETTERS:
        text = F.replace(text, F.lit(f"{letter} "), F.lit(letter + CUT))
    marks = "".join(m for m in MARKS if m not in WIDE)
    return F.split(text, f"(?<=[{marks}])" if keep else f"[{marks}]")


def _wide(text: Column) -> Column:
    """Whether text has a mark of WIDE; texts of single bytes are told by their lengths."""
    some = F.lit(False)
    for mark in WIDE:
        some = some | F.contains(text, F.lit(mark))
    return (F.octet_length(text) != F.length(text)) & some


def has_cut(text: Column) -> Column:
    return F.instr(text, CUT) > 0


def split_lines(text: Column) -> Column:
    """The lines of text, which joined and shown() give it back."""
    return F.when(has_cut(text), F.split(text, f"(?<=[{MARKS}]|[{LETTERS}] )")).when(_wide(text), _cut(text, True)).otherwise(_near(text, True))


def shown(part: Column, own: Column) -> Column:
    """Lines of a text, or several joined, as the text has them; own: has_cut() of the text."""
    return F.when(own, part).otherwise(F.replace(part, F.lit(CUT), F.lit(" ")))


def bare_lines(text: Column) -> Column:
    """split_lines() without the marks and blanks at their ends."""
    return F.when(_wide(text), _cut(text, False)).otherwise(_near(text, False))


def _started(texts: DataFrame) -> DataFrame:
    """texts(key, text) with `h`, the hashes of its lines, and `starts`, the first line (from 0) of each chunk. Each step
    is a projection of its own: a lambda that looks into an array must find a column, not an expression to be made again."""
    h = F.transform("lines", lambda x: F.crc32(F.trim(x)))
    # get() is null outside an array and r[0] is null, so the first two lines and the last one begin no chunk
    r = F.transform("h", lambda b, j: (F.get("h", j - 1) * 31 + b).bitwiseAND(F.lit(4294967295)))
    low = F.transform("r", lambda x, j: F.when((x < F.get("r", j - 1)) & (x <= F.get("r", j + 1)), j))
    starts = F.concat(F.array(F.lit(0)), F.filter("low", lambda x: x.isNotNull()))
    # no filter on the lines: Spark would move it before the step and split each text once more for it
    steps = texts.select(*KEY, bare_lines(F.col("text")).alias("lines")).select(*KEY, h.alias("h"))
    return steps.select(*KEY, "h", r.alias("r")).select(*KEY, "h", low.alias("low")).select(*KEY, "h", starts.alias("starts"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY: whole numbers as they are, which rows of chunks are smaller and faster with, other ids as text."""
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.withColumn("__line_id", id_).withColumn("__line_hash", F.xxhash64("text"))


def _trimmed(lines: Column, own: Column) -> Column:
    """The trimmed lines, joined by newlines; a CUT that stands for a blank goes as that would."""
    joined = F.array_join(F.transform(lines, lambda x: F.trim(x)), "\n")
    return F.when(own, joined).otherwise(F.replace(joined, F.lit(CUT), F.lit("")))


def chunks(texts: DataFrame) -> DataFrame:
    """(key, at, n, chunk): first line, number of lines and hash of every chunk of two or more lines."""
    starts = _started(texts.where("text is not null"))
    n = lambda s, k: F.coalesce(F.get("starts", k + 1), F.size("h")) - s
    named = F.transform("starts", lambda s, k: F.struct(s.alias("at"), n(s, k).alias("n"), F.xxhash64(F.slice("h", s + 1, n(s, k))).alias("chunk")))
    return starts.select(*KEY, F.inline(named)).where("n > 1")


def repeats(texts: DataFrame) -> DataFrame:
    """(key, gone): the chunks that go, (at, n) in order, for documents that lose any; texts(key, text)."""
    rows = written(chunks(texts), "chunks")
    # hash joins: the side with the texts or the rows of all chunks is never sorted.
    # the aggregates are tables before they are joined: a join of two shuffles is one that Spark can split at a hot key
    twice = written(rows.groupBy("chunk").agg(F.count("*").alias("c")).where("c > 1").select("chunk"), "twice")
    found = rows.join(twice.hint("shuffle_hash"), "chunk").groupBy(*KEY).agg(F.collect_set(F.struct("at", "n")).alias("found"))
    held = texts.join(found.hint("shuffle_hash"), KEY).select(*KEY, has_cut(F.col("text")).alias("own"), split_lines(F.col("text")).alias("lines"), "found")
    cut = F.transform("found", lambda f: F.struct(f["at"].alias("at"), f["n"].alias("n"), _trimmed(F.slice("lines", f["at"] + 1, f["n"]), F.col("own")).alias("bytes")))
    held = held.select(*KEY, F.explode(cut).alias("f")).select(*KEY, "f.at", "f.n", "f.bytes").where(F.length("bytes") >= LEAST)
    held = written(held, "candidates")
    whole = isinstance(texts.schema["__line_id"].dataType, IntegralType)
    place = F.struct("__line_id", "__line_hash", "at") if whole else F.struct(F.length("__line_id").alias("l"), "__line_id", "__line_hash", "at")
    first = held.groupBy("bytes").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("bytes", "first")
    first = written(first, "first")
    gone = held.join(first.hint("shuffle_hash"), "bytes").where(place != F.col("first"))
    return gone.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("__gone"))


def deduplicated(docs: DataFrame, count: str = "removed_lines") -> DataFrame:
    """docs with repeated chunks taken out of text, and how many lines went, called `count` (it replaces a
    column of that name); other columns as they are."""
    named = keyed(docs)
    gone = written(repeats(named.select(*KEY, "text")), "gone")
    out = named.join(gone.hint("shuffle_hash"), KEY, "left")
    end = lambda i: F.when(i == 0, 0).otherwise(F.get("__gone", i - 1)["at"] + F.get("__gone", i - 1)["n"])
    start = lambda i, lines: F.coalesce(F.get("__gone", i)["at"], F.size(lines))
    between = lambda lines: F.flatten(F.transform(F.sequence(F.lit(0), F.size("__gone")), lambda i: F.slice(lines, end(i) + 1, start(i, lines) - end(i))))
    # lines are bound by a lambda, so that a filter behind this, which Spark moves before it, splits a text once too
    new = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.transform(F.array(split_lines(F.col("text"))), lambda lines: shown(F.array_join(between(lines), ""), has_cut(F.col("text"))))[0])
    lost = F.aggregate(F.coalesce("__gone", F.array().cast("array<struct<at:int,n:int>>")), F.lit(0), lambda a, g: a + g["n"])
    return out.select(*[new.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != count], lost.cast("long").alias(count))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "removed_lines", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


SQL = rf"""
with l as (select doc_id, string_split(regexp_replace(text, '([.!?,;:。，、\n]|[{LETTERS}] )', '\1' || chr(1), 'g'), chr(1)) as lines from documents where text is not null),
 y as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from l),
 x as (select *, trim(regexp_replace(line, '[.!?,;:。，、\n]$', ''), ' ') as bare from y),
 tab as (select [list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n) for n in range(256)] as tab),
 crc as (select t, xor(list_reduce([cast('0x' || substring(hex(encode(t)), i, 2) as bigint) for i in range(1, 2 * strlen(t), 2)],
   lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8), 4294967295::bigint), 4294967295) as crc from (select distinct bare as t from x), tab),
 h as (select doc_id, i, line, trim(line, ' ') as t, crc as h from x join crc on crc.t = bare),
 r as (select *, (lag(h) over d * 31 + h) % 4294967296 as r from h window d as (partition by doc_id order by i)),
 b as (select *, case when r < lag(r) over d and r <= lead(r) over d then 1 else 0 end as b from r window d as (partition by doc_id order by i)),
 c as (select *, sum(b) over (partition by doc_id order by i) as k from b),
 g as (select doc_id, k, min(i) as first, string_agg(t, chr(10) order by i) as bytes from c group by doc_id, k having count(*) > 1),
 n as (select *, row_number() over (partition by bytes order by doc_id, first) as rn from g where length(bytes) >= {LEAST}),
 k as (select c.doc_id, count(*) filter (rn > 1) as removed_lines,
         coalesce(string_agg(line, '' order by i) filter (rn is null or rn = 1), '') as text
       from c left join n on n.doc_id = c.doc_id and n.k = c.k group by c.doc_id)
select d.doc_id, coalesce(removed_lines, 0) as removed_lines,
  cast(length(k.text) as bigint) as kept_chars, md5(k.text) as kept_md5
from documents d left join k on k.doc_id = d.doc_id
"""

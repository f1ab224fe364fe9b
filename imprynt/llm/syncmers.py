"""Operator 10, document fingerprints: closed syncmers over tokens.

A token is a Han character or a run of up to 24 letters, marks and digits, lower-cased. Of every
k-mer of K = 6 tokens the hashes of its five inner pairs are compared: it is a closed syncmer, an
anchor, if the least is at its first or last pair. The choice needs no context outside the k-mer,
so equal stretches of text have equal anchors, and any K tokens more than a window hold one. An
anchor has a hash and a position; of equal hashes in a text the first counts.

Texts are matched by position: an anchor of one text that the other has too is matched if a
neighbouring common anchor (in the order of the first text) is shifted by the same distance - one
that agrees by chance alone is not - or if it is the only common one. Likeness is matched anchors
over all anchors of both (Jaccard). It is taken from all anchors; the fingerprint is a digest of all
anchors with their positions, followed by the hashes of one in SHARE of them in hexadecimal, chosen
by value, so its length grows with the text. Everything here is DataFrame functions. Texts move
once, to ranges of the document order, where each meets the next.

Null text counts as empty. An empty text has the empty fingerprint, like only another empty one. A
text without an anchor is its own single anchor. Every row gives a row. Equal doc_ids are ordered by
a hash of the text, so that many rows of one doc_id are many ranges; a null doc_id comes first, with
the smallest long. Rows equal in doc_id and text stand next to each other: they move and are
fingerprinted once, with their number, and all but the last have their own text as the next one. A
very long text is one row's work; positions count modulo 2^24. Other columns play no part.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imprynt.llm.common import dropped, table, written

NAME = "op10_syncmers"
TOKEN = r"\p{IsHan}|[\p{L}\p{M}\p{N}&&[^\p{IsHan}]]{1,24}"
#: Hashes are below 2^38, positions below 2^24; between them is a bit that tells two texts apart.
K, SHARE, MODULUS, PLACES = 6, 16, 274877906899, 1 << 24
RANGE, MOST_RANGES, LEAST = 1000, 1 << 16, -(1 << 63)


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, 25)


def _place(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(PLACES - 1))


def anchors(df: DataFrame, text: str, out: str, keep: list[str]) -> DataFrame:
    """df's columns in keep and `out`: the anchors of the column `text`, as sorted longs of hash and position by token.
    Each step is a projection: a lambda that looks into an array must find a column, not an expression."""
    h = F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.crc32(t))
    pair = F.transform("__h", lambda x, i: (x * 31 + F.get("__h", i + 1)) % 4294967296)
    at = lambda i, d: F.get("__p", i + d)
    closed = lambda x, i: F.least(x, at(i, 4)) <= F.least(at(i, 1), at(i, 2), at(i, 3))
    mixed = lambda x, i: (x * 40503 + at(i, 2) * 65599 + at(i, 4)) % MODULUS
    every = F.transform("__p", lambda x, i: F.when((i < F.size("__p") - 5) & closed(x, i), mixed(x, i) * (2 * PLACES) + i % PLACES))
    first = F.filter("__a", lambda x, i: (i == 0) | (_hash(x) != _hash(F.get("__a", i - 1))))
    steps = df.select(*keep, h.alias("__h")).select(*keep, pair.alias("__p"))
    return steps.select(*keep, F.sort_array(F.array_compact(every)).alias("__a")).select(*keep, first.alias(out))


def anchored(df: DataFrame, text: str, out: str, drop_text: bool = False) -> DataFrame:
    """df and the anchors of its column `text`; a text without any is one anchor itself, an empty one has none."""
    keep = [f"`{c}`" for c in df.columns]
    alone = F.array(F.conv(F.substring(F.md5(text), 1, 9), 16, 10).cast("long") * (2 * PLACES))
    found = F.when(F.col(text) == "", F.array().cast("array<bigint>")).when(F.size("__found") == 0, alone).otherwise(F.col("__found"))
    out_ = anchors(df, text, "__found", keep).select(*keep, found.alias(out))
    return out_.drop(text) if drop_text else out_


def fingerprint(found: Column) -> Column:
    share = F.filter(found, lambda x: _hash(x) % SHARE == 0)
    hexadecimal = F.array_join(F.transform(share, lambda x: F.lower(F.lpad(F.hex(_hash(x)), 10, "0"))), "")
    return F.when(F.size(found) == 0, "").otherwise(F.concat(F.md5(F.array_join(found.cast("array<string>"), ",")), hexadecimal))


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df and the likeness of its anchor columns a and b. Both are sorted together, so that equal hashes are neighbours;
    what they have in common is sorted by position in a, so that equal shifts are."""
    keep = [f"`{c}`" for c in df.columns]
    shift = lambda x: x.bitwiseAND(F.lit(2 * PLACES - 1))
    both = F.sort_array(F.concat(F.col(a), F.transform(b, lambda x: x + PLACES)))
    common = F.transform("__m", lambda x, i: F.when(_hash(x) == _hash(F.get("__m", i + 1)), _place(x) * (2 * PLACES) + _place(F.get("__m", i + 1)) - _place(x) + PLACES))
    agree = F.filter("__s", lambda x, i: F.coalesce(shift(x) == shift(F.get("__s", i - 1)), F.lit(False)) | F.coalesce(shift(x) == shift(F.get("__s", i + 1)), F.lit(False)))
    n = F.when(F.size("__s") == 1, 1).otherwise(F.size(agree))
    steps = df.select(*keep, both.alias("__m")).select(*keep, F.sort_array(F.array_compact(common)).alias("__s")).select(*keep, n.alias("__n"))
    like = F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.col("__n") / (F.size(a) + F.size(b) - F.col("__n")))
    return steps.select(*keep, like.alias(out))


def _longs(values: list[int]) -> Column:
    """A constant array, folded when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def boundaries(ids: DataFrame, size: int) -> list[tuple[int, int]]:
    """The first (i, t) of each range of about `size` rows of ids(i, t), which has no row twice; at most MOST_RANGES,
    beyond which ranges grow instead of their list in the plan. An id with many rows is cut by its hashes t, which are
    spread evenly."""
    n = ids.count()
    if not n:
        return []
    cuts, starts = min(MOST_RANGES, n // size), [(LEAST, LEAST)]
    if cuts:
        shares = F.split(F.lit(",".join(str(k / (cuts + 1)) for k in range(1, cuts + 1))), ",").cast("array<double>")
        at = Counter(ids.agg(F.percentile_approx("i", shares, F.lit(min(20 * cuts, 2_000_000)))).first()[0])
        starts += sorted((i, LEAST + k * ((1 << 64) // c)) for i, c in at.items() for k in range(c))
    firsts = ids.groupBy(ranges_of(starts).alias("r")).agg(F.min(F.struct("i", "t")).alias("f")).collect()  # a row for each range
    return sorted((r["f"]["i"], r["f"]["t"]) for r in firsts)


def ranges_of(cuts: list[tuple[int, int]]) -> Column:
    """The range (from 0) of the columns (i, t), by binary search among the cuts."""
    ids, hashes = _longs([i for i, _ in cuts]), _longs([t for _, t in cuts])
    lo, hi = (lambda a: a["lo"]), (lambda a: a["hi"])
    mid = lambda a: F.floor((lo(a) + hi(a)) / 2).cast("int")
    reached = lambda m: (F.get(ids, m) < F.col("i")) | ((F.get(ids, m) == F.col("i")) & (F.get(hashes, m) <= F.col("t")))
    step = lambda a, _: F.when(hi(a) - lo(a) <= 1, a).otherwise(F.when(reached(mid(a)), F.struct(mid(a).alias("lo"), hi(a).alias("hi"))).otherwise(F.struct(lo(a).alias("lo"), mid(a).alias("hi"))))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length()))), start, step, lo)


def with_next(named: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """named(i, t, doc_id, m, text) with its anchors `own`, and text and anchors of the next row by (i, t) - the first
    after the last - as `next`. Rows go to ranges of this order once; the row at the start of a range also goes to the
    range before it (that of the first range to the last), where it stands at the end and gives no row."""
    last = len(cuts) - 1
    ranged = named.withColumn("r", ranges_of(cuts))
    start = lambda k: F.get(_longs([c[k] for c in cuts]), F.col("r"))
    first = (F.col("i") == start(0)) & (F.col("t") == start(1))
    before = F.when(F.col("r") == 0, last).otherwise(F.col("r") - 1)
    both = F.array_compact(F.array(F.struct(F.lit(0).alias("late"), "r"), F.when(first, F.struct(F.lit(1).alias("late"), before.alias("r")))))
    dealt = ranged.withColumn("to", F.explode(both)).select("i", "t", "doc_id", "m", "text", "to.late", "to.r").repartition("r")
    own = Window.partitionBy("r").orderBy("late", "i", "t", "doc_id")
    return anchored(dealt, "text", "own").withColumn("next", F.lead(F.struct("text", "own")).over(own)).where("late = 0").drop("late", "r")


def repeated(rows: DataFrame, times: str, step: int = 4096) -> DataFrame:
    """Each row as often as its column `times` says, in steps, so that no array is long."""
    rest = F.least(F.lit(step), F.col(times) - F.col("__s"))
    steps = rows.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(step).cast("long"))))
    return steps.withColumn("__k", F.explode(F.array_repeat(F.lit(0), rest.cast("int")))).drop(times, "__s", "__k")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("t"), text.alias("text"))
    ids = written(named.groupBy("doc_id", "t").agg(F.count("*").alias("m")), "ids")
    place = F.coalesce(F.col("doc_id"), F.lit(LEAST)).alias("i")
    cuts = boundaries(ids.select(place, "t"), RANGE) or [(LEAST, LEAST)]
    repeats = bool(ids.where("m > 1").take(1))
    dropped(ids)
    counted = named.groupBy("doc_id", "t").agg(F.first("text").alias("text"), F.count("*").alias("m")) if repeats else named.withColumn("m", F.lit(1).cast("long"))
    met = with_next(counted.select(place, "t", "doc_id", "m", "text"), cuts)
    if repeats:
        again = F.when(F.col("m") > 1, F.struct(F.struct("text", "own").alias("next"), (F.col("m") - 1).alias("m")))
        both = F.array_compact(F.array(F.struct("next", F.lit(1).cast("long").alias("m")), again))
        met = met.withColumn("to", F.explode(both)).select("doc_id", "text", "own", "to.next", "to.m")
    met = met.withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    edited = F.expr("concat(substring(text, 1, length(text) - half), substring(next.text, 1, half))")
    base = met.select("doc_id", F.length("text").cast("long").alias("n_chars"), "m", "own", F.col("next.own").alias("next"), edited.alias("edited"))
    out = anchored(base.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "new", drop_text=True)
    out = likeness(likeness(out, "own", "next", "near_next").drop("next"), "own", "new", "near_edited")
    out = out.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"), "near_edited", "near_next", "m")
    return repeated(out, "m") if repeats else out.drop("m")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
 f as (select *, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as nx,
   coalesce(lead(doc_id) over (order by doc_id), first_value(doc_id) over (order by doc_id)) as nid, length(text) // 2 as half from d),
 e as (select doc_id, nid, text, substring(text, 1, length(text) - half) || substring(nx, 1, half) as edited from f),
 x as (select doc_id as id, 0 as kind, text from e union all select doc_id, 1, edited from e),
 w as (select id, kind, unnest(toks) as t, unnest(range(len(toks))) as i
   from (select id, kind, regexp_extract_all(lower(text), '\p{{Han}}|[\p{{L}}\p{{M}}\p{{N}}]{{1,24}}') as toks from x)),
 few as (select id, kind, text as t from x where text <> '' and (id, kind) not in (select (id, kind) from w)),
 tab as (select [list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n) for n in range(256)] as tab),
 crc as (select t, xor(list_reduce([cast('0x' || substring(hex(encode(t)), i, 2) as bigint) for i in range(1, 2 * strlen(t), 2)],
   lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8), 4294967295::bigint), 4294967295) as crc from (select distinct t from w), tab),
 h as (select id, kind, list(crc order by i) as h from w join crc on crc.t = w.t group by id, kind),
 p as (select id, kind, [(h[i] * 31 + h[i + 1]) % 4294967296 for i in range(1, len(h))] as p from h),
 u as (select id, kind, unnest([{{'pos': i - 1, 'hash': (p[i] * 40503 + p[i + 2] * 65599 + p[i + 4]) % {MODULUS}}} for i in range(1, len(p) - 3)
   if least(p[i], p[i + 4]) <= least(p[i + 1], p[i + 2], p[i + 3])]) as a from p),
 g as (select id, kind, a.hash as hash, min(a.pos) as pos from u group by all),
 s as (from g union all select id, kind, cast('0x' || substring(md5(text), 1, 9) as bigint), 0 from x
   where text <> '' and not exists (select 1 from g where g.id = x.id and g.kind = x.kind)),
 n as (select id, kind, count(*) as n, md5(string_agg(hash * 33554432 + pos, ',' order by hash)) ||
   coalesce(string_agg(lpad(printf('%x', hash), 10, '0'), '' order by hash) filter (hash % {SHARE} = 0), '') as print from s group by id, kind),
 m as (select e.doc_id, 1 as what, o.pos as pa, q.pos - o.pos as shift from e join s o on o.id = e.doc_id and o.kind = 0 join s q on q.id = e.doc_id and q.kind = 1 and q.hash = o.hash
   union all select e.doc_id, 0, o.pos, q.pos - o.pos from e join s o on o.id = e.doc_id and o.kind = 0 join s q on q.id = e.nid and q.kind = 0 and q.hash = o.hash),
 k as (select *, count(*) over (partition by doc_id, what) as c, lag(shift) over v as l, lead(shift) over v as r from m window v as (partition by doc_id, what order by pa)),
 y as (select doc_id, what, count(*) filter (c = 1 or shift = l or shift = r) as agree from k group by doc_id, what),
 z as (select e.doc_id, e.text, e.edited, coalesce(o.print, '') as own, coalesce(w.print, '') as new, coalesce(o.n, 0) as no, coalesce(w.n, 0) as nw, coalesce(q.n, 0) as nq,
   coalesce(y1.agree, 0) as a1, coalesce(y0.agree, 0) as a0 from e
   left join n o on o.id = e.doc_id and o.kind = 0 left join n w on w.id = e.doc_id and w.kind = 1 left join n q on q.id = e.nid and q.kind = 0
   left join y y1 on y1.doc_id = e.doc_id and y1.what = 1 left join y y0 on y0.doc_id = e.doc_id and y0.what = 0)
select doc_id, cast(length(text) as bigint) as n_chars, sha256(edited) as edited_sha256, own as fingerprint, new as edited_fingerprint,
  case when no + nw = 0 then 1.0 else a1 / (no + nw - a1)::double end as near_edited,
  case when no + nq = 0 then 1.0 else a0 / (no + nq - a0)::double end as near_next
from z
"""

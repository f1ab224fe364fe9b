"""Operator 13, phrase collocation mining: multikey three-way quicksort of suffix pointers.

A suffix is a word with what follows it in its piece, to DEPTH = 3 words. A first pass counts words. In
a second, tasks merge the equal suffixes of a block of texts and route them by leading words, up to
the first that is not hot: a word met at most GROUP / 4 times (or a 2^20th of all, if that is more, so
that at most 2^20 words are hot and a broadcast of them is bounded). All suffixes with the same
leading words so meet in one group, which holds no more than what is met with one word that is not
hot; suffixes of hot words alone are few different ones in a block, and are routed by all three. What
goes from a block to a group is one row, its words in order as three strings.

In a group, pointers are sorted by multikey three-way quicksort, all partitions of a round at once:
a partition of pointers is parted into less than, equal to and greater than a pivot's word at its
depth; equal ones go on at the next word. The size of an equal partition is a phrase's count. As all
suffixes with its leading words are here, any partition below `least` is given up: nothing in it can
reach that. What counts too little is never sorted further. Only two hot words in a row are counted
in several groups, and those counts are added up.

Scores, cuts and the test of longer phrases are joins of the frequent phrases. All numbers that are
multiplied are decimals of 38 digits.

Null text counts as empty, null lang as `und`; empty texts and pieces have no word. Repeated rows
count again. Equal scores and counts are in the order of the phrase's bytes. A long text is cut
between pieces; a piece without end is one task's work. Other columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imprynt.llm.common import table, written
from imprynt.llm.words import END, blocks, kinds, words

NAME = "op13_collocations"
DEPTH = 3
BLOCK, GROUP, MOST_HOT = 6 << 20, 1_000_000, 1 << 20
KIND = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
COUNTS = "lang string, w1 string, m long"
ROUTED = "route long, lang string, w1 string, w2 string, w3 string, n array<int>"


def merged(lead: np.ndarray, two: np.ndarray, three: np.ndarray, sizes: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Equal rows of (lead, two, three) once, in order, and how many there are; sizes: numbers of leads, and of words."""
    if sizes[0] * sizes[1] ** 2 < 1 << 62:
        key, n = np.unique((lead * sizes[1] + two) * sizes[1] + three, return_counts=True)
        return key // sizes[1] ** 2, key // sizes[1] % sizes[1], key % sizes[1], n
    order = np.lexsort((three, two, lead))
    lead, two, three = lead[order], two[order], three[order]
    new = np.append(True, (lead[1:] != lead[:-1]) | (two[1:] != two[:-1]) | (three[1:] != three[:-1]))
    at = np.flatnonzero(new)
    return lead[at], two[at], three[at], np.diff(np.append(at, len(lead)))


def _coded(docs: DataFrame, make, schema: str, block: int) -> DataFrame:
    """make(lang, names, row of each word's lang, ids, piece) for each block of docs(lang, text); names are its words."""

    def look(batches):
        for b in batches:
            lang = b.column(0).fill_null("und").dictionary_encode()
            for body, at, row in blocks(b.column(1), KIND, block, END):
                found, text, piece = words(body, at, KIND)
                if len(found):
                    coded = found.dictionary_encode()
                    yield from make(lang.dictionary.cast(pa.string()), coded.dictionary.cast(pa.string()), lang.indices.to_numpy().astype(np.int64)[row[text]], coded.indices.to_numpy().astype(np.int64), piece)

    return docs.select(F.col("lang").cast("string"), "text").mapInArrow(look, schema)


def word_counts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, w1, f): how often each word is met."""

    def count(langs, names, lang, ids, _):
        key, m = np.unique(lang * len(names) + ids, return_counts=True)
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(key // len(names))), names.take(pa.array(key % len(names))), pa.array(m, pa.int64())], ["lang", "w1", "m"])

    return _coded(docs, count, COUNTS, block).groupBy("lang", "w1").agg(F.sum("m").alias("f"))


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ more) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def routed(docs: DataFrame, counts: DataFrame, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """ROUTED: the suffixes of more than one word of each block for each group: their words, joined by blanks (an empty
    third one behind the end of a piece), and how often each is met. Routes below zero are by all three words."""
    total = counts.agg(F.sum("f")).first()[0] or 0
    routes, most = max(1, -(-total // group)), max(group // 4, total // MOST_HOT)
    hot = counts.where(F.col("f") > most).select("lang", "w1").collect()  # at most 2^20 words
    by_lang: dict[str, list[str]] = {}
    for r in hot:
        by_lang.setdefault(r["lang"], []).append(r["w1"])
    known = docs.sparkSession.sparkContext.broadcast(by_lang)

    def send(langs, names, lang, ids, piece):
        size = len(names)
        on, further = piece[1:] == piece[:-1], piece[2:] == piece[:-2]
        two, three = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)  # 0 is none
        two[:-1][on] = ids[1:][on] + 1
        three[:-2][further] = ids[2:][further] + 1
        lead = lang * size + ids
        lead, two, three, n = merged(lead[two > 0], two[two > 0], three[two > 0], (len(langs) * size, size + 1))
        if not len(n):
            return
        lang, one, two = lead // size, lead % size, two - 1
        texts = langs.to_pylist()
        is_hot = np.stack([pc.is_in(names, value_set=pa.array(known.value.get(t, []), pa.string())).to_numpy(zero_copy_only=False) for t in texts])
        h = np.fromiter((zlib.crc32(w.encode()) for w in names.to_pylist()), np.uint64, size)
        own = np.array([zlib.crc32(t.encode()) for t in texts], np.uint64)[lang]
        first, second = is_hot[lang, one], is_hot[lang, two]
        to = _mixed(own, h[one])
        to = np.where(first, _mixed(to, h[two]), to)
        deep = first & second
        to = np.where(deep, _mixed(to, np.append(np.uint64(1), h)[three]), to)
        to = (to % np.uint64(routes)).astype(np.int64)
        to = np.where(deep, -1 - to, to)
        order = np.argsort((to + routes) * len(texts) + lang, kind="stable")
        to, lang, one, two, three, n = (x[order] for x in (to, lang, one, two, three, n))
        start = np.flatnonzero(np.append(True, (to[1:] != to[:-1]) | (lang[1:] != lang[:-1])))
        offsets = pa.array(np.append(start, len(to)), pa.int32())
        ends = pa.concat_arrays([pa.array([""]), names])
        columns = [pc.binary_join(pa.ListArray.from_arrays(offsets, x), " ") for x in (names.take(pa.array(one)), names.take(pa.array(two)), ends.take(pa.array(three)))]
        yield pa.RecordBatch.from_arrays([pa.array(to[start]), langs.take(pa.array(lang[start])), *columns, pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))], ["route", "lang", "w1", "w2", "w3", "n"])

    return _coded(docs, send, ROUTED, block)


def equal_parts(keys: np.ndarray, weights: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, pointer, weight) of the equal partitions of multikey three-way quicksort: keys[d] is the word of each
    pointer at depth d, and depth d gives partitions of a weight of least[d] or more (least does not fall)."""
    p, depth, size = np.arange(len(weights)), np.zeros(1, np.int64), np.array([len(weights)])
    lowest, random = np.array(least, np.int64), np.random.default_rng(7)
    out: list[tuple] = []
    while len(p):
        segment, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        word = keys[depth[segment], p]
        some = np.stack([word[start + random.integers(0, size)] for _ in range(3)])
        some.sort(axis=0)
        pivot = some[1][segment]
        side = (word >= pivot).astype(np.int8) + (word > pivot)
        number = segment * 3 + side
        count = np.bincount(number, minlength=3 * len(size))
        to = np.cumsum(count) - count
        moved = np.empty_like(p)
        for s in range(3):
            at = np.flatnonzero(side == s)
            mine = count[s::3]
            moved[to[number[at]] + np.arange(len(at)) - (np.cumsum(mine) - mine)[segment[at]]] = p[at]
        part = np.flatnonzero(count)
        total = np.add.reduceat(weights[moved], to[part])
        d, equal = depth[part // 3], part % 3 == 1
        full = equal & (total >= lowest[d])
        out.append((d[full], moved[to[part[full]]], total[full]))
        goes = np.where(equal, d + 1, d)
        on = (goes < len(least)) & (total >= lowest[np.minimum(goes, len(least) - 1)])
        p, depth, size = moved[np.repeat(on, count[part])], goes[on], count[part[on]]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def frequent(rows: DataFrame, least: int) -> DataFrame:
    """(lang, w1, w2, w3, a): the phrases of two (w3 is null) and three words met `least` times or more, of ROUTED."""

    def parts(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        size = pc.list_value_length(t["n"]).to_numpy()
        weights = t["n"].combine_chunks().flatten().to_numpy().astype(np.int64)
        flat = pa.concat_arrays([pc.split_pattern(x.cast(pa.large_string()), " ").flatten() for c in ("w1", "w2", "w3") for x in t[c].chunks]).dictionary_encode()
        langs = t["lang"].combine_chunks().dictionary_encode()
        ids = flat.indices.to_numpy().reshape(3, -1)
        lead = np.repeat(langs.indices.to_numpy().astype(np.int64), size) * len(flat.dictionary) + ids[0]
        keys = np.stack([np.unique(lead, return_inverse=True)[1].astype(np.int32), ids[1], ids[2]])
        depth, at, a = equal_parts(keys, weights, (1, 1, least) if key[0].as_py() < 0 else (least,) * DEPTH)
        ended = flat.dictionary.index(pa.scalar("", pa.large_string())).as_py()
        keep = (depth == 1) | ((depth == 2) & (ids[2][at] != ended))
        depth, at, a = depth[keep], at[keep], a[keep]
        word = lambda d: flat.dictionary.take(pa.array(ids[d][at])).cast(pa.string())
        third = pc.if_else(pa.array(depth == 2), word(2), pa.scalar(None, pa.string()))
        lang = langs.take(pa.array(np.repeat(np.arange(len(size)), size)[at])).cast(pa.string())
        return pa.table({"lang": lang, "w1": word(0), "w2": word(1), "w3": third, "a": pa.array(a, pa.int64())})

    found = rows.groupBy("route").applyInArrow(parts, "lang string, w1 string, w2 string, w3 string, a long")
    return found.groupBy("lang", "w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each lang."""
    counts = written(word_counts(docs, block), "words")
    every = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    ones = counts.where(F.col("f") >= least)
    found = written(frequent(routed(docs, counts, group, block), least), "phrases")
    twos, threes = found.where("w3 is null").drop("w3"), found.where("w3 is not null")
    word = lambda c, f: ones.select("lang", F.col("w1").alias(c), F.col("f").alias(f))
    pair = lambda x, y, f: twos.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(f))

    longer = threes.select("lang", "w1", "w2", "a").unionByName(threes.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longest = longer.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    free = twos.join(longest, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    two = free.join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r")
    three = threes.join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(word("w1", "l1"), ["lang", "w1"]).join(word("w3", "r2"), ["lang", "w3"])
    cut = lambda k: F.struct(scored("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut(1), cut(2)).alias("c"))
    both = two.withColumn("score", scored("a", "l", "r")).unionByName(three.select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # what is not among the first of its share is not among the first of all
    shared = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    first = both.withColumn("rank", F.row_number().over(shared)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(every, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def scored(a: str, left: str, right: str) -> Column:
    """floor(10^6 a a / (l r)) without rounding: a is at most l and r, so the result is a long."""
    big = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({big(a)} * {big(a)} * 1000000BD) div ({big(left)} * {big(right)})").cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (select coalesce(lang, 'und') as lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
 p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
 q as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
 u as (select lang, ws[i] as w1, ws[i + 1] as w2, ws[i + 2] as w3 from (select lang, ws, unnest(range(1, len(ws) + 1)) as i from q)),
 f1 as (select lang, w1, count(*) as f from u group by all),
 n as (select lang, sum(f)::bigint as n from f1 group by lang),
 f2 as (select lang, w1, w2, count(*) as a from u where w2 is not null group by all having count(*) >= 10),
 f3 as (select lang, w1, w2, w3, count(*) as a from u where w3 is not null group by all having count(*) >= 10),
 x as (select lang, w1, w2, max(a) as longer from (select lang, w1, w2, a from f3 union all select lang, w2, w3, a from f3) group by all),
 c as (select f2.lang, f2.w1 || ' ' || f2.w2 as phrase, f2.a, l.f as l, r.f as r, 1 as k from f2
     join f1 l on l.lang = f2.lang and l.w1 = f2.w1 join f1 r on r.lang = f2.lang and r.w1 = f2.w2
     left join x on x.lang = f2.lang and x.w1 = f2.w1 and x.w2 = f2.w2 where x.longer is null or 100 * x.longer < 50 * f2.a
   union all select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, l.f, r.a, 1 from f3
     join f1 l on l.lang = f3.lang and l.w1 = f3.w1 join f2 r on r.lang = f3.lang and r.w1 = f3.w2 and r.w2 = f3.w3
   union all select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, l.a, r.f, 2 from f3
     join f2 l on l.lang = f3.lang and l.w1 = f3.w1 and l.w2 = f3.w2 join f1 r on r.lang = f3.lang and r.w1 = f3.w3),
 s as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from c),
 b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as best from s) where best = 1),
 o as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from b)
select o.lang, rank, phrase, a, l, r, n, score from o join n on n.lang = o.lang where rank <= 2000
"""

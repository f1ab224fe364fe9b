"""Operator 11, MinHash near-dedup with odd sketches.

A document is its set of 3-word shingles, as 64-bit hashes; equal sets are one node. SAMPLES = BANDS *
ROWS MinHash samples of a set give two things: the keys of BANDS bands, and the odd sketch, a bitmap
of 256 bits in which each sample (with its number) flips one bit. Samples in which two sets agree
cancel in the XOR of their sketches, so the population count of the XOR estimates how many differ, and
most precisely where few do. A pair of one band is a candidate if its count is at most MOST, five
standard deviations beyond the mean of a pair at the limit, and if the sizes of its sets allow a link.
Every link is confirmed on the full sets. A pair at the limit shares no band with a probability of
7e-7 and is turned away by its sketch with one of 3e-7; closer pairs with far less.

Not all pairs of a bucket are tried. First each node meets the smallest of its bucket; most buckets
are then one component, and links inside a component say nothing new. Of buckets that still hold
several, small ones (SMALL) try the pairs of different components, and large ones are dealt into
blocks: every two meet in a task of their own, which confirms on the sets it holds and gives a
spanning forest. Buckets with the same members are tried once. Sets are made only for nodes that are
in a candidate or in a large bucket.

Null and empty texts have no set: they are linked with nothing. Repeated rows and doc_ids give a row
each; equal sets are linked, whatever their doc_ids. Null doc_ids are a component_id only where a
component has no other. Fewer than three words are one shingle. A long text is one task's work in
memory of some times its size. Other columns play no part. Two different sets have the same 64-bit
digest, and count as equal, with a probability of 2^-64.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imprynt.llm.common import table, written
from imprynt.llm.components import components
from imprynt.llm.words import PLAIN, blocks, words

NAME = "op11_minhash"
BANDS, ROWS, BITS, MOST, SHARE, WORDS = 30, 6, 256, 85, 85, 3
SAMPLES = BANDS * ROWS
SMALL, BLOCK, BLOCK_SHINGLES, TEXTS = 48, 1024, 1_000_000, 8 << 20
SKETCH = [f"o{i}" for i in range(BITS // 64)]
KEYS = [f"b{i}" for i in range(BANDS)]
_RANDOM = np.random.default_rng(20140407)
FACTOR, PLUS, MIX = (_RANDOM.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (SAMPLES, SAMPLES, SAMPLES))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def shingle_sets(column: pa.Array, width: int = WORDS):
    """(row, set) of each text with a word: the sorted distinct hashes of its shingles."""
    for body, at, row in blocks(column, PLAIN, TEXTS):
        found, text, _ = words(body, at, PLAIN)
        if not len(found):
            continue
        coded = found.dictionary_encode()
        names = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        h = names[coded.indices.to_numpy()]
        first = np.searchsorted(text, np.arange(len(row) + 1))
        for i in np.flatnonzero(np.diff(first)):
            own = h[first[i] : first[i + 1]]
            n = len(own)
            k = min(n, width)
            total = np.full(n - k + 1, k, np.uint64)
            for j in range(k):
                total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + own[j : n - k + 1 + j])
            yield row[i], np.unique(total)


def samples(values: np.ndarray) -> np.ndarray:
    """The least value of a set under each of SAMPLES permutations."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(values), 1024):
        np.minimum(out, (values[None, lo : lo + 1024] * FACTOR[:, None] + PLUS[:, None]).min(axis=1), out=out)
    return out


def sketches(least: np.ndarray) -> np.ndarray:
    """The odd sketch of each row of samples, as BITS / 64 words."""
    bit = (mixed(least * MIX[None, :] + PLUS[None, :]) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    parity = np.bincount((np.arange(len(least))[:, None] * BITS + bit).ravel(), minlength=len(least) * BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(len(least), BITS), axis=1, bitorder="little").view(np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A hash of the samples of each band, and of its number."""
    own = (least * MIX[None, :]).reshape(len(least), BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS))
    for r in range(ROWS):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + own[:, :, r])
    return total


def described(rows: DataFrame) -> DataFrame:
    """(id, q, n, node, sketch, band keys) of rows(id, q, text); without words node and all after it are null or 0."""

    def look(batches):
        for b in batches:
            n, node = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.uint64)
            least = np.zeros((b.num_rows, SAMPLES), np.uint64)
            for i, own in shingle_sets(b.column(2)):
                n[i], node[i], least[i] = len(own), xxhash.xxh3_64_intdigest(own.tobytes()), samples(own)
            odd, keys = sketches(least).view(np.int64), band_keys(least).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(node.view(np.int64), mask=n == 0), *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(len(SKETCH))), *(pa.array(np.ascontiguousarray(keys[:, i])) for i in range(BANDS))], ["id", "q", "n", "node", *SKETCH, *KEYS])

    return rows.mapInArrow(look, "id long, q long, n int, node long, " + ", ".join(f"{c} long" for c in SKETCH + KEYS))


def sets_of(rows: DataFrame) -> DataFrame:
    """(node, set) of rows(node, text)."""

    def look(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                held = list(shingle_sets(part.column(1)))
                if held:
                    at = pa.array([i for i, _ in held])
                    offsets = pa.array(np.append(0, np.cumsum([len(s) for _, s in held])), pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([s for _, s in held]).view(np.int64)))], ["node", "set"])

    return rows.select("node", "text").mapInArrow(look, "node long, set array<long>")


def differing(a: str = "", b: str = "_v") -> Column:
    return sum((F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in SKETCH[1:]), F.bit_count(F.col(f"{SKETCH[0]}{a}").bitwiseXOR(F.col(f"{SKETCH[0]}{b}"))))


def likely(a: str = "", b: str = "_v", share: int = SHARE, most: int = MOST) -> Column:
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    return (100 * F.least(n, m).cast("long") >= share * F.greatest(n, m).cast("long")) & (differing(a, b) <= most)


def confirmed(pairs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs (u, v) whose full sets are alike."""
    mine, other = (sets.select(F.col("node").alias(c), F.col("set").alias(s)) for c, s in (("u", "a"), ("v", "b")))
    both = pairs.join(mine, "u").join(other, "v").withColumn("i", F.size(F.array_intersect("a", "b")).cast("long"))
    return both.where(100 * F.col("i") >= share * (F.size("a") + F.size("b") - F.col("i"))).select("u", "v")


def in_blocks(members: DataFrame, sets: DataFrame, share: int, most: int, block: int) -> DataFrame:
    """(u, v): links that join different roots among members(key, node, root, n, sketch) of large buckets, a spanning
    forest of each two blocks."""
    size = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(size, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    two = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    two = two.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with", "blocks").join(sets, "node")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        frame = frame.sort_values("node", ignore_index=True)
        odd, n, node = frame[SKETCH].to_numpy().view(np.uint64), frame["n"].to_numpy().astype(np.int64), frame["node"].to_numpy()
        own, top, links = frame["set"].to_list(), {}, []
        root_of = frame["root"].to_numpy()

        def root(x):
            while top.get(x, x) != x:
                top[x] = top.get(top[x], top[x])
                x = top[x]
            return x

        left, right = (np.flatnonzero(frame["block"].to_numpy() == x) for x in (i, j))
        for a in left:
            rest = right[right > a] if i == j else right
            rest = rest[root_of[rest] != root_of[a]]
            rest = rest[(100 * np.minimum(n[rest], n[a]) >= share * np.maximum(n[rest], n[a])) & (np.bitwise_count(odd[rest] ^ odd[a]).sum(axis=1) <= most)]
            for b in rest:
                p, q = root(root_of[a]), root(root_of[b])
                if p != q:
                    both = len(np.intersect1d(own[a], own[b], assume_unique=True))
                    if 100 * both >= share * (n[a] + n[b] - both):
                        top[max(p, q)] = min(p, q)
                        links.append((node[a], node[b]))
        return pd.DataFrame(links, columns=["u", "v"], dtype=np.int64)

    return two.groupBy("key", "i", "j").applyInPandas(meet, "u long, v long")


def near_duplicates(docs: DataFrame, share: int = SHARE, most: int = MOST, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text): sets are linked if 100 times the size
    of their intersection is `share` times that of their union or more."""
    id_ = F.col("doc_id").cast("long")
    named = docs.select(id_.alias("id"), F.xxhash64(F.coalesce(id_, F.lit(0)), id_.isNull(), F.coalesce("text", F.lit(""))).alias("q"), "text")
    rows = written(described(named), "sketches")
    # equal nodes have equal sketches, sizes and keys; q tells the row whose text stands for the node
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("q").alias("q"), *(F.max(c).alias(c) for c in ("n", *SKETCH, *KEYS)))
    nodes = written(nodes, "nodes")
    own = nodes.select("node", "n", *SKETCH)

    banded = nodes.select("node", F.explode(F.array(*KEYS)).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("count"), F.min("node").alias("leader"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("digest")).where("count > 1")
    buckets = written(shared.groupBy("count", "leader", "digest").agg(F.min("key").alias("key")).drop("digest"), "buckets")
    members = written(banded.join(buckets, "key").join(own, "node"), "members")

    other = lambda d: d.select(*(F.col(c).alias(f"{c}_v") for c in ("node", "n", *SKETCH)))
    pair = [F.greatest("node", "node_v").alias("u"), F.least("node", "node_v").alias("v")]
    to_leader = members.where("node <> leader").join(other(own), F.col("leader") == F.col("node_v")).where(likely(share=share, most=most))
    star = written(to_leader.select(*pair).distinct(), "star")
    few = members.where(F.col("count") <= small)
    again = few.select("key", *(F.col(c).alias(f"{c}_v") for c in ("node", "n", *SKETCH)))
    each = few.join(again, "key").where((F.col("node") > F.col("node_v")) & (F.col("node_v") != F.col("leader")) & likely(share=share, most=most))
    met = written(each.select(*pair).distinct(), "met")
    large = members.where(F.col("count") > small)
    wanted = star.select("u").union(star.select("v")).union(met.select("u")).union(met.select("v")).union(large.select("node")).distinct().withColumnRenamed("u", "node")
    texts = named.join(nodes.join(wanted, "node").select("q", "node"), "q").select("node", "text")
    sets = written(sets_of(texts), "sets")
    if rows.select("q").count() != rows.select("q").distinct().count():
        sets = written(sets.dropDuplicates(["node"]), "sets_once")

    links = written(confirmed(star, sets, share), "links")
    roots = components(links).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = lambda c, r: roots.select(F.col("node").alias(c), F.col("root").alias(r))
    apart = met.join(rooted("u", "r"), "u", "left").join(rooted("v", "s"), "v", "left").where(F.coalesce("r", "u") != F.coalesce("s", "v")).select("u", "v")
    spread = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = spread.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    more = written(confirmed(apart, sets, share).unionByName(in_blocks(spread.join(several, "key").select("key", "node", "root", "n", *SKETCH), sets, share, most, block)), "more_links")
    if not more.isEmpty():
        roots = components(links.unionByName(more)).select(F.col("u").alias("node"), F.col("v").alias("root"))

    lead = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = lead.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.select("id", "n", "node").join(lead.join(best, "root").select("node", "component_id"), "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
 s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
   else [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] end) as x from d),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select a.doc_id as u, b.doc_id as v, count(*) as i from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by all),
 l as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * i >= 85 * (a.n + b.n - i)),
 r as (select doc_id, doc_id as c from n union select r.doc_id, l.v from r join l on l.u = r.c),
 c as (select doc_id, min(c) as c from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.c, d.doc_id) as component_id, coalesce(c.c, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id
"""

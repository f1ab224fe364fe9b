"""Operator 12, ranked lexical search: a document FP-tree, searched depth first by branch and bound.

Documents are restricted to the terms of the items. Each task sorts a block of them as an FP-tree
does: a document's terms in order of corpus frequency, the most frequent first, are its path, and
documents share the trie's nodes as far as their paths agree. Paths without a fork are one node, and
a node of few documents is a leaf. Every node has the least m of the documents below it and for each
term below it the largest tf there. A term's part of a score grows with tf and falls with m, so both
bound the score of every document below a node.

Each item then goes through the tree depth first, the child of the highest bound first, and leaves
out what is bound below its tenth best score so far; leaves are scored exactly. An item's best go on
with the task from block to block, and the tasks' best meet in one ranking. Equal scores are never
cut off: bounds that equal the tenth score are followed.

Items are read in blocks of at most BLOCK characters (a longer item is a block by itself); each block
is a broadcast of bounded size, is searched over all documents, and is gone before the next. The sums
over the corpus (documents, terms, document frequencies of the block's terms) are over all documents.

Null text has no term; such documents count for nothing. Equal scores are in ascending doc_id, null
last. Repeated documents rank one by one. Repeated rows of an item count once; other texts under the
same item_id, null too, are items of their own. A long text is read in pieces. Other columns play no
part.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imprynt.llm.common import dropped, table, written
from imprynt.llm.words import GAP, blocks, kinds, words

NAME = "op12_ranked_search"
BLOCK, TEXTS, POSTINGS, DOCS, LEAF = 4_000_000, 8 << 20, 1_500_000, 40_000, 16
KIND = kinds(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
KIND[65:91] = 1  # lower-cased before they are looked up
VECTORS = "doc_id long, n long, terms array<int>, tfs array<long>"
FOUND = "item int, item_id long, doc_id long, score long"


def terms(text: str | None) -> list[str]:
    column = pa.array([text or ""], pa.string())
    return [w for body, at, _ in blocks(column, KIND, 1 << 40) for w in words(body, at, KIND)[0].to_pylist()]


def vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """VECTORS of each row of docs(doc_id, text): the number of all its terms, and the numbers in vocabulary (a broadcast
    list) of those that are there, ascending, with their occurrences."""

    def look(batches):
        known = pa.array(vocabulary.value, pa.large_string())
        for b in batches:
            n, keys, counts = np.zeros(b.num_rows, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for body, at, row in blocks(b.column(1), KIND, TEXTS, GAP):
                found, text, _ = words(body, at, KIND)
                if not len(found):
                    continue
                text = row[text]
                n += np.bincount(text, minlength=b.num_rows)
                coded = found.dictionary_encode()
                term = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy()[coded.indices.to_numpy()].astype(np.int64)
                key, count = np.unique((text * len(known) + term)[term >= 0], return_counts=True)
                keys.append(key)
                counts.append(count)
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            tf = np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)
            offsets = pa.array(np.searchsorted(key, np.arange(b.num_rows + 1) * max(1, len(known))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array((key % max(1, len(known))).astype(np.int32)), pa.array(tf))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, VECTORS)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """The FP-tree of a block: documents in the order of their paths, nodes as ranges of them, the root first."""

    def __init__(self, m: np.ndarray, offsets: np.ndarray, term: np.ndarray, tf: np.ndarray, rank: np.ndarray, leaf: int = LEAF):
        size = np.diff(offsets)
        doc = np.repeat(np.arange(len(m)), size)
        by_path = np.lexsort((rank[term], doc))
        path = rank[term][by_path].astype(">u4")
        raw = path.tobytes()
        order = np.array(sorted(range(len(m)), key=lambda d: raw[4 * offsets[d] : 4 * offsets[d + 1]]), np.int64)
        self.order, self.m, self.size = order, m[order], size[order]
        self.at = np.append(0, np.cumsum(self.size))
        moved = np.repeat(offsets[:-1][order] - self.at[:-1], self.size) + np.arange(len(term))
        self.path, by_path = path[moved].astype(np.int64), by_path[moved]
        self.term, self.tf = term[by_path].astype(np.int64), tf[by_path]
        self._nodes(leaf)
        self._maxima(int(term.max()) + 1 if len(term) else 1)

    def _nodes(self, leaf: int) -> None:
        lo, hi, parent, level, children = [0], [len(self.m)], [-1], [0], [[]]
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            a, b = lo[node], hi[node]
            if b - a <= leaf:
                continue
            while True:  # to the next fork
                known = self.size[a:b] > depth
                step = np.where(known, self.path[np.minimum(self.at[a:b] + depth, len(self.path) - 1)], -1)
                if step[0] != step[-1] or step[0] < 0:
                    break
                depth += 1
            cuts = np.flatnonzero(step[1:] != step[:-1]) + 1
            if not len(cuts):
                continue  # equal paths to the end: a leaf, however many
            for x, y in zip(np.append(0, cuts), np.append(cuts, b - a), strict=True):
                children[node].append(len(lo))
                todo.append((len(lo), depth + 1))
                lo.append(a + int(x))
                hi.append(a + int(y))
                parent.append(node)
                level.append(level[node] + 1)
                children.append([])
        self.lo, self.hi, self.parent, self.level, self.children = np.array(lo), np.array(hi), np.array(parent), np.array(level), children
        ends = np.stack([self.lo, self.hi], axis=1).ravel()
        self.least = np.minimum.reduceat(np.append(self.m, np.iinfo(np.int64).max), ends)[::2] if len(self.m) else np.zeros(1, np.int64)

    def _maxima(self, n: int) -> None:
        """The entries (term, node, largest tf), by term: leaves first, then every level from the one below it."""
        is_leaf = np.array([not c for c in self.children])
        leaves = np.flatnonzero(is_leaf)
        leaves = leaves[np.argsort(self.lo[leaves])]
        owner = np.repeat(leaves, self.hi[leaves] - self.lo[leaves])[np.repeat(np.arange(len(self.m)), self.size)]
        below = np.zeros((3, 0), np.int64)
        entries = []
        for depth in range(int(self.level.max()), -1, -1):
            own = self.level[owner] == depth
            rows = np.concatenate([below, np.stack([owner[own], self.term[own], self.tf[own]])], axis=1)
            order = np.lexsort((-rows[2], rows[1], rows[0]))
            rows = rows[:, order]
            key = rows[0] * n + rows[1]
            rows = rows[:, np.append(True, key[1:] != key[:-1])] if len(key) else rows
            entries.append(rows)
            below = np.stack([self.parent[rows[0]], rows[1], rows[2]])
        every = np.concatenate(entries, axis=1)
        every = every[:, np.argsort(every[1], kind="stable")]
        self.node, self.most = every[0], every[2]
        self.first = np.searchsorted(every[1], np.arange(n + 1))

    def bounds(self, wanted: dict[int, int]) -> np.ndarray:
        """For each node a score that no document below it exceeds."""
        out = np.zeros(len(self.lo), np.int64)
        for t, w in wanted.items():
            if t + 1 < len(self.first):
                at = slice(self.first[t], self.first[t + 1])
                out[self.node[at]] += w * gain(self.most[at], self.least[self.node[at]])
        return out

    def scores(self, node: int, weight: np.ndarray) -> np.ndarray:
        a, b = self.lo[node], self.hi[node]
        at = slice(self.at[a], self.at[b])
        doc = np.repeat(np.arange(a, b), self.size[a:b])
        out = np.zeros(b - a, np.int64)
        np.add.at(out, doc - a, weight[self.term[at]] * gain(self.tf[at], self.m[doc]))
        return out

    def search(self, wanted: dict[int, int], weight: np.ndarray, ids: list, best: list, top: int) -> list:
        """best, (-score, id is null, id) of documents so far, with those of this tree: the first `top`."""
        bound = self.bounds(wanted)
        stack = [0]
        while stack:
            node = stack.pop()
            low = -best[-1][0] if len(best) == top else 1
            if bound[node] < low:
                continue
            if self.children[node]:
                under = [c for c in self.children[node] if bound[c] >= low]
                stack += sorted(under, key=bound.__getitem__)
                continue
            score = self.scores(node, weight)
            some = np.flatnonzero(score >= low)
            if len(some):
                found = [(-int(score[i]), ids[d] is None, ids[d] or 0) for i, d in zip(some, self.order[self.lo[node] + some], strict=True)]
                best = heapq.nsmallest(top, best + found)
        return best


def searched(rows: DataFrame, plan, top: int) -> DataFrame:
    """FOUND: each task's best of rows(doc_id, m, terms, tfs) for each item of plan, a broadcast (items, weights, ranks)."""

    def look(batches):
        items, weights, rank = plan.value
        best: list[list] = [[] for _ in items]
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = [t[c].combine_chunks() for c in ("terms", "tfs")]
            tree = Tree(t["m"].to_numpy(), np.append(0, np.cumsum(pc.list_value_length(lists[0]).to_numpy())), lists[0].flatten().to_numpy().astype(np.int64), lists[1].flatten().to_numpy(), rank)
            ids = t["doc_id"].to_pylist()
            for i, (_, wanted) in enumerate(items):
                weight = np.zeros(len(weights), np.int64)
                for w, q in wanted.items():
                    weight[w] = weights[w] * q
                best[i] = tree.search({w: int(weights[w]) * q for w, q in wanted.items()}, weight, ids, best[i], top)
            held.clear()

        docs = postings = 0
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                held.append(part)
                docs, postings = docs + part.num_rows, postings + len(part.column(2).flatten())
                if docs >= DOCS or postings >= POSTINGS:
                    flush()
                    docs = postings = 0
        if held:
            flush()
        out = [(i, items[i][0], None if none else d, -s) for i, x in enumerate(best) for s, none, d in x]
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["item", "item_id", "doc_id", "score"])

    return rows.mapInArrow(look, FOUND)


def weight_of(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def ranked(docs: DataFrame, benchmark: DataFrame, top: int = 10, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of a score above 0 of each row of benchmark(item_id, text)."""
    spark = docs.sparkSession
    items = written(benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct(), "items")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    results = []
    for b in range(-(-size // block)):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(-(-size // block))) == b).orderBy("item_id", "text").collect()  # about `block` characters
        texts = [(r["item_id"], terms(r["text"])) for r in rows]
        known = sorted({t for _, ts in texts for t in ts})
        number = {t: i for i, t in enumerate(known)}
        if not known:
            continue
        vocabulary = spark.sparkContext.broadcast(known)
        vecs = written(vectors(docs, vocabulary), "vectors")
        documents, length = vecs.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = {r["t"]: r["count"] for r in vecs.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # one row a term of the block
        weights = np.array([weight_of(documents, df.get(i, 0)) for i in range(len(known))], np.int64)
        rank = np.empty(len(known), np.int64)
        rank[sorted(range(len(known)), key=lambda i: (-df.get(i, 0), i))] = np.arange(len(known))
        counted = [(i, reduce(lambda c, t: c | {number[t]: c.get(number[t], 0) + 1}, ts, {})) for i, ts in texts]
        plan = spark.sparkContext.broadcast((counted, weights, rank))
        m = F.expr(f"25 + ((cast(75 as decimal(2,0)) * cast(n as decimal(17,0)) * cast({documents} as decimal(17,0))) div {max(1, length or 0)})")
        found = written(searched(vecs.where("size(terms) > 0").select("doc_id", m.cast("long").alias("m"), "terms", "tfs"), plan, top), "found")
        results.append(found.withColumn("item", F.col("item").cast("long") + (b << 32)))
        for x in (vocabulary, plan):
            x.destroy()
        dropped(vecs)
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out = reduce(DataFrame.unionByName, results).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as ts from documents),
 s as (select r, doc_id, len(ts)::bigint as n from d where len(ts) > 0),
 g as (select count(*)::bigint as nn, sum(n)::bigint as l from s),
 m as (select r, doc_id, 25 + ((75 * n * nn) // l) as m from s, g),
 tf as (select r, term, count(*) as tf from (select r, unnest(ts) as term from d) group by all),
 i as (select item_id, term, count(*) as q from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
 w as (select term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tf group by term), g),
 x as (select i.item_id, m.r, m.doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
   from i join w on w.term = i.term join tf on tf.term = i.term join m on m.r = tf.r group by all),
 o as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from x where score > 0)
select item_id, rank::int as rank, doc_id, score from o where rank <= 10
"""

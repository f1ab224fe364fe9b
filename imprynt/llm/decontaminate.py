"""Operator 3, benchmark decontamination: q-gram lemma filtering in diagonal bands.

Texts are compared in lower case with runs of white space as one space. A benchmark text of m
characters is found where it aligns with a document's text in at most k edits (insertions, deletions,
substitutions), k = floor(EDITS * m), or less for short items: the most for which the bound below is
positive, so none is beyond the filter (items of 8 to 15 characters are found verbatim). By the
q-gram lemma such a place shares at least m + 1 - q - k * q of the item's q-grams, all on k + 1
neighbouring diagonals. So:

1. tasks look up the q-grams of document blocks in the benchmark's, and count hits for each
   (document, item, band); bands are 2k + 2 diagonals wide and overlap by half, so that one of them
   holds every hit of a place. Bands that reach the bound leave as small text regions;
2. regions are dealt out again (a passage in a third of all documents is not one task's work), meet
   their item by an equi-join and are verified by banded alignment.

The benchmark is read in blocks of at most BLOCK characters, one after the other, each block a
broadcast of bounded size that goes once its matches are written; a benchmark beyond one block takes
more passes over the documents. Where many items share q-grams, a megabyte of documents meets them in
parts of about HITS hits (or one item's), so that memory does not grow with what items share.

Null and empty texts match nothing. Items of fewer than q characters have no q-gram; they match
documents that hold nothing else. Repeated items and documents are allowed; rows of one
(doc_id, item_id) are merged into the one with fewest edits, then the smallest start (ties: the
smallest end). A long document is looked at as a whole in one task, in memory of a few times its
size. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprynt.llm.common import table, written

NAME = "op3_decontamination"
Q, EDITS, BLOCK = 8, 0.1, 4_000_000
BASE = 0x9E3779B97F4A7C15
BITS, SLOTS, HITS = 22, 1 << 21, 1 << 21
MATCH = "doc_id long, item_id long, start long, end long, edits int"


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int) -> int:
    return max(0, min(int(EDITS * m), (m - Q) // Q))


def grams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 8 characters from each place on."""
    h, width = chars.astype(np.uint64), 1
    while width < Q:
        h = h[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + h[width:] if len(h) > width else h[:0]
        width *= 2
    return h ^ h >> np.uint64(29)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


class Index:
    """The q-grams of one block of the benchmark, and the items that are too short to have any."""

    def __init__(self, items: list[tuple[int, str]]):
        self.short: dict[str, list[int]] = {}
        for i, t in items:
            if len(t) < Q:
                self.short.setdefault(t, []).append(i)
        items = [(i, t) for i, t in items if len(t) >= Q]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.length = np.array([len(t) for _, t in items], np.int64)
        self.edits = np.array([budget(len(t)) for _, t in items], np.int64)
        self.least = self.length + 1 - Q - self.edits * Q
        hashes = [np.zeros(0, np.uint64), *(grams(_codes(t)) for _, t in items)]
        self.hash = np.concatenate(hashes)
        self.item = np.repeat(np.arange(len(items)), [len(h) for h in hashes[1:]])
        self.at = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(self.hash, kind="stable")
        self.item, self.at = self.item[order], self.at[order]
        self.hash, rank, self.n = np.unique(self.hash[order], return_inverse=True, return_counts=True)
        self.rank = rank.reshape(-1)
        self.code = self.rank * len(items) + self.item  # in order: by q-gram, then by item
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.hash >> np.uint64(64 - BITS)] = True

    def shared(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in chars, number of the q-gram) where a q-gram is one of the benchmark's."""
        h = grams(chars)
        place = np.flatnonzero(self.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(self.hash):
            return (np.zeros(0, np.int64),) * 2
        at = np.minimum(np.searchsorted(self.hash, h[place]), len(self.hash) - 1)
        same = self.hash[at] == h[place]
        return place[same], at[same]

    def parts(self, gram: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of items that have about HITS hits each; an item with more stands alone."""
        if self.n[gram].sum() <= HITS:
            return [(0, len(self.ids))]
        met = np.bincount(gram, minlength=len(self.hash))
        hits = np.bincount(self.item, weights=met[self.rank], minlength=len(self.ids))
        part = (np.cumsum(hits) / HITS).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(self.ids)]
        return list(zip(cuts, cuts[1:], strict=False))

    def hits(self, place: np.ndarray, gram: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in chars, item, place in item) of every shared q-gram of the items from lo to hi."""
        first = np.searchsorted(self.code, gram * len(self.ids) + lo)
        n = np.searchsorted(self.code, gram * len(self.ids) + hi) - first
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(place, n), self.item[entry], self.at[entry]

    def regions(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, from, to) of the bands that reach the lemma's bound; texts in chars are set apart by gaps
        of a character that no text holds."""
        place, gram = self.shared(chars)
        found = [self._bands(*self.hits(place, gram, lo, hi)) for lo, hi in self.parts(gram)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _bands(self, place: np.ndarray, item: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide = self.edits[item] + 1
        band = (place - at + self.length[item]) // wide  # a text may start before its first character here
        key = np.concatenate([item << 40 | band, item << 40 | np.maximum(band - 1, 0)])
        slot = ((key >> 40) * 0x9E3779B1 + (key & (1 << 40) - 1)) & SLOTS - 1
        some = np.bincount(slot, minlength=SLOTS)[slot] >= self.least[key >> 40]  # several bands may share a slot
        key, at = key[some], np.concatenate([at, at])[some]
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        new = np.ones(len(key), bool)  # a q-gram of the item counts once in a band, however often it is met there
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
        key, n = np.unique(key[new], return_counts=True)
        item, band = key >> 40, key & (1 << 40) - 1
        full = n >= self.least[item]
        item, band = item[full], band[full]
        wide, lo = self.edits[item] + 1, band * (self.edits[item] + 1) - self.length[item]
        return item, lo - self.edits[item], lo + 2 * wide + self.length[item] + self.edits[item]


def candidates(docs: DataFrame, index, most: int = 1 << 20) -> DataFrame:
    """(doc_id, item_id, at, region): text regions of documents that may hold an item; index: a broadcast Index."""

    def flush(held: list[tuple[int, str]], out: list):
        for doc, text in held:
            if 0 < len(text) < Q:
                out += [(doc, i, 0, text) for i in index.value.short.get(text, ())]
        gap = "\0" * Q
        joined = gap.join(t for _, t in held) + gap
        starts = np.cumsum([0, *(len(t) + Q for _, t in held)])
        item, lo, hi = index.value.regions(_codes(joined))
        for j, a, b in zip(item, lo, hi, strict=True):
            # a band may reach beyond a text on either side: the region belongs to each text it touches
            first = max(0, int(np.searchsorted(starts, a, "right")) - 1)
            for d in range(first, len(held)):
                if starts[d] >= b:
                    break
                s, e = max(0, int(a - starts[d])), min(len(held[d][1]), int(b - starts[d]))
                if e - s >= index.value.length[j] - index.value.edits[j]:
                    out.append((held[d][0], int(index.value.ids[j]), s, held[d][1][s:e]))

    def look(batches):
        for b in batches:
            held, size, out = [], 0, []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append((doc, normalized(text.as_py())))
                size += len(held[-1][1])
                if size >= most:
                    flush(held, out)
                    held, size = [], 0
            if held:
                flush(held, out)
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "item_id", "at", "region"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, "doc_id long, item_id long, at long, region string")


def align(item: str, region: str, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of item's best place in region if that takes at most k edits: one row for each
    character of item, over the diagonals a place inside the region can use."""
    p, t = _codes(item), _codes(region)
    m, n = len(p), len(t)
    wide = n - m + 2 * k + 1  # diagonals -k .. n - m + k
    if wide <= 0:
        return None
    t = np.concatenate([np.full(k + 1, 0x110000, np.uint32), t, np.full(k + m + wide, 0x110000, np.uint32)])
    far, at = m + k + 9, np.arange(wide)
    inside = lambda i: (at - k + i >= 0) & (at - k + i <= n)
    cost, start = np.where(inside(0), 0, far), at - k
    for i in range(1, m + 1):
        same = cost + (t[at + i] != p[i - 1])  # t[at + i] is the region's character at + i - 1 - k
        gone = np.append(cost[1:], far) + 1
        new, began = np.where(gone < same, gone, same), np.where(gone < same, np.append(start[1:], 0), start)
        new = np.where(inside(i), new, far)
        low = np.minimum.accumulate(new - at)
        by = np.maximum.accumulate(np.where(new - at == low, at, 0))
        cost, start = low + at, began[by]
        if cost.min() > k:
            return None
    best = int(np.argmin(cost))
    return int(cost[best]), int(start[best]), best - k + m


def verified(regions: DataFrame, items: DataFrame) -> DataFrame:
    """MATCH rows of the regions that hold their item within its budget."""

    def check(batches):
        for b in batches:
            found = []
            for doc, item, at, region, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = budget(len(text))
                where = region.find(text)
                hit = (0, where, where + len(text)) if where >= 0 else align(text, region, k)
                if hit and hit[0] <= k:
                    found.append((doc, item, at + hit[1], at + hit[2], hit[0]))
            cols = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.int32()), strict=True)], ["doc_id", "item_id", "start", "end", "edits"])

    met = regions.join(items, "item_id").select("doc_id", "item_id", "at", "region", "item")
    return met.repartition(F.xxhash64("doc_id", "item_id", "at")).mapInArrow(check, MATCH)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """MATCH: for each document and benchmark item that it holds, the best place (in normalised text)."""
    spark = docs.sparkSession

    def clean(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([normalized(t) for t in b.column(1).to_pylist()], pa.string())], ["item_id", "item"])

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(clean, "item_id long, item string").where(F.length("item") > 0)
    items = written(items.dropDuplicates(), "items")
    size = items.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks, found = -(-size // BLOCK), None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item_id", "item").collect()  # about BLOCK characters
        if not rows:
            continue
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["item"]) for r in rows]))
        hits = verified(candidates(docs, index), items)
        if blocks > 1:
            hits = written(hits, "matches")
            index.destroy()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], MATCH)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "end")).alias("b")).select("doc_id", "item_id", "b.start", "b.end", "b.edits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Operator 2, SimHash near-dedup: Golay-code keys find fingerprints that differ in few bits.

The 64 bits are three segments of 22, 21 and 21 bits, each a word of the perfect (23, 12) Golay
code with leading zeros. Let two fingerprints differ in at most 4 bits. The segment with most
errors has at least 2 of 4, so some two segments differ in at most 2 bits together; on those 43 or
42 bits there is a midpoint at most one bit from either. Decoding is exact (every word lies within
3 bits of one codeword), so both fingerprints hold the midpoint's pair of codeword indices among
the keys that decoding their own one-bit neighbourhood gives. Keys: at most 11 for each of three
pairs of segments, 24 bits each. What shares a key is verified on all 64 bits.

A key that more than SMALL fingerprints share is made longer, by what the pigeonhole leaves for its
other errors: if the pair of segments holds two, the third segment holds at most two, and both
fingerprints have a codeword index of its own one-bit neighbourhood in common; if it holds one or
none, one of its segments is the same in both, bit for bit. So each entry of such a key becomes up
to eight of 36 or more bits, and no link is lost: the number of candidates of a fingerprint stays
about the same until far more than 10^9 different ones.

Copies share a fingerprint and are one node. A longer key that more than SMALL fingerprints still
share - near copies of one text - is dealt into blocks of BLOCK; every two blocks meet in a task of
their own and give a spanning forest of their links only, so no group is collected whole and no
group's pairs are all written.

near_duplicates() takes components of links, as fingerprints alone tell them. similar_groups() finds
texts whose sets of word shingles overlap by a stated share: fingerprints of their distinct words
only propose groups there, and the shingle sets decide.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imprynt.llm import oddsketch
from imprynt.llm.common import LOWER, byte_view, table, written
from imprynt.llm.components import components

NAME = "op2_simhash"
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SHIFTS, WIDTHS = (42, 21, 0), (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))
SMALL, BLOCK = 48, 2048
#: Texts of a group whose leaders are found by one task, shingles of what meets them in another, and bits that sketches
#: of texts with a Jaccard coefficient of 0.8 never differ in (55 on average, standard deviation 9).
BATCH, SHINGLES, FAR = 1024, 2_000_000, 100


def simhash(text: bytes, words: int = 4) -> int:
    """The fingerprint of UTF-8 text; 0 without words."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    total, n = np.zeros(64, np.int64), max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, 50_000):
        h = np.array([digest(b" ".join(w[i : i + words]), 42) for i in range(lo, min(n, lo + 50_000))], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (total * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(id, fp): doc_id and fingerprint (as a signed long) of each row; null text counts as empty."""

    def hashed(batches):
        for b in batches:
            body, at = byte_view(b.column(1))
            raw = body.tobytes()
            fp = np.array([simhash(raw[at[i] : at[i + 1]], words) for i in range(b.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(hashed, "id long, fp long")


# ---- Golay keys


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by GENERATOR."""
    out = words.copy()
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _decoder() -> np.ndarray:
    """For each syndrome the error pattern of weight 3 at most: 1 + 23 + 253 + 1771 = 2048 of them."""
    errors = np.array([sum(1 << b for b in c) for k in range(4) for c in combinations(range(23), k)], np.int64)
    table = np.full(2048, -1, np.int64)
    table[_syndromes(errors)] = errors
    assert (table >= 0).all()
    return table


ERRORS = _decoder()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[_syndromes(words)]) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for unsigned fingerprints: the keys of every one-bit neighbourhood, distinct in a row."""
    seg = [(fp >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS, strict=True)]
    own = [decode(s) for s in seg]
    near = [decode(s[:, None] ^ (1 << np.arange(w))[None, :]) for s, w in zip(seg, WIDTHS, strict=True)]
    rows, out = [], []
    each = np.arange(len(fp))
    for p, (a, b) in enumerate(PAIRS):
        both = np.concatenate([(own[a] << 12 | own[b])[:, None], near[a] << 12 | own[b][:, None], own[a][:, None] << 12 | near[b]], axis=1) | p << 24
        both.sort(axis=1)
        new = np.ones(both.shape, bool)
        new[:, 1:] = both[:, 1:] != both[:, :-1]
        rows.append(np.broadcast_to(each[:, None], both.shape)[new])
        out.append(both[new])
    return np.concatenate(rows), np.concatenate(out)


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp) of distinct fingerprints."""

    def emit(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 4096):
                rows, k = keys(fp[lo : lo + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(fp[lo : lo + 4096][rows])], ["key", "fp"])

    return fps.select("fp").mapInArrow(emit, "key int, fp long")


# ---- links


def _forest(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between (and, where a is b, within) two blocks."""
    same = a is b
    left, right, top = [], [], {}

    def root(x):
        while top.get(x, x) != x:
            top[x] = top.get(top[x], top[x])
            x = top[x]
        return x

    for i, x in enumerate(a):
        other = b[i + 1 :] if same else b
        for y in other[np.bitwise_count(other ^ x) <= most]:
            if y != x and (p := root(int(x))) != (q := root(int(y))):
                top[max(p, q)] = min(p, q)
                left.append(x)
                right.append(y)
    return np.array(left, np.uint64), np.array(right, np.uint64)


def longer(pairs: DataFrame) -> DataFrame:
    """(key, fp) of keyed() with longer keys, so that what shares a key and is within four bits shares a longer one."""

    def emit(batches):
        for b in batches:
            key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for lo in range(0, len(fp), 1 << 14):
                k, f = key[lo : lo + (1 << 14)].astype(np.int64), fp[lo : lo + (1 << 14)]
                rows, out = _longer(k, f.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(f[rows])], ["key", "fp"])

    return pairs.select("key", "fp").mapInArrow(emit, "key long, fp long")


def _longer(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, longer key) of keys and their fingerprints: key, kind and value side by side."""
    seg = np.stack([(fp >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS, strict=True)])
    each, rows, out = np.arange(len(fp)), [], []
    for p, (a, b) in enumerate(PAIRS):
        own = each[key >> 24 == p]
        c = 3 - a - b
        word = seg[c][own]
        near = decode(np.concatenate([word[:, None], word[:, None] ^ (1 << np.arange(WIDTHS[c]))[None, :]], axis=1))
        near.sort(axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        for kind, at, value in ((0, np.broadcast_to(own[:, None], near.shape)[new], near[new]), (1, own, seg[a][own]), (2, own, seg[b][own])):
            rows.append(at)
            out.append((key[at] << 2 | kind) << 23 | value)
    return np.concatenate(rows), np.concatenate(out)


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """(u, v): links between distinct fingerprints that differ in at most `most` <= 4 bits; the
    components are those of all such links."""

    def met(pairs: DataFrame) -> DataFrame:
        b = pairs.select("key", F.col("fp").alias("other"))
        near = pairs.join(b, "key").where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most))
        return near.select(F.col("fp").alias("u"), F.col("other").alias("v")).distinct()

    def large(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("key").count().where(F.col("count") > SMALL)

    pairs = written(keyed(fps), "keys")
    many = written(large(pairs), "keys_many").select("key")
    refined = written(longer(pairs.join(many, "key")), "keys_longer")
    hot = written(large(refined), "keys_hot").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))

    dealt = refined.join(hot, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    two = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    two = two.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "fp")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        fp, block = frame["fp"].to_numpy().view(np.uint64), frame["block"].to_numpy()
        left = np.sort(fp[block == i])
        u, v = _forest(left, left if i == j else np.sort(fp[block == j]), most)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    forests = two.groupBy("key", "i", "j").applyInPandas(meet, "u long, v long")
    return met(pairs.join(many, "key", "left_anti")).unionByName(met(refined.join(hot, "key", "left_anti"))).unionByName(forests)


def near_duplicates(docs: DataFrame, most: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and doc_ids
    give a row each. Null doc_ids are never a component_id unless a component has no other. A bit that
    half of the shingles set (a tie) is 0. A very long text is hashed in pieces in one task. Other
    columns play no part.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes, most))
    lead = nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = lead.groupBy("root").agg(F.min("least").alias("component_id"))
    named = lead.join(best, "root").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- groups of similar texts


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def word_fingerprints(docs: DataFrame) -> DataFrame:
    """(id, place, sig, fp, fp2) of docs(id, place, text): a hash of the text's words in order, and two independent
    fingerprints of its distinct words."""

    def hashed(batches):
        for b in batches:
            body, at = byte_view(b.column(2))
            raw, out, sig = body.tobytes(), np.zeros((b.num_rows, 2), np.uint64), []
            for i in range(b.num_rows):
                w = _words(raw[at[i] : at[i + 1]])
                sig.append(xxhash.xxh3_64_intdigest(b" ".join(w)) - (1 << 63))
                own, total = list(set(w)), np.zeros(128, np.int64)
                for lo in range(0, len(own), 50_000):
                    h = b"".join(map(xxhash.xxh3_128_digest, own[lo : lo + 50_000]))
                    total += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(total * 2 > len(own)).view(np.uint64)
            fps = out.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sig), pa.array(fps[:, 0]), pa.array(fps[:, 1])], ["id", "place", "sig", "fp", "fp2"])

    kind = docs.schema["place"].dataType.simpleString()
    return docs.select("id", "place", "text").mapInArrow(hashed, f"id long, place {kind}, sig long, fp long, fp2 long")


def shingles(text: str | None, words: int) -> set[int]:
    w = _words((text or "").encode())
    return {xxhash.xxh3_64_intdigest(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))} if w else set()


def described(texts: DataFrame, words: int) -> DataFrame:
    """(root, place, id, n, sketch, set) of texts(root, place, id, text): the shingle set of each, its size and odd sketch;
    a text without words has the empty set."""

    def look(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [np.zeros(0, np.uint64)] * part.num_rows
                for i, own in oddsketch.shingle_sets(part.column(3), words):
                    sets[i] = own
                odd = oddsketch.sketches(np.stack([oddsketch.samples(s) for s in sets])).view(np.int64)
                offsets = pa.array(np.append(0, np.cumsum([len(s) for s in sets])), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(s) for s in sets], pa.int32()), *(pa.array(np.ascontiguousarray(odd[:, k])) for k in range(odd.shape[1])), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], ["root", "place", "id", "n", *oddsketch.SKETCH, "set"])

    kind = texts.schema["place"].dataType.simpleString()
    return texts.select("root", "place", "id", "text").mapInArrow(look, f"root long, place {kind}, id long, n int, {', '.join(f'{c} long' for c in oddsketch.SKETCH)}, set array<bigint>")


class Leaders:
    """Texts that lead, in order of place; first_like() is the first that a text is like, exactly: sketches only leave
    out pairs that are five standard deviations from the limit."""

    def __init__(self, least: float):
        self.least, self.ids, self.sets = least, [], []
        self.n, self.odd = np.zeros(64, np.int64), np.zeros((64, len(oddsketch.SKETCH)), np.uint64)

    def add(self, id_: int, odd: np.ndarray, own: np.ndarray) -> None:
        k = len(self.ids)
        if k == len(self.n):
            self.n, self.odd = np.concatenate([self.n, self.n]), np.concatenate([self.odd, self.odd])
        self.n[k], self.odd[k] = len(own), odd
        self.ids.append(id_)
        self.sets.append(own)

    def first_like(self, odd: np.ndarray, own: np.ndarray) -> int | None:
        k = len(self.ids)
        n = self.n[:k]
        near = (np.minimum(n, len(own)) >= self.least * np.maximum(n, len(own))) & (np.bitwise_count(self.odd[:k] ^ odd).sum(axis=1) <= FAR)
        for i in np.flatnonzero(near):
            both = len(np.intersect1d(own, self.sets[i], assume_unique=True))
            if both >= self.least * (n[i] + len(own) - both):
                return self.ids[i]
        return None


def similar_groups(docs: DataFrame, least: float = 0.8, words: int = 5, batch: int = BATCH) -> DataFrame:
    """(id, leader) of every row of docs(id, place, text): the id of its group's first text by place.

    A text belongs to a leader if their sets of `words`-word shingles (fewer words: the whole text) have a Jaccard
    coefficient of `least` or more, or both have no word; a leader belongs to no earlier leader. So no text is
    grouped with one that is unlike it, however long a chain between them. Texts whose distinct-word fingerprints are
    not linked, directly or over others, are not compared. Ids are unique but for copies of a row; null texts have no
    word. Places are unique but for copies of a text; they tell which of several texts leads.

    Proposed groups are settled in rounds. In each, one task a group finds the leaders among the first `batch` texts
    left; what else is left of the group is dealt into blocks, and every block meets those leaders in a task of its own.
    A group of at most `batch` texts takes one round, any other one for every `batch` texts that are unlike all before.
    """
    rows = written(word_fingerprints(docs), "word_fingerprints")
    node = ["sig", "fp", "fp2"]
    nodes = written(rows.groupBy(*node).agg(F.min(F.struct("place", "id")).alias("first")), "nodes")
    apart = F.lit(0x5851F42D4C957F2D)  # tells the second fingerprints from the first; a chance match would only propose a group
    edges = [nodes.select(F.col("fp").alias("u"), F.col("fp2").bitwiseXOR(apart).alias("v"))]
    for name, flip in (("fp", F.lit(0)), ("fp2", apart)):
        near = links(nodes.select(F.col(name).alias("fp")).distinct())
        edges.append(near.select(F.col("u").bitwiseXOR(flip).alias("u"), F.col("v").bitwiseXOR(flip).alias("v")))
    roots = components(edges[0].unionByName(edges[1]).unionByName(edges[2])).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    named = written(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    several = written(named.groupBy("root").count().where("count > 1").select("root"), "several")
    proposed = named.join(several, "root").select("root", "first.place", "first.id")
    left = written(described(proposed.join(docs.select("id", "text").dropDuplicates(["id"]), "id"), words), "proposed")
    done = []
    narrow = ["root", "id", *oddsketch.SKETCH, "set"]

    def lead(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", ignore_index=True)
        leaders, out = Leaders(least), []
        for id_, odd, own in zip(frame["id"], frame[oddsketch.SKETCH].to_numpy().view(np.uint64), frame["set"], strict=True):
            to = leaders.first_like(odd, own)
            if to is None:
                leaders.add(id_, odd, own)
            out.append(id_ if to is None else to)
        return pd.DataFrame({"id": frame["id"], "leader": out})

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        leaders = Leaders(least)
        odd, lead_ = frame[oddsketch.SKETCH].to_numpy().view(np.uint64), frame["rank"].to_numpy()
        for i in np.argsort(lead_, kind="stable"):
            if lead_[i]:
                leaders.add(frame["id"].iloc[i], odd[i], frame["set"].iloc[i])
        own = np.flatnonzero(lead_ == 0)
        return pd.DataFrame({"id": frame["id"].to_numpy()[own], "leader": pd.array([leaders.first_like(odd[i], frame["set"].iloc[i]) for i in own], "Int64")})

    while True:
        order = Window.partitionBy("root").orderBy("place", "id")
        first = written(left.select("root", "place", "id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= batch).select("id", "rank"), "firsts")
        led = written(left.join(first, "id").select(*narrow, "rank").groupBy("root").applyInPandas(lead, "id long, leader long"), "led")
        done.append(led)
        rest = left.join(first, "id", "left_anti")
        size = written(rest.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / batch), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks")), "rest")
        if size.isEmpty():
            break
        leaders = left.join(first, "id").join(led.where("id = leader").select("id"), "id").join(size, "root").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*narrow, "rank", "block")
        dealt = rest.join(size, "root").select(*narrow, F.lit(0).alias("rank"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        met = written(dealt.unionByName(leaders).groupBy("root", "block").applyInPandas(follow, "id long, leader long"), "met")
        done.append(met.where("leader is not null"))
        left = written(left.join(met.where("leader is null").select("id"), "id", "left_semi"), "left")
    every = done[0]
    for t in done[1:]:
        every = every.unionByName(t)
    alone = named.join(several, "root", "left_anti").select(*node, F.col("first.id").alias("leader"))
    led = named.join(several, "root").select(*node, F.col("first.id").alias("id")).join(every, "id").select(*node, "leader")
    return rows.join(alone.unionByName(led), node).select("id", "leader")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

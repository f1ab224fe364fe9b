"""Operator 4, quality classifier: interpolated modified Kneser-Ney over bytes, trained on trusted text.

Trusted texts are documents labelled quality = 1 and not toxic. The model is over the UTF-8 bytes
of a text (so it knows every alphabet), ORDER bytes long, with Chen and Goodman's three discounts
for each order. Counts of counts, continuation counts, context sums and the interpolation are
Spark aggregations and joins on n-gram codes over all trusted text.

Documents are packed once, without a shuffle, into blocks of about BLOCK bytes, in a table bucketed
by block, so that what joins a block moves and the texts do not. Scoring is joins of counts with the
model by n-gram code: a block sends each n-gram it holds once; the n-grams of all blocks, each once,
meet the model's orders from the longest to the shortest, adding back-off weights where one is
missing (orders 1 and 2, at most 65,792 rows, are broadcast; the others are dealt by code like any
join, and AQE can split a frequent one); the answers go back to the blocks, which sum them up for
each document. Nothing of the model passes through the driver but discounts and limits.

One in HELD_OUT trusted documents is kept out of training and sets the limits. A document is kept
if its perplexity is at most its language's limit: the QUANTILE of the held-out documents'
perplexities in that language (over bins of BIN in log2), widened by SPREAD times the distance from
their median to it. Languages of fewer than FEW held-out documents, and null, use the limit over
all of them.

Null or empty text has no perplexity and is not kept. Every row gives a row; equal rows give equal
ones. A very long text is a block of its own. Without trusted text the model is uniform and every
document with text is kept. Other columns play no part.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imprynt.llm.common import byte_view, runs, shared_dir, table, written

NAME = "op4_quality"
ORDER, BLOCK, PIECE = 5, 32 << 20, 4 << 20
QUANTILE, SPREAD, BIN, FEW, HELD_OUT = 0.98, 0.5, 1 / 256, 20, 5
PACKED = "ids array<long>, hashes array<long>, langs array<string>, sizes array<long>, counts array<long>, bodies array<binary>"


# ---- blocks


def blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, lang, text) packed: one row (block, PACKED) for about BLOCK bytes of consecutive texts, in a table
    bucketed by block; bodies are their UTF-8 in pieces of about PIECE bytes, compressed, counts the texts of each piece,
    sizes are in bytes."""
    spark, codec = docs.sparkSession, "zstd"

    def pack(batches):
        kind = pa.schema([("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("bodies", pa.list_(pa.binary()))])
        held, size = [], 0

        def row():
            ids, hashes, langs, sizes, bodies = zip(*held, strict=True)
            lists = [pa.array([sum((c.to_pylist() for c in x), [])], kind.field(n).type) for x, n in ((ids, "ids"), (hashes, "hashes"), (langs, "langs"))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([np.concatenate(sizes)], kind.field("sizes").type), pa.array([[len(x) for x in sizes]], kind.field("counts").type), pa.array([bodies], kind.field("bodies").type)], schema=kind)

        for b in batches:
            body, at = byte_view(b.column(3))
            for lo, hi in runs(at, PIECE):
                # at once: what waits for its block is compressed
                held.append((*(b.column(i)[lo:hi] for i in range(3)), np.diff(at[lo : hi + 1]), pa.compress(body[at[lo] : at[hi]].tobytes(), codec, asbytes=True)))
                size += int(at[hi] - at[lo])
                if size >= BLOCK:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    packed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.col("lang").cast("string"), "text").mapInArrow(pack, PACKED)
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.withColumn("block", F.monotonically_increasing_id()).write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out._imprynt_table = name
    return out


def _texts(b, i: int):
    """(place of the first, bytes, offsets) of each piece of a block's texts, one decompressed at a time."""
    sizes, first = _column(b, "sizes", i), 0
    for n, body in zip(b.column("counts")[i].as_py(), b.column("bodies")[i].values, strict=True):
        at = np.concatenate([[0], np.cumsum(sizes[first : first + n])]).astype(np.int64)
        yield first, np.frombuffer(pa.decompress(body.as_buffer(), int(at[-1]), "zstd", asbytes=True), np.uint8), at
        first += n


def _column(b, name: str, i: int) -> np.ndarray:
    return b.column(name)[i].values.to_numpy(zero_copy_only=False)


# ---- n-grams


def codes(body: np.ndarray, n: int) -> np.ndarray:
    """The n-byte code that ends at each byte from the (n - 1)-th on."""
    out = body[: len(body) - n + 1].astype(np.int64)
    for i in range(1, n):
        out = out << 8 | body[i : len(body) - n + 1 + i]
    return out


def _starts(at: np.ndarray, n: int) -> np.ndarray:
    """Mask, over codes(body, n) of several texts, of n-grams that lie inside one text."""
    inside = np.ones(max(0, int(at[-1]) - n + 1), bool)
    for a in at[1:-1]:
        inside[max(0, a - n + 1) : a] = False
    return inside


def _code_runs(body: np.ndarray, at: np.ndarray, order: int, most: int = 1 << 20):
    """(codes, text of each) of every position of the texts, in pieces of about `most` bytes, which bound the memory of
    the codes; the first order - 1 bytes of a text are preceded by zero bytes."""
    for lo, hi in runs(at, most):
        if at[hi] - at[lo] > 2 * most:  # one long text, in windows that overlap by what a code needs
            text = body[at[lo] : at[hi]]
            for i in range(0, len(text), most):
                window = np.concatenate([np.zeros(max(0, order - 1 - i), np.uint8), text[max(0, i - order + 1) : i + most]])
                code = codes(window, order)
                yield code, np.full(len(code), lo)
            continue
        padded, starts = _padded(body, at, lo, hi, order)
        if len(padded) >= order:
            yield codes(padded, order)[_starts(starts, order)], np.repeat(np.arange(lo, hi), np.maximum(starts[1:] - starts[:-1] - order + 1, 0))


def _distinct(arrays: list[np.ndarray]) -> np.ndarray:
    """The different values of some arrays, in order: by sorting, which needs no more than their own size again."""
    every = np.concatenate([np.zeros(0, np.int64), *arrays])
    every.sort()
    return every[np.append(True, every[1:] != every[:-1])] if len(every) else every


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) of some such pairs as one, in order of the codes."""
    code, c = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    if not len(code):
        return []
    order = np.argsort(code)
    code, c = code[order], c[order]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return [(code[at], np.add.reduceat(c, at))]


def _counts(found, most: int = 2_000_000):
    """Batches (code, c) that add up to how often each code occurs."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    batch = lambda code, c: pa.RecordBatch.from_arrays([pa.array(code), pa.array(c)], ["code", "c"])
    for code in found:
        held.append(np.unique(code, return_counts=True))
        if sum(len(x) for x, _ in held) > most + len(held[0][0]):
            held = _summed(held)
            if len(held[0][0]) > most:
                yield batch(*held.pop())
    for x in _summed(held):
        yield batch(*x)


def ngrams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, c): how often each string of `order` bytes occurs in texts(text)."""

    def count(batches):
        yield from _counts(code for b in batches for code, _ in _code_runs(*byte_view(b.column(0)), order))

    return texts.select("text").mapInArrow(count, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def ngrams_of(held: DataFrame, members: DataFrame, order: int = ORDER) -> DataFrame:
    """ngrams() of the texts that members(block, own: their places in it) names."""

    def count(batches):
        def found():
            for b in batches:
                for i in range(b.num_rows):
                    every = np.sort(_column(b, "own", i))
                    for first, body, at in _texts(b, i):
                        own = every[(every >= first) & (every < first + len(at) - 1)] - first
                        if len(own):
                            part = np.concatenate([[0], np.cumsum(at[own + 1] - at[own])])
                            chosen = np.concatenate([body[at[k] : at[k + 1]] for k in own])
                            yield from (code for code, _ in _code_runs(chosen, part, order))

        yield from _counts(found())

    met = held.select("block", "sizes", "counts", "bodies").join(members.hint("shuffle_hash"), "block").select("sizes", "counts", "bodies", "own")
    return met.mapInArrow(count, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def _padded(body: np.ndarray, at: np.ndarray, lo: int, hi: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts lo..hi one after the other, each behind order - 1 zero bytes, and their offsets."""
    size = at[lo + 1 : hi + 1] - at[lo:hi]
    starts = np.concatenate([[0], np.cumsum(size + order - 1)])
    out = np.zeros(starts[-1], np.uint8)
    shift = np.repeat((np.arange(hi - lo) + 1) * (order - 1), size)
    out[np.arange(at[hi] - at[lo]) + shift] = body[at[lo] : at[hi]]
    return out, starts


def _mask(n: int) -> int:
    return (1 << 8 * n) - 1


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of one order, from its counts of counts."""
    n = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


class Model:
    """For each order n: p[n](code, logp), natural, of a code's last byte after the others; back[n](code, logback), the
    weight that order n gives to the next shorter one after a context."""

    def __init__(self, order: int):
        self.order, self.p, self.back = order, {}, {}


def train(top: DataFrame, order: int = ORDER) -> Model:
    """The model of n-gram counts top(code, c) of the longest order."""
    counts, model, below = {order: written(top, "ngrams")}, Model(order), None
    for n in range(order - 1, 0, -1):  # in how many ways an n-gram goes on to the left
        counts[n] = written(counts[n + 1].groupBy((F.col("code").bitwiseAND(F.lit(_mask(n)))).alias("code")).agg(F.count("*").alias("c")), f"continued{n}")
    for n in range(1, order + 1):
        d1, d2, d3 = _discounts(counts[n])
        c = F.col("c")
        taken = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        rows = counts[n].select("code", "c", F.shiftrightunsigned("code", 8).alias("ctx"), taken.alias("d"))
        # a table of its own: rows of one context can then be split where they meet its sums
        sums = written(rows.groupBy("ctx").agg(F.sum("c").alias("s"), F.sum("d").alias("t")), f"contexts{n}")
        p = rows.join(sums, "ctx").select("code", ((c - F.col("d")) / F.col("s")).alias("own"), (F.col("t") / F.col("s")).alias("back"))
        if below is None:
            p = p.select("code", (F.col("own") + F.col("back") / 256).alias("p"))
        else:
            p = p.withColumn("low", F.col("code").bitwiseAND(F.lit(_mask(n - 1)))).join(below.select(F.col("code").alias("low"), F.col("p").alias("q")), "low")
            p = p.select("code", (F.col("own") + F.col("back") * F.col("q")).alias("p"))
        below = written(p, f"p{n}")
        model.p[n] = below.select("code", F.log("p").alias("logp"))
        model.back[n] = sums.select(F.col("ctx").alias("code"), F.log(F.col("t") / F.col("s")).alias("logback"))
    return model


def log_probabilities(found: DataFrame, model: Model) -> DataFrame:
    """(code, logp) of found(code), distinct codes of the longest order: the longest order that knows one gives its
    probability, times the back-off weights of the orders that do not."""
    out = found.select("code", F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("logp"))
    small = F.broadcast  # orders 1 and 2: at most 256 + 65,536 rows, and 1 + 256 contexts
    for n in range(model.order, 0, -1):
        p, back = (t.select(F.col("code").alias(k), v) for t, k, v in ((model.p[n], "__p", "logp"), (model.back[n], "__b", "logback")))
        p = p.withColumnRenamed("logp", "own")
        p, back = (small(p), small(back)) if n <= 2 else (p, back)
        now = F.col("code").bitwiseAND(F.lit(_mask(n)))
        met = out.join(p, now == F.col("__p"), "left").join(back, F.shiftrightunsigned(now, 8) == F.col("__b"), "left")
        out = met.select("code", (F.col("weight") + F.coalesce("logback", F.lit(0.0))).alias("weight"), F.coalesce("logp", F.col("weight") + F.col("own")).alias("logp"))
    return out.select("code", F.coalesce("logp", F.col("weight") - float(np.log(256))).alias("logp"))


def scores(held: DataFrame, model: Model) -> DataFrame:
    """(doc_id, h, lang, bytes, bits) of every text of the blocks: h hashes the text, bits is log2 of the perplexity, per byte."""
    order = model.order

    def distinct(batches):
        for b in batches:
            for i in range(b.num_rows):
                held_ = [np.zeros(0, np.int64)]
                for _, body, at in _texts(b, i):
                    for more, _ in _code_runs(body, at, order):
                        held_.append(_distinct([more]))
                        if sum(map(len, held_)) > 1_500_000 + 2 * len(held_[0]):
                            held_ = [_distinct(held_)]
                code = _distinct(held_)
                for lo in range(0, len(code), 100_000):
                    own = code[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b.column("block")[i].as_py(), np.int64)), pa.array(own)], ["block", "code"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known, logp = right["code"].to_numpy(), right["logp"].to_numpy()
        order_ = np.argsort(known)
        known, logp = known[order_], logp[order_]
        out = []
        for i in range(left.num_rows):
            size = _column(left, "sizes", i)
            total = np.zeros(len(size))
            for base, body, at in _texts(left, i):
                for code, doc in _code_runs(body, at, order):
                    first = doc[0] if len(doc) else 0
                    own, where = np.unique(code, return_inverse=True)  # in order, they are found side by side
                    part = np.bincount(doc - first, logp[np.searchsorted(known, own)][where])
                    total[base + first : base + first + len(part)] += part
            bits = pa.array(-total / np.maximum(size, 1) / np.log(2), mask=size == 0)
            out.append(pa.table([*(pa.concat_arrays([left.column(c)[i].values]) for c in ("ids", "hashes", "langs")), pa.array(size), bits], ["doc_id", "h", "lang", "bytes", "bits"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64())], ["doc_id", "h", "lang", "bytes", "bits"])

    need = written(held.select("block", "sizes", "counts", "bodies").mapInArrow(distinct, "block long, code long"), "block_ngrams")
    known = written(log_probabilities(need.select("code").distinct(), model), "block_logps")
    answers = need.join(known, "code").select("block", "code", F.col("logp").cast("float").alias("logp"))
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, h long, lang string, bytes long, bits double")


def limits(trusted: DataFrame, quantile: float = QUANTILE, spread: float = SPREAD) -> tuple[DataFrame, float]:
    """(lang, most): the limit in bits of each language with enough trusted(lang, bits); and the limit over all."""
    bins = trusted.where("bits is not null").groupBy("lang", F.ceil(F.col("bits") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    bins = written(bins.withColumn("every", F.lit(0)), "bins")

    def of(key: str, few: int) -> DataFrame:
        own = Window.partitionBy(key)
        summed = bins.groupBy(key, "bin").agg(F.sum("n").alias("n"))
        ranked = summed.withColumn("below", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own)).where(F.col("all") >= few)
        at = lambda q: F.min(F.when(F.col("below") >= F.col("all") * q, F.col("bin")))
        return ranked.groupBy(key).agg(((at(quantile) + spread * (at(quantile) - at(0.5))) * BIN).alias("most"))

    every = of("every", 1).first()
    return of("lang", FEW).where("lang is not null"), every["most"] if every else float("inf")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, spread: float = SPREAD) -> DataFrame:
    """(doc_id, h, lang, bytes, perplexity, most, keep) of every row of docs; h is xxhash64 of the text."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.coalesce(F.max("toxic"), F.lit(0)).alias("t")).where("q = 1 and t = 0").select("doc_id")
    aside = F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0
    held = blocks(docs)
    places = held.select("block", F.posexplode("ids").alias("place", "doc_id")).join(good.where(~aside), "doc_id", "left_semi")
    model = train(ngrams_of(held, places.groupBy("block").agg(F.collect_list("place").alias("own")), order), order)
    scored = written(scores(held, model), "scores")
    docs.sparkSession.sql(f"drop table {held._imprynt_table}")  # its name: the files stay with the others of the run
    per, every = limits(scored.join(good.where(aside), "doc_id", "left_semi"), quantile, spread)
    out = scored.join(per, "lang", "left").withColumn("most", F.coalesce("most", F.lit(every)))
    keep = (F.col("bits") <= F.col("most")) & (F.col("bytes") > 0)
    return out.select("doc_id", "h", "lang", "bytes", F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "most").alias("most"), F.coalesce(keep, F.lit(False)).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

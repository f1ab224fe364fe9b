"""Operator 6, best-fit packing: documents into as few sequences of `size` tokens as possible.

Tokens are made once, in tasks. A document longer than `size` is cut so that only its first piece
may be shorter. From there on only piece lengths matter, and there are at most `size` of them, so
the plan is made on the histogram of lengths (at most `size` rows reach the driver, whatever the
corpus): a list of fillings, each with the number of sequences that use it. Pieces then take the
planned places by their rank among the pieces of their length; ranks are counted in shards, so a
length that a third of all pieces share is ranked by many tasks.

The plan is bin completion on that histogram: a sequence is filled around the largest length left by
an undominated filling, used as often as the lengths last; branches are pruned by the waste that a
better plan may have; best fit gives the first incumbent; meeting the lower bound ends the search.
Which fillings come first - long pieces with a little waste, or none at all - is tried in four ways.

Null and empty texts are one piece, the end token alone. Ties and repeated rows are pieces of their
own. A very long text is many pieces of one task. Other columns play no part. No rows: no result.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imprynt.llm.common import table, written

NAME = "op6_best_fit_packing"
VOCABULARY, SIZE, END = "byte_bpe_50k.json", 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLACKS, NODES = (16, 32, 40, 64), 4000


# ---- tokens


@cache
def _tokenizer(path: str):
    """ids(text) by the vocabulary at path. Beside it lies the same vocabulary as merge ranks: it gives
    the same ids several times faster, and serves texts of code points below 0x250 without special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    whole = lambda text: slow.encode(text, add_special_tokens=False).ids
    ranks_at = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_at):
        return whole
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_at, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = lambda text: (text.isascii() or max(text) < "ɐ") and not any(t in text for t in special)
    return lambda text: fast.encode_ordinary(text) if plain(text) else whole(text)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def pieces(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece of each row of docs, see PIECES; ids_crc32 is over little-endian 32-bit ids."""

    def cut(batches):
        encode = _tokenizer(vocabulary or default_vocabulary())
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                first = len(ids) % size or size
                at = [0, *range(first, len(ids), size)] if len(ids) > size else [0]
                for k, (lo, hi) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
                    for c, v in zip(out, (doc, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


# ---- the plan, on a histogram of lengths

Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing; sequences that hold the same lengths are one entry."""
    open_at: list[Counter] = [Counter() for _ in range(size + 1)]
    for l in sorted(counts, reverse=True):
        left, room = counts[l], l
        while left and room <= size:
            if not open_at[room]:
                room += 1
                continue
            filling, n = open_at[room].popitem()
            used = min(left, n)
            if n > used:
                open_at[room][filling] = n - used
            open_at[room - l][(*filling, l)] += used
            left, room = left - used, l
        each = size // l
        for n, k in ((left // each, each), (1, left % each)):
            if n and k:
                open_at[size - k * l][(l,) * k] += n
    return [(f, n) for room in open_at for f, n in room.items()]


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Sequences that any packing needs: over all k, those of pieces too long to stand with one of k or more, and
    what the pieces from k to half a sequence need beyond the room left beside the longer ones."""
    most = -(-sum(l * n for l, n in counts.items()) // size)
    for k in [0, *(l for l in counts if 2 * l <= size)]:
        alone = sum(n for l, n in counts.items() if l > size - k)
        half = sum(n for l, n in counts.items() if size < 2 * l <= 2 * (size - k))
        room = sum((size - l) * n for l, n in counts.items() if size < 2 * l <= 2 * (size - k))
        small = sum(l * n for l, n in counts.items() if k <= l and 2 * l <= size)
        most = max(most, alone + half + max(0, -(-(small - room) // size)))
    return most


def _dominated(counts: dict[int, int], every: int, chosen: tuple[int, ...], waste: int) -> bool:
    """Whether a piece left out fits beside chosen, or could stand for some of its pieces: whatever that other filling
    leaves over fits where the piece stood, so this one need not be tried. every: the lengths of counts, as bits."""
    single, several = 0, 0  # sums, as bits, of one piece of chosen and of several
    for c in chosen:
        several |= (single | several) << c
        single |= 1 << c
        if chosen.count(c) == counts[c]:
            every &= ~(1 << c)
    able = _smeared(several, waste + 1) | _smeared(single << 1, waste) | (1 << waste + 1) - 1
    return bool(every & able)


def _smeared(bits: int, n: int) -> int:
    """bits and their n - 1 next higher neighbours; nothing for n = 0."""
    wide = 1
    while wide < n:
        step = min(wide, n - wide)
        bits |= bits << step
        wide += step
    return bits if n else 0


def fillings(counts: dict[int, int], room: int, most: int, slack: int = 0):
    """(waste, filling): undominated multisets of lengths from counts that leave at most `most` of room; those that
    leave up to `slack` first, then by waste; of each kind those of longer pieces first. Sums that shorter pieces can
    make are known as bits, so that no step of the enumeration is in vain."""
    lengths = sorted(l for l in counts if l <= room)
    reach, before, mask = 1, [], (1 << room + 1) - 1
    for l in lengths:
        before.append(reach)
        left, k = min(counts[l], room // l), 1
        while left > 0:
            reach |= reach << min(k, left) * l & mask
            left, k = left - k, 2 * k

    def within(sums: int, lo: int, hi: int) -> bool:
        return hi >= 0 and sums >> max(lo, 0) & (1 << hi - max(lo, 0) + 1) - 1 > 0

    def of_sum(i: int, lo: int, hi: int):
        for j in range(i - 1, -1, -1):
            if not within(before[j + 1] if j + 1 < len(before) else reach, lo, hi):
                return
            l = lengths[j]
            for k in range(min(counts[l], hi // l), 0, -1):
                if within(before[j], lo - k * l, hi - k * l):
                    for sum_, more in of_sum(j, lo - k * l, hi - k * l):
                        yield sum_ + k * l, (l,) * k + more
        if lo <= 0:
            yield 0, ()

    most, every = min(most, room), sum(1 << l for l in counts)
    for least, last in [(0, min(slack, most)), *((w, w) for w in range(slack + 1, most + 1))]:
        if within(reach, room - last, room - least):
            for used, chosen in of_sum(len(lengths), room - last, room - least):
                if not _dominated(counts, every, chosen, room - used):
                    yield room - used, chosen


def _choice(counts: dict[int, int], size: int, most: int, slack: int, index: int):
    """The index-th way to go on: (filling around the largest length, how often, its waste), or None. Each filling is
    tried as often as the lengths last first, then ever less often."""
    top = max(counts)
    rest = {l: n - (l == top) for l, n in counts.items() if n > (l == top)}
    for waste, chosen in fillings(rest, size - top, most, slack):
        filling = (top, *chosen)
        n = min(counts[l] // k for l, k in Counter(filling).items())
        n = min(n, most // waste) if waste else n
        if index < n:
            return filling, n - index, waste
        index -= n
    return None


def completed(counts: dict[int, int], size: int, best: Plan, slack: int = 0, nodes: int = NODES) -> Plan:
    """Bin completion: depth-first over the fillings of the largest length left. A branch ends where its waste rules
    out a plan of fewer sequences than the best so far; the search ends when the lower bound is met or proven to be
    out of reach, or after `nodes` choices, which bounds its time and nothing else: best stays a whole plan."""
    counts = {l: n for l, n in counts.items() if n}
    total, bound = sum(l * n for l, n in counts.items()), lower_bound(counts, size)
    taken: list[tuple[tuple[int, ...], int, int, int]] = []
    waste, index = 0, 0

    def put(filling, n):
        for l in filling:
            counts[l] = counts.get(l, 0) + n
            if not counts[l]:
                del counts[l]

    while nodes and _sequences(best) > bound:
        nodes -= 1
        most = (_sequences(best) - 1) * size - total - waste
        if not counts and most >= 0:
            best = [(f, n) for f, n, _, _ in taken]
            continue
        way = _choice(counts, size, most, slack, index) if counts and most >= 0 else None
        if way:
            filling, n, left = way
            put(filling, -n)
            taken.append((filling, n, left, index))
            waste, index = waste + n * left, 0
        elif taken:
            filling, n, left, index = taken.pop()
            put(filling, n)
            waste, index = waste - n * left, index + 1
        else:
            break
    return best


def _sequences(plan: Plan) -> int:
    return sum(n for _, n in plan)


def make_plan(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Fillings that place every piece: bin completion with best fit as its first incumbent, once for each of SLACKS."""
    best = best_fit(counts, size)
    for slack in SLACKS:
        best = completed(counts, size, best, slack)
    return best


def places(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) for every place of the plan."""
    out, taken, base = [], Counter(), 0
    for filling, n in plan:
        at = 0
        for l in filling:
            out.append((l, taken[l], taken[l] + n, base, at))
            taken[l] += n
            at += l
        base += n
    return out


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut (as pieces() gives it, written) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    slots = places(make_plan(counts, size))
    shards = max(8, total // 20_000)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    before = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = before.select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("before"))
    at = spark.createDataFrame(slots, "length long, low long, high long, base long, offset long")
    out = ranked.alias("r").join(at.alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return out.select("doc_id", "piece", "start", "r.length", "ids_crc32", (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(written(pieces(table(spark, sf_dir, "documents")), "pieces"))

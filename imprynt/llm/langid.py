"""Operator 9, language ID: nearest of several clustered TF-IDF centroids, by cosine.

A text is its UTF-8 bytes with A-Z lower-cased and every other ASCII byte that is no letter made a
space; its vector counts byte trigrams in DIM hashed cells, weighted by log(1 + count) times the
cell's inverse document frequency and scaled to length one. Fitting, over rows of `train`:

1. document frequencies over all of them;
2. k-means++ seeds and a few spherical k-means rounds in each language, on a hash sample of about
   SAMPLE different texts a language (the one bounded step);
3. one round over all of them, which moves every centroid to the mean of its members and sets the
   rejection limit of each: the members' mean cosine less four standard deviations.

The model is languages x CLUSTERS x DIM floats, whatever the input's size: it grows with the number
of languages alone, 49 KB each.

Null text or text without a letter: `und`, score 0, not rejected. Ties: the smaller language name.
A null language is never learned; a null doc_id counts as the text ''. Repeated rows count again,
but for the sample, which takes a text once. Without any training row every text is `und`. A very
long text is one row's work. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprynt.llm.common import LOWER, byte_view, runs, table

NAME = "op9_language_id"
DIM, CLUSTERS, SAMPLE, ROUNDS = 4096, 3, 2000, 8
#: Letters lower-cased, bytes of other alphabets kept, the rest a space.
FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in LOWER], np.uint8)


def histograms(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Trigram counts (rows x DIM, float32) of the texts that byte_view() gave."""
    out = np.zeros((len(at) - 1, DIM), np.float32)
    folded = FOLD[body].astype(np.uint32)
    if len(folded) < 3:
        return out
    code = folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]
    cell = (code * np.uint32(2654435761)) >> np.uint32(32 - DIM.bit_length() + 1)
    blank = np.uint32(0x202020)
    for i in range(len(at) - 1):
        lo, hi = at[i], max(at[i], at[i + 1] - 2)
        own = cell[lo:hi]
        out[i] = np.bincount(own[code[lo:hi] != blank], minlength=DIM)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _parts(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """(first row, histograms) of a batch in pieces of bounded size."""
    body, at = byte_view(batch.column(column))
    for lo, hi in runs(at, most):
        for l2 in range(lo, hi, 512):
            h2 = min(hi, l2 + 512)
            yield l2, h2, histograms(body[at[l2] : at[h2]], at[l2 : h2 + 1] - at[l2])


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    chosen = [int(rng.integers(len(x)))]
    far = 1 - x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        p = np.maximum(far, 0)
        if not p.sum():
            break
        chosen.append(int(rng.choice(len(x), p=p / p.sum())))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    return x[chosen]


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; empty clusters are left out."""
    c = _seeds(x, k, np.random.default_rng(0))
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) for j in range(len(c)) if (own == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, limits: np.ndarray):
        self.idf, self.langs, self.centroids, self.limits = idf, langs, centroids, limits


def _cells(frame: DataFrame, name: str) -> np.ndarray:
    out = np.zeros(DIM, np.float64)
    for r in frame.collect():  # DIM rows at most
        out[r["cell"]] = r[name]
    return out


def fit(train: DataFrame) -> Model | None:
    """train(text, lang), lang not null."""
    h = F.xxhash64("text", F.lit(9))
    counts = train.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(h).alias("texts")).orderBy("lang").collect()  # a row a language
    sizes = {r["lang"]: r["texts"] for r in counts}
    if not sizes:
        return None

    def frequencies(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for _, _, h in _parts(b, 0):
                df += (h > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM, dtype=np.int32)), pa.array(df)], ["cell", "df"])

    df = _cells(train.select("text").mapInArrow(frequencies, "cell int, df long").groupBy("cell").agg(F.sum("df").alias("df")), "df")
    idf = (np.log((1 + sum(r["n"] for r in counts)) / (1 + df)) + 1).astype(np.float32)

    # of a language of up to 2 x SAMPLE texts all are taken: none is left without a sample
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(SAMPLE / v if v > 2 * SAMPLE else 1.0))])
    chosen = train.withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    # a text once: in two steps, so that copies meet as hashes and only one of them takes its text along
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def embed(batches):
        for b in batches:
            for lo, hi, h in _parts(b, 1):
                rows = pa.array([r.tobytes() for r in vectors(h, idf).astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], rows], ["lang", "v"])

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(sorted(frame["v"])), np.float16).reshape(-1, DIM).astype(np.float32)
        c = _cluster(x, CLUSTERS)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "j": range(len(c)), "c": [r.tobytes() for r in c.astype(np.float32)]})

    first = chosen.select("lang", "text").mapInArrow(embed, "lang string, v binary").groupBy("lang").applyInPandas(cluster, "lang string, j int, c binary")
    rows = sorted(first.collect(), key=lambda r: (r["lang"], r["j"]))  # CLUSTERS rows a language
    langs, start = [r["lang"] for r in rows], np.stack([np.frombuffer(r["c"], np.float32) for r in rows])
    of = {name: np.array([i for i, x in enumerate(langs) if x == name]) for name in set(langs)}

    def refine(batches):
        total, stats = np.zeros((len(langs), DIM)), np.zeros((len(langs), 3))
        for b in batches:
            names = b.column(0).to_pylist()
            for lo, hi, h in _parts(b, 1):
                v = vectors(h, idf)
                s = v @ start.T
                for r, name in enumerate(names[lo:hi]):
                    if name in of:
                        own = of[name][int(np.argmax(s[r, of[name]]))]
                        total[own] += v[r]
                        stats[own] += (1, s[r, own], s[r, own] ** 2)
        j = pa.array(np.arange(len(langs), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([j, pa.array([r.tobytes() for r in total.astype(np.float32)], pa.binary()), *(pa.array(stats[:, i]) for i in range(3))], ["j", "c", "n", "s", "ss"])

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(DIM)
        for r in frame["c"]:
            total += np.frombuffer(r, np.float32)
        return pd.DataFrame({"j": [frame["j"].iloc[0]], "c": [total.astype(np.float32).tobytes()], "n": [frame["n"].sum()], "s": [frame["s"].sum()], "ss": [frame["ss"].sum()]})

    # one row for each centroid and task, summed in two steps: a group holds about the square root of the tasks
    parts = train.select("lang", "text").mapInArrow(refine, "j int, c binary, n double, s double, ss double")
    parts = parts.withColumn("k", F.spark_partition_id() % 32).groupBy("j", "k").applyInPandas(lambda f: combine(f), "j int, c binary, n double, s double, ss double")
    moved = parts.groupBy("j").applyInPandas(combine, "j int, c binary, n double, s double, ss double").collect()
    centroids, limits = start.copy(), np.zeros(len(langs))
    for r in moved:
        c, n = np.frombuffer(r["c"], np.float32), max(r["n"], 1)
        if np.linalg.norm(c) > 0:
            centroids[r["j"]] = c / np.linalg.norm(c)
        limits[r["j"]] = r["s"] / n - 4 * np.sqrt(max(r["ss"] / n - (r["s"] / n) ** 2, 0))
    return Model(idf, langs, centroids, limits)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns in keep, lang_pred, score, rejected for every row of docs (with text)."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    base = docs.select(*keep, letter.alias("letter"), "text")
    if model is None:
        return base.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    n = len(keep)

    def apply(batches):
        for b in batches:
            if not b.num_rows:
                continue
            best, score = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for lo, hi, h in _parts(b, n + 1):
                s = vectors(h, model.idf) @ model.centroids.T
                best[lo:hi] = np.argmax(s, axis=1)
                score[lo:hi] = np.clip(s.max(axis=1), 0, 1)
            letter = b.column(n).to_numpy(zero_copy_only=False)
            pred = [model.langs[j] if x else "und" for j, x in zip(best, letter, strict=True)]
            score = np.where(letter, score, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(pred, pa.string()), pa.array(score), pa.array(letter & (score < model.limits[best]))], [*keep, "lang_pred", "score", "rejected"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return base.mapInArrow(apply, ", ".join([*kinds, "lang_pred string", "score double", "rejected boolean"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold % 5 == 0).alias("held_out"))
    model = fit(docs.where(~F.col("held_out") & F.col("lang").isNotNull()).select("text", "lang"))
    return predict(docs, model, ["doc_id", "held_out"])

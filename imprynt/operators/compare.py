"""Pairs of records: field by field, LoRA chains side by side, word differences."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare_fields(pairs: DataFrame, records: DataFrame, fields: list[str], key: str = "file_id") -> DataFrame:
    """(a_id, b_id, field, a, b, differs) for pairs(a_id, b_id); two nulls are equal."""
    one = lambda side: records.select(F.col(key).alias(f"{side}_id"), F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(c).cast("string") for c in fields))).alias(side))
    both = pairs.join(one("a"), "a_id").join(one("b"), "b_id")
    rows = both.select("a_id", "b_id", F.explode(F.array(*map(F.lit, fields))).alias("field"), "a", "b")
    return rows.select("a_id", "b_id", "field", F.col("a")[F.col("field")].alias("a"), F.col("b")[F.col("field")].alias("b")).withColumn("differs", ~F.col("a").eqNullSafe(F.col("b")))


def compare_loras(pairs: DataFrame, loras: DataFrame) -> DataFrame:
    """(a_id, b_id, name, nth, a_position, b_position, a_strength, b_strength, differs): uses aligned by name and how
    often it came before; what only one side has has nulls for the other."""
    n = F.row_number().over(Window.partitionBy("file_id", "name").orderBy("position"))
    used = loras.withColumn("nth", n).select("file_id", "name", "nth", "position", F.col("strength_model").alias("strength"))
    left = pairs.join(used.select(F.col("file_id").alias("a_id"), "name", "nth", F.col("position").alias("a_position"), F.col("strength").alias("a_strength")), "a_id")
    right = pairs.join(used.select(F.col("file_id").alias("b_id"), "name", "nth", F.col("position").alias("b_position"), F.col("strength").alias("b_strength")), "b_id")
    both = left.join(right, ["a_id", "b_id", "name", "nth"], "full_outer")
    return both.withColumn("differs", ~F.col("a_strength").eqNullSafe(F.col("b_strength")) | F.col("a_position").isNull() | F.col("b_position").isNull())


def stage_chains(stages: DataFrame) -> DataFrame:
    """(file_id, chain, base_model, lora_stack_key, stages): stages of one model and stack, in order of first appearance."""
    g = stages.groupBy("file_id", "base_model", "lora_stack_key").agg(F.array_sort(F.collect_list("stage_index")).alias("stages"))
    return g.withColumn("chain", F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("stages")[0])) - 1)


def disabled_loras(loras: DataFrame) -> DataFrame:
    return loras.where("not enabled").dropDuplicates(["file_id", "node_id", "entry"])


def texts_differ(a: str, b: str) -> Column:
    """Whether two texts differ in more than white space."""
    words = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(TOKENS.replace(r"|\s+", "")), F.lit(0))
    return words(a) != words(b)


#: Words, runs of white space, and single other characters.
TOKENS = r"[\p{L}\p{N}_'’-]+|\s+|[^\p{L}\p{N}_'’\s-]"
OPS = "array<struct<op:string,a:string,b:string>>"


def _aligned(x: np.ndarray, y: np.ndarray) -> list[tuple[str, int, int]]:
    """(op, place in x, place in y) along a longest common subsequence of two arrays of token numbers; where both
    ways are as long, the token of x goes first. Tables of suffix lengths are made a row at a time."""
    n, m = len(x), len(y)
    rows = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        row = np.maximum(rows[i + 1, :-1], np.where(y == x[i], rows[i + 1, 1:] + 1, 0))
        rows[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append(("same", i, j))
            i, j = i + 1, j + 1
        elif i < n and (j == m or rows[i + 1, j] >= rows[i, j + 1]):
            out.append(("removed", i, j))
            i += 1
        else:
            out.append(("added", i, j))
            j += 1
    return out


def compared(a: str, b: str, max_cells: int) -> tuple[list[dict], bool]:
    """(runs, coarse): runs of one kind in order, each with its text on both sides. White space equals white space; each side keeps
    its own. What both share at either end is not aligned; a middle of more than max_cells pairs is one block
    each, and coarse tells so."""
    ta, tb = regex.findall(TOKENS, a), regex.findall(TOKENS, b)
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(" " if t.isspace() else t, len(number)) for t in side], np.int64) for side in (ta, tb))
    short = min(len(x), len(y))
    unlike = np.flatnonzero(x[:short] != y[:short])
    lo = int(unlike[0]) if len(unlike) else short
    unlike = np.flatnonzero(x[lo:][::-1][: short - lo] != y[lo:][::-1][: short - lo])
    hi = int(unlike[0]) if len(unlike) else short - lo
    mx, my = x[lo : len(x) - hi], y[lo : len(y) - hi]
    coarse = (len(mx) + 1) * (len(my) + 1) > max_cells
    if coarse:
        middle = [("removed", i, 0) for i in range(len(mx))] + [("added", 0, j) for j in range(len(my))]
    else:
        middle = _aligned(mx, my)
    steps = [("same", i, i) for i in range(lo)] + [(op, lo + i, lo + j) for op, i, j in middle] + [("same", len(x) - hi + k, len(y) - hi + k) for k in range(hi)]
    out: list[dict] = []
    for op, run in groupby(steps, key=lambda s: s[0]):
        run = list(run)
        out.append({"op": op, "a": "" if op == "added" else "".join(ta[i] for _, i, _ in run), "b": "" if op == "removed" else "".join(tb[j] for _, _, j in run)})
    return out, coarse


def diff_runs(a: str, b: str, max_cells: int) -> list[dict]:
    return compared(a, b, max_cells)[0]


def word_diff(pairs: DataFrame, a: str, b: str, max_cells: int = 4_000_000) -> DataFrame:
    """pairs with `ops` and `coarse`, see compared(), by longest common subsequence; a null text counts as empty."""

    @F.pandas_udf(f"ops {OPS}, coarse boolean")
    def diff(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compared(p or "", q or "", max_cells) for p, q in zip(x, y, strict=True)], columns=["ops", "coarse"])

    keep = [F.col(f"`{c}`") for c in pairs.columns if c not in ("ops", "coarse")]
    return pairs.select(*keep, diff(F.col(a), F.col(b)).alias("__d")).select(*keep, "__d.ops", "__d.coarse")

"""Lists: sorted pages, details, suggestions, row updates and tag edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORT_KEYS = {"generated_at": "generated_at", "rel_path": "rel_path", "family": "model_family", "steps": "steps", "cfg": "cfg"}
MOST = 2000


def _order(key: str, descending: bool) -> list[Column]:
    c = SORT_KEYS[key]
    return [F.desc_nulls_last(c), F.desc("id")] if descending else [F.asc_nulls_last(c), F.asc("id")]


def page(images: DataFrame, key: str, descending: bool, offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of the sorted list with their place from 1; nulls last, ties by id. Spark keeps
    the offset + limit first rows of each partition only, so no row beyond is moved."""
    if not 0 < limit <= MOST:
        raise ValueError(f"a page has 1 to {MOST} rows")
    order = _order(key, descending)
    best = images.orderBy(*order).limit(offset + limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > offset)


def page_after(images: DataFrame, key: str, descending: bool, last_value, last_id: int, limit: int) -> DataFrame:
    """The page after a row: a filter that reaches the scan instead of an offset; key's nulls are not paged."""
    c = F.col(SORT_KEYS[key])
    past = (c < last_value) | ((c == last_value) & (F.col("id") < last_id)) if descending else (c > last_value) | ((c == last_value) & (F.col("id") > last_id))
    return images.where(past).orderBy(*_order(key, descending)).limit(limit)


def sorted_ids(images: DataFrame, key: str, descending: bool) -> DataFrame:
    return images.orderBy(*_order(key, descending)).select("id", SORT_KEYS[key])


def with_saved_badge(rows: DataFrame, links: DataFrame) -> DataFrame:
    mark = links.where("content_hash <> ''").select("content_hash").distinct().withColumn("__s", F.lit(True))
    return rows.join(mark, "content_hash", "left").withColumn("saved", F.coalesce("__s", F.lit(False))).drop("__s")


def details(images: DataFrame, loras: DataFrame, warnings: DataFrame) -> DataFrame:
    """images with nested loras (reachable ones first, then by position, nulls last) and warnings (by code, node)."""
    held = loras.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((~F.col("reachable")).alias("unused"), F.col("position").isNull().alias("unplaced"), "position", "name", "strength_model", "enabled"))).alias("loras"))
    told = warnings.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("code", "node_id"))).alias("warnings"))
    return images.join(held, "id", "left").join(told, "id", "left").withColumns({"loras": F.coalesce("loras", F.array()), "warnings": F.coalesce("warnings", F.array())})


def suggest(facets: DataFrame, query: str, exclude: tuple[str, ...], limit: int) -> DataFrame:
    """(facet, value, count, head, match, tail): values of each facet that hold query, those that start with it first."""
    low, q = F.lower("value"), query.lower()
    hits = facets.where(F.contains(low, F.lit(q)) & ~F.col("value").isin(list(exclude)))
    order = Window.partitionBy("facet").orderBy(F.desc(F.startswith(low, F.lit(q))), F.desc("count"), "value")
    at = F.instr(low, q)
    cut = lambda start, n=None: F.substring(F.col("value"), start, F.length("value") if n is None else n)
    best = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
    return best.select("facet", "value", "count", cut(F.lit(1), at - 1).alias("head"), cut(at, F.lit(len(q))).alias("match"), cut(at + len(q)).alias("tail"))


def update_rows(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns of patch's rows in place of its own; patch keys are unique."""
    new = patch.select(key, F.lit(True).alias("__patched"), *(F.col(c).alias(f"__{c}") for c in columns))
    out = base.join(new, key, "left")
    return out.select(*(F.when(F.col("__patched"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def edit_tags(tags: Column, remove: list[str], add: list[str]) -> Column:
    """(tags - remove) + add, sorted."""
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.array_except(tags, lit(remove)), lit(add)))

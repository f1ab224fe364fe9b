"""Statistics by group: frequency tables, numeric profiles, histograms, configurations, timelines, bursts.

A group is a column, several fields are unpivoted and go through one aggregation, and the result is
long (group, field, ...). No operator runs once for each group or field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprynt.functions.scalars import lora_base_step
from imprynt.sources.tables import written


def unpivot(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """(keep, field, value as double): one row for each field; NaN is null."""
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias("value")) for f in fields))
    return df.select(*keep, F.explode(values).alias("x")).select(*keep, "x.field", "x.value")


def unpivot_text(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    return df.select(*keep, F.explode(values).alias("x")).select(*keep, "x.field", "x.value")


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(name) <= k)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, where null is equal to null; right's keys are left out."""
    on = F.struct(*keys)
    return left.withColumn("__k", on).join(right.select(on.alias("__k"), *[c for c in right.columns if c not in keys]), "__k", how).drop("__k")


#: Different values of one key that one task puts in order; more are split into cells first.
LARGEST_CELL, CELLS = 1 << 20, 1024


def _cell(value: str, log: bool, cells: int) -> Column:
    """The cell (from 0) of a value between __lo and __hi; rising with it, and never the same for both ends."""
    f = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if log else (lambda c: c * F.lit(0.5))
    x, lo, hi = (f(F.col(c).cast("double")) for c in (value, "__lo", "__hi"))
    part = F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0))
    inner = F.greatest(F.lit(0), F.least(F.floor(part * cells), F.lit(cells - 1))).cast("int")
    return F.when(F.col(value) == F.col("__lo"), 0).when(F.col(value) == F.col("__hi"), cells - 1).otherwise(inner)


def quantiles(values: DataFrame, keys: list[str], column: str, shares: tuple[float, ...], largest: int = LARGEST_CELL, cells: int = CELLS) -> DataFrame:
    """(keys, q: array of the exact quantiles), linear between ranks, of values that are not null.

    Different values are counted, and ranks looked for among them. The range of a key in which a rank lies is split into
    `cells` - by logarithm first, evenly afterwards - and the cell that holds the rank takes its place, until it has at
    most `largest` different values; only those are put in order. A split parts the ends of a range, so it always goes
    on, and a long tail takes some splits more: no task ever orders more than `largest` values of a key."""
    one = [*keys, "__lo", "__hi"]
    counts = written(values.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__v")).agg(F.count("*").alias("__n")), "counts")
    per = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.count("*").alias("__d"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    rank = lambda q: F.lit(q) * (F.col("__all") - 1)
    below = lambda q: F.floor(rank(q)).cast("bigint")
    asked = [F.struct(F.lit(j).alias("__j"), F.lit(i).alias("__i"), F.least(below(q) + i, F.col("__all") - 1).alias("__r"), (rank(q) - below(q)).alias("__part")) for j, q in enumerate(shares) for i in (0, 1)]
    want = written(per.select(*one, "__d", F.inline(F.array(*asked))), "ranks")

    def inside(cell: DataFrame) -> DataFrame:
        """The counted values of each cell: keys, __lo, __hi, __v, __n."""
        return join_same(counts, cell.select(*one).distinct(), keys).where((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))

    log = True
    while want.where(F.col("__d") > largest).limit(1).count():
        large = want.where(F.col("__d") > largest)
        split = inside(large).withColumn("__c", _cell("__v", log, cells)).groupBy(*one, "__c").agg(F.sum("__n").alias("__n"), F.count("*").alias("__m"), F.min("__v").alias("__a"), F.max("__v").alias("__b"))
        split = split.withColumn("__to", F.sum("__n").over(Window.partitionBy(*one).orderBy("__c"))).withColumn("__from", F.col("__to") - F.col("__n"))
        met = join_same(large, split, one).where((F.col("__r") >= F.col("__from")) & (F.col("__r") < F.col("__to")))
        next_ = met.select(*keys, F.col("__a").alias("__lo"), F.col("__b").alias("__hi"), F.col("__m").alias("__d"), "__j", "__i", (F.col("__r") - F.col("__from")).alias("__r"), "__part")
        want, log = written(want.where(F.col("__d") <= largest).unionByName(next_), "ranks"), False
    ordered = inside(want).withColumn("__end", F.sum("__n").over(Window.partitionBy(*one).orderBy("__v")))
    hit = join_same(want, ordered.select(*one, "__v", "__n", "__end"), one).where((F.col("__r") < F.col("__end")) & (F.col("__r") >= F.col("__end") - F.col("__n")))
    low, high = (F.max(F.when(F.col("__i") == i, F.col("__v"))) for i in (0, 1))
    each = hit.groupBy(*keys, "__j", "__part").agg((low + (high - low) * F.col("__part")).alias("__q"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__j", "__q"))), lambda x: x["__q"]).alias("q"))


def value_counts(df: DataFrame, fields: list[str], group: str = "group", top_n: int = 20) -> DataFrame:
    """(group, field, value, count, share, rank, other, missing): the most frequent values; share is of all rows,
    missing ones too; other is what the listed values leave of those present."""
    counts = unpivot_text(df, fields, [group]).groupBy(group, "field", "value").agg(F.count("*").alias("count"))
    own = Window.partitionBy(group, "field")
    sums = counts.groupBy(group, "field").agg(F.sum("count").alias("total"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing"))
    ranked = join_same(top_k(counts.where("value is not null"), [group, "field"], [F.desc("count"), F.col("value")], top_n), sums, [group, "field"])
    return ranked.withColumn("other", F.col("total") - F.col("missing") - F.sum("count").over(own)).select(group, "field", "value", "count", (F.col("count") / F.col("total")).alias("share"), "rank", "other", "missing")


def tag_counts(df: DataFrame, group: str = "group", top_n: int = 20) -> DataFrame:
    """(group, value, count, share, rank, n): tags by files; share is of files, n counts tagged files; df(id, group, tags)."""
    files = df.groupBy(group).agg(F.count("*").alias("files"), F.count_if(F.size("tags") > 0).alias("n"))
    counts = df.select(group, F.explode(F.array_distinct("tags")).alias("value")).groupBy(group, "value").agg(F.count("*").alias("count")).join(files, group)
    return top_k(counts, [group], [F.desc("count"), F.col("value")], top_n).select(group, "value", "count", (F.col("count") / F.col("files")).alias("share"), "rank", "n")


def seed_stats(df: DataFrame, group: str = "group", top: int = 10) -> tuple[DataFrame, DataFrame]:
    """((group, n, n_unique), (group, seed, count, rank) of seeds seen more than once)."""
    counts = df.where("seed is not null").groupBy(group, "seed").agg(F.count("*").alias("count"))
    sums = counts.groupBy(group).agg(F.sum("count").alias("n"), F.count("*").alias("n_unique"))
    return sums, top_k(counts.where("count > 1"), [group], [F.desc("count"), F.col("seed")], top)


def numeric_stats(df: DataFrame, fields: list[str], group: str = "group") -> DataFrame:
    """(group, field, n, n_missing, mean, std, min, p25, median, p75, max): exact, linear between ranks."""
    v, rows = F.col("value"), unpivot(df, fields, [group])
    out = rows.groupBy(group, "field").agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    out = join_same(out, quantiles(rows, [group, "field"], "value", (0.25, 0.5, 0.75)), [group, "field"], "left")
    return out.select(group, "field", "n", "n_missing", "mean", F.when(F.col("n") > 1, F.col("std")).alias("std"), "min", *(F.get("q", i).alias(p) for i, p in enumerate(("p25", "median", "p75"))), "max")


def rounded_counts(df: DataFrame, fields: list[str], group: str, decimals: int = 4) -> DataFrame:
    v = unpivot(df, fields, [group]).where("value is not null")
    return v.groupBy(group, "field", (F.bround("value", decimals) + F.lit(0.0)).alias("value")).agg(F.count("*").alias("count"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def modes(df: DataFrame, fields: list[str], group: str = "group", decimals: int = 4) -> DataFrame:
    """(group, field, mode, tied, share): up to three smallest of the most frequent rounded values; an empty mode where
    nothing repeats among several."""
    counts = rounded_counts(df, fields, group, decimals)
    per = counts.groupBy(group, "field").agg(F.max("count").alias("top"), F.sum("count").alias("n"))
    best = counts.join(per, [group, "field"]).where("count = top")
    tie = top_k(best, [group, "field"], [F.col("value")], 4)
    out = tie.groupBy(group, "field", "top", "n").agg(F.array_sort(F.collect_list("value")).alias("v"))
    none = (F.col("top") == 1) & (F.col("n") > 1)
    return out.select(group, "field", F.when(none, F.array().cast("array<double>")).otherwise(F.slice("v", 1, 3)).alias("mode"), (~none & (F.size("v") > 1)).alias("tied"), F.when(~none, F.col("top") / F.col("n")).alias("share"))


def histogram(df: DataFrame, fields: list[str], group: str = "group", bins: int = 20, discrete_max: int = 25, decimals: int = 4) -> DataFrame:
    """(group, field, kind, x0, x1, count): a bar for each of up to discrete_max rounded values, else equal bins
    over [min, max], the last one closed, empty ones kept."""
    counts = rounded_counts(df, fields, group, decimals)
    per = counts.groupBy(group, "field").agg(F.count("*").alias("k"), F.min("lo").alias("low"), F.max("hi").alias("high"))
    both = counts.join(per, [group, "field"])
    bars = both.where(F.col("k") <= discrete_max).select(group, "field", F.lit("value").alias("kind"), F.col("value").alias("x0"), F.col("value").alias("x1"), "count")
    width = (F.col("high") - F.col("low")) / bins
    at = F.least(F.greatest(F.floor((F.col("value") - F.col("low")) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    filled = both.where(F.col("k") > discrete_max).groupBy(group, "field", at.alias("bin")).agg(F.sum("count").alias("count"))
    every = per.where(F.col("k") > discrete_max).select(group, "field", "low", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    binned = every.join(filled, [group, "field", "bin"], "left")
    binned = binned.select(group, "field", F.lit("bin").alias("kind"), (F.col("low") + F.col("w") * F.col("bin")).alias("x0"), (F.col("low") + F.col("w") * (F.col("bin") + 1)).alias("x1"), F.coalesce("count", F.lit(0)).alias("count"))
    return bars.unionByName(binned)


def with_examples(df: DataFrame, keys: list[str], examples: int = 6) -> DataFrame:
    """(keys, count, ids, hashes): the count of each key and its most recent files; df(id, content_hash, generated_at).
    Each task keeps its own most recent files of a key; only those meet."""
    best = top_k(df.select(*keys, "id", "content_hash", "generated_at"), keys, [F.desc_nulls_last("generated_at"), F.desc("id")], examples, "r")
    held = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "id", "content_hash"))).alias("x"))
    out = join_same(df.groupBy(*keys).agg(F.count("*").alias("count")), held, keys)
    return out.select(*keys, "count", F.transform("x", lambda e: e["id"]).alias("ids"), F.transform("x", lambda e: e["content_hash"]).alias("hashes"))


def top_values(df: DataFrame, column: str, group: str = "group", top_n: int = 20, examples: int = 6) -> DataFrame:
    return top_k(with_examples(df.where(F.col(column).isNotNull()), [group, column], examples), [group], [F.desc("count"), F.col(column)], top_n)


CONFIG_FIELDS = ("model_family", "base_model", "lora_stack_key", "sampler_name", "scheduler", "steps", "cfg", "denoise", "guidance", "shift")


def config_key(decimals: int = 2, fields: tuple[str, ...] = CONFIG_FIELDS, numbers: tuple[str, ...] = ("cfg", "denoise", "guidance", "shift")) -> Column:
    """A configuration as one canonical JSON array; floats rounded, nulls kept."""
    one = [F.coalesce(F.to_json(F.struct((F.bround(F.col(f), decimals) + F.lit(0.0) if f in numbers else F.col(f)).alias("v"))), F.lit("{}")) for f in fields]
    bare = [F.when(x == "{}", "null").otherwise(F.regexp_replace(x, r'^\{"v":|\}$', "")) for x in one]
    return F.concat(F.lit("["), F.concat_ws(",", *bare), F.lit("]"))


def decode_config_key(key: Column, fields: tuple[str, ...] = CONFIG_FIELDS, numbers: tuple[str, ...] = ("steps", "cfg", "denoise", "guidance", "shift")) -> Column:
    """The struct of a config_key; numbers as double."""
    parts = F.from_json(key, "array<string>")
    return F.struct(*((F.get(parts, i).try_cast("double") if f in numbers else F.get(parts, i)).alias(f) for i, f in enumerate(fields)))


def top_configs(df: DataFrame, group: str = "group", top_n: int = 20) -> DataFrame:
    """The most used whole configurations, with share of the group's rows; df has config_key."""
    size = df.groupBy(group).agg(F.count("*").alias("rows"))
    return top_values(df, "config_key", group, top_n).join(size, group).select(group, "config_key", "count", (F.col("count") / F.col("rows")).alias("share"), "rank", "ids")


def lora_table(uses: DataFrame, sizes: DataFrame, key: str = "name") -> DataFrame:
    """(group, key, files, share, uses, model_mean, model_min, model_median, model_max, clip_mean, first_positions):
    LoRAs by distinct files; strengths are over uses; uses(group, id, name, base_name, position, strength_model, strength_clip)."""
    named = uses.withColumn("lora", F.col(key))
    out = named.groupBy("group", "lora").agg(F.count_distinct("id").alias("files"), F.count("*").alias("uses"), F.avg("strength_model").alias("model_mean"), F.min("strength_model").alias("model_min"), F.max("strength_model").alias("model_max"), F.avg("strength_clip").alias("clip_mean"), F.count_if(F.col("position") == 0).alias("first_positions"))
    median = quantiles(named, ["group", "lora"], "strength_model", (0.5,)).select("group", "lora", F.get("q", 0).alias("model_median"))
    return join_same(out, median, ["group", "lora"], "left").join(sizes, "group").withColumn("share", F.col("files") / F.col("rows")).drop("rows")


def lora_values(uses: DataFrame, key: str, column: str) -> DataFrame:
    """(group, lora, value, count): positions or training steps of each LoRA; null counts too."""
    return uses.groupBy("group", F.col(key).alias("lora"), F.col(column).cast("bigint").alias("value")).agg(F.count("*").alias("count"))


def effective_loras(loras: DataFrame) -> DataFrame:
    """Reachable, enabled uses; a LoRA that stages share counts once, at its earliest stage."""
    used = loras.where("reachable and enabled")
    own = Window.partitionBy("file_id", "node_id", "entry")
    return used.withColumn("__first", F.min("stage_index").over(own)).where("stage_index = __first").drop("__first")


def facets(images: DataFrame, loras: DataFrame) -> DataFrame:
    """(facet, value, count): tags, families, models, samplers, schedulers, statuses and LoRAs by files."""
    single = {"family": "model_family", "base_model": "base_model", "sampler": "sampler_name", "scheduler": "scheduler", "status": "status"}
    named = unpivot_text(images.select(*(F.col(c).alias(f) for f, c in single.items())), list(single), []).withColumnRenamed("field", "facet")
    tags = images.select(F.lit("tag").alias("facet"), F.explode("tags").alias("value"))
    uses = loras.select("file_id", "name").distinct().select(F.lit("lora").alias("facet"), F.col("name").alias("value"))
    return named.unionByName(tags).unionByName(uses).where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("count"))


def ranges(images: DataFrame, fields: list[str]) -> DataFrame:
    return unpivot(images, fields, []).groupBy("field").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def library_summary(images: DataFrame) -> DataFrame:
    """(kind, value, count): the total, files by status and by family, files with a suspect time."""
    kinds = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")), F.struct(F.lit("status").alias("kind"), F.col("status").alias("value")),
        F.struct(F.lit("family").alias("kind"), F.coalesce("model_family", F.lit("(no metadata)")).alias("value")),
        F.when(F.col("timestamp_suspect"), F.struct(F.lit("suspect").alias("kind"), F.lit("").alias("value"))),
    )
    return images.select(F.explode(kinds).alias("x")).where("x is not null").groupBy("x.kind", "x.value").agg(F.count("*").alias("count"))


def timeline(rows: DataFrame, bucket: str = "day", time: str = "date", series: str = "model_family", selected: Column | None = None, suspect: Column | None = None) -> DataFrame:
    """(bucket, series, kind, count): counts for each day, Monday week or month, zero-filled between the first and
    the last for every series; kind is `all`, and `selected` and `suspect` where those conditions are given."""
    kinds = [F.lit("all")] + [F.when(c, F.lit(k)) for k, c in (("selected", selected), ("suspect", suspect)) if c is not None]
    at = F.to_date(F.date_trunc(bucket, F.col(time)))
    counted = rows.where(F.col(time).isNotNull()).select(at.alias("bucket"), F.coalesce(F.col(series).cast("string"), F.lit("(no metadata)")).alias("series"), F.explode(F.array(*kinds)).alias("kind")).where("kind is not null").groupBy("bucket", "series", "kind").agg(F.count("*").alias("count"))
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[bucket]
    span = counted.groupBy().agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    names = counted.groupBy().agg(F.collect_set(F.struct("series", "kind")).alias("names"))  # as many as the chart has series
    calendar = span.select(F.explode_outer(F.expr(f"sequence(lo, hi, {step})")).alias("bucket"), F.lit(1).alias("one"))
    every = calendar.join(names.withColumn("one", F.lit(1)), "one").select("bucket", F.explode("names").alias("n")).select("bucket", "n.series", "n.kind")
    return every.join(counted, ["bucket", "series", "kind"], "left").select("bucket", "series", "kind", F.coalesce("count", F.lit(0)).alias("count"))


def calendar_levels(days: DataFrame) -> DataFrame:
    """(date, total, level, week, weekday): level 0 to 4 by the quartiles, floor(q (n - 1)), of days that are not
    empty; week counts columns from the first day's week, weekday 0 is Monday; days(date, total)."""
    full = days.where("total > 0").groupBy().agg(F.array_sort(F.collect_list("total")).alias("t"), F.min("date").alias("lo"))  # one number for each day
    q = lambda x: F.get("t", F.floor(F.lit(x) * (F.size("t") - 1)).cast("int"))
    limits = full.select("lo", q(0.25).alias("a"), q(0.5).alias("b"), q(0.75).alias("c"), F.lit(1).alias("one"))
    monday = F.date_sub("lo", F.weekday("lo"))
    level = F.when(F.col("total") == 0, 0).when(F.col("total") <= F.col("a"), 1).when(F.col("total") <= F.col("b"), 2).when(F.col("total") <= F.col("c"), 3).otherwise(4)
    return days.withColumn("one", F.lit(1)).join(limits, "one").select("date", "total", level.cast("int").alias("level"), F.expr("cast(floor(datediff(date, date_sub(lo, weekday(lo))) / 7) as int)").alias("week"), F.weekday("date").alias("weekday"))


def burst_clusters(df: DataFrame, window: int, min_distinct: int, block: int | None = None) -> DataFrame:
    """(cluster, start, end, files, distinct): stretches where some `window` long span, ends included, holds
    min_distinct keys; df(id, t, key), t and window in one integer unit.

    Time is cut into blocks many windows long; rows shortly before a block join it as a halo, so each
    block is counted by itself. Islands are formed from suspect rows only, within blocks; what is put in order
    over all time is one row a block, its first and last suspect time."""
    block = block or 64 * window
    rows = df.select("id", "t", "key", F.floor(F.col("t") / block).alias("b"))
    halo = rows.where(F.pmod(F.col("t"), F.lit(block)) >= block - window).withColumn("b", F.col("b") + 1)
    both = rows.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))
    # a key counts from each of its rows until the span has passed it or its next row takes over: a running sum of
    # starts and ends is the number of different keys at any time, however many rows a burst has
    after = F.lead("t").over(Window.partitionBy("b", "key").orderBy("t"))
    live = both.withColumn("end", F.least(F.col("t") + window, F.coalesce(after - 1, F.col("t") + window))).where("end >= t")
    event = lambda d, at, n: d.select("b", at.alias("t"), F.lit(n).alias("d"), F.lit(False).alias("own"))
    events = event(live, F.col("t"), 1).unionByName(event(live, F.col("end") + 1, -1)).unionByName(both.where("own").select("b", "t", F.lit(0).alias("d"), "own").distinct())
    events = events.groupBy("b", "t").agg(F.sum("d").alias("d"), F.bool_or("own").alias("own"))
    suspect = events.withColumn("n", F.sum("d").over(Window.partitionBy("b").orderBy("t"))).where(F.col("own") & (F.col("n") >= min_distinct)).select("b", "t")
    order, blocks = Window.partitionBy("b").orderBy("t"), Window.orderBy("b")
    local = suspect.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(order) > window).cast("int"), F.lit(0))).withColumn("part", F.sum("new").over(order))
    parts = local.groupBy("b", "part").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    edges = parts.groupBy("b").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.max("part").alias("inner"))
    edges = edges.withColumn("new", F.coalesce((F.col("first") - F.lag("last").over(blocks) > window).cast("int"), F.lit(1)))
    edges = edges.select("b", (F.sum(F.col("new") + F.col("inner")).over(blocks) - F.col("inner")).alias("base"))
    islands = parts.join(edges, "b").select((F.col("base") + F.col("part")).alias("cluster"), "lo", "hi")
    spans = islands.groupBy("cluster").agg((F.min("lo") - window).alias("start"), F.max("hi").alias("end"))
    hit = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    members = rows.join(hit, "b").where((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("end")))
    return members.groupBy("cluster").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("files"), F.count_distinct("key").alias("distinct"))


def burst_members(df: DataFrame, clusters: DataFrame, block: int) -> DataFrame:
    """(id, cluster): rows inside a cluster; both sides meet by blocks of time."""
    hit = clusters.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    return df.withColumn("b", F.floor(F.col("t") / block)).join(hit, "b").where((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("end"))).select("id", "cluster")


def apply_bursts(files: DataFrame, warnings: DataFrame, members: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with timestamp_suspect set anew, warnings with that code's rows rewritten)."""
    told = members.join(clusters, "cluster").select(F.col("id").alias("file_id"), F.lit("TIMESTAMP_SUSPECT").alias("code"), F.lit(None).cast("string").alias("node_id"), F.format_string("%d files of %d generations written together", F.col("files"), F.col("distinct")).alias("message"))
    mark = members.select("id").distinct().withColumn("__s", F.lit(True))
    marked = files.drop("timestamp_suspect").join(mark, "id", "left").withColumn("timestamp_suspect", F.coalesce("__s", F.lit(False))).select(files.columns)
    return marked, warnings.where("code <> 'TIMESTAMP_SUSPECT'").unionByName(told, allowMissingColumns=True)


def loras_with_steps(loras: DataFrame) -> DataFrame:
    x = lora_base_step("name")
    return loras.withColumn("base_name", x["base"]).withColumn("step", x["step"])

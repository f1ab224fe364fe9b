"""Scopes: which rows of the wide image table a question is about."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprynt.functions import scalars as S

NO_METADATA = "(no metadata)"
RANGES = ("steps", "cfg", "denoise", "shift", "megapixels")


@dataclass(frozen=True)
class Scope:
    """A filter; empty fields filter nothing. ids, if given, override everything else."""

    families: tuple[str, ...] = ()
    base_models: tuple[str, ...] = ()
    samplers: tuple[str, ...] = ()
    schedulers: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    loras: tuple[str, ...] = ()
    lora_mode: str = "any"
    text: str = ""
    saved: bool | None = None
    ids: tuple[int, ...] | None = None


def wide_images(files: DataFrame, generations: DataFrame, tags: DataFrame) -> DataFrame:
    """files with their generation, tags and derived facts; one row for each file."""
    tagged = tags.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    gens = generations.withColumnRenamed("file_id", "id").drop("model_family").withColumn("has_generation", F.lit(True))
    family = generations.select(F.col("file_id").alias("id"), F.col("model_family").alias("__family"))
    out = files.drop("model_family").join(gens, "id", "left").join(family, "id", "left").join(tagged, "id", "left")
    facts = S.size_facts("width", "height")
    return out.select(
        *[c for c in files.columns if c != "model_family"], F.col("__family").alias("model_family"), *[c for c in gens.columns if c not in ("id", "has_generation", "seed")], S.seed_number("seed").alias("seed"),
        F.coalesce("has_generation", F.lit(False)).alias("has_generation"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))).alias("resolution"), facts["megapixels"].alias("megapixels"), facts["aspect"].alias("aspect"), facts["aspect_label"].alias("aspect_label"),
    )


def in_list(column: str, values: tuple[str, ...]) -> Column:
    """column is one of values; "(no metadata)" also takes null."""
    known = F.col(column).isin([v for v in values if v != NO_METADATA])
    return (known | F.col(column).isNull()) if NO_METADATA in values else known


def predicate(scope: Scope, ignore_dates: bool = False) -> Column:
    """The part of a scope that one row decides."""
    out = F.lit(True)
    for column, values in (("model_family", scope.families), ("base_model", scope.base_models), ("sampler_name", scope.samplers), ("scheduler", scope.schedulers), ("status", scope.statuses)):
        out = out & in_list(column, values) if values else out
    if scope.tags:
        out = out & F.arrays_overlap("tags", F.array(*map(F.lit, scope.tags)))
    if not ignore_dates:
        out = out & (F.col("date") >= F.to_date(F.lit(scope.date_from))) if scope.date_from else out
        out = out & (F.col("date") <= F.to_date(F.lit(scope.date_to))) if scope.date_to else out
    for name, (lo, hi) in scope.ranges.items():
        if name not in RANGES:
            raise ValueError(f"no numeric range on {name}")
        out = out & (F.col(name) >= lo) if lo is not None else out
        out = out & (F.col(name) <= hi) if hi is not None else out
    return out


def with_loras(images: DataFrame, loras: DataFrame, names: tuple[str, ...], mode: str = "any") -> DataFrame:
    """images that use any (or all) of the LoRAs; loras(file_id, name)."""
    hits = loras.where(F.col("name").isin(list(names))).groupBy(F.col("file_id").alias("id")).agg(F.count_distinct("name").alias("n"))
    return images.join(hits.where(F.col("n") >= (len(set(names)) if mode == "all" else 1)).select("id"), "id", "left_semi")


def text_search(texts: DataFrame, text: str) -> DataFrame:
    """(file_id): rows of texts(file_id, ...strings) one of whose strings holds text as a run of whole words, whatever
    the case and accents; text without a word is looked for as it stands."""
    words = lambda c: F.array_join(F.regexp_extract_all(F.collate(c, "UTF8_BINARY"), F.lit(r"(?U)[\p{L}\p{M}\p{N}_]+"), F.lit(0)), " ")
    strings = [c for c, kind in texts.dtypes if kind == "string" and c != "file_id"]
    session = texts.sparkSession
    own = session.range(1).select(words(F.lit(text)).alias("w")).first()["w"]
    if not own:
        found = [S.contains_literal(F.coalesce(F.col(c), F.lit("")), text) for c in strings]
    else:
        padded = [F.concat(F.lit(" "), words(F.coalesce(F.col(c), F.lit(""))), F.lit(" ")) for c in strings]
        found = [F.contains(F.collate(p, "UNICODE_CI_AI"), F.collate(F.lit(f" {own} "), "UNICODE_CI_AI")) for p in padded]
    hit = found[0]
    for f in found[1:]:
        hit = hit | f
    return texts.where(hit).select("file_id").distinct()


def saved_filter(images: DataFrame, links: DataFrame, saved: bool) -> DataFrame:
    """images whose content is (not) linked to a saved prompt; links(content_hash)."""
    return images.join(links.where("content_hash <> ''").select("content_hash").distinct(), "content_hash", "left_semi" if saved else "left_anti").select(images.columns)


def saved_prompt_files(images: DataFrame, keys: DataFrame, links: DataFrame, prompts: DataFrame) -> DataFrame:
    """(prompt_id, id): files of each saved prompt, by linked content or by equal prompt key."""
    by_hash = links.join(images.where("content_hash <> ''"), "content_hash").select("prompt_id", "id")
    by_key = prompts.select("prompt_id", S.prompt_key("positive").alias("key")).join(keys, "key").select("prompt_id", F.col("file_id").alias("id"))
    return by_hash.unionByName(by_key).distinct()


def is_filtered(scope: Scope) -> bool:
    return any((scope.families, scope.base_models, scope.samplers, scope.schedulers, scope.statuses, scope.tags, scope.date_from, scope.date_to, scope.ranges, scope.loras, scope.text.strip(), scope.saved is not None))


def scope_kind(scope: Scope) -> str:
    return "selection" if scope.ids is not None else "filtered" if is_filtered(scope) else "all"


def apply(images: DataFrame, scope: Scope, loras: DataFrame | None = None, texts: DataFrame | None = None, links: DataFrame | None = None, ignore_dates: bool = False) -> DataFrame:
    if scope.ids is not None:
        return images.where(F.col("id").isin(list(scope.ids)))
    out = images.where(predicate(scope, ignore_dates))
    out = with_loras(out, loras, scope.loras, scope.lora_mode) if scope.loras else out
    if scope.text.strip():
        out = out.join(text_search(texts, scope.text).withColumnRenamed("file_id", "id"), "id", "left_semi")
    return saved_filter(out, links, scope.saved) if scope.saved is not None else out


def dedupe_identical(rows: DataFrame) -> DataFrame:
    """One row for each content, that with the lowest id; unreadable files (hash '') are never merged."""
    least = rows.where("content_hash <> ''").groupBy("content_hash").agg(F.min("id").alias("__least"))
    kept = rows.join(least, "content_hash", "left").where("__least is null or id = __least")
    return kept.select(rows.columns)


def resolve(rows: DataFrame, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows to analyse with `group`, one row of counts: size, excluded, duplicates, analyzed)."""
    has = rows.where("has_generation")
    kept = dedupe_identical(has) if dedupe else has
    unique = F.count_distinct(F.when(F.col("has_generation") & (F.col("content_hash") != ""), F.col("content_hash"))) + F.count_if(F.col("has_generation") & (F.col("content_hash") == ""))
    n = rows.agg(F.count("*").alias("size"), F.count_if(~F.col("has_generation")).alias("excluded"), unique.alias("unique"))
    analyzed = F.col("unique") if dedupe else F.col("size") - F.col("excluded")
    info = n.select("size", "excluded", (F.col("size") - F.col("excluded") - analyzed).alias("duplicates"), analyzed.alias("analyzed"))
    return kept.withColumn("group", F.coalesce("model_family", F.lit("unknown"))), info


def search_collection(prompts: DataFrame, tags: DataFrame, q: str = "", tag: str | None = None, family: str | None = None) -> DataFrame:
    """Saved prompts with q in a text field or a tag, with the tag, of the family."""
    out = prompts
    if q.strip():
        in_text = F.lit(False)
        for c in ("title", "positive", "negative", "notes"):
            in_text = in_text | F.coalesce(S.contains_literal(c, q.strip()), F.lit(False))
        hit = tags.where(S.contains_literal("tag", q.strip())).select("prompt_id").distinct().withColumn("__hit", F.lit(True))
        out = out.join(hit, "prompt_id", "left").where(in_text | F.col("__hit").isNotNull()).drop("__hit")
    if tag is not None:
        out = out.join(tags.where(F.col("tag") == tag).select("prompt_id"), "prompt_id", "left_semi")
    return out.where(F.col("model_family") == family) if family is not None else out


def recency(partition: list[str]) -> Column:
    """Rank by time, newest first and unknown times last, then by id downwards."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc_nulls_last("generated_at"), F.desc("id")))

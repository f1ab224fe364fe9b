"""The saved-prompt collection: matching with files, search results, edits as merges, import and export.

A store is a dict of tables: prompts, images(prompt_id, content_hash, role, position), tags(prompt_id, tag), originals.
Edits return new tables; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imprynt.functions import scalars as S

GRACE_SECONDS = 24 * 3600


def saved_settings(generations: DataFrame, loras: DataFrame) -> DataFrame:
    """(file_id, settings): the settings of a file with its effective LoRAs once each, in chain order."""
    used = loras.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("position", "name", F.col("strength_model").alias("model"), F.col("strength_clip").alias("clip")))).alias("l"))
    lean = F.transform(F.coalesce("l", F.array()), lambda x: F.struct(x["name"].alias("name"), x["model"].alias("model"), x["clip"].alias("clip")))
    fields = [c for c in ("base_model", "seed", "steps", "cfg", "sampler_name", "scheduler", "denoise", "guidance", "shift") if c in generations.columns]
    return generations.join(used, "file_id", "left").select("file_id", F.struct(*fields, lean.alias("loras")).alias("settings"))


def facets(prompts: DataFrame, tags: DataFrame) -> DataFrame:
    family = prompts.where("model_family is not null").groupBy(F.col("model_family").alias("value")).agg(F.count("*").alias("count")).withColumn("facet", F.lit("family"))
    tag = tags.distinct().groupBy(F.col("tag").alias("value")).agg(F.count("*").alias("count")).withColumn("facet", F.lit("tag"))
    return family.unionByName(tag).select("facet", "value", "count")


def summaries(prompts: DataFrame, images: DataFrame, tags: DataFrame) -> DataFrame:
    """prompts with tags, cover (the first reference, else the first attempt) and counts of both."""
    t = tags.groupBy("prompt_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    i = images.groupBy("prompt_id").agg(F.min_by("content_hash", F.struct(F.col("role") != "reference", "position")).alias("cover"), F.count_if(F.col("role") == "reference").alias("references"), F.count_if(F.col("role") == "attempt").alias("attempts"))
    out = prompts.join(t, "prompt_id", "left").join(i, "prompt_id", "left")
    return out.withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "references": F.coalesce("references", F.lit(0)), "attempts": F.coalesce("attempts", F.lit(0))})


def prompts_for_images(images: DataFrame, keys: DataFrame, prompts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, prompt_id, relation): saved prompts linked by content, and those with an equal prompt key that are not linked."""
    linked = images.where("content_hash <> ''").join(links.select("content_hash", "prompt_id").distinct(), "content_hash").select("id", "prompt_id", F.lit("linked").alias("relation"))
    same = prompts.select("prompt_id", S.prompt_key("positive").alias("key")).join(keys, "key").select(F.col("file_id").alias("id"), "prompt_id").distinct()
    return linked.unionByName(same.join(linked, ["id", "prompt_id"], "left_anti").withColumn("relation", F.lit("matching")))


def library_counts(prompts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(prompt_id, files): distinct files of each saved prompt, 0 without any; pairs(prompt_id, id) is distinct."""
    return prompts.select("prompt_id").join(pairs.groupBy("prompt_id").agg(F.count("*").alias("files")), "prompt_id", "left").withColumn("files", F.coalesce("files", F.lit(0)))


def library_ids(images: DataFrame, hashes: DataFrame) -> DataFrame:
    return images.where("content_hash <> ''").join(hashes.select("content_hash").distinct(), "content_hash", "left_semi").groupBy("content_hash").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def union_distinct(first: DataFrame, *more: DataFrame) -> DataFrame:
    for m in more:
        first = first.unionByName(m)
    return first.distinct()


def validated(changes: DataFrame) -> DataFrame:
    """changes with `error`: a title of 1 to 200 characters, good tags; null where all is well."""
    t = F.length(F.trim(F.coalesce("title", F.lit(""))))
    bad = F.size(S.normalize_tags("tags")["rejected"]) > 0
    return changes.withColumn("error", F.when((t < 1) | (t > 200), "title").when(bad, "tags"))


def save_prompts(prompts: DataFrame, tags: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prompts, tags, errors) after valid changes(prompt_id, title, ..., tags) replaced or added their rows."""
    judged = validated(changes)
    good = judged.where("error is null")
    ids = good.select("prompt_id")
    new = prompts.join(ids, "prompt_id", "left_anti").unionByName(good.select([c for c in prompts.columns if c in good.columns]), allowMissingColumns=True)
    own = good.select("prompt_id", F.explode(S.normalize_tags("tags")["tags"]).alias("tag"))
    return new, tags.join(ids, "prompt_id", "left_anti").unionByName(own), judged.where("error is not null").select("prompt_id", "error")


def delete_prompts(store: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The store without the prompts and what hangs on them."""
    return {n: t.join(ids.select("prompt_id"), "prompt_id", "left_anti") if "prompt_id" in t.columns else t for n, t in store.items()}


def link_attempts(images: DataFrame, links: DataFrame) -> DataFrame:
    """images with new links(prompt_id, content_hash) as attempts after the last position; known ones are left alone."""
    new = links.select("prompt_id", "content_hash").distinct().join(images.select("prompt_id", "content_hash"), ["prompt_id", "content_hash"], "left_anti")
    last = images.where("role = 'attempt'").groupBy("prompt_id").agg(F.max("position").alias("last"))
    n = F.row_number().over(Window.partitionBy("prompt_id").orderBy("content_hash"))
    placed = new.join(last, "prompt_id", "left").select("prompt_id", "content_hash", F.lit("attempt").alias("role"), (F.coalesce("last", F.lit(-1)) + n).alias("position"))
    return images.unionByName(placed)


def unlink_attempts(images: DataFrame, links: DataFrame) -> DataFrame:
    gone = links.select("prompt_id", "content_hash", F.lit("attempt").alias("role"))
    return images.join(gone, ["prompt_id", "content_hash", "role"], "left_anti").select(images.columns)


def rehash_attempts(images: DataFrame, mapping: DataFrame, keep: bool) -> DataFrame:
    """Every attempt with an old hash of mapping(old, new) gets the new one, and loses the old one unless kept."""
    hit = images.where("role = 'attempt'").join(mapping, F.col("content_hash") == F.col("old")).select("prompt_id", F.col("new").alias("content_hash"))
    out = link_attempts(images, hit)
    return out if keep else out.join(mapping.select(F.col("old").alias("content_hash"), F.lit("attempt").alias("role")), ["content_hash", "role"], "left_anti").select(images.columns)


def orphan_originals(originals: DataFrame, images: DataFrame, now: int, grace: int = GRACE_SECONDS) -> DataFrame:
    """(content_hash): originals that no reference uses and that are older than the grace period."""
    used = images.where("role = 'reference'").select("content_hash")
    return originals.where(F.col("added_at") < now - grace).join(used, "content_hash", "left_anti").select("content_hash")


def images_with_originals(images: DataFrame, originals: DataFrame) -> DataFrame:
    return images.join(originals.withColumn("has_original", F.lit(True)), "content_hash", "left").withColumn("has_original", F.coalesce("has_original", F.lit(False)))


def export_collection(prompts: DataFrame, images: DataFrame, tags: DataFrame) -> DataFrame:
    """(prompt_id, document): each prompt with its tags and images as JSON."""
    i = images.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("role", "position", "content_hash"))).alias("images"))
    t = tags.groupBy("prompt_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return prompts.join(i, "prompt_id", "left").join(t, "prompt_id", "left").select("prompt_id", F.to_json(F.struct(*[c for c in prompts.columns if c != "prompt_id"], "images", "tags")).alias("document"))


def import_collection(prompts: DataFrame, images: DataFrame, new_prompts: DataFrame, new_images: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prompts, images, counts): prompts whose uid is new are added; references to unknown originals are dropped, and
    attempts that are also references. One bad uid rejects the whole import."""
    if new_prompts.where("uid is null or not uid rlike '^[0-9a-f]{32}$'").limit(1).count():
        raise ValueError("an imported prompt has no valid uid")
    fresh = new_prompts.join(prompts.select("uid"), "uid", "left_anti")
    own = new_images.join(fresh.select("prompt_id"), "prompt_id", "left_semi")
    refs = own.where("role = 'reference'").join(originals.select("content_hash"), "content_hash", "left_semi").select(images.columns)
    tries = own.where("role = 'attempt'").join(refs.select("prompt_id", "content_hash"), ["prompt_id", "content_hash"], "left_anti").select(images.columns)
    flagged = new_prompts.join(prompts.select("uid").withColumn("known", F.lit(True)), "uid", "left")
    counts = flagged.agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if(F.col("known")).alias("skipped"))
    return prompts.unionByName(fresh.select(prompts.columns)), images.unionByName(refs).unionByName(tries), counts


def drafts(generations: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, title, positive, source): from the extraction if there is one, else from A1111 text, else empty."""
    a = S.parse_parameters(texts, "parameters", ["file_id"]).select("file_id", F.col("positive").alias("__a"))
    both = texts.select("file_id").join(generations.select("file_id", F.col("positive_prompt").alias("__g")), "file_id", "left").join(a, "file_id", "left")
    pos = F.coalesce("__g", "__a", F.lit(""))
    return both.select("file_id", S.suggest_title(pos).alias("title"), pos.alias("positive"), F.when(F.col("__g").isNotNull(), "extraction").when(F.col("__a").isNotNull(), "a1111").otherwise("none").alias("source"))


def rename_rows(files: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, failures): renames(id, name) applied; a name must be trimmed, without slash and control characters, of at
    most 255 bytes and the same extension; another row that holds the new path goes."""
    ext = lambda c: F.lower(F.regexp_extract(c, r"(\.[^.]*)$", 1))
    j = renames.join(files.select("id", "rel_path"), "id", "left")
    n = F.col("name")
    error = F.when(F.col("rel_path").isNull(), "unknown").when((n == "") | (n != F.trim(n)), "blank").when(n.rlike(r"[/\\\x00-\x1f\x7f]"), "characters").when(F.octet_length(n) > 255, "length").when(ext(n) != ext(F.col("rel_path")), "extension")
    judged = j.withColumn("error", error)
    good = judged.where("error is null").select("id", F.concat(F.regexp_extract("rel_path", r"^(.*/)?[^/]*$", 1), n).alias("__new"))
    moved = files.join(good, "id", "left")
    stale = good.select(F.col("__new").alias("rel_path"), F.col("id").alias("__by"))
    kept = moved.join(stale, "rel_path", "left").where("__by is null or __by = id or __new is not null")
    return kept.select(*[F.coalesce("__new", "rel_path").alias(c) if c == "rel_path" else F.col(c) for c in files.columns]), judged.where("error is not null").select("id", "error")


def retag_rows(images: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, failures): edits(id, add, remove) applied to the tags; unknown ids are failures."""
    e = edits.select("id", "add", "remove")
    out = images.join(e, "id", "left").withColumn("tags", F.when(F.col("add").isNull(), F.col("tags")).otherwise(F.array_sort(F.array_union(F.array_except("tags", "remove"), F.col("add"))))).select(images.columns)
    return out, edits.join(images.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("error"))


def remove_rows(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti").select(table.columns)

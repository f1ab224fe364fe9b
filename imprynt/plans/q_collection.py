"""Queries for the saved-prompt collection, table edits, comparisons, sources and streams."""

from __future__ import annotations

import re

import pandas as pd

from pyspark.sql import functions as F

from imprynt.functions import scalars as S
from imprynt.operators import collection as C
from imprynt.operators import compare as D
from imprynt.operators import listing as O
from imprynt.operators import scope as P
from imprynt.plans.fixtures import table, view
from imprynt.plans.registry import joined, query
from imprynt.sources import files as X
from imprynt.sources.tables import staged
from imprynt.streaming import catalog as K
from imprynt.streaming import watch as ST

KEY = "substring(md5(regexp_replace(regexp_replace(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g')), 1, 16)"


def v(name):
    return lambda s, d: staged(s, d, name, lambda: view(s, d, name))


saved, links, tags = v("v_saved"), v("v_saved_images"), v("v_saved_tags")


def doc_images(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("content_hash"))


def doc_keys(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("file_id"), S.prompt_key("text").alias("key"))


IMG = f"img as (select doc_id as id, md5(text) as content_hash, {KEY.format('text')} as key from documents), sk as (select prompt_id, {KEY.format('positive')} as key from v_saved), by_hash as (select distinct prompt_id, id from v_saved_images join img using (content_hash)), by_key as (select distinct prompt_id, id from sk join img using (key))"


def both_matches(s, d):
    return P.saved_prompt_files(doc_images(s, d), doc_keys(s, d), links(s, d), saved(s, d))


@query("p09_saved_prompt_files", f"with {IMG} select * from by_hash union select * from by_key")
def _(s, d):
    return both_matches(s, d)


@query("s01_union_distinct", f"with {IMG} select * from by_hash union select * from by_key")
def _(s, d):
    h = links(s, d).join(doc_images(s, d), "content_hash").select("prompt_id", "id")
    k = saved(s, d).select("prompt_id", S.prompt_key("positive").alias("key")).join(doc_keys(s, d), "key").select("prompt_id", F.col("file_id").alias("id"))
    return C.union_distinct(h, k)


@query("s02_union_ids", f"with {IMG} select distinct id from (select id from by_hash union all select id from by_key)")
def _(s, d):
    return both_matches(s, d).select("id").distinct()


@query("s04_tag_roles", "select role, count(*) as n from (select 'a' as role from documents union all select 'b' from benchmark) group by role")
def _(s, d):
    return table(s, d, "documents").select(F.lit("a").alias("role")).unionByName(table(s, d, "benchmark").select(F.lit("b").alias("role"))).groupBy("role").agg(F.count("*").alias("n"))


@query("p14_search_collection", "select prompt_id from v_saved v where (contains(lower(title), 'an') or contains(lower(positive), 'an') or exists (select 1 from v_saved_tags t where t.prompt_id = v.prompt_id and contains(t.tag, 'an'))) and exists (select 1 from v_saved_tags t where t.prompt_id = v.prompt_id and t.tag = 'even') and model_family = 'fam-2'")
def _(s, d):
    return P.search_collection(saved(s, d), tags(s, d), "an", "even", "fam-2").select("prompt_id")


@query("j09_images_with_originals", "select prompt_id, content_hash, role, prompt_id % 2 = 0 and role = 'reference' as has_original from v_saved_images where content_hash not in (select content_hash from v_saved_images group by content_hash having count(*) > 1)")
def _(s, d):
    i = links(s, d)
    once = i.groupBy("content_hash").agg(F.count("*").alias("n")).where("n = 1").select("content_hash")
    i = i.join(once, "content_hash", "left_semi")
    return C.images_with_originals(i, i.where("prompt_id % 2 = 0 and role = 'reference'").select("content_hash")).select("prompt_id", "content_hash", "role", "has_original")


@query("j10_prompts_for_images", f"with {IMG} select id, prompt_id, 'linked' as relation from by_hash union all (select id, prompt_id, 'matching' from by_key except select id, prompt_id, 'matching' from by_hash)")
def _(s, d):
    return C.prompts_for_images(doc_images(s, d), doc_keys(s, d), saved(s, d), links(s, d)).distinct()


@query("a18_collection_facets", "select 'family' as facet, model_family as value, count(*) as count from v_saved where model_family is not null group by model_family union all select 'tag', tag, count(distinct prompt_id) from v_saved_tags group by tag")
def _(s, d):
    return C.facets(saved(s, d), tags(s, d))


@query("a19_summaries", """select s.prompt_id, coalesce(t.tags, '') as tags, i.cover, coalesce(i.refs, 0) as "references", coalesce(i.attempts, 0) as attempts from v_saved s
 left join (select prompt_id, string_agg(tag, '|' order by tag) as tags from (select distinct * from v_saved_tags) group by prompt_id) t on t.prompt_id = s.prompt_id
 left join (select prompt_id, (list(content_hash order by role <> 'reference', position))[1] as cover, count(*) filter (role = 'reference') as refs, count(*) filter (role = 'attempt') as attempts from v_saved_images group by prompt_id) i on i.prompt_id = s.prompt_id""")
def _(s, d):
    return C.summaries(saved(s, d), links(s, d), tags(s, d)).select("prompt_id", joined("tags"), "cover", "references", "attempts")


@query("a20_library_counts", f"with {IMG}, u as (select * from by_hash union select * from by_key) select s.prompt_id, count(u.id) as files from v_saved s left join u on u.prompt_id = s.prompt_id group by s.prompt_id")
def _(s, d):
    return C.library_counts(saved(s, d), both_matches(s, d))


@query("a21_library_ids", f"with {IMG} select content_hash, string_agg(id, '|' order by id) as ids from img where content_hash in (select content_hash from v_saved_images) group by content_hash")
def _(s, d):
    return C.library_ids(doc_images(s, d), links(s, d)).select("content_hash", joined("ids"))


@query("u01_rename_rows", "select id, case when id % 5 = 0 and id % 3 <> 0 then regexp_replace(rel_path, '[^/]*$', 'n-' || id || '.PNG') else rel_path end as rel_path from v_files")
def _(s, d):
    f = view(s, d, "v_files")
    names = f.where("id % 5 = 0").select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("a/"), F.col("id"), F.lit(".png"))).otherwise(F.concat(F.lit("n-"), F.col("id"), F.lit(".PNG"))).alias("name"))
    return C.rename_rows(f, names)[0].select("id", "rel_path")


@query("u01_rename_failures", "select id, 'characters' as error from v_files where id % 15 = 0")
def _(s, d):
    f = view(s, d, "v_files")
    return C.rename_rows(f, f.where("id % 15 = 0").select("id", F.concat(F.lit("a/"), F.col("id"), F.lit(".png")).alias("name")))[1]


def tagged(s, d):
    return view(s, d, "v_tags").groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


@query("u02_retag_rows", "select file_id as id, array_to_string(case when file_id % 2 = 0 then list_sort(list_distinct(list_filter(list(distinct tag), lambda x: x <> 'quality') || ['edited'])) else list_sort(list(distinct tag)) end, '|') as tags from v_tags group by file_id")
def _(s, d):
    t = tagged(s, d)
    edits = t.where("id % 2 = 0").select("id", F.array(F.lit("edited")).alias("add"), F.array(F.lit("quality")).alias("remove"))
    return C.retag_rows(t, edits)[0].select("id", joined("tags"))


@query("u03_remove_rows", "select file_id, position from v_loras where file_id % 10 <> 0")
def _(s, d):
    return C.remove_rows(view(s, d, "v_loras"), view(s, d, "v_files").where("id % 10 = 0"), "file_id").select("file_id", F.col("position"))


def changes(s, d):
    return saved(s, d).where("prompt_id % 4 = 0").select("prompt_id", F.when(F.col("prompt_id") % 8 == 0, "").otherwise("new title").alias("title"), F.array(F.lit(" New  Tag ")).alias("tags"))


@query("u04_save_prompts", "select prompt_id, case when prompt_id % 4 = 0 and prompt_id % 8 <> 0 then 'new title' else title end as title from v_saved")
def _(s, d):
    return C.save_prompts(saved(s, d), tags(s, d), changes(s, d))[0].select("prompt_id", "title")


@query("u04_save_tags", "select prompt_id, tag from v_saved_tags where not (prompt_id % 4 = 0 and prompt_id % 8 <> 0) union all select prompt_id, 'new tag' from v_saved where prompt_id % 4 = 0 and prompt_id % 8 <> 0")
def _(s, d):
    return C.save_prompts(saved(s, d), tags(s, d), changes(s, d))[1]


@query("u04_delete_prompts", "select prompt_id, content_hash, role from v_saved_images where prompt_id % 3 <> 0")
def _(s, d):
    store = {"prompts": saved(s, d), "images": links(s, d), "tags": tags(s, d)}
    return C.delete_prompts(store, saved(s, d).where("prompt_id % 3 = 0"))["images"].select("prompt_id", "content_hash", "role")


@query("u05_link_attempts", "select prompt_id, content_hash, role, position from v_saved_images union all select prompt_id, md5('x' || prompt_id), 'attempt', coalesce(m, -1) + 1 from v_saved left join (select prompt_id, max(position) as m from v_saved_images where role = 'attempt' group by prompt_id) using (prompt_id)")
def _(s, d):
    new = saved(s, d).select("prompt_id", F.md5(F.concat(F.lit("x"), F.col("prompt_id"))).alias("content_hash"))
    return C.link_attempts(links(s, d), new.unionByName(links(s, d).select("prompt_id", "content_hash"))).select("prompt_id", "content_hash", "role", F.col("position").cast("bigint").alias("position"))


@query("u05_unlink_attempts", "select prompt_id, content_hash, role from v_saved_images where not (role = 'attempt' and prompt_id % 2 = 0)")
def _(s, d):
    return C.unlink_attempts(links(s, d), links(s, d).where("prompt_id % 2 = 0")).select("prompt_id", "content_hash", "role")


@query("u06_rehash_attempts", "select prompt_id, content_hash, role from v_saved_images where not (role = 'attempt' and prompt_id % 2 = 0 and content_hash not in (select content_hash from v_saved_images where prompt_id % 2 = 1)) union select i.prompt_id, md5(i.content_hash), 'attempt' from v_saved_images i where role = 'attempt' and content_hash in (select content_hash from v_saved_images where role = 'attempt' and prompt_id % 2 = 0) and content_hash not in (select content_hash from v_saved_images where prompt_id % 2 = 1)")
def _(s, d):
    i = links(s, d)
    odd = i.where("prompt_id % 2 = 1").select("content_hash")
    mapping = i.where("role = 'attempt' and prompt_id % 2 = 0").join(odd, "content_hash", "left_anti").select(F.col("content_hash").alias("old"), F.md5("content_hash").alias("new")).distinct()
    return C.rehash_attempts(i, mapping, False).select("prompt_id", "content_hash", "role").distinct()


@query("u07_orphan_originals", "select content_hash from (select md5(text) as content_hash, 1700000000 + doc_id * 3600 as added_at from documents group by all) where added_at < 1700000000 + 400000 - 86400 and content_hash not in (select content_hash from v_saved_images where role = 'reference')")
def _(s, d):
    o = table(s, d, "documents").select(F.md5("text").alias("content_hash"), (1700000000 + F.col("doc_id") * 3600).alias("added_at"))
    return C.orphan_originals(o, links(s, d), 1700000000 + 400000)


@query("u08_drafts", "select o_orderkey as file_id, case when o_orderkey % 2 = 0 then 'extracted ' || o_custkey else concat('order of ', o_custkey, ' <lora:part-', o_custkey % 7, ':0.8>') end as positive, case when o_orderkey % 2 = 0 then 'extracted ' else 'order of ' end || o_custkey as title, case when o_orderkey % 2 = 0 then 'extraction' else 'a1111' end as source from orders")
def _(s, d):
    gens = table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("extracted "), F.col("o_custkey")).alias("positive_prompt"))
    return C.drafts(gens, view(s, d, "v_a1111").withColumnRenamed("id", "file_id"))


FIELDS = ["base_model", "sampler_name", "scheduler", "steps", "seed"]


@query("c01_compare_fields", "with j as (select a_id, b_id, x.base_model as a1, y.base_model as b1, x.sampler_name as a2, y.sampler_name as b2, x.scheduler as a3, y.scheduler as b3, cast(x.steps as varchar) as a4, cast(y.steps as varchar) as b4, x.seed as a5, y.seed as b5 from v_pairs join v_generations x on x.file_id = a_id join v_generations y on y.file_id = b_id), u as (select a_id, b_id, unnest(['base_model', 'sampler_name', 'scheduler', 'steps', 'seed']) as field, unnest([a1, a2, a3, a4, a5]) as a, unnest([b1, b2, b3, b4, b5]) as b from j) select *, a is distinct from b as differs from u")
def _(s, d):
    return D.compare_fields(view(s, d, "v_pairs"), view(s, d, "v_generations"), FIELDS)


@query("c02_compare_loras", """with u as (select *, row_number() over (partition by file_id, name order by position) as nth from v_loras), a as (select a_id, b_id, name, nth, position, strength_model from v_pairs join u on file_id = a_id), b as (select a_id, b_id, name, nth, position, strength_model from v_pairs join u on file_id = b_id)
 select a_id, b_id, name, nth, a.position as a_position, b.position as b_position, a.position is null or b.position is null or a.strength_model is distinct from b.strength_model as differs from a full join b using (a_id, b_id, name, nth)""")
def _(s, d):
    return D.compare_loras(view(s, d, "v_pairs"), view(s, d, "v_loras")).select("a_id", "b_id", "name", "nth", "a_position", "b_position", "differs")


@query("c03_stage_chains", "with g as (select file_id, base_name, list_sort(list(position)) as st from v_loras group by all) select file_id, base_name as base_model, array_to_string(st, '|') as stages, row_number() over (partition by file_id order by st[1]) - 1 as chain from g")
def _(s, d):
    st = view(s, d, "v_loras").select("file_id", F.col("position").alias("stage_index"), F.col("base_name").alias("base_model"), F.lit("").alias("lora_stack_key"))
    return D.stage_chains(st).select("file_id", "base_model", joined("stages"), "chain")


@query("c04_disabled_loras", "select distinct file_id, node_id from v_staged_loras where not enabled")
def _(s, d):
    return D.disabled_loras(view(s, d, "v_staged_loras")).select("file_id", "node_id")


@query("c06_word_diff", "select a.item_id as a_id, md5(a.text) as a_text, md5(b.text) as b_text, 0 as doubled from benchmark a join benchmark b on b.item_id = a.item_id + 1")
def _(s, d):
    side = lambda x: F.md5(F.array_join(F.transform("ops", lambda o: o[x]), ""))
    # both texts come back from the runs, and no two neighbours are of one kind
    doubled = F.size(F.filter(F.transform("ops", lambda o, i: o["op"] == F.get("ops", i + 1)["op"]), lambda same: F.coalesce(same, F.lit(False))))
    return D.word_diff(item_pairs(s, d), "a", "b").select("a_id", side("a").alias("a_text"), side("b").alias("b_text"), doubled.alias("doubled"))


def item_pairs(s, d):
    b = table(s, d, "benchmark")
    return b.select(F.col("item_id").alias("a_id"), F.col("text").alias("a")).join(b.select((F.col("item_id") - 1).alias("a_id"), F.col("text").alias("b")), "a_id")


TOKEN_SQL = "list_transform(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_''’-]+|\\s+|[^\\p{{L}}\\p{{N}}_''’\\s-]'), lambda t: case when trim(t, ' ' || chr(9) || chr(10) || chr(13)) = '' then ' ' else t end)"


@query("c06_common_tokens", f"""with recursive p as (select a.item_id as a_id, {TOKEN_SQL.format('a.text')} as x, {TOKEN_SQL.format('b.text')} as y from benchmark a join benchmark b on b.item_id = a.item_id + 1),
 k as (select a_id, x, y, 0 as i, list_transform(range(len(y) + 1), lambda v: 0::bigint) as r from p
   union all select a_id, x, y, i + 1, list_reduce(range(1, len(y) + 1), lambda c, j: list_append(c, case when x[i + 1] = y[j] then r[j] + 1 else greatest(r[j + 1], c[j]) end), [0::bigint]) from k where i < len(x))
 select a_id, r[len(r)] as same, (len(x) + 1) * (len(y) + 1) > 40000000 as coarse from k where i = len(x)""")
def _(s, d):
    """Tokens in `same` runs: the length of a longest common subsequence, which SQL counts on its own."""
    size = F.aggregate(F.filter("ops", lambda o: o["op"] == "same"), F.lit(0).cast("bigint"), lambda n, o: n + F.size(F.regexp_extract_all(o["a"], F.lit(r"[\p{L}\p{N}_'’-]+|\s+|[^\p{L}\p{N}_'’\s-]"), F.lit(0))))
    return D.word_diff(item_pairs(s, d), "a", "b", 40_000_000).select("a_id", size.alias("same"), "coarse")


@query("c06_coarse", f"""select a.item_id as a_id, (len({TOKEN_SQL.format("'x ' || a.text || ' x'")}) + 1) * (len({TOKEN_SQL.format("'y ' || b.text || ' y'")}) + 1) > 10000 as coarse from benchmark a join benchmark b on b.item_id = a.item_id + 1""")
def _(s, d):
    """Which pairs, made to begin and end differently, are too long to be aligned word by word."""
    framed = lambda c, by: F.concat(F.lit(f"{by} "), c, F.lit(f" {by}")).alias(c)
    return D.word_diff(item_pairs(s, d).select("a_id", framed("a", "x"), framed("b", "y")), "a", "b", 10_000).select("a_id", "coarse")


@query("src02_content_hash", "select doc_id, md5(text) as content_hash from documents")
def _(s, d):
    return X.with_content_hash(table(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))).select("doc_id", "content_hash")


def png(s, d):
    """(file_id, content): a PNG for each document with its text in a tEXt chunk, built by Spark from the table."""
    c = lambda h: F.unhex(F.lit(h))
    be = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    body = F.concat(F.encode(F.lit("prompt"), "UTF-8"), c("00"), F.unhex(F.hex(F.encode(F.col("source"), "UTF-8"))))
    ihdr = F.concat(c("0000000D49484452"), be(F.col("doc_id") % 900 + 1), be(F.col("n_chars") % 900 + 1), c("080200000000000000"))
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.concat(c("89504E470D0A1A0A"), ihdr, be(F.octet_length(body)), c("74455874"), body, c("00000000"), c("0000000049454E44AE426082")).alias("content"))


@query("src03_image_header", "select cast(doc_id as varchar) as file_id, 'png' as format, cast(doc_id % 900 + 1 as int) as width, cast(n_chars % 900 + 1 as int) as height from documents")
def _(s, d):
    return X.with_image_header(png(s, d)).select("file_id", "format", "width", "height")


@query("src04_extract_texts", "select cast(doc_id as varchar) as file_id, 'prompt' as key, source as text, 'tEXt' as source from documents")
def _(s, d):
    return X.extract_texts(png(s, d))


@query("src05_xmp_tags", "select file_id, string_agg(distinct tag, '|' order by tag) as tags from v_tags group by file_id")
def _(s, d):
    packet = view(s, d, "v_tags").groupBy("file_id").agg(F.concat(F.lit("<x><dc:subject><rdf:Bag>"), F.array_join(F.transform(F.collect_list("tag"), lambda t: F.concat(F.lit("<rdf:li> "), t, F.lit("</rdf:li>"))), ""), F.lit("</rdf:Bag></dc:subject></x>")).alias("p"))
    return packet.select("file_id", joined(S.xmp_tags("p"), "tags"))


def kinds(s, d):
    return staged(s, d, "kinds", lambda: X.classify_blobs(view(s, d, "v_blobs")))


@query("src06_classify_blobs", "select concat('e', event_id) as file_id, 'json' as kind, true as mismatch from events union all select concat('p', o_orderkey), 'workflow', false from orders")
def _(s, d):
    return kinds(s, d).select("file_id", "kind", "mismatch")


@query("e20_read_warnings", """select concat('e', event_id) as file_id, 'METADATA_KEY_MISMATCH' as code, 'key prompt holds json' as message from events
 union all select cast(id as varchar), 'UNSUPPORTED_FORMAT', 'text parameters are stored but not parsed' from v_a1111 union all select cast(doc_id as varchar), 'TRUNCATED', 'the file ends before its last part' from documents where doc_id % 3 = 0""")
def _(s, d):
    cut = png(s, d).withColumn("content", F.when(F.col("file_id").cast("long") % 3 == 0, F.expr("substring(content, 1, octet_length(content) - 30)")).otherwise(F.col("content")))
    flat = view(s, d, "v_a1111").select(F.col("id").cast("string").alias("file_id"), F.lit("UserComment").alias("key"), F.col("parameters").alias("text"))
    return X.read_warnings(X.extract_texts(cut), kinds(s, d).unionByName(X.classify_blobs(flat), allowMissingColumns=True)).select("file_id", "code", "message")


@query("src07_file_status", "select concat('e', event_id) as file_id, 'no_metadata' as status from events union all select concat('p', o_orderkey), 'partial' from orders")
def _(s, d):
    return X.file_status(kinds(s, d))


@query("src08_raw_metadata", "select concat('e', event_id) as file_id, 'prompt' as sources, cast(null as varchar) as workflow_json from events union all select concat('p', o_orderkey), 'workflow', concat('{\"nodes\":[],\"links\":[],\"v\":', o_orderkey, '}') from orders")
def _(s, d):
    return X.raw_metadata(kinds(s, d)).select("file_id", "sources", "workflow_json")


def scans(s, d):
    f = view(s, d, "v_files").select("id", "rel_path", "size", (F.col("generated_at") * 1_000_000_000).alias("mtime_ns"))
    return f.where("id % 11 <> 0").withColumn("size", F.when(F.col("id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))), f.where("id % 13 <> 0")


CHANGE = "case when id % 11 = 0 then 'deleted' when id % 13 = 0 then 'new' when id % 7 = 0 or id % 17 = 0 then 'changed' else 'unchanged' end"


def the_diff(s, d):
    scan, catalog = scans(s, d)
    return X.diff_catalog(scan, catalog, catalog.where("id % 17 = 0"))


@query("src09_diff_catalog", f"select rel_path, {CHANGE} as change from v_files where not (id % 11 = 0 and id % 13 = 0)")
def _(s, d):
    return the_diff(s, d)


@query("src10_upsert_catalog", "select id, case when id % 7 = 0 then size + 1 else size end as size from v_files where id % 11 <> 0 ")
def _(s, d):
    scan, catalog = scans(s, d)
    gone = catalog.join(scan.select("id"), "id", "left_anti")
    return X.upsert_catalog(catalog, scan, "id", gone).select("id", "size")


@query("src11_reextract_plan", "select id as file_id from v_files where id % 4 <> 3 or id % 5 = 0")
def _(s, d):
    f = view(s, d, "v_files").select(F.col("id").alias("file_id"), (F.col("id") % 4).alias("extractor_version"), F.when(F.col("id") % 5 == 0, "old").otherwise("new").alias("config_hash"))
    return X.reextract_plan(f, 3, "new")


@query("src12_missing_artifacts", "select content_hash, (list(rel_path order by id))[1] as rel_path from v_files where content_hash not in (select content_hash from v_files where id % 3 = 0) and content_hash not in (select content_hash from v_files where id % 5 = 0) group by content_hash")
def _(s, d):
    f = view(s, d, "v_files")
    return X.missing_artifacts(f, f.where("id % 3 = 0"), f.where("id % 5 = 0"))


@query("src13_run_summary", f"select change as metric, count(*)::double as value from (select {CHANGE} as change from v_files where not (id % 11 = 0 and id % 13 = 0)) group by change")
def _(s, d):
    return X.run_summary(the_diff(s, d), 2.0, 4).where("metric in ('new', 'changed', 'unchanged', 'deleted')")


@query("src15_export_collection", "select s.prompt_id, title, count(i.content_hash) as images from v_saved s left join v_saved_images i on i.prompt_id = s.prompt_id group by s.prompt_id, title")
def _(s, d):
    x = C.export_collection(saved(s, d), links(s, d), tags(s, d))
    n = F.coalesce(F.size(F.from_json(F.get_json_object("document", "$.images"), "array<string>")), F.lit(0))
    return x.select("prompt_id", F.get_json_object("document", "$.title").alias("title"), F.when(F.get_json_object("document", "$.images").isNull(), 0).otherwise(n).cast("bigint").alias("images"))


@query("src16_import_collection", "select count(*) filter (prompt_id % 2 = 1 and prompt_id % 3 <> 0) as added, count(*) filter (not (prompt_id % 2 = 1 and prompt_id % 3 <> 0)) as skipped from v_saved where prompt_id % 2 = 1 or prompt_id % 3 = 0")
def _(s, d):
    p, i = saved(s, d), links(s, d)
    own, more = p.where("not (prompt_id % 2 = 1 and prompt_id % 3 <> 0)"), p.where("prompt_id % 2 = 1 or prompt_id % 3 = 0")
    return C.import_collection(own, i.where("prompt_id % 2 = 0"), more, i, i.select("content_hash").distinct())[2]


@query("st02_quiet_sessions", "with e as (select ts, user_id, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events), g as (select *, sum(new) over (partition by user_id order by ts) as g from e) select user_id, cast(min(ts) as varchar) as start, count(*) as count from g group by user_id, g")
def _(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.quiet_sessions(e, "ts", "6 hours", "user_id").select("user_id", F.col("start").cast("string").alias("start"), "count")


def replayed(s, d, name, make, mode):
    """The end state of a stream over the events, see ended()."""
    import uuid

    from imprynt.sources.tables import written

    source = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = written(source, "stream").inputFiles()[0].rsplit("/", 1)[0]
    return ended(s, make(ST.watch_table(s, path, source.schema)), f"{path.rsplit('/', 1)[0]}/{name}-{uuid.uuid4().hex}", mode)


def ended(s, stream, at, mode):
    """The end state of a stream, as Parquet in the shared folder: in complete mode the last batch, else all of them. A
    batch that runs again writes its folder again."""
    s.createDataFrame([], stream.schema).write.parquet(f"{at}/none")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{at}/{'all' if mode == 'complete' else batch_id}")

    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}-progress").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(at)


@query("st04_live_counts", "select cast(date_trunc('day', ts) as varchar) as bucket, event_type as series, count(*) as count from events group by all")
def _(s, d):
    out = replayed(s, d, "live", lambda e: ST.live_counts(e, "ts", "day", "event_type"), "complete")
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "series", "count")


@query("st05_replay_patches", "select id, case when id % 6 = 0 then 'second' when id % 3 = 0 then 'first' else status end as status from v_files where id % 5 <> 0")
def _(s, d):
    f = view(s, d, "v_files").select("id", "status")
    log = f.where("id % 3 = 0").select("id", F.lit(1).alias("seq"), F.lit("set").alias("op"), F.lit("first").alias("status"))
    log = log.unionByName(f.where("id % 6 = 0").select("id", F.lit(2).alias("seq"), F.lit("set").alias("op"), F.lit("second").alias("status")))
    log = log.unionByName(f.where("id % 5 = 0").select("id", F.lit(3).alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("status")))
    return ST.replay_patches(ST.replay_patches(f, log), log)


@query("st06_dedupe_stream", "select distinct user_id from events")
def _(s, d):
    return replayed(s, d, "dedupe", lambda e: ST.dedupe_stream(e.select("user_id"), ["user_id"]), "append")


FOLDERS = "select lang, source, sum(strlen(text) + 1) as size from documents group by all"


def library(s, d):
    """A folder tree of text files, lang/source, written from documents; its root."""
    import uuid

    root = f"{staged(s, d, 'library_root', lambda: table(s, d, 'documents').limit(0)).inputFiles()[0].rsplit('/', 2)[0]}/library-{uuid.uuid4().hex}"
    table(s, d, "documents").select("text", "lang", "source").repartition("lang", "source").write.partitionBy("lang", "source").text(root)
    return root


def by_folder(files, path, size):
    part = lambda name: F.regexp_extract(path, f"(?:^|/){name}=([^/]*)/", 1)
    return files.groupBy(part("lang").alias("lang"), part("source").alias("source")).agg(F.sum(size).alias("size"))


@query("src01_scan_library", FOLDERS)
def _(s, d):
    return by_folder(X.scan_library(s, library(s, d), extensions=(".txt",)), "rel_path", "size")


@query("st01_watch_source", FOLDERS)
def _(s, d):
    root = library(s, d)
    stream = ST.watch_source(s, root, extensions=(".txt",))
    return by_folder(ended(s, stream.select("path", "length"), f"{root}-seen", "append"), "path", "length")


def at_new(s, d, name):
    """A new folder beside the staged tables."""
    import uuid

    return f"{staged(s, d, 'library_root', lambda: table(s, d, 'documents').limit(0)).inputFiles()[0].rsplit('/', 2)[0]}/{name}-{uuid.uuid4().hex}"


@query("st03_index_stream", "select user_id, max(event_id) as seq, max_by(event_type, event_id) as event_type from events group by user_id having max_by(event_id % 5, event_id) <> 0")
def _(s, d):
    source = table(s, d, "events").select("user_id", F.col("event_id").alias("seq"), "event_type")
    at = at_new(s, d, "updates")
    source.repartition(4).write.parquet(at)
    catalog = K.Catalog(s, at_new(s, d, "catalog"), source.schema, "user_id", buckets=16, most_deltas=2)
    run = K.index_stream(ST.watch_table(s, at, source.schema, 1), catalog, f"{at}-state", "seq % 5 = 0").trigger(availableNow=True).start()
    run.awaitTermination()
    return catalog.read()


@query("src10_merge_on_read", "select id, case when id % 7 = 0 then size + 1 else size end as size from v_files where id % 11 <> 0 ")
def _(s, d):
    """The upsert in three appends and a compaction between."""
    scan, catalog = (f.select("id", "size") for f in scans(s, d))
    c = K.Catalog(s, at_new(s, d, "catalog"), catalog.withColumn("seq", F.lit(0).cast("long")).schema, "id", buckets=16)
    c.append(catalog.withColumn("seq", F.lit(1)))
    c.append(scan.where("id % 2 = 0").withColumn("seq", F.lit(2)))
    c.compact(whole=True)
    c.append(scan.where("id % 2 = 1").withColumn("seq", F.lit(3)))
    c.append(catalog.join(scan.select("id"), "id", "left_anti").withColumn("seq", F.lit(4)), deleted="true")
    return c.read().drop("seq")


@query("st03_coalesced_requests", "select distinct lang, source from documents")
def _(s, d):
    """Requests for folders, in many files, as few runs; what was asked for in all runs."""
    asked, seen = at_new(s, d, "asked"), at_new(s, d, "reread")
    rows = table(s, d, "documents").select("lang", "source")
    rows.repartition(8).write.parquet(asked)
    s.createDataFrame([], rows.schema).write.parquet(seen)
    K.on_request(s.readStream.schema(rows.schema).parquet(asked), lambda wanted: wanted.write.mode("append").parquet(seen), f"{asked}-state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(seen)


@query("st06_dedupe_horizon", "select distinct user_id, cast(date_trunc('day', ts) as varchar) as day from events")
def _(s, d):
    """First events of a user and day on a stream in the order of time, whose state holds some days."""
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("day", F.date_trunc("day", "ts"))
    at = at_new(s, d, "by_time")
    e.repartitionByRange(4, "ts").write.parquet(at)
    out = ST.dedupe_stream(ST.watch_table(s, at, e.schema, 100), ["user_id", "day"], "ts", "3 days")
    return ended(s, out.select("user_id", "day"), f"{at}-seen", "append").select("user_id", F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("day"))


def hard_png(s, d):
    """(file_id, content): PNG files whose chunks hold texts in two encodings, packed, damaged and too long, from documents."""
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def build(source: pd.Series, text: pd.Series) -> pd.Series:
        head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0))
        parts = lambda s, t: (chunk(b"tEXt", f"prompt\0{s} größe €".encode()), chunk(b"tEXt", f"old\0{s} größe".encode("latin-1")), chunk(b"zTXt", b"bad\0\0\x78\x9c" + b"\xff" * 9), chunk(b"zTXt", b"long\0\0" + zlib.compress(t.encode(), 1)), chunk(b"iTXt", b"last\0\1\0\0\0" + zlib.compress(s.encode())))
        return pd.Series([head + b"".join(parts(s, t)) + chunk(b"IEND", b"") for s, t in zip(source, text, strict=True)])

    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.pandas_udf(build, "binary")("source", "text").alias("content"))


@query("src04_hard_chunks", """select cast(doc_id as varchar) as file_id, 'prompt' as key, md5(source || ' größe €') as text from documents union all select cast(doc_id as varchar), 'old', md5(source || ' größe') from documents
 union all select cast(doc_id as varchar), 'long', md5(text) from documents where strlen(text) <= 2000 union all select cast(doc_id as varchar), 'last', md5(source) from documents""")
def _(s, d):
    return X.extract_texts(hard_png(s, d), most=2000).select("file_id", "key", F.md5("text").alias("text"))


@query("src03_jpeg_size", "select cast(doc_id as varchar) as file_id, 'jpeg' as format, cast(doc_id % 900 + 1 as int) as width, cast(n_chars % 900 + 1 as int) as height from documents")
def _(s, d):
    """JPEG files of a table segment, fill bytes and a frame header, from documents."""
    hex_ = lambda x: F.lpad(F.hex(x), 4, "0")
    head = F.concat(F.lit("FFD8FFE00006"), F.substring(F.md5("source"), 1, 8), F.lit("FFFFC40004C0C0FFC2000B08"), hex_(F.col("n_chars") % 900 + 1), hex_(F.col("doc_id") % 900 + 1), F.lit("01112200FFDA0002"))
    return X.with_image_header(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.unhex(head).alias("content"))).drop("content")


@query("src01_odd_names", "select concat('_', doc_id % 7, '/') as folder, count(*) as files from documents group by 1")
def _(s, d):
    """Names with "_" in front, a pruned folder beside them: Spark's own listing would see none of these."""
    root = library(s, d)
    files = table(s, d, "documents").select(F.concat(F.lit("_"), F.col("doc_id") % 7).alias("folder"), F.concat(F.lit("_"), "doc_id", F.lit(".png")).alias("name"))
    base = re.sub("^file:/*", "/", root)

    def touch(frames):
        import os

        for f in frames:
            for folder, name in zip(f["folder"], f["name"], strict=True):
                for way in (folder, f"{folder}/.cache"):
                    os.makedirs(f"{base}/{way}", exist_ok=True)
                    with open(f"{base}/{way}/{name}", "w"):
                        pass
            yield pd.DataFrame({"n": [len(f)]})

    files.mapInPandas(touch, "n long").agg(F.sum("n")).collect()
    return X.scan_library(s, root).groupBy(F.regexp_extract("rel_path", "^(.*/)", 1).alias("folder")).agg(F.count("*").alias("files"))

"""Queries for scope, statistics, lists and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from imprynt.functions import scalars as S
from imprynt.operators import scope as P
from imprynt.operators import stats as A
from imprynt.plans.fixtures import table, view
from imprynt.plans.registry import joined, query, r6


def wide(spark, sf):
    return P.wide_images(view(spark, sf, "v_files"), view(spark, sf, "v_generations"), view(spark, sf, "v_tags"))


def rows(spark, sf):
    """Resolved rows of the whole library."""
    return P.resolve(wide(spark, sf))[0]


WIDE = """
with tg as (select file_id as id, list_sort(list(distinct tag)) as tags from v_tags group by file_id),
 wide as (select f.id, rel_path, content_hash, format, status, width, height, date, timestamp_suspect, size, generated_at, g.model_family, base_model, sampler_name, scheduler,
   steps, cfg, denoise, stage_count, shift, try_cast(seed as hugeint) as seed, g.file_id is not null as has_generation, coalesce(tags, []) as tags,
   width || 'x' || height as resolution, round(width * height / 1000000.0, 3) as megapixels
 from v_files f left join v_generations g on g.file_id = f.id left join tg on tg.id = f.id),
 res as (select *, coalesce(model_family, 'unknown') as grp from wide where has_generation qualify content_hash = '' or id = min(id) over (partition by content_hash))"""


@query("src17_wide_images", WIDE + """
 select id, status, model_family, base_model, steps, cfg, cast(seed as varchar) as seed, has_generation, array_to_string(tags, '|') as tags, resolution, megapixels, cast(date as varchar) as date from wide""")
def _(spark, sf):
    w = wide(spark, sf)
    return w.select("id", "status", "model_family", "base_model", "steps", "cfg", F.col("seed").cast("string").alias("seed"), "has_generation", joined("tags"), "resolution", "megapixels", F.col("date").cast("string").alias("date"))


@query("f04_aspect", """
 select id, round(width::double / height, 3) as aspect, case when e.e <= 0.03 then e.l else 'other' end as label, round(width::double * height / 1000000, 3) as megapixels
 from (select id, width::double as width, height::double as height, list_min([{'e': abs(width::double / height - x.w / x.h) / (x.w / x.h), 'i': x.i, 'l': x.w::int || ':' || x.h::int} for x in
  [{'w': 1.0, 'h': 1.0, 'i': 0}, {'w': 4.0, 'h': 5.0, 'i': 1}, {'w': 3.0, 'h': 4.0, 'i': 2}, {'w': 2.0, 'h': 3.0, 'i': 3}, {'w': 9.0, 'h': 16.0, 'i': 4}, {'w': 9.0, 'h': 21.0, 'i': 5},
   {'w': 5.0, 'h': 4.0, 'i': 6}, {'w': 4.0, 'h': 3.0, 'i': 7}, {'w': 3.0, 'h': 2.0, 'i': 8}, {'w': 16.0, 'h': 9.0, 'i': 9}, {'w': 21.0, 'h': 9.0, 'i': 10}]]) as e from v_files)""")
def _(spark, sf):
    x = S.size_facts("width", "height")
    return view(spark, sf, "v_files").select("id", x["aspect"].alias("aspect"), x["aspect_label"].alias("label"), x["megapixels"].alias("megapixels"))


def scoped(name: str, scope: P.Scope, where: str, **more):
    """A query of the ids that a scope leaves."""

    @query(name, f"{WIDE} select id from wide where {where}")
    def _(spark, sf):
        kw = {k: v(spark, sf) for k, v in more.items()}
        return P.apply(wide(spark, sf), scope, **kw).select("id")


scoped("p01_list_filters", P.Scope(families=("1-URGENT", "5-LOW"), samplers=("sampler-1", "sampler-2"), statuses=("ok",)), "model_family in ('1-URGENT', '5-LOW') and sampler_name in ('sampler-1', 'sampler-2') and status = 'ok'")
scoped("p02_no_metadata", P.Scope(families=("3-MEDIUM", P.NO_METADATA)), "model_family = '3-MEDIUM' or model_family is null")
scoped("p03_tags_any", P.Scope(tags=("quality", "src3")), "list_has_any(tags, ['quality', 'src3'])")
scoped("p04_dates", P.Scope(date_from="1994-03-01", date_to="1996-01-31"), "date between date '1994-03-01' and date '1996-01-31'")
scoped("p05_ranges", P.Scope(ranges={"steps": (10, 20), "cfg": (1.5, None)}), "steps between 10 and 20 and cfg >= 1.5")
scoped("p06_loras_any", P.Scope(loras=("part-3_000001000", "part-7_000002000")), "id in (select file_id from v_loras where name in ('part-3_000001000', 'part-7_000002000'))", loras=lambda s, d: view(s, d, "v_loras"))
scoped("p06_loras_all", P.Scope(loras=("part-3_000001000", "part-7_000002000"), lora_mode="all"), "id in (select file_id from v_loras where name in ('part-3_000001000', 'part-7_000002000') group by file_id having count(distinct name) = 2)", loras=lambda s, d: view(s, d, "v_loras"))
scoped("p07_text_search", P.Scope(text="The of, THE"), "id in (select doc_id from documents where ' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{M}\\p{N}_]+'), ' ') || ' ' like '% the of the %')", texts=lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("file_id"), "text"))
scoped("p08_saved", P.Scope(saved=True, statuses=("ok",)), "status = 'ok' and content_hash in (select content_hash from v_files where id % 7 = 0)", links=lambda s, d: view(s, d, "v_files").where("id % 7 = 0").select("content_hash"))
scoped("p08_unsaved", P.Scope(saved=False), "content_hash not in (select content_hash from v_files where id % 7 = 0)", links=lambda s, d: view(s, d, "v_files").where("id % 7 = 0").select("content_hash"))
scoped("p11_selection", P.Scope(ids=(1, 5, 9, 100), families=("1-URGENT",)), "id in (1, 5, 9, 100)")


@query("p12_ignore_dates", f"{WIDE} select id from wide where status = 'ok'")
def _(spark, sf):
    return P.apply(wide(spark, sf), P.Scope(statuses=("ok",), date_from="1995-01-01"), ignore_dates=True).select("id")


@query("p13_resolve", f"""{WIDE} select count(*) as size, count(*) filter (not has_generation) as excluded,
  count(*) filter (has_generation) - (select count(*) from res) as duplicates, (select count(*) from res) as analyzed from wide""")
def _(spark, sf):
    return P.resolve(wide(spark, sf))[1]


@query("w01_dedupe", f"{WIDE} select id, grp from res")
def _(spark, sf):
    return rows(spark, sf).select("id", F.col("group").alias("grp"))


CATEGORIES = ["base_model", "sampler_name", "scheduler", "steps"]
NUMBERS = ["steps", "cfg", "denoise", "shift", "megapixels"]
_texts = " union all ".join(f"select grp, '{c}' as field, cast({c} as varchar) as value from res" for c in CATEGORIES)
_nums = " union all ".join(f"select grp, '{c}' as field, cast({c} as double) as value from res" for c in NUMBERS)


@query("a01_value_counts", f"""{WIDE}, v as ({_texts}), c as (select grp, field, value, count(*) as count from v group by all),
 s as (select *, sum(count) over d as total, coalesce(sum(count) filter (value is null) over d, 0) as missing from c window d as (partition by grp, field)),
 k as (select *, row_number() over (partition by grp, field order by count desc, value) as rank from s where value is not null qualify rank <= 5)
 select grp, field, value, count, round(count / total, 6) as share, rank, cast(total - missing - sum(count) over (partition by grp, field) as bigint) as other, cast(missing as bigint) as missing from k""")
def _(spark, sf):
    return A.value_counts(rows(spark, sf), CATEGORIES, top_n=5).select(F.col("group").alias("grp"), "field", "value", "count", r6("share"), "rank", "other", "missing")


@query("a02_tag_counts", f"""{WIDE}, n as (select grp, count(*) as files, count(*) filter (len(tags) > 0) as n from res group by grp),
 c as (select grp, value, count(*) as count from (select grp, unnest(tags) as value from res) group by all)
 select grp, value, count, round(count / files, 6) as share, row_number() over (partition by grp order by count desc, value) as rank, n from c join n using (grp) qualify rank <= 10""")
def _(spark, sf):
    return A.tag_counts(rows(spark, sf), top_n=10).select(F.col("group").alias("grp"), "value", "count", r6("share"), "rank", "n")


@query("a03_seeds", f"""{WIDE}, c as (select grp, seed, count(*) as count from res where seed is not null group by all)
 select grp, cast(seed as varchar) as seed, count, row_number() over (partition by grp order by count desc, seed) as rank,
  cast(n as bigint) as n, n_unique from (select *, sum(count) over d as n, count(*) over d as n_unique from c window d as (partition by grp)) where count > 1 qualify rank <= 10""")
def _(spark, sf):
    sums, top = A.seed_stats(rows(spark, sf))
    return top.join(sums, "group").select(F.col("group").alias("grp"), F.col("seed").cast("string").alias("seed"), "count", "rank", "n", "n_unique")


@query("a04_numeric_stats", f"""{WIDE}, v as ({_nums})
 select grp, field, count(value) as n, count(*) - count(value) as n_missing, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(min(value), 6) as min,
  round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as p75, round(max(value), 6) as max from v group by grp, field""")
def _(spark, sf):
    return A.numeric_stats(rows(spark, sf), NUMBERS).select(F.col("group").alias("grp"), "field", "n", "n_missing", *(r6(c) for c in ("mean", "std", "min", "p25", "median", "p75", "max")))


@query("a04_lineitem_profile", """select l_returnflag as grp, field, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 4) as std, round(quantile_cont(value, 0.25), 6) as p25,
  round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as p75, round(max(value), 6) as max
 from (select l_returnflag, 'l_quantity' as field, l_quantity as value from lineitem union all select l_returnflag, 'l_discount', l_discount from lineitem) group by all""")
def _(spark, sf):
    return A.numeric_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag").select(F.col("l_returnflag").alias("grp"), "field", "n", r6("mean"), F.round("std", 4).alias("std"), *(r6(c) for c in ("p25", "median", "p75", "max")))


_rounded = f"{WIDE}, v as ({_nums}), c as (select grp, field, round_even(value, 4) + 0.0 as value, count(*) as count, min(value) as lo, max(value) as hi from v where value is not null group by grp, field, round_even(value, 4) + 0.0)"


@query("a05_modes", f"""{_rounded}, p as (select grp, field, max(count) as top, sum(count) as n from c group by all),
 b as (select grp, field, list_sort(list(value)) as vs, any_value(top) as top, any_value(n) as n from c join p using (grp, field) where count = top group by grp, field)
 select grp, field, case when top = 1 and n > 1 then '' else array_to_string([printf('%.4f', x) for x in vs[1:3]], '|') end as mode, not (top = 1 and n > 1) and len(vs) > 1 as tied,
  case when not (top = 1 and n > 1) then round(top / n, 6) end as share from b""")
def _(spark, sf):
    out = A.modes(rows(spark, sf), NUMBERS)
    return out.select(F.col("group").alias("grp"), "field", F.array_join(F.transform("mode", lambda x: F.format_string("%.4f", x)), "|").alias("mode"), "tied", r6("share"))


@query("a06_histogram", f"""{_rounded}, p as (select grp, field, count(*) as k, min(lo) as low, max(hi) as high from c group by all),
 f as (select grp, field, cast(least(greatest(floor((value - low) / ((high - low) / 20)), 0), 19) as int) as bin, sum(count) as count from c join p using (grp, field) where k > 25 group by all)
 select grp, field, 'value' as kind, round(value, 4) as x0, cast(count as bigint) as count from c join p using (grp, field) where k <= 25
 union all select p.grp, p.field, 'bin', round(low + (high - low) / 20 * b.bin, 4), cast(coalesce(f.count, 0) as bigint) from p cross join (select unnest(range(20)) as bin) b
   left join f on f.grp = p.grp and f.field = p.field and f.bin = b.bin where k > 25""")
def _(spark, sf):
    return A.histogram(rows(spark, sf), NUMBERS).select(F.col("group").alias("grp"), "field", "kind", F.round("x0", 4).alias("x0"), "count")


def uses(spark, sf):
    return view(spark, sf, "v_loras").where("reachable and enabled").join(rows(spark, sf).select(F.col("id").alias("file_id"), "group"), "file_id").withColumnRenamed("file_id", "id")


_uses = f"{WIDE}, u as (select grp, l.* from v_loras l join res on res.id = l.file_id where reachable and enabled), n as (select grp, count(*) as rows from res group by grp)"


@query("a07_lora_table", f"""{_uses} select grp, base_name as lora, count(distinct file_id) as files, count(*) as uses, round(count(distinct file_id) / any_value(rows), 6) as share, round(avg(strength_model), 6) as model_mean,
  round(quantile_cont(strength_model, 0.5), 6) as model_median, round(avg(strength_clip), 6) as clip_mean, count(*) filter (position = 0) as first_positions from u join n using (grp) group by grp, base_name""")
def _(spark, sf):
    sizes = rows(spark, sf).groupBy("group").agg(F.count("*").alias("rows"))
    return A.lora_table(uses(spark, sf), sizes, "base_name").select(F.col("group").alias("grp"), "lora", "files", "uses", r6("share"), r6("model_mean"), r6("model_median"), r6("clip_mean"), "first_positions")


@query("a07_lora_steps", f"{_uses} select grp, base_name as lora, cast(step as bigint) as value, count(*) as count from u group by all")
def _(spark, sf):
    return A.lora_values(uses(spark, sf), "base_name", "step").withColumnRenamed("group", "grp")


@query("a08_top_values", f"""{WIDE}, e as (select grp, base_model, id, row_number() over (partition by grp, base_model order by generated_at desc nulls last, id desc) as r from res where base_model is not null)
 select grp, base_model, count(*) as count, array_to_string(list(id order by r) filter (r <= 6), '|') as ids, row_number() over (partition by grp order by count(*) desc, base_model) as rank from e group by grp, base_model qualify rank <= 20""")
def _(spark, sf):
    return A.top_values(rows(spark, sf), "base_model").select(F.col("group").alias("grp"), "base_model", "count", joined("ids"), "rank")


@query("a09_top_configs", f"""{WIDE}, k as (select *, concat_ws('/', coalesce(base_model, '?'), coalesce(sampler_name, '?'), coalesce(scheduler, '?')) as key from res), n as (select grp, count(*) as rows from res group by grp)
 select grp, key as decoded, count(*) as count, round(count(*) / any_value(rows), 6) as share from k join n using (grp) group by grp, key qualify row_number() over (partition by grp order by count(*) desc, key) <= 10""")
def _(spark, sf):
    fields = ("base_model", "sampler_name", "scheduler")
    keyed = rows(spark, sf).withColumn("config_key", A.config_key(2, fields, ()))
    top = A.with_examples(keyed, ["group", "config_key"]).join(keyed.groupBy("group").agg(F.count("*").alias("rows")), "group")
    d = A.decode_config_key(F.col("config_key"), fields, ())
    named = top.withColumn("decoded", F.concat_ws("/", *(F.coalesce(d[f], F.lit("?")) for f in fields)))
    return A.top_k(named, ["group"], [F.desc("count"), F.col("decoded")], 10).select(F.col("group").alias("grp"), "decoded", "count", r6(F.col("count") / F.col("rows"), "share"))


@query("a10_stats_sections", f"""{WIDE}, v as ({_nums}), t as ({_texts})
 select grp, 'numeric' as section, field, '' as value, count(value) as count from v group by all
 union all select grp, 'categorical', field, coalesce(value, ''), count(*) from t group by all
 union all select grp, 'seeds', 'seed', '', count(seed) from res group by grp""")
def _(spark, sf):
    r = rows(spark, sf)
    num = A.numeric_stats(r, NUMBERS).select("group", F.lit("numeric").alias("section"), "field", F.lit("").alias("value"), F.col("n").alias("count"))
    cat = A.unpivot_text(r, CATEGORIES, ["group"]).groupBy("group", "field", F.coalesce("value", F.lit("")).alias("value")).agg(F.count("*").alias("count")).select("group", F.lit("categorical").alias("section"), "field", "value", "count")
    seeds = r.groupBy("group").agg(F.count("seed").alias("count")).select("group", F.lit("seeds").alias("section"), F.lit("seed").alias("field"), F.lit("").alias("value"), "count")
    return num.unionByName(cat).unionByName(seeds).withColumnRenamed("group", "grp")


_facets = f"""{WIDE}, fc as (select 'family' as facet, model_family as value from wide union all select 'base_model', base_model from wide union all select 'sampler', sampler_name from wide union all select 'scheduler', scheduler from wide
  union all select 'status', status from wide union all select 'tag', unnest(tags) from wide union all select 'lora', name from (select distinct file_id, name from v_loras where reachable and enabled)),
 facets as (select facet, value, count(*) as count from fc where value is not null group by all)"""


def all_facets(spark, sf):
    return A.facets(wide(spark, sf), view(spark, sf, "v_loras").where("reachable and enabled"))


@query("a11_facets", _facets + " select * from facets")
def _(spark, sf):
    return all_facets(spark, sf)


@query("a11_ranges", f"{WIDE} select 'steps' as field, min(steps)::double as min, max(steps)::double as max from wide union all select 'cfg', min(cfg), max(cfg) from wide union all select 'shift', min(shift), max(shift) from wide")
def _(spark, sf):
    return A.ranges(wide(spark, sf), ["steps", "cfg", "shift"])


@query("a12_library_summary", f"""{WIDE} select 'total' as kind, '' as value, count(*) as count from wide union all select 'status', status, count(*) from wide group by status
 union all select 'family', coalesce(model_family, '(no metadata)'), count(*) from wide group by model_family union all select 'suspect', '', count(*) from wide where timestamp_suspect""")
def _(spark, sf):
    return A.library_summary(wide(spark, sf))


@query("a13_report_files", f"{WIDE} select status, format, count(*) as files, round(count(*) filter (status = 'ok') / count(*), 6) as ok_share from wide group by status, format")
def _(spark, sf):
    return wide(spark, sf).groupBy("status", "format").agg(F.count("*").alias("files"), r6(F.count_if(F.col("status") == "ok") / F.count("*"), "ok_share"))


@query("a13_unknown_models", f"{WIDE} select base_model, count(*) as files from wide where base_model is not null and (model_family is null or model_family = '4-NOT SPECIFIED') group by base_model order by files desc, base_model limit 10")
def _(spark, sf):
    unknown = wide(spark, sf).where("base_model is not null and (model_family is null or model_family = '4-NOT SPECIFIED')")
    return unknown.groupBy("base_model").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "base_model").limit(10)


@query("a15_report_warnings", "select code, count(*) as warnings, count(distinct file_id) as files, code in ('UNUSED_LORA', 'UNKNOWN_MODEL_PATCH', 'NO_SAMPLER', 'GENERATED_PROMPT') as informational from v_warnings group by code")
def _(spark, sf):
    from imprynt.operators.extraction import INFORMATIONAL

    return view(spark, sf, "v_warnings").groupBy("code").agg(F.count("*").alias("warnings"), F.count_distinct("file_id").alias("files")).withColumn("informational", F.col("code").isin(list(INFORMATIONAL)))


@query("a15_unused_loras", "select name, count(distinct file_id) as files from v_loras where not reachable group by name order by files desc, name limit 20")
def _(spark, sf):
    return view(spark, sf, "v_loras").where("not reachable").groupBy("name").agg(F.count_distinct("file_id").alias("files")).orderBy(F.desc("files"), "name").limit(20)


@query("a16_report_per_family", f"""{_uses}, l as (select grp, 'lora' as kind, name as value, count(distinct file_id) as n from u group by grp, name),
 c as (select grp, 'config' as kind, concat_ws('/', coalesce(base_model, '?'), coalesce(scheduler, '?')) as value, count(*) as n from res group by all)
 select grp, kind, value, n from (select *, row_number() over (partition by grp order by n desc, value) as r from l) where r <= 10
 union all select grp, kind, value, n from (select *, row_number() over (partition by grp order by n desc, value) as r from c) where r <= 5""")
def _(spark, sf):
    loras = uses(spark, sf).groupBy("group", F.col("name").alias("value")).agg(F.count_distinct("id").alias("n")).withColumn("kind", F.lit("lora"))
    configs = rows(spark, sf).groupBy("group", F.concat_ws("/", F.coalesce("base_model", F.lit("?")), F.coalesce("scheduler", F.lit("?"))).alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("config"))
    both = [A.top_k(d, ["group"], [F.desc("n"), F.col("value")], k) for d, k in ((loras, 10), (configs, 5))]
    return both[0].unionByName(both[1]).select(F.col("group").alias("grp"), "kind", "value", "n")


@query("a17_report", f"""{WIDE} select 'files' as section, status as key, count(*) as n from wide group by status union all select 'families', coalesce(model_family, 'unknown'), count(*) from wide where has_generation group by model_family
 union all select 'warnings', code, count(*) from v_warnings group by code union all select 'unused_loras', 'distinct', count(distinct name) from v_loras where not reachable""")
def _(spark, sf):
    w = wide(spark, sf)
    parts = [
        w.groupBy(F.col("status").alias("key")).agg(F.count("*").alias("n")).withColumn("section", F.lit("files")),
        w.where("has_generation").groupBy(F.coalesce("model_family", F.lit("unknown")).alias("key")).agg(F.count("*").alias("n")).withColumn("section", F.lit("families")),
        view(spark, sf, "v_warnings").groupBy(F.col("code").alias("key")).agg(F.count("*").alias("n")).withColumn("section", F.lit("warnings")),
        view(spark, sf, "v_loras").where("not reachable").agg(F.count_distinct("name").alias("n")).withColumns({"section": F.lit("unused_loras"), "key": F.lit("distinct")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("section", "key", "n")


def events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


for bucket in ("day", "week", "month"):
    step = {"day": "1 day", "week": "7 days", "month": "1 month"}[bucket]

    @query(f"a14_timeline_{bucket}", f"""with c as (select cast(date_trunc('{bucket}', ts) as date) as bucket, event_type as series, count(*) as count from events group by all),
 s as (select distinct series from c), k as (select unnest(generate_series(min(bucket)::timestamp, max(bucket)::timestamp, interval '{step}'))::date as bucket from c)
 select cast(k.bucket as varchar) as bucket, s.series, 'all' as kind, coalesce(count, 0) as count from k cross join s left join c on c.bucket = k.bucket and c.series = s.series""")
    def _(spark, sf, bucket=bucket):
        return A.timeline(events(spark, sf), bucket, "ts", "event_type").withColumn("bucket", F.col("bucket").cast("string"))


@query("a14_timeline_files", f"""{WIDE}, e as (select date_trunc('month', date)::date as bucket, coalesce(model_family, '(no metadata)') as series, timestamp_suspect as s, status from wide),
 c as (select bucket, series, 'all' as kind, count(*) as count from e group by all union all select bucket, series, 'suspect', count(*) from e where s group by all union all select bucket, series, 'selected', count(*) from e where status = 'ok' group by all),
 s as (select distinct series, kind from c), k as (select unnest(generate_series(min(bucket)::timestamp, max(bucket)::timestamp, interval '1 month'))::date as bucket from c)
 select cast(k.bucket as varchar) as bucket, s.series, s.kind, coalesce(count, 0) as count from k cross join s left join c on c.bucket = k.bucket and c.series = s.series and c.kind = s.kind""")
def _(spark, sf):
    return A.timeline(wide(spark, sf), "month", selected=F.col("status") == "ok", suspect=F.col("timestamp_suspect")).withColumn("bucket", F.col("bucket").cast("string"))


@query("a22_calendar_levels", """with d as (select cast(ts as date) as date, count(*) as total from events group by 1), t as (select list_sort(list(total)) as t, min(date) as lo from d),
 q as (select lo, t[1 + floor(0.25 * (len(t) - 1))::int] as a, t[1 + floor(0.5 * (len(t) - 1))::int] as b, t[1 + floor(0.75 * (len(t) - 1))::int] as c from t)
 select cast(date as varchar) as date, total, case when total = 0 then 0 when total <= a then 1 when total <= b then 2 when total <= c then 3 else 4 end as level,
  cast(floor((date - (lo - (isodow(lo) - 1)::int)) / 7) as int) as week, cast(isodow(date) - 1 as int) as weekday from d, q""")
def _(spark, sf):
    days = events(spark, sf).groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("total"))
    return A.calendar_levels(days).withColumn("date", F.col("date").cast("string"))


W, K = 600_000_000, 8
_burst = f"""with e as (select event_id as id, epoch_us(ts) as t, user_id as key from events),
 n as (select t, (select count(distinct key) from e x where x.t between e.t - {W} and e.t) as n from e), s as (select distinct t from n where n >= {K}),
 i as (select t, case when t - lag(t) over (order by t) <= {W} then 0 else 1 end as new from s), c as (select t, sum(new) over (order by t) as cluster from i),
 sp as (select cluster, min(t) - {W} as lo, max(t) as hi from c group by cluster)"""


def event_rows(spark, sf):
    return events(spark, sf).select(F.col("event_id").alias("id"), F.unix_micros("ts").alias("t"), F.col("user_id").alias("key"))


@query("w02_burst_clusters", _burst + ' select cast(cluster as bigint) as cluster, min(t) as start, max(t) as "end", count(*) as files, count(distinct key) as "distinct" from e join sp on t between lo and hi group by cluster')
def _(spark, sf):
    return A.burst_clusters(event_rows(spark, sf), W, K)


@query("w03_suspect_flags", _burst + ", m as (select distinct id from e join sp on t between lo and hi) select e.id, m.id is not null as timestamp_suspect from e left join m on m.id = e.id")
def _(spark, sf):
    rows_ = event_rows(spark, sf)
    clusters = A.burst_clusters(rows_, W, K)
    members = A.burst_members(rows_, clusters, 64 * W)
    none = spark.createDataFrame([], "file_id long, code string, node_id string, message string")
    return A.apply_bursts(rows_.withColumn("timestamp_suspect", F.lit(True)), none, members, clusters)[0].select("id", "timestamp_suspect")


@query("w04_recency", f"{WIDE} select grp, id, row_number() over (partition by grp order by generated_at desc nulls last, id desc) as r from res qualify r <= 6")
def _(spark, sf):
    return rows(spark, sf).withColumn("r", P.recency(["group"])).where("r <= 6").select(F.col("group").alias("grp"), "id", "r")


@query("src14_effective_loras", "select file_id, node_id, stage_index, name, position from v_staged_loras where reachable and enabled qualify stage_index = min(stage_index) over (partition by file_id, node_id, entry)")
def _(spark, sf):
    return A.effective_loras(view(spark, sf, "v_staged_loras")).select("file_id", "node_id", "stage_index", "name", "position")


@query("o01_page", f"{WIDE} select id, steps, row_number() over (order by steps desc nulls last, id desc) as place from wide order by place limit 100 offset 40")
def _(spark, sf):
    from imprynt.operators import listing as O

    return O.page(wide(spark, sf), "steps", True, 40, 100).select("id", "steps", "place")


@query("o02_sorted_ids", f"{WIDE} select id, model_family from wide order by model_family nulls last, id")
def _(spark, sf):
    from imprynt.operators import listing as O

    return O.sorted_ids(wide(spark, sf), "family", False)


@query("o03_saved_badge", f"{WIDE} select id, content_hash in (select content_hash from v_files where id % 7 = 0) as saved from wide")
def _(spark, sf):
    from imprynt.operators import listing as O

    return O.with_saved_badge(wide(spark, sf), view(spark, sf, "v_files").where("id % 7 = 0").select("content_hash")).select("id", "saved")


@query("o04_details", f"""{WIDE} select w.id, status, coalesce(l.names, '') as loras, coalesce(x.codes, '') as warnings from wide w
 left join (select file_id, string_agg(name, '|' order by reachable desc, position, name) as names from v_loras group by file_id) l on l.file_id = w.id
 left join (select file_id, string_agg(code, '|' order by code, node_id) as codes from v_warnings group by file_id) x on x.file_id = w.id""")
def _(spark, sf):
    from imprynt.operators import listing as O

    d = O.details(wide(spark, sf), view(spark, sf, "v_loras"), view(spark, sf, "v_warnings"))
    return d.select("id", "status", F.array_join(F.transform("loras", lambda x: x["name"]), "|").alias("loras"), F.array_join(F.transform("warnings", lambda x: x["code"]), "|").alias("warnings"))


@query("o05_suggest", _facets + """ select facet, value, count, substring(value, 1, instr(lower(value), '1') - 1) as head, substring(value, instr(lower(value), '1'), 1) as match, substring(value, instr(lower(value), '1') + 1) as tail
 from facets where contains(lower(value), '1') and value <> 'sampler-1' qualify row_number() over (partition by facet order by starts_with(lower(value), '1') desc, count desc, value) <= 8""")
def _(spark, sf):
    from imprynt.operators import listing as O

    return O.suggest(all_facets(spark, sf), "1", ("sampler-1",), 8)


@query("o06_top_k", f"{WIDE} select grp, scheduler, count(*) as count, row_number() over (partition by grp order by count(*) desc, scheduler) as rank from res group by grp, scheduler qualify rank <= 2")
def _(spark, sf):
    return A.top_k(rows(spark, sf).groupBy("group", "scheduler").agg(F.count("*").alias("count")), ["group"], [F.desc("count"), F.col("scheduler")], 2).withColumnRenamed("group", "grp")


@query("j11_update_rows", f"{WIDE} select id, case when id % 5 = 0 then 'edited' else array_to_string(tags, '|') end as tags from wide")
def _(spark, sf):
    from imprynt.operators import listing as O

    w = wide(spark, sf)
    return O.update_rows(w, w.where("id % 5 = 0").select("id", F.array(F.lit("edited")).alias("tags")), "id", ["tags"]).select("id", joined("tags"))


@query("s03_edit_tags", f"{WIDE} select id, array_to_string(list_sort(list_distinct(list_filter(tags, lambda x: x <> 'en') || ['new'])), '|') as tags, list_contains(tags, 'en') or not list_contains(tags, 'new') as changed from wide")
def _(spark, sf):
    from imprynt.operators import listing as O

    new = O.edit_tags(F.col("tags"), ["en"], ["new"])
    return wide(spark, sf).select("id", joined(new, "tags"), (new != F.col("tags")).alias("changed"))

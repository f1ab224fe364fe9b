"""Adapter views: the catalog's tables as SQL over the benchmark tables, the same text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from imprynt.sources.tables import sized

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_files": """
select o_orderkey as id, concat(o_orderstatus,'/',cast(o_orderkey as varchar(20)),'.png') as rel_path,
  md5(concat(cast(o_custkey as varchar(20)),'|',o_orderpriority)) as content_hash, 'png' as format,
  case o_orderstatus when 'F' then 'ok' when 'O' then 'partial' else 'no_metadata' end as status,
  512 + 64*(o_orderkey % 17) as width, 512 + 64*(o_custkey % 17) as height,
  cast(o_orderdate as date) as date,
  case when o_orderstatus='P' then null else o_orderpriority end as model_family,
  o_orderkey % 10 = 0 as timestamp_suspect, o_orderkey * 1000 + o_custkey as size,
  1700000000 + o_orderkey * 60 as generated_at
from orders""",
    "v_generations": """
select o_orderkey as file_id, o_orderpriority as model_family,
  concat('model-',cast(o_custkey % 12 as varchar(20))) as base_model,
  case when o_custkey % 5 = 0 then null else concat('sampler-',cast(o_custkey % 5 as varchar(20))) end as sampler_name,
  concat('sched-',cast(o_orderkey % 4 as varchar(20))) as scheduler,
  cast(o_custkey % 300 as varchar(20)) as seed, 8 + o_orderkey % 25 as steps, (o_custkey % 9) / 2.0E0 as cfg,
  case when o_orderkey % 3 = 0 then null else (o_custkey % 4) / 4.0E0 end as denoise,
  1 + o_orderkey % 2 as stage_count, o_totalprice as shift
from orders where o_orderstatus <> 'P'""",
    "v_loras": """
select l_orderkey as file_id,
  concat('part-',cast(l_partkey % 40 as varchar(20)),'_', lpad(cast(1000*(l_suppkey % 5) as varchar(20)),9,'0')) as name,
  concat('part-',cast(l_partkey % 40 as varchar(20))) as base_name, 1000*(l_suppkey % 5) as step,
  row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) - 1 as position,
  l_quantity/10 as strength_model, case when l_returnflag='N' then null else l_tax*10 end as strength_clip,
  l_linestatus='O' as enabled, l_returnflag<>'R' as reachable
from lineitem""",
    "v_staged_loras": """
select v.*, cast(file_id as varchar(20)) || '-' || cast(position as varchar(20)) as node_id, '' as entry, s as stage_index
from v_loras v join (select 0 as s union all select 1) x on s = 0 or file_id % 2 = 1""",
    "v_tags": """
select d.doc_id as file_id, d.lang as tag from documents d where d.doc_id % 3 <> 0
union all select doc_id, source from documents where doc_id % 4 = 0
union all select doc_id, 'quality' from labels where quality = 1""",
    "v_prompts": """
select doc_id as file_id, text as positive_prompt, cast(null as varchar(10)) as negative_prompt,
  lang as grp, md5(text) as content_hash, 1700000000 + doc_id*3600 as generated_at
from documents""",
    "v_nodes": """
select o_orderkey as file_id, n as node_id, c as class_type from orders cross join (values
  ('1','UNETLoader'),('2','CLIPLoader'),('3','VAELoader'),('4','CLIPTextEncode'),('5','EmptyLatentImage'),
  ('6','KSampler'),('7','VAEDecode'),('8','SaveImage')) v(n, c)
union all select l_orderkey, cast(99 + row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) + 1 as varchar(20)), 'LoraLoaderModelOnly' from lineitem""",
    "v_edges": """
with r as (select l_orderkey f, l_returnflag rf, row_number() over (partition by l_orderkey
             order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) rn from lineitem),
 c as (select f, rn, cast(100+rn as varchar(20)) n,
         lag(cast(100+rn as varchar(20)),1,'1') over (partition by f order by rn) p from r where rf <> 'R'),
 lst as (select f, max(rn) m from c group by f)
select f as file_id, n as dst, 'model' as input, p as src from c
union all select f, cast(100+rn as varchar(20)), 'model', '1' from r where rf='R'
union all select o_orderkey, d, i, s from orders cross join (values
  ('4','clip','2'),('6','positive','4'),('6','negative','4'),('6','latent_image','5'),
  ('7','samples','6'),('7','vae','3'),('8','images','7')) e(d,i,s)
union all select o_orderkey, '6', 'model', coalesce(cast(100+m as varchar(20)),'1')
  from orders left join lst on lst.f = o_orderkey""",
    "v_literals": """
with r as (select l_orderkey f, l_partkey pk, l_suppkey sk, l_quantity q, row_number() over (partition by l_orderkey
             order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) rn from lineitem)
select f as file_id, cast(100+rn as varchar(20)) as node_id, 'lora_name' as input,
  concat('loras/part-',cast(pk % 40 as varchar(20)),'_',lpad(cast(1000*(sk % 5) as varchar(20)),9,'0'),'.safetensors') as str, cast(null as double) as num, cast(null as boolean) as bool from r
union all select f, cast(100+rn as varchar(20)), 'strength_model', cast(null as varchar(20)), q/10, cast(null as boolean) from r
union all select o_orderkey, '1', 'unet_name', concat(case o_custkey % 4 when 0 then 'flux' when 1 then 'qwen_image' when 2 then 'krea2' else 'other' end, cast(o_custkey % 12 as varchar(20)), '.safetensors'), null, null from orders
union all select o_orderkey, '2', 'clip_name', concat('dir/clip-', cast(o_custkey % 3 as varchar(20)), '.safetensors'), null, null from orders
union all select o_orderkey, '2', 'type', case when o_custkey % 5 = 0 then 'qwen_image' else 'sd3' end, null, null from orders
union all select o_orderkey, '3', 'vae_name', 'vae.sft', null, null from orders
union all select o_orderkey, '4', 'text', concat('order of ', cast(o_custkey as varchar(20))), null, null from orders
union all select o_orderkey, '5', 'batch_size', null, 1 + o_orderkey % 2, null from orders
union all select o_orderkey, '6', 'seed', null, o_custkey % 300, null from orders
union all select o_orderkey, '6', 'steps', null, 8 + o_orderkey % 25, null from orders
union all select o_orderkey, '6', 'cfg', null, (o_custkey % 9) / 2.0E0, null from orders
union all select o_orderkey, '6', 'sampler_name', concat('sampler-', cast(o_custkey % 5 as varchar(20))), null, null from orders""",
    "v_switch_nodes": """
select file_id, node_id, class_type from v_nodes
union all select o_orderkey, '50', 'ComfySwitchNode' from orders where o_orderkey % 4 = 0
union all select o_orderkey, '51', 'PrimitiveBoolean' from orders where o_orderkey % 4 = 0""",
    "v_switch_edges": """
select file_id, dst, case when file_id % 4 = 0 and dst = '6' and input = 'model' then 'on_true' else input end as input, src, case when file_id % 4 = 0 and dst = '6' and input = 'model' then '50' else dst end as to_id from v_edges
union all select o_orderkey, '6', 'model', '50', '6' from orders where o_orderkey % 4 = 0
union all select o_orderkey, '50', 'on_false', '1', '50' from orders where o_orderkey % 4 = 0
union all select o_orderkey, '50', 'switch', '51', '50' from orders where o_orderkey % 4 = 0""",
    "v_blobs": """
select concat('e',cast(event_id as varchar(20))) as file_id, 'prompt' as key, props as text from events
union all select concat('p',cast(o_orderkey as varchar(20))), 'workflow',
  concat('{"nodes":[],"links":[],"v":',cast(o_orderkey as varchar(20)),'}') from orders""",
    "v_a1111": r"""
select o_orderkey as id, concat('order of ',cast(o_custkey as varchar(20)),
  ' <lora:part-',cast(o_custkey % 7 as varchar(20)),':0.8>',chr(10), 'Negative prompt: ',lower(o_orderpriority),chr(10),
  'Steps: ',cast(8+o_orderkey % 25 as varchar(20)),', Sampler: Euler, CFG scale: 7.5, Seed: ',
  cast(o_orderkey as varchar(20)),', Lora hashes: "a: 1, b: 2"') as parameters
from orders""",
    "v_saved": """
select item_id as prompt_id, md5(concat('uid',cast(item_id as varchar(20)))) as uid, substring(b.text,1,40) as title,
  case when item_id % 2 = 0 then b.text else d.text end as positive, '' as negative, '' as notes,
  case when item_id % 3 = 0 then null else concat('fam-',cast(item_id % 4 as varchar(20))) end as model_family,
  1700000000 + item_id*60 as updated_at
from benchmark b join documents d on d.doc_id = b.item_id""",
    "v_saved_images": """
select item_id as prompt_id, content_hash, role,
  row_number() over (partition by item_id, role order by content_hash) - 1 as position
from (select item_id, md5(d.text) as content_hash,
        max(case when doc_id = item_id then 'reference' else 'attempt' end) as role
      from benchmark b join documents d on d.doc_id % 40 = b.item_id group by item_id, md5(d.text)) x""",
    "v_saved_tags": """
select item_id as prompt_id, case when item_id % 2 = 0 then 'even' else 'odd' end as tag from benchmark
union all select item_id, concat('mod', cast(item_id % 5 as varchar(20))) from benchmark where item_id % 3 = 0""",
    "v_rich_nodes": """
select o_orderkey as file_id, n as node_id, c as class_type from orders cross join (values
  ('1','UNETLoader'),('2','CLIPLoader'),('3','VAELoader'),('5','EmptyLatentImage'),('P','Power Lora Loader (rgthree)'),('Q','Power Lora Loader (rgthree)'),('M','MysteryPatch'),
  ('T1','PrimitiveString'),('T2','StringConcatenate'),('T3','PreviewAny'),('T4','TextGenerate'),('T5','StringConcatenate'),('T6','PrimitiveString'),
  ('10','CLIPTextEncode'),('11','CLIPTextEncode'),('12','ConditioningCombine'),('13','FluxGuidance'),('14','ConditioningZeroOut'),('15','MysteryNode'),('16','CLIPTextEncodeFlux'),
  ('20','KSampler'),('9','KSampler'),('30','SamplerCustomAdvanced'),('31','CFGGuider'),('40','VAEDecode'),('41','SaveImage'),('42','VAEDecode'),('43','SaveImage')) v(n, c)""",
    "v_rich_edges": """
select o_orderkey as file_id, d as dst, i as input, s as src from orders cross join (values
  ('P','model','1'),('M','model','P'),('Q','model','1'),('10','clip','2'),('11','clip','2'),('16','clip','2'),
  ('T2','string_a','T1'),('T3','source','T2'),('T4','prompt','T3'),('T5','string_a','T4'),('T5','string_b','T1'),('10','text','T5'),
  ('13','conditioning','10'),('12','conditioning_1','13'),('12','conditioning_2','11'),('14','conditioning','11'),
  ('20','model','M'),('20','positive','12'),('20','negative','14'),('20','latent_image','5'),
  ('9','positive','15'),('9','negative','16'),('9','latent_image','20'),
  ('31','model','1'),('31','positive','16'),('31','negative','14'),('30','guider','31'),('30','latent_image','5'),
  ('40','samples','9'),('40','vae','3'),('41','images','40'),('42','samples','30'),('42','vae','3'),('43','images','42')) e(d, i, s)
union all select o_orderkey, 'T5', 'delimiter', 'T6' from orders where o_orderkey % 2 = 0
union all select o_orderkey, '15', 'my_cond', '11' from orders where o_orderkey % 3 = 1""",
    "v_rich_literals": """
select o_orderkey as file_id, 'T1' as node_id, 'value' as input, concat('a',cast(o_custkey as varchar(20))) as str, cast(null as double) as num, cast(null as boolean) as bool from orders
union all select o_orderkey, n, i, t, null, null from orders cross join (values ('T2','string_b','b'),('T2','delimiter',' '),('T6','value','-'),('1','unet_name','flux.safetensors'),('2','clip_name','clip.safetensors'),('11','text','second text'),('16','t5xxl',' '),('16','clip_l','third text'),('15','small','short')) v(n, i, t)
union all select o_orderkey, '13', 'guidance', null, 2.5E0 + o_orderkey % 3, null from orders
union all select o_orderkey, '16', 'guidance', null, 9.0E0, null from orders
union all select o_orderkey, '15', 'words', concat('a prompt guessed from ', cast(o_orderkey as varchar(20))), null, null from orders where o_orderkey % 3 = 0""",
    "v_pairs": """
select a.o_orderkey as a_id, b.o_orderkey as b_id from orders a join orders b
  on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.o_orderpriority = b.o_orderpriority""",
    "v_warnings": """
select l_orderkey as file_id, 'UNUSED_LORA' as code, cast(l_linenumber as varchar(20)) as node_id from lineitem where l_returnflag = 'R'
union all select id, 'TIMESTAMP_SUSPECT', cast(null as varchar(20)) from v_files where timestamp_suspect""",
}


def views_of(body: str) -> list[str]:
    """The views that body uses, each after those it uses itself."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            out += [n for n in [*views_of(VIEWS[name]), name] if n not in out]
    return out


def oracle(body: str) -> str:
    """body as one DuckDB statement: the views it uses come before its own common tables."""
    head = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in views_of(body))
    body = body.strip()
    if not head:
        return body
    if m := re.match(r"with\s+(recursive\s+)?", body, re.I):
        return f"with {m[1] or ''}{head},\n{body[m.end():]}"
    return f"with {head}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables in sf_dir. The names it reads get a prefix, so that a session's own views
    of these names stay. Tables of many rows are joined by sorting, see sized(): of a few of their columns Spark expects
    a few MB, and would broadcast what a view groups of them."""
    text = VIEWS[name]
    for t in (*TABLES, *views_of(text)):
        if re.search(rf"\b(?:from|join)\s+{t}\b", text):
            source = sized(table(spark, sf_dir, t)) if t in TABLES else view(spark, sf_dir, t)
            source.createOrReplaceTempView(f"imprynt_{t}")
            text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 imprynt_{t}", text)
    return spark.sql(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

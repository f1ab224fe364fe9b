"""Queries for graphs and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from imprynt.functions import scalars as S
from imprynt.operators import extraction as E
from imprynt.operators import graph as G
from imprynt.operators import stats as A
from imprynt.plans.fixtures import table, view
from imprynt.plans.registry import joined, query
from imprynt.sources.tables import staged

NODES_OF = "(values " + ", ".join(f"('{c}','{r}')" for r, cs in G.ROLES.items() for c in cs) + ") roles(class_type, role)"


def nodes(s, d):
    return staged(s, d, "nodes", lambda: view(s, d, "v_nodes"))


def edges(s, d):
    return staged(s, d, "edges", lambda: view(s, d, "v_edges"))


def literals(s, d):
    return staged(s, d, "literals", lambda: view(s, d, "v_literals"))


def digests(s, d):
    return staged(s, d, "graph_digests", lambda: G.graph_digests(nodes(s, d), edges(s, d)))


def same(s, d):
    """(file_id, same): files of equal graphs, and the one that stands for them."""
    return staged(s, d, "same", lambda: G.equal_graphs(digests(s, d)))


def standing(s, d):
    """Nodes and links of the files that stand for others."""
    return tuple(staged(s, d, f"standing_{n}", lambda r=r: G.standing(r(s, d), same(s, d))) for n, r in (("nodes", nodes), ("edges", edges)))


def spread(s, d, name, build, alike=None):
    """build(), worked out for the files that stand for others, for all files."""
    return staged(s, d, name, lambda: G.spread(build(), (alike or same)(s, d)))


def same_texts(s, d):
    """same(), told apart by where long texts are too."""
    return staged(s, d, "same_texts", lambda: G.equal_graphs(digests(s, d), G.digests(E.long_texts(literals(s, d)).withColumn("__kind", F.lit("long")), "__kind", "node_id")))


def standing_texts(s, d):
    """Nodes, links, stages and order of the files that stand for others in same_texts()."""
    make = lambda: (nodes(s, d), edges(s, d), stages(s, d), order(s, d))
    return tuple(staged(s, d, f"texts_{n}", lambda i=i: G.standing(make()[i], same_texts(s, d))) for i, n in enumerate(("nodes", "edges", "stages", "order")))


def reached(s, d):
    return spread(s, d, "reached", lambda: standing_reached(s, d))


def standing_reached(s, d):
    n, e = standing(s, d)
    return staged(s, d, "standing_reached", lambda: G.reachable(e, G.graph_roots(n, e)))


def cleanup(s, d):
    return spread(s, d, "cleanup", lambda: G.cleanup_plan(*standing(s, d), standing_reached(s, d)))


def no_switch(s):
    return s.createDataFrame([], "file_id long, node_id string, input string")


def roots(s, d):
    return G.graph_roots(nodes(s, d), edges(s, d))


def switched(s, d):
    """Nodes, edges and literals with a constant switch before the sampler of every fourth graph."""
    e = view(s, d, "v_switch_edges").select("file_id", F.col("to_id").alias("dst"), "input", "src")
    cond = table(s, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("file_id"), F.lit("51").alias("node_id"), F.lit("value").alias("input"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("double").alias("num"), (F.col("o_custkey") % 2 == 0).alias("bool"))
    return staged(s, d, "switch_nodes", lambda: view(s, d, "v_switch_nodes")), staged(s, d, "switch_edges", lambda: e), literals(s, d).unionByName(cond)


def api_json(s, d):
    """(file_id, prompt_json): the graphs as API prompts, links and literals in one object a node."""
    return staged(s, d, "api_json", lambda: _api_json(s, d))


def _api_json(s, d):
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    links = edges(s, d).select("file_id", F.col("dst").alias("node_id"), F.concat(quoted(F.col("input")), F.lit(":["), quoted(F.col("src")), F.lit(",0]")).alias("kv"))
    value = F.coalesce(quoted(F.col("str")), F.format_string("%s", F.col("num")), F.col("bool").cast("string"))
    lits = literals(s, d).select("file_id", "node_id", F.concat(quoted(F.col("input")), F.lit(":"), value).alias("kv"))
    # both groupings are by file, so links, literals and nodes move once
    kinds = nodes(s, d).select("file_id", "node_id", F.lit(None).cast("string").alias("kv"), "class_type")
    rows = links.unionByName(lits).withColumn("class_type", F.lit(None).cast("string")).unionByName(kinds).repartition("file_id")
    held = rows.groupBy("file_id", "node_id").agg(F.max("class_type").alias("class_type"), F.array_join(F.array_sort(F.collect_list("kv")), ",").alias("kv")).where("class_type is not null")
    one = held.select("file_id", F.concat(quoted(F.col("node_id")), F.lit(':{"class_type":'), quoted(F.col("class_type")), F.lit(',"inputs":{'), F.col("kv"), F.lit("}}")).alias("n"))
    return one.groupBy("file_id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("n")), ","), F.lit("}")).alias("prompt_json"))


REACH = "with recursive reach as (select o_orderkey as file_id, '8' as node_id from orders union select e.file_id, e.src from reach r join v_edges e on e.file_id = r.file_id and e.dst = r.node_id)"


@query("g01_nodes", "select file_id, node_id, class_type from v_nodes")
def _(s, d):
    return G.graph_nodes(api_json(s, d)).select("file_id", "node_id", "class_type")


@query("g02_edges", "select file_id, dst, input, src, 0 as slot from v_edges")
def _(s, d):
    return G.graph_edges(G.graph_nodes(api_json(s, d)))


@query("g03_literals", "select file_id, node_id, input, str, num, bool from v_literals")
def _(s, d):
    n = G.graph_nodes(api_json(s, d))
    return G.graph_literals(n, G.graph_edges(n))


@query("g04_roots", "select file_id, node_id, 'output' as kind from v_nodes where class_type in ('SaveImage', 'PreviewImage')")
def _(s, d):
    return roots(s, d)


@query("g05_reachable", REACH + " select * from reach")
def _(s, d):
    return G.reachable(edges(s, d), roots(s, d))


@query("g05_reachable_switches", """with recursive off as (select o_orderkey as file_id, case when o_custkey % 2 = 0 then 'on_false' else 'on_true' end as input from orders where o_orderkey % 4 = 0),
 live as (select e.file_id, to_id as dst, src from v_switch_edges e left join off on off.file_id = e.file_id and e.to_id = '50' and e.input = off.input where off.file_id is null),
 reach as (select o_orderkey as file_id, '8' as node_id from orders union select e.file_id, e.src from reach r join live e on e.file_id = r.file_id and e.dst = r.node_id) select * from reach""")
def _(s, d):
    n, e, l = switched(s, d)
    return G.reachable(e, G.graph_roots(n, e), G.inactive_inputs(n, e, l))


@query("g06_topo_order", """with recursive reach as (select o_orderkey as file_id, '8' as node_id from orders union select e.file_id, e.src from reach r join v_edges e on e.file_id = r.file_id and e.dst = r.node_id),
 n as (select file_id, list(node_id) as ns from reach group by file_id), e as (select file_id, list({'dst': dst, 'src': src}) as es from v_edges group by file_id),
 k as (select n.file_id, ns, es, []::varchar[] as done from n join e on e.file_id = n.file_id
   union all select file_id, ns, es, list_append(done, list_min(list_filter(ns, lambda x: not list_contains(done, x) and len(list_filter(es, lambda y: y.dst = x and not list_contains(done, y.src))) = 0))) from k where len(done) < len(ns))
 select file_id, unnest(done) as node_id, cast(unnest(range(len(done))) as int) as rank, cast(null as varchar) as error from k where len(done) = len(ns)""")
def _(s, d):
    return order(s, d)


@query("g06_levels", REACH + """, lv as (select file_id, node_id, 0 as level from reach union select e.file_id, e.dst, level + 1 from lv join v_edges e on e.file_id = lv.file_id and e.src = lv.node_id join reach r on r.file_id = e.file_id and r.node_id = e.dst)
 select file_id, node_id, max(level) as level from lv group by file_id, node_id""")
def _(s, d):
    return G.spread(G.levels(standing(s, d)[1], standing_reached(s, d)), same(s, d))


def with_cycles(s, d):
    return edges(s, d).unionByName(table(s, d, "orders").where("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("file_id"), F.lit("1").alias("dst"), F.lit("model").alias("input"), F.lit("8").alias("src")))


@query("e19_cycle_errors", "select o_orderkey as file_id, 'GRAPH_CYCLE' as code from orders where o_orderkey % 97 = 0")
def _(s, d):
    return E.extraction_errors(with_cycles(s, d)).select("file_id", "code")


@query("g07_nearest_samplers", "select o_orderkey as file_id, '8' as output, '6' as samplers, false as multi from orders")
def _(s, d):
    near = G.nearest_by_output(nodes(s, d), edges(s, d), roots(s, d))
    return near.join(G.multiple_branches(near), "file_id").select("file_id", "output", joined("samplers"), "multi")


@query("g08_inactive_inputs", "select o_orderkey as file_id, '50' as node_id, case when o_custkey % 2 = 0 then 'on_false' else 'on_true' end as input from orders where o_orderkey % 4 = 0")
def _(s, d):
    return G.inactive_inputs(*switched(s, d))


LAST = """lastl as (select l_orderkey as f, cast(100 + max(rn) as varchar) as n from (select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) as rn from lineitem) where l_returnflag <> 'R' group by l_orderkey)"""


@query("g09_resolve_switches", f"with {LAST} select o_orderkey as file_id, case when o_orderkey % 4 = 0 and o_custkey % 2 <> 0 then '1' else coalesce(n, '1') end as past from orders left join lastl on f = o_orderkey")
def _(s, d):
    n, e, l = switched(s, d)
    links = e.where("dst = '6' and input = 'model'")
    return G.resolve_switches(links, n, e, G.inactive_inputs(n, e, l)).select("file_id", "past")


CHAIN = "with recursive ch as (select file_id, src as node_id, 0 as depth from v_edges where dst = '6' and input = 'model' union all select c.file_id, e.src, depth + 1 from ch c join v_edges e on e.file_id = c.file_id and e.dst = c.node_id and e.input = 'model')"


@query("g10_follow_model", CHAIN + " select * from ch")
def _(s, d):
    starts = nodes(s, d).where("node_id = '6'").select("file_id", F.col("node_id").alias("start"))
    return G.follow_input(starts, nodes(s, d), edges(s, d), no_switch(s), "model").select("file_id", "node_id", "depth")


@query("g11_constants", "select o_orderkey as file_id, node_id, input, o_custkey % 2 = 0 as value from orders, (values ('51', 'value'), ('50', 'switch')) v(node_id, input) where o_orderkey % 4 = 0")
def _(s, d):
    n, e, l = switched(s, d)
    return G.constants(e, n, l, "bool")


@query("g12_resolve_strings", "select file_id, node_id, input, str as text from v_literals where input = 'text'")
def _(s, d):
    want = nodes(s, d).where("node_id = '4'").select("file_id", "node_id", F.lit("text").alias("input"))
    return G.resolve_strings(want, nodes(s, d), edges(s, d), literals(s, d), no_switch(s))


@query("g13_cleanup_plan", "select l_orderkey as file_id, cast(100 + rn as varchar) as node_id from (select *, row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) as rn from lineitem) where l_returnflag = 'R'")
def _(s, d):
    return cleanup(s, d)


@query("g14_clean_prompt", "select o_orderkey as file_id, 8 + coalesce(n, 0) as nodes from orders left join (select l_orderkey, count(*) as n from lineitem where l_returnflag <> 'R' group by l_orderkey) on l_orderkey = o_orderkey")
def _(s, d):
    j = api_json(s, d)
    return G.clean_prompt(j, cleanup(s, d)).select("file_id", F.size(F.from_json("prompt_json", "map<string,variant>")).cast("bigint").alias("nodes"))


@query("g16_stage_nodes", "with recursive up as (select o_orderkey as file_id, '6' as node_id from orders union select e.file_id, e.src from up join v_edges e on e.file_id = up.file_id and e.dst = up.node_id) select * from up")
def _(s, d):
    starts = nodes(s, d).where("class_type = 'KSampler'").select("file_id", F.col("node_id").alias("sampler"), "node_id")
    stops = nodes(s, d).where(G.role_of().isin("sampler", "generator")).select("file_id", "node_id")
    return G.stopped(edges(s, d), starts, stops, ["file_id", "sampler"]).select("file_id", "node_id")


@query("g17_nearest_role", "select o_orderkey as file_id, '8' as start, '7' as node_id from orders")
def _(s, d):
    return G.nearest_role(edges(s, d), nodes(s, d), roots(s, d).select("file_id", F.col("node_id").alias("start")), "vae_decode")


@query("g18_registry", f"select n.class_type, role, count(*) as nodes from v_nodes n left join {NODES_OF} on roles.class_type = n.class_type group by all")
def _(s, d):
    return nodes(s, d).join(F.broadcast(G.registry(s)), "class_type", "left").groupBy("class_type", "role").agg(F.count("*").alias("nodes"))


@query("g19_unregistered", "select class_type || '-' || o_orderpriority as class_type, count(distinct file_id) as files from v_nodes join orders on o_orderkey = file_id where class_type = 'VAEDecode' group by 1")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("file_id"), "o_orderpriority")
    odd = nodes(s, d).join(o, "file_id").withColumn("class_type", F.when(F.col("class_type") == "VAEDecode", F.concat_ws("-", "class_type", "o_orderpriority")).otherwise(F.col("class_type")))
    return G.unregistered(odd)


def stages(s, d):
    return spread(s, d, "stages", lambda: standing_stages(s, d))


def standing_stages(s, d):
    return staged(s, d, "standing_stages", lambda: E.sampler_stages(standing(s, d)[0], standing_order(s, d)))


def standing_order(s, d):
    return staged(s, d, "standing_order", lambda: G.topo_order(standing(s, d)[1], standing_reached(s, d)))


def order(s, d):
    return spread(s, d, "order", lambda: standing_order(s, d))


def rich(s, d):
    """Nodes, edges and literals of graphs with two outputs, three samplers, chained texts, combined, guided and zeroed
    conditioning, a node of no known role, and power loaders."""
    return tuple(staged(s, d, n, lambda n=n: view(s, d, n)) for n in ("v_rich_nodes", "v_rich_edges", "v_rich_literals"))


def rich_same(s, d):
    """(file_id, same): files of equal rich graphs, told apart by where long texts are too, and the one that stands for them."""
    n, e, l = rich(s, d)
    return staged(s, d, "rich_same", lambda: G.equal_graphs(G.graph_digests(n, e), G.digests(E.long_texts(l).withColumn("__kind", F.lit("long")), "__kind", "node_id")))


def rich_standing(s, d):
    """Nodes, links, order and stages of the files that stand for others."""
    n, e = (staged(s, d, f"rich_standing_{i}", lambda i=i: G.standing(rich(s, d)[i], rich_same(s, d))) for i in (0, 1))
    rank = staged(s, d, "rich_order", lambda: G.topo_order(e, G.reachable(e, G.graph_roots(n, e))))
    return n, e, rank, staged(s, d, "rich_standing_stages", lambda: E.sampler_stages(n, rank))


def rich_stages(s, d):
    return spread(s, d, "rich_stages", lambda: rich_standing(s, d)[3], rich_same)


def rich_chain(s, d):
    """The model chains of the files that stand for others."""
    n, e, _, st = rich_standing(s, d)
    return staged(s, d, "rich_chain", lambda: E.model_chain(st, n, e, no_switch(s)))


def rich_plan(s, d):
    """What a cleanup takes, of all files."""
    n, e, _, _ = rich_standing(s, d)
    return spread(s, d, "rich_plan", lambda: G.cleanup_plan(n, e, G.reachable(e, G.graph_roots(n, e))), rich_same)


def rich_traces(s, d, side):
    n, e, rank, st = rich_standing(s, d)
    return staged(s, d, f"rich_{side}", lambda: E.trace_prompts(st, n, e, rich(s, d)[2], no_switch(s), side, rank, rich_same(s, d)))


def power_prompts(s, d):
    """API prompts with power loaders only: P with three entries, one of them off in every other graph, and Q."""
    entry = lambda on, lora, more: f'{{"on":{on},"lora":"{lora}",{more}}}'
    text = F.concat(F.lit('{"P":{"class_type":"Power Lora Loader (rgthree)","inputs":{"lora_1":' + entry("", "", "").split('"on":')[0] + '"on":'), (F.col("o_orderkey") % 2 == 0).cast("string"), F.lit(',"lora":"x/part-'), (F.col("o_custkey") % 7).cast("string"), F.lit('.safetensors","strength":0.5},"lora_2":' + entry("true", "None", '"strength":1') + ',"LORA_3":' + entry("true", "part-9_000001000.safetensors", '"strength":0.25,"strengthTwo":0.75') + ',"text":"kept"}},"Q":{"class_type":"Power Lora Loader (rgthree)","inputs":{"lora_1":' + entry("true", "q.safetensors", '"strength":1') + "}}}"))
    # the table is a few MB, one task's share, and its prompts are long to parse: dealt out while they are two numbers
    dealt = table(s, d, "orders").select("o_orderkey", "o_custkey").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return dealt.select(F.col("o_orderkey").alias("file_id"), text.alias("prompt_json"))


def chain(s, d):
    return spread(s, d, "chain", lambda: standing_chain(s, d))


def standing_chain(s, d):
    return staged(s, d, "standing_chain", lambda: E.model_chain(standing_stages(s, d), *standing(s, d), no_switch(s)))


def uses(s, d):
    return E.lora_uses(standing_chain(s, d), standing(s, d)[0], literals(s, d), same=same(s, d))


@query("e01_sampler_stages", "select o_orderkey as file_id, 0 as stage_index, '6' as node_id, 'KSampler' as class_type from orders")
def _(s, d):
    return stages(s, d)


@query("e02_stage_settings", "select o_orderkey as file_id, cast(o_custkey % 300 as double) as seed, cast(8 + o_orderkey % 25 as double) as steps, (o_custkey % 9) / 2.0 as cfg, concat('sampler-', o_custkey % 5) as sampler_name from orders")
def _(s, d):
    return E.stage_settings(stages(s, d), nodes(s, d), edges(s, d), literals(s, d)).select("file_id", "seed", "steps", "cfg", "sampler_name")


STEM = "regexp_replace(regexp_replace(str, '^.*/', ''), '\\.(safetensors|sft)$', '')"


@query("e03_model_chain", CHAIN + f", l as (select file_id, count(*) as n from ch where node_id <> '1' group by file_id) select t.file_id, '1' as loader, {STEM} as base_model, coalesce(n, 0) as loras, false as broken from v_literals t left join l on l.file_id = t.file_id where t.input = 'unet_name'")
def _(s, d):
    c = chain(s, d)
    n = c.groupBy("file_id").agg(F.count_if(F.col("role") == "lora").alias("loras"))
    return E.chain_summary(c, literals(s, d)).join(n, "file_id").select("file_id", "loader", "base_model", "loras", "broken")


@query("e04_lora_uses", f"""with r as (select l_orderkey as f, l_returnflag <> 'R' as ok, row_number() over w as rn, sum(case when l_returnflag <> 'R' then 1 else 0 end) over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity rows unbounded preceding) as k from lineitem window w as (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity))
 select f as file_id, cast(100 + rn as varchar) as node_id, case when ok then k - 1 end as position, v.name, v.base_name, cast(v.step as bigint) as step, v.strength_model, ok as reachable from r join v_loras v on v.file_id = f and v.position = rn - 1""")
def _(s, d):
    return uses(s, d).select("file_id", "node_id", F.col("position").cast("bigint").alias("position"), "name", "base_name", "step", "strength_model", "reachable")


def traces(s, d, side="positive"):
    n, e, st, rank = standing_texts(s, d)
    return staged(s, d, f"traces_{side}", lambda: E.trace_prompts(st, n, e, literals(s, d), no_switch(s), side, rank, same_texts(s, d)))


def encoders(s, d):
    n, e, _, _ = standing_texts(s, d)
    return E.text_encoders(traces(s, d), n, e, literals(s, d), no_switch(s), same_texts(s, d))


@query("e04_power_loras", """select o_orderkey as file_id, case when node_id = 'P' then 1 end as stage_index, node_id, entry, case when node_id = 'P' and (entry <> 'lora_1' or o_orderkey % 2 = 0) then case when entry = 'lora_1' then 0 else 1 - o_orderkey % 2 end end as position,
  case when entry = 'LORA_3' then 'part-9_000001000' when node_id = 'Q' then 'q' else concat('part-', o_custkey % 7) end as name, case when entry = 'LORA_3' then 0.25 when node_id = 'Q' then 1.0 else 0.5 end as strength_model, case when entry = 'LORA_3' then 0.75 when node_id = 'Q' then 1.0 else 0.5 end as strength_clip,
  entry <> 'lora_1' or node_id = 'Q' or o_orderkey % 2 = 0 as enabled, node_id = 'P' as reachable from orders, (values ('P', 'lora_1'), ('P', 'LORA_3'), ('Q', 'lora_1')) v(node_id, entry)""")
def _(s, d):
    entries = G.power_entries(G.graph_nodes(power_prompts(s, d)))
    u = E.lora_uses(rich_chain(s, d), rich_standing(s, d)[0], rich(s, d)[2], entries, rich_same(s, d))
    return u.select("file_id", "stage_index", "node_id", "entry", F.col("position").cast("bigint").alias("position"), "name", "strength_model", "strength_clip", "enabled", "reachable")


def ordered_prompts(s, d):
    """(file_id, prompt_json): a power loader whose entries are not in the order of their names, from orders."""
    entry = lambda name, file: F.concat(F.lit(f'"{name}":{{"on":true,"lora":"'), F.lit(file), F.col("o_custkey").cast("string"), F.lit('","strength":1}'))
    turn = F.when(F.col("o_orderkey") % 2 == 0, F.concat(entry("lora_b", "b"), F.lit(","), entry("lora_a", "a"))).otherwise(F.concat(entry("lora_a", "a"), F.lit(","), entry("lora_b", "b")))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit('{"1":{"inputs":{'), entry("LORA_9", "z"), F.lit(',"x":1,'), turn, F.lit(',"lora_10":{"on":true,"lora":"None","strength":1}},"class_type":"Power Lora Loader (rgthree)"}}')).alias("prompt_json"))


@query("e04_entry_order", """select o_orderkey as file_id, entry, case when entry = 'LORA_9' then 0 when (entry = 'lora_b') = (o_orderkey % 2 = 0) then 1 else 2 end as place from orders, (values ('LORA_9'), ('lora_a'), ('lora_b')) v(entry)""")
def _(s, d):
    prompts = ordered_prompts(s, d)
    return G.power_entries(G.graph_nodes(prompts), G.field_order(prompts)).select("file_id", "entry", "place")


@query("g13_switched_off", "select o_orderkey as file_id, 'P' as node_id, 'lora_1' as entry from orders where o_orderkey % 2 = 1")
def _(s, d):
    return G.switched_off(G.power_entries(G.graph_nodes(power_prompts(s, d))), rich_plan(s, d)).select("file_id", "node_id", "entry")


@query("g14_clean_entries", """select o_orderkey as file_id, 'P' as node_id, e as input from orders, (values ('lora_1'), ('lora_2'), ('LORA_3'), ('text')) v(e) where e <> 'lora_1' or o_orderkey % 2 = 0""")
def _(s, d):
    plan = rich_plan(s, d)
    prompts = power_prompts(s, d)
    cleaned = G.clean_prompt(prompts, plan, G.switched_off(G.power_entries(G.graph_nodes(prompts)), plan))
    return G.graph_nodes(cleaned).select("file_id", "node_id", F.explode(F.map_keys("inputs")).alias("input"))


WORKFLOW = """'{"nodes":[{"id":1,"type":"UNETLoader","outputs":[{"name":"m","links":[1,2]}]},{"id":102,"type":"LoraLoaderModelOnly","inputs":[{"name":"model","link":1}]},{"id":7,"type":"X","inputs":[{"name":"a","link":2},{"name":"b","link":3}]}],"links":[[1,1,0,102,0,"M"],{"id":2,"origin_id":1,"target_id":7},[3,102,0,7,1,"M"]],"extra":{"linkExtensions":[{"id":3},{"id":2}],"reroutes":[{"id":9,"linkIds":[1,2]}]},"v":' || {n} || '}'"""


@query("g15_clean_workflow", """select l_orderkey as file_id, case when r then '1|7' else '1|102|7' end as nodes, case when r then '2' else '1|2|3' end as links, case when r then '[2]' else '[1,2]' end as out, case when r then '2|' else '2|3' end as ins, case when r then '2' else '3|2' end as extensions, case when r then '[2]' else '[1,2]' end as routes, l_orderkey as v
 from (select l_orderkey, bool_or(rn = 2 and l_returnflag = 'R') as r from (select *, row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) as rn from lineitem) group by l_orderkey)""")
def _(s, d):
    files = table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id")).distinct()
    flows = files.select("file_id", F.expr(WORKFLOW.replace("{n}", "cast(file_id as string)")).alias("workflow_json"))
    plan = cleanup(s, d).join(nodes(s, d), ["file_id", "node_id"]).select("file_id", "node_id", "class_type")
    w = G.clean_workflow(flows, plan).select("file_id", F.parse_json("workflow_json").alias("w"))
    each = lambda path, f: F.array_join(F.transform(F.variant_get("w", path, "array<variant>"), f), "|", "")
    of = lambda p: lambda x: F.try_variant_get(x, p, "string")
    return w.select("file_id", each("$.nodes", of("$.id")).alias("nodes"), each("$.links", lambda x: F.coalesce(of("$[0]")(x), of("$.id")(x))).alias("links"), F.variant_get("w", "$.nodes[0].outputs[0].links", "string").alias("out"), each("$.nodes[1].inputs", of("$.link")).alias("in1"), each("$.nodes[2].inputs", of("$.link")).alias("in2"), each("$.extra.linkExtensions", of("$.id")).alias("extensions"), F.variant_get("w", "$.extra.reroutes[0].linkIds", "string").alias("routes"), F.variant_get("w", "$.v", "bigint").alias("v")).select("file_id", "nodes", "links", "out", F.when(F.size(F.split("nodes", "[|]")) == 2, F.col("in1")).otherwise(F.col("in2")).alias("ins"), "extensions", "routes", "v")


@query("e05_trace_prompts", "select file_id, str as prompt, '4' as encoders from v_literals where input = 'text'")
def _(s, d):
    return traces(s, d).select("file_id", "prompt", joined("encoders"))


@query("e06_guidance", "select o_orderkey as file_id, stage_index, case stage_index when 1 then 2.5 + o_orderkey % 3 else 9.0 end as guidance from orders, (values (0), (1), (2)) v(stage_index)")
def _(s, d):
    return E.guidance(rich_traces(s, d, "positive"), rich_traces(s, d, "negative"))


@query("e01_rich_stages", "select o_orderkey as file_id, stage_index, node_id, class_type from orders, (values (0, '30', 'SamplerCustomAdvanced'), (1, '20', 'KSampler'), (2, '9', 'KSampler')) v(stage_index, node_id, class_type)")
def _(s, d):
    return rich_stages(s, d)


TEXT = "concat('a', o_custkey, ' b', case when o_orderkey % 2 = 0 then '-' else '' end, 'a', o_custkey)"


@query("e05_rich_prompts", f"""select o_orderkey as file_id, 1 as stage_index, concat('second text', chr(10), chr(10), {TEXT}) as positive, '' as negative, '11|10' as encoders from orders
 union all select o_orderkey, 0, 'third text', '', '16' from orders
 union all select o_orderkey, 2, case o_orderkey % 3 when 0 then concat('a prompt guessed from ', o_orderkey) when 1 then 'second text' end, 'third text', case when o_orderkey % 3 = 1 then '11' else '' end from orders""")
def _(s, d):
    p, n = rich_traces(s, d, "positive"), rich_traces(s, d, "negative").select("file_id", "stage_index", F.col("prompt").alias("negative"))
    return p.join(n, ["file_id", "stage_index"]).select("file_id", "stage_index", F.col("prompt").alias("positive"), "negative", joined("encoders"))


@query("g12_text_chains", f"""select o_orderkey as file_id, n as node_id, i as input, case n when '10' then {TEXT} when '11' then 'second text' when 'T3' then concat('a', o_custkey, ' b') when 'T2' then concat('a', o_custkey) end as text
 from orders, (values ('10', 'text'), ('11', 'text'), ('T3', 'source'), ('T2', 'string_a'), ('16', 'nothing')) v(n, i)""")
def _(s, d):
    n, e, l = rich(s, d)
    want = s.createDataFrame([("10", "text"), ("11", "text"), ("T3", "source"), ("T2", "string_a"), ("16", "nothing")], "node_id string, input string")
    return G.resolve_strings(n.select("file_id").distinct().crossJoin(F.broadcast(want)), n, e, l, no_switch(s))


@query("e07_text_encoders", "select o_orderkey as file_id, concat('clip-', o_custkey % 3) as text_encoder, case when o_custkey % 5 = 0 then 'qwen_image' else 'sd3' end as clip_type from orders")
def _(s, d):
    return encoders(s, d).select("file_id", "text_encoder", "clip_type")


@query("e08_vae", "select o_orderkey as file_id, 'vae' as vae from orders")
def _(s, d):
    return E.vae(roots(s, d), nodes(s, d), edges(s, d), literals(s, d))


@query("e09_latent_source", "select o_orderkey as file_id, 'EmptyLatentImage' as latent_source, 1 + o_orderkey % 2 as batch_size from orders")
def _(s, d):
    return E.latent_source(stages(s, d), nodes(s, d), edges(s, d), literals(s, d), no_switch(s))


@query("e10_input_images", "select doc_id as file_id, '9' as node_id, source || '.png' as filename, case when doc_id % 2 = 0 then sha256(source) end as sha256 from documents")
def _(s, d):
    doc = table(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit("9").alias("node_id"), F.lit("LoadImage").alias("class_type"), "source")
    name = doc.select("file_id", "node_id", F.lit("image").alias("input"), F.concat("source", F.lit(".png")).alias("str"))
    sha = doc.select("file_id", "node_id", F.lit("sha256").alias("input"), F.when(F.col("file_id") % 2 == 0, F.upper(F.sha2("source", 256))).otherwise("nothing").alias("str"))
    return E.input_images(doc.select("file_id", "node_id", "class_type"), name.unionByName(sha))


FAMILY = """case when m like 'qwen%' then 'qwen-image' when c % 5 = 0 then 'qwen-image' when m like 'krea2%' then 'krea-2' when m like 'flux%' then 'flux' end"""


@query("e11_match_family", f"select f as file_id, {FAMILY} as model_family from (select file_id as f, {STEM} as m from v_literals where input = 'unet_name') join (select o_orderkey as k, o_custkey as c from orders) on k = f")
def _(s, d):
    c = E.chain_summary(chain(s, d), literals(s, d))
    kind = literals(s, d).where("input = 'type'").select("file_id", F.col("str").alias("clip_type"))
    classes = nodes(s, d).groupBy("file_id").agg(F.collect_set("class_type").alias("classes"))
    return c.join(kind, "file_id").join(classes, "file_id").select("file_id", E.match_family(F.col("loader_kind"), F.col("base_model"), F.col("clip_type"), F.col("classes")).alias("model_family"))



def family_stages(s, d):
    return view(s, d, "v_loras").join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id")).distinct(), "file_id").select("file_id", F.col("position").alias("stage_index"), F.when(F.col("reachable"), F.when(F.col("enabled"), "a").otherwise("b")).alias("family"))


@query("e12_pipeline_family", """with k as (select file_id, position as i, case when enabled then 'a' else 'b' end as family from v_loras where reachable),
 o as (select *, lag(family) over (partition by file_id order by i) as before from k) select file_id, string_agg(family, ' + ' order by i) as model_family from o where before is distinct from family group by file_id""")
def _(s, d):
    return E.pipeline_family(family_stages(s, d))


@query("w07_collapse_adjacent", """with o as (select file_id, position as i, enabled, lag(enabled) over (partition by file_id order by position) as before, row_number() over (partition by file_id order by position) as rn from v_loras) select file_id, i from o where rn = 1 or before is distinct from enabled""")
def _(s, d):
    return E.collapse_adjacent(view(s, d, "v_loras"), ["file_id"], "position", "enabled").select("file_id", F.col("position").alias("i"))


@query("e13_generator_prompt", "select o_orderkey as file_id, concat('order of ', o_custkey) as prompt from orders where o_orderkey % 3 = 0")
def _(s, d):
    o = table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("file_id"), "o_custkey")
    n = o.select("file_id", F.lit("1").alias("node_id"), F.lit("Krea2ImageNode").alias("class_type")).unionByName(o.select("file_id", F.lit("2").alias("node_id"), F.lit("PrimitiveString").alias("class_type")))
    e = o.select("file_id", F.lit("1").alias("dst"), F.lit("prompt").alias("input"), F.lit("2").alias("src"))
    l = o.select("file_id", F.lit("2").alias("node_id"), F.lit("value").alias("input"), F.concat(F.lit("order of "), F.col("o_custkey")).alias("str"))
    return E.generator_prompt(n, e, l, no_switch(s))


@query("e14_lora_stack_key", "select file_id, 0 as stage_index, string_agg(name || '@' || printf('%.2f', round_even(strength_model, 2)), ' + ' order by position) as lora_stack_key from v_loras where reachable and enabled group by file_id")
def _(s, d):
    return E.lora_stack_key(view(s, d, "v_loras").withColumn("stage_index", F.lit(0)))


@query("e15_config_key", "select file_id, model_family || '/' || coalesce(sampler_name, '?') || '/' || steps || '/' || printf('%.2f', cfg) || '/' || coalesce(printf('%.2f', denoise), '?') as decoded from v_generations")
def _(s, d):
    fields = ("model_family", "sampler_name", "steps", "cfg", "denoise")
    k = view(s, d, "v_generations").withColumn("k", A.config_key(2, fields, ("cfg", "denoise")))
    x = A.decode_config_key(F.col("k"), fields, ("steps", "cfg", "denoise"))
    two = lambda c: F.coalesce(F.format_string("%.2f", c), F.lit("?"))
    den = F.when(x["denoise"].isNull(), F.lit("?")).otherwise(two(x["denoise"]))
    return k.select("file_id", F.concat_ws("/", x["model_family"], F.coalesce(x["sampler_name"], F.lit("?")), x["steps"].cast("bigint").cast("string"), two(x["cfg"]), den).alias("decoded"))


@query("e16_generation_key", """with l as (select file_id, string_agg(node_id || input || coalesce(str, '') || coalesce(cast(num as varchar), '') || coalesce(cast(bool as varchar), ''), '|' order by node_id, input) as t from v_literals group by file_id), e as (select file_id, string_agg(dst || input || src, '|' order by dst, input) as t from v_edges group by file_id),
 g as (select file_id // 2 as pair, file_id, l.t || coalesce(e.t, '') as t from l left join e using (file_id) union all select file_id // 2, -file_id, l.t || coalesce(e.t, '') from l left join e using (file_id) where file_id % 5 = 0) select file_id, min(file_id) over (partition by t) as first from g""")
def _(s, d):
    once = api_json(s, d)
    again = once.where("file_id % 5 = 0").select((-F.col("file_id")).alias("file_id"), F.concat(F.lit(" "), "prompt_json").alias("prompt_json"))
    keys = E.canonical_graphs(once.unionByName(again))
    return keys.join(keys.groupBy("generation_key").agg(F.min("file_id").alias("first")), "generation_key").select("file_id", "first")


@query("e17_stage_prompts", """with c as (select conv_id as file_id, turn as i, role as prompt from conversations), f as (select file_id, prompt as base from c where i = 0),
 l as (select c.file_id, prompt, min(i) as i from c left join f on f.file_id = c.file_id where i > 0 and trim(prompt) <> '' and prompt is distinct from base group by c.file_id, prompt) select file_id, string_agg(prompt, chr(10) || chr(10) order by i) as stage_prompts from l group by file_id""")
def _(s, d):
    return E.stage_prompts(table(s, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("stage_index"), F.col("role").alias("prompt")))


@query("e18_generations", f"""select o_orderkey as file_id, {FAMILY.replace("c %", "o_custkey %")} as model_family, m as base_model, concat('clip-', o_custkey % 3) as text_encoder, 'vae' as vae, cast(o_custkey % 300 as double) as seed, concat('order of ', o_custkey) as positive_prompt, 1 as stage_count
 from orders join (select file_id as f, {STEM} as m from v_literals where input = 'unet_name') on f = o_orderkey""")
def _(s, d):
    n, e, l, st = nodes(s, d), edges(s, d), literals(s, d), stages(s, d)
    stacks = E.lora_stack_key(uses(s, d))
    g = E.generations(E.stage_settings(st, n, e, l), E.chain_summary(chain(s, d), l), traces(s, d), traces(s, d, "negative"), encoders(s, d), E.vae(roots(s, d), n, e, l), E.latent_source(st, n, e, l, no_switch(s)), stacks, n)
    return g.select("file_id", "model_family", "base_model", "text_encoder", "vae", "seed", "positive_prompt", "stage_count")


@query("e20_warnings", "select l_orderkey as file_id, 'UNUSED_LORA' as code, count(*) as n from lineitem where l_returnflag = 'R' group by 1 union all select o_orderkey, 'GRAPH_CYCLE', 1 from orders where o_orderkey % 97 = 0")
def _(s, d):
    w = E.collect_warnings(E.unused_lora_warnings(uses(s, d)), E.extraction_errors(with_cycles(s, d)))
    return w.groupBy("file_id", "code").agg(F.count("*").alias("n"))


@query("e20_graph_warnings", """select o_orderkey as file_id, code, node_id from orders, (values ('MULTIPLE_OUTPUT_BRANCHES', null), ('UNKNOWN_MODEL_PATCH', 'M'), ('MODEL_CHAIN_BROKEN', '9'), ('UNUSED_LORA', 'Q'), ('GENERATED_PROMPT', 'T4'), ('MULTIPLE_PROMPT_SOURCES', null)) v(code, node_id)
 union all select o_orderkey, 'HEURISTIC_PROMPT', '15' from orders where o_orderkey % 3 = 0 union all select o_orderkey, 'PROMPT_UNRESOLVED', '15' from orders where o_orderkey % 3 = 2
 union all select -o_orderkey, code, null from orders, (values ('NO_OUTPUT_NODE'), ('NO_SAMPLER')) v(code) where o_orderkey % 4 = 0 and o_orderkey > 0""")
def _(s, d):
    n, e, _, st = rich_standing(s, d)
    bare = rich(s, d)[0].where("file_id % 4 = 0 and file_id > 0 and class_type = 'UNETLoader'").withColumn("file_id", -F.col("file_id"))
    alike = staged(s, d, "rich_bare", lambda: G.equal_graphs(G.digests(bare, "node_id", "class_type")))
    graphs = E.collect_warnings(E.graph_warnings(n, e, st), E.chain_warnings(st, rich_chain(s, d), n, e))
    none = E.graph_warnings(G.standing(bare, alike), e, st)
    entries = G.power_entries(G.graph_nodes(power_prompts(s, d)))
    uses = E.lora_uses(rich_chain(s, d), n, rich(s, d)[2], entries, rich_same(s, d))
    w = E.collect_warnings(G.spread(graphs, rich_same(s, d)), G.spread(none, alike), E.unused_lora_warnings(uses), E.prompt_warnings(rich_traces(s, d, "positive"), rich_traces(s, d, "negative")))
    return w.select("file_id", "code", "node_id").distinct()


@query("e21_inspect_documents", "select o_orderkey as file_id, o_orderstatus || '/' || o_orderkey || '.png' as rel_path, (select count(*) from v_nodes n where n.file_id = o_orderkey) as nodes from orders")
def _(s, d):
    docs = E.inspect_documents(view(s, d, "v_files"), view(s, d, "v_generations"), nodes(s, d), view(s, d, "v_warnings"))
    return docs.select("file_id", F.get_json_object("document", "$.file.rel_path").alias("rel_path"), F.size(F.from_json(F.get_json_object("document", "$.nodes"), "array<string>")).cast("bigint").alias("nodes"))


@query("f01_model_stem", f"select file_id, input, {STEM} as stem from v_literals where str is not null and input like '%name' and input <> 'sampler_name'")
def _(s, d):
    return literals(s, d).where("str is not null and input like '%name' and input <> 'sampler_name'").select("file_id", "input", S.model_stem("str").alias("stem"))


@query("f02_lora_base_step", "select file_id, position, base_name as base, cast(step as bigint) as step from v_loras")
def _(s, d):
    x = S.lora_base_step("name")
    return view(s, d, "v_loras").select("file_id", "position", x["base"].alias("base"), x["step"].alias("step"))

"""Graph operators over the node graphs of all files at once.

Graphs are small and many: a file's edges become one array by one shuffle, and walks are folds inside
the row that go on from what they met last (at most as many rounds as there are nodes with links, so
every walk ends, on cycles too; rounds after the last hop do nothing). Nothing loops on the driver.
Only orders, levels and cycles are sequential enough for a Python step: over Arrow batches of
different graphs, each once however many files share it, in time linear in its links.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imprynt.sources.tables import few, written

# Classes, the role of each and the names of the inputs it is read by.
OUTPUT_CLASSES = ("SaveImage", "PreviewImage", "SaveImageWebsocket", "Image Save", "SaveImageExtended")
OUTPUT_NAME = r"(?i)(save|preview)"
ROLES = {
    "sampler": ("KSampler", "KSamplerAdvanced", "SamplerCustom", "SamplerCustomAdvanced"),
    "noise": ("RandomNoise", "DisableNoise"),
    "guider": ("CFGGuider", "BasicGuider", "DualCFGGuider"),
    "sampler_select": ("KSamplerSelect",),
    "sigmas": ("BasicScheduler",),
    "model_loader": ("UNETLoader", "UnetLoaderGGUF", "CheckpointLoaderSimple"),
    "lora": ("LoraLoaderModelOnly", "LoraLoader", "Power Lora Loader (rgthree)"),
    "model_patch": ("ModelSamplingAuraFlow", "ModelSamplingSD3", "ModelSamplingFlux"),
    "clip_loader": ("CLIPLoader", "DualCLIPLoader", "TripleCLIPLoader"),
    "vae_loader": ("VAELoader",),
    "vae_decode": ("VAEDecode", "VAEDecodeTiled"),
    "text_encoder": ("CLIPTextEncode", "CLIPTextEncodeFlux", "TextEncodeQwenImage21", "TextEncodeQwenImageEdit", "TextEncodeQwenImageEditPlus"),
    "conditioning_pass": ("FluxGuidance", "ConditioningCombine", "ConditioningConcat", "ConditioningSetTimestepRange", "ConditioningSetArea", "ConditioningSetAreaPercentage", "ConditioningSetAreaStrength", "ConditioningSetAreaPercentageVideo", "ReferenceLatent"),
    "conditioning_zero": ("ConditioningZeroOut",),
    "latent_source": ("EmptyLatentImage", "EmptySD3LatentImage", "VAEEncode", "VAEEncodeForInpaint"),
    "image_input": ("LoadImage",),
    "string_source": ("PrimitiveString", "PrimitiveStringMultiline", "StringConcatenate"),
    "primitive": ("PrimitiveBoolean", "PrimitiveInt", "PrimitiveFloat"),
    "switch": ("ComfySwitchNode", "ComfySoftSwitchNode", "easy ifElse"),
    "string_pass": ("PreviewAny",),
    "text_generator": ("TextGenerate",),
    "generator": ("Krea2ImageNode",),
}
SWITCHES = {"ComfySwitchNode": ("switch", "on_true", "on_false", False), "ComfySoftSwitchNode": ("switch", "on_true", "on_false", True), "easy ifElse": ("boolean", "on_true", "on_false", False)}
NAME_INPUTS = {"UNETLoader": ("unet_name",), "UnetLoaderGGUF": ("unet_name",), "CheckpointLoaderSimple": ("ckpt_name",), "CLIPLoader": ("clip_name",), "DualCLIPLoader": ("clip_name1", "clip_name2"), "TripleCLIPLoader": ("clip_name1", "clip_name2", "clip_name3"), "VAELoader": ("vae_name",), "PrimitiveString": ("value",), "PrimitiveStringMultiline": ("value",), "StringConcatenate": ("string_a", "string_b"), "PreviewAny": ("source",), "TextGenerate": ("prompt",)}


def registry(spark: SparkSession) -> DataFrame:
    """(class_type, role, kind, names): some sixty rows, made from the constants above."""
    kind = lambda c: "ckpt" if c.startswith("Checkpoint") else "unet" if "unet" in c.lower() else "power" if c.startswith("Power") else "soft" if "Soft" in c else ""
    return spark.createDataFrame([(c, r, kind(c), list(NAME_INPUTS.get(c, ()))) for r, cs in ROLES.items() for c in cs], "class_type string, role string, kind string, names array<string>")


def role_of(class_type: str = "class_type") -> Column:
    """As one expression: made of Columns it would take half a second wherever it is used."""
    cases = " ".join(f"when `{class_type}` in ({', '.join(repr(c) for c in cs)}) then '{r}'" for r, cs in ROLES.items())
    return F.expr(f"case {cases} end")


# ---- JSON to tables

API = "map<string,struct<class_type:variant,inputs:variant,_meta:variant>>"


def graph_nodes(prompts: DataFrame) -> DataFrame:
    """(file_id, node_id, class_type, title, inputs) from prompts(file_id, prompt_json): entries with a string
    class_type and an object of inputs; inputs is map<string, variant>."""
    parsed = prompts.select("file_id", F.from_json("prompt_json", API).alias("g"))
    rows = parsed.select("file_id", F.explode("g").alias("node_id", "n"))
    kind = lambda c: F.schema_of_variant(c)
    good = rows.where((kind(F.col("n.class_type")) == "STRING") & kind(F.col("n.inputs")).startswith("OBJECT"))
    title = F.when(F.schema_of_variant(F.try_variant_get("n._meta", "$.title", "variant")) == "STRING", F.try_variant_get("n._meta", "$.title", "string"))
    return good.select("file_id", "node_id", F.try_variant_get("n.class_type", "$", "string").alias("class_type"), title.alias("title"), F.try_variant_get("n.inputs", "$", "map<string,variant>").alias("inputs"))


def _inputs(nodes: DataFrame) -> DataFrame:
    values = nodes.select("file_id", F.col("node_id").alias("dst"), F.explode("inputs").alias("input", "v"))
    return values.withColumn("t", F.schema_of_variant("v"))


def graph_edges(nodes: DataFrame) -> DataFrame:
    """(file_id, dst, input, src, slot): an input is a link if it is [id of a node of this graph, whole number]."""
    v = _inputs(nodes).where(F.col("t").startswith("ARRAY") & F.try_variant_get("v", "$[1]", "variant").isNotNull() & F.try_variant_get("v", "$[2]", "variant").isNull())
    typed = v.where((F.schema_of_variant(F.try_variant_get("v", "$[0]", "variant")) == "STRING") & (F.schema_of_variant(F.try_variant_get("v", "$[1]", "variant")) == "BIGINT"))
    links = typed.select("file_id", "dst", "input", F.try_variant_get("v", "$[0]", "string").alias("src"), F.try_variant_get("v", "$[1]", "bigint").alias("slot"))
    return links.join(nodes.select("file_id", F.col("node_id").alias("src")), ["file_id", "src"], "left_semi").select("file_id", "dst", "input", "src", "slot")


def graph_literals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, node_id, input, str, num, bool): inputs that are no links, by type; not finite numbers are null."""
    v = _inputs(nodes).join(edges.select("file_id", "dst", "input"), ["file_id", "dst", "input"], "left_anti")
    num = F.when(~F.col("t").isin("STRING", "BOOLEAN", "VOID") & ~F.col("t").rlike("^(ARRAY|OBJECT)"), F.try_variant_get("v", "$", "double"))
    num = F.when(F.isnan(num) | (F.abs(num) == float("inf")), None).otherwise(num)
    return v.select("file_id", F.col("dst").alias("node_id"), "input", F.when(F.col("t") == "STRING", F.try_variant_get("v", "$", "string")).alias("str"), num.alias("num"), F.when(F.col("t") == "BOOLEAN", F.try_variant_get("v", "$", "boolean")).alias("bool"))


# ---- equal graphs


def digests(rows: DataFrame, *columns: str) -> DataFrame:
    """(file_id, n, d1..d4): how many rows a file has and what they are, in any order: the sums of the halves of two
    64-bit hashes of each. Sums of each task are what moves."""
    told = [x for c in columns for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    hashed = rows.where("file_id is not null").select("file_id", F.xxhash64(*told).alias("__a"), F.xxhash64(F.lit("again"), *told).alias("__b"))
    halves = [half for c in ("__a", "__b") for half in (F.col(c).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(c, 32))]
    return hashed.groupBy("file_id").agg(F.count("*").alias("n"), *(F.sum(h).alias(f"d{i}") for i, h in enumerate(halves, 1)))


def graph_digests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """digests() of the nodes and links of each file."""
    kind = lambda df, k: df.withColumn("__kind", F.lit(k))
    n = digests(kind(nodes, "node"), "__kind", "node_id", "class_type")
    return n.unionByName(digests(kind(slotted(edges), "link"), "__kind", "dst", "input", "src", "slot"))


def equal_graphs(*parts: DataFrame) -> DataFrame:
    """(file_id, same): the file that stands for all those whose digests(), of all parts together, are equal. What
    follows from nodes and links alone is worked out for these few, a template or a batch once, see spread()."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = ["n", "d1", "d2", "d3", "d4"]
    each = written(every.groupBy("file_id").agg(*(F.sum(c).alias(c) for c in sums)), "digests")
    first = written(each.groupBy(*sums).agg(F.min("file_id").alias("same")), "equal")
    return each.join(few(first), sums).select("file_id", "same")


def standing(rows: DataFrame, same: DataFrame) -> DataFrame:
    """rows(file_id, ...) of the files that stand for others."""
    return rows.join(few(written(same.select(F.col("same").alias("file_id")).distinct(), "standing")), "file_id", "left_semi")


def spread(found: DataFrame, same: DataFrame) -> DataFrame:
    """found(file_id, ...), worked out for the files that stand for others, for every file."""
    rest = [c for c in found.columns if c != "file_id"]
    per = found.groupBy(F.col("file_id").alias("same")).agg(F.collect_list(F.struct(*rest)).alias("__r"))
    return same.join(few(written(per, "found")), "same").select("file_id", F.inline("__r"))


# ---- reachability


def graph_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, node_id, kind): output nodes; samplers (kind `fallback`) of files that have none."""
    known, named, sampler = F.col("class_type").isin(list(OUTPUT_CLASSES)), F.col("class_type").rlike(OUTPUT_NAME), F.coalesce(role_of() == "sampler", F.lit(False))
    some = nodes.where(known | named | sampler).groupBy("file_id").agg(F.collect_list(F.struct("node_id", known.alias("known"), named.alias("named"), sampler.alias("sampler"))).alias("__c"))
    # by file alone and over the links as walks take them, so that only these few nodes move besides
    held = some.join(_linked(edges), "file_id", "left").withColumn("__used", F.coalesce(F.flatten(F.map_values("m")), F.array().cast("array<string>")))
    out = F.filter("__c", lambda x: x["known"] | (x["named"] & ~F.array_contains("__used", x["node_id"])))
    as_ = lambda x, kind: F.transform(x, lambda n: F.struct(n["node_id"].alias("node_id"), F.lit(kind).alias("kind")))
    bare = as_(F.filter("__c", lambda x: x["sampler"]), "fallback")
    return held.select("file_id", "__c", out.alias("__out")).select("file_id", F.inline(F.when(F.size("__out") > 0, as_(F.col("__out"), "output")).otherwise(bare)))


LINKS = "map<string,array<string>>"


def _mapped(links: DataFrame, node: str = "dst", source: str = "src") -> DataFrame:
    """(file_id, m): node -> the nodes that feed it. Both groupings are by file, so links move once."""
    per = links.repartition("file_id").groupBy("file_id", node).agg(F.collect_set(source).alias("__s"))
    return per.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct(node, "__s"))).alias("m"))


def _linked(edges: DataFrame) -> DataFrame:
    """(file_id, m): the links of a file as one map, by one shuffle."""
    return _mapped(edges.select("file_id", "dst", "src"))


def _folded(edges: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, roots, m: the links of a file beside each set of starting nodes; starts(keys..., node_id)."""
    roots = starts.groupBy(*keys).agg(F.collect_set("node_id").alias("roots"))
    return roots.join(_linked(edges), "file_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast(LINKS)))


def _feeding(m: str, front: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(front, lambda n: F.coalesce(F.try_element_at(F.col(m), n), F.array().cast("array<string>")))))


def _upstream(m: str, roots: str) -> Column:
    """roots and all nodes that feed them: each round goes one hop on from the nodes met last; nothing is left to do
    once there are none, at the latest after as many rounds as nodes have links."""
    start = F.struct(F.col(roots).alias("seen"), F.col(roots).alias("front"))
    hop = lambda s: F.transform(F.array(F.array_except(_feeding(m, s["front"]), s["seen"])), lambda new: F.struct(F.concat(s["seen"], new).alias("seen"), new.alias("front")))[0]
    return F.aggregate(F.sequence(F.lit(0), F.size(m)), start, lambda s, _: F.when(F.size(s["front"]) == 0, s).otherwise(hop(s)), lambda s: s["seen"])


def reachable(edges: DataFrame, roots: DataFrame, inactive: DataFrame | None = None) -> DataFrame:
    """(file_id, node_id): roots and all that feeds them; inactive(file_id, node_id, input) links do not count."""
    live = edges if inactive is None else edges.join(inactive.select("file_id", F.col("node_id").alias("dst"), "input"), ["file_id", "dst", "input"], "left_anti")
    return _folded(live, roots, ["file_id"]).select("file_id", F.explode(_upstream("m", "roots")).alias("node_id"))


def stopped(edges: DataFrame, starts: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., node_id): what feeds each start, not going on past stops(file_id, node_id); starts go on even if they are stops."""
    held = edges.join(stops.select("file_id", F.col("node_id").alias("dst")), ["file_id", "dst"], "left_anti")
    first = starts.join(edges.select("file_id", F.col("dst").alias("node_id"), "src"), ["file_id", "node_id"]).select(*keys, F.col("src").alias("node_id"))
    walked = _folded(held, first, keys).select(*keys, F.explode(_upstream("m", "roots")).alias("node_id"))
    return walked.unionByName(starts.select(*keys, "node_id")).distinct()


def nearest_by_output(nodes: DataFrame, edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """(file_id, output, samplers): the samplers that an output meets first."""
    samplers = nodes.where(role_of() == "sampler").select("file_id", "node_id")
    starts = outputs.select("file_id", F.col("node_id").alias("output"), "node_id")
    met = stopped(edges, starts, samplers, ["file_id", "output"]).where("node_id <> output").join(samplers, ["file_id", "node_id"], "left_semi")
    return met.groupBy("file_id", "output").agg(F.array_sort(F.collect_set("node_id")).alias("samplers"))


def multiple_branches(nearest: DataFrame) -> DataFrame:
    return nearest.groupBy("file_id").agg((F.count_distinct("samplers") > 1).alias("multi"))


def _graphs(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """(file_id, key, g): the nodes and links of each file in a canonical form, an array of (dst, src) in order; a node
    itself is a link from "\0". Without nodes those of the links are meant."""
    if nodes is None:
        links = edges.select("file_id", F.struct("dst", "src").alias("x"))
    else:
        own = nodes.select("file_id", F.col("node_id").alias("dst")).distinct()
        links = edges.join(own, ["file_id", "dst"], "left_semi").select("file_id", F.struct("dst", "src").alias("x"))
        links = links.unionByName(own.select("file_id", F.struct("dst", F.lit("\0").alias("src")).alias("x")))
    return links.groupBy("file_id").agg(F.array_sort(F.collect_set("x")).alias("g")).select("file_id", F.xxhash64("g").alias("key"), "g")


ORDERED = "node_id string, rank int, level int, stuck boolean"


def ordered_once(graphs: DataFrame) -> DataFrame:
    """(key, g, each): every different graph once, with its nodes in order, see _order(). What many files share - a
    template, a batch - is put in order by one call."""
    different = graphs.select("key", "g").distinct()

    def ranked(batches):
        kind = pa.list_(pa.struct([("node_id", pa.string()), ("rank", pa.int32()), ("level", pa.int32()), ("stuck", pa.bool_())]))
        for b in batches:
            made = []
            for g in b.column(1).to_pylist():
                order, level, stuck = _order([x["dst"] for x in g], [x["src"] for x in g])
                made.append([{"node_id": n, "rank": i, "level": level[n], "stuck": False} for i, n in enumerate(order)] + [{"node_id": n, "rank": None, "level": None, "stuck": True} for n in stuck])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, kind)], ["key", "g", "each"])

    return different.mapInArrow(ranked, f"key long, g array<struct<dst:string,src:string>>, each array<struct<{ORDERED.replace(' ', ':').replace(',:', ',')}>>")


def _ordered(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    graphs = _graphs(edges, nodes)
    return graphs.join(ordered_once(graphs), ["key", "g"]).select("file_id", "each")


def topo_order(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(file_id, node_id, rank, error): sources first, ties by the smaller id string; on a cycle one row with the
    stuck ids in error."""
    each = _ordered(edges, reached)
    stuck = F.array_join(F.transform(F.filter("each", lambda x: x["stuck"]), lambda x: x["node_id"]), ",")
    error = F.array(F.struct(F.lit(None).cast("string").alias("node_id"), F.lit(-1).alias("rank"), stuck.alias("error")))
    fine = F.transform("each", lambda x: F.struct(x["node_id"].alias("node_id"), x["rank"].alias("rank"), F.lit(None).cast("string").alias("error")))
    return each.select("file_id", F.inline(F.when(F.exists("each", lambda x: x["stuck"]), error).otherwise(fine)))


def _order(dst: list[str], src: list[str]) -> tuple[list[str], dict[str, int], list[str]]:
    """Nodes in order, the longest path to each from a node without sources, and those on or behind a cycle: every link
    is counted off once. Sources that are no dst themselves do not count."""
    known = set(dst)
    feeds: dict[str, list[str]] = {n: [] for n in known}
    missing = dict.fromkeys(known, 0)
    for d, s in set(zip(dst, src, strict=True)):
        if s in known:
            feeds[s].append(d)
            missing[d] += 1
    ready, out, level = [n for n, k in missing.items() if not k], [], dict.fromkeys(known, 0)
    heapq.heapify(ready)
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for d in feeds[n]:
            level[d] = max(level[d], level[n] + 1)
            missing[d] -= 1
            if not missing[d]:
                heapq.heappush(ready, d)
    return out, level, sorted(known - set(out))


def levels(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(file_id, node_id, level): the longest path from a source; null for nodes on or behind a cycle."""
    return _ordered(edges, reached).select("file_id", F.inline("each")).select("file_id", "node_id", "level")


def cyclic(edges: DataFrame) -> DataFrame:
    """(file_id, stuck): graphs with a cycle and the nodes left when sources are taken away until nothing changes."""
    left = _ordered(edges, None).select("file_id", F.transform(F.filter("each", lambda x: x["stuck"]), lambda x: x["node_id"]).alias("left"))
    return left.where(F.size("left") > 0).select("file_id", F.array_join("left", ",").alias("stuck"))


# ---- switches and chains


def constants(edges: DataFrame, nodes: DataFrame, literals: DataFrame, kind: str) -> DataFrame:
    """(file_id, node_id, input, value): inputs that are a literal of a kind (str, num, bool) or link to a primitive
    node with exactly one of that kind."""
    own = literals.where(F.col(kind).isNotNull()).select("file_id", "node_id", "input", F.col(kind).alias("value"))
    one = own.join(nodes.where(role_of() == "primitive").select("file_id", "node_id"), ["file_id", "node_id"], "left_semi").groupBy("file_id", F.col("node_id").alias("src")).agg(F.count("*").alias("n"), F.first("value").alias("value")).where("n = 1")
    return own.unionByName(edges.join(one, ["file_id", "src"]).select("file_id", F.col("dst").alias("node_id"), "input", "value"))


def inactive_inputs(nodes: DataFrame, edges: DataFrame, literals: DataFrame) -> DataFrame:
    """(file_id, node_id, input): the inputs that switches with a constant condition did not choose; a soft switch
    falls back where the chosen one is not connected."""
    shape = F.create_map(*[x for c, (cond, on, off, soft) in SWITCHES.items() for x in (F.lit(c), F.struct(F.lit(cond).alias("cond"), F.lit(on).alias("on"), F.lit(off).alias("off"), F.lit(soft).alias("soft")))])
    sw = nodes.where(role_of() == "switch").select("file_id", "node_id", shape[F.col("class_type")].alias("s"))
    known = sw.join(constants(edges, nodes, literals, "bool").withColumnRenamed("input", "cond"), ["file_id", "node_id"]).where("cond = s.cond")
    picked = known.select("file_id", "node_id", "s.soft", F.when(F.col("value"), F.col("s.on")).otherwise(F.col("s.off")).alias("chosen"), F.when(F.col("value"), F.col("s.off")).otherwise(F.col("s.on")).alias("other"))
    linked = edges.select("file_id", F.col("dst").alias("node_id"), F.col("input").alias("chosen"), F.lit(True).alias("linked"))
    return picked.join(linked, ["file_id", "node_id", "chosen"], "left").select("file_id", "node_id", F.when(F.col("soft") & F.col("linked").isNull(), F.col("chosen")).otherwise(F.col("other")).alias("input"))


def slotted(edges: DataFrame) -> DataFrame:
    """edges with the output slot of their source; 0 where the table has none."""
    return edges if "slot" in edges.columns else edges.withColumn("slot", F.lit(0).cast("long"))


def _next(nodes: DataFrame, edges: DataFrame, inactive: DataFrame, name: str | None) -> DataFrame:
    """(file_id, m): where each node goes on to, and from which slot: along input `name`; a switch to its single active input."""
    sw = nodes.where(role_of() == "switch").select("file_id", F.col("node_id").alias("dst"), F.lit(True).alias("sw"))
    live = slotted(edges).join(inactive.select("file_id", F.col("node_id").alias("dst"), "input"), ["file_id", "dst", "input"], "left_anti").join(sw, ["file_id", "dst"], "left").withColumn("to", F.struct("src", "slot"))
    through = live.where(F.col("sw") & F.col("input").isin("on_true", "on_false")).groupBy("file_id", "dst").agg(F.count("*").alias("n"), F.min("to").alias("to")).where("n = 1").select("file_id", "dst", "to")
    if name is not None:
        through = through.unionByName(live.where(F.col("sw").isNull() & (F.col("input") == name)).groupBy("file_id", "dst").agg(F.min("to").alias("to")))
    return through.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("dst", "to"))).alias("m"))


def _walk(m: str, start: str) -> Column:
    """The nodes from start on, until the end or one seen before."""
    last = lambda a: F.try_element_at(F.col(m), F.element_at(a, -1))["src"]
    step = lambda a, _: F.when(last(a).isNull() | F.array_contains(a, last(a)), a).otherwise(F.concat(a, F.array(last(a))))
    return F.when(F.col(m).isNull(), F.array(F.col(start))).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(m)), F.array(F.col(start)), step))


def resolve_switches(links: DataFrame, nodes: DataFrame, edges: DataFrame, inactive: DataFrame) -> DataFrame:
    """links(file_id, dst, input, src) with `past` and `past_slot`: src and slot past any chain of switches; null when a
    choice is open."""
    end = slotted(links).join(_next(nodes, edges, inactive, None), "file_id", "left").withColumn("__w", _walk("m", "src"))
    slot = F.when(F.size("__w") == 1, F.col("slot")).otherwise(F.try_element_at(F.col("m"), F.get("__w", F.size("__w") - 2))["slot"])
    end = end.withColumn("past", F.element_at("__w", -1)).withColumn("past_slot", slot).drop("m", "__w")
    open_ = nodes.where(role_of() == "switch").select("file_id", F.col("node_id").alias("past"), F.lit(True).alias("open"))
    return end.join(open_, ["file_id", "past"], "left").withColumn("past", F.when(F.col("open").isNull(), F.col("past"))).drop("open")


def follow_input(starts: DataFrame, nodes: DataFrame, edges: DataFrame, inactive: DataFrame, name: str) -> DataFrame:
    """(file_id, start, node_id, depth): the chain from each node upwards along one input, through switches; a switch
    row means that its choice is open and the chain ends there. starts(file_id, start)."""
    way = F.filter(_walk("m", "start"), lambda x, i: i > 0)
    walked = starts.join(_next(nodes, edges, inactive, name), "file_id", "left").select("file_id", "start", F.posexplode(way).alias("depth", "node_id"))
    kinds = nodes.select("file_id", "node_id", (role_of() == "switch").alias("sw"))
    last = walked.groupBy("file_id", "start").agg(F.max("depth").alias("last"))
    joined = walked.join(kinds, ["file_id", "node_id"]).join(last, ["file_id", "start"]).where(~F.coalesce("sw", F.lit(False)) | (F.col("depth") == F.col("last")))
    return joined.select("file_id", "start", "node_id", "depth")


def nearest_role(edges: DataFrame, nodes: DataFrame, starts: DataFrame, role: str) -> DataFrame:
    """(file_id, start, node_id): the nearest node upstream with a role, of equally near ones the smallest id."""
    with_role = nodes.where(role_of() == role).groupBy("file_id").agg(F.collect_set("node_id").alias("want"))
    base = starts.join(_linked(edges), "file_id").join(with_role, "file_id").withColumn("__s", F.array("start"))
    step = lambda f, _: F.when((F.size(f) == 0) | F.arrays_overlap(f, "want"), f).otherwise(_feeding("m", f))
    front = F.aggregate(F.sequence(F.lit(0), F.size("m")), _feeding("m", F.col("__s")), step)
    found = base.select("file_id", "start", F.array_min(F.array_intersect(front, "want")).alias("node_id"))
    return found.where("node_id is not null")


def cleanup_plan(nodes: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(file_id, node_id): LoRA nodes that feed no output and nothing else that stays."""
    loras = nodes.where(role_of() == "lora").groupBy("file_id").agg(F.collect_set("node_id").alias("idle"))
    met = reached.groupBy("file_id").agg(F.collect_set("node_id").alias("__met"))
    idle = loras.join(met, "file_id", "left").select("file_id", F.array_except("idle", F.coalesce("__met", F.array().cast("array<string>"))).alias("idle")).where(F.size("idle") > 0)
    own = edges.groupBy("file_id").agg(F.collect_list(F.struct("dst", "src")).alias("e"))
    base = idle.join(own, "file_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<dst:string,src:string>>")))
    stays = lambda keep, n: F.exists("e", lambda x: (x["src"] == n) & ~F.array_contains(keep, x["dst"]))
    step = lambda keep, _: F.filter(keep, lambda n: ~stays(keep, n))
    return base.select("file_id", F.explode(F.aggregate(F.sequence(F.lit(1), F.size("idle")), F.col("idle"), step)).alias("node_id"))


# ---- entries of the power loader, and what a cleanup takes


def field_order(prompts: DataFrame) -> DataFrame:
    """(file_id, node_id, fields): the names of each node's inputs as they follow in the document, of prompts(file_id,
    prompt_json). Spark's parser puts the fields of an object in order of their names; the text of an object keeps it."""
    each = prompts.select("file_id", F.explode(F.from_json("prompt_json", "map<string,struct<inputs:string>>")).alias("node_id", "n"))
    return each.select("file_id", "node_id", F.json_object_keys("n.inputs").alias("fields")).where("fields is not null")


def power_entries(nodes: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(file_id, node_id, entry, place, on, lora, strength, strength_two): the LoRA entries of power loaders: inputs
    called lora_..., in any case, that are objects with on, lora and strength and name a file. place is their order: that
    of the document by order, see field_order(); without it numbered names are in the order of their numbers."""
    power = [c for c in ROLES["lora"] if c.startswith("Power")]
    own = nodes.where(F.col("class_type").isin(power)).select("file_id", "node_id", F.explode("inputs").alias("entry", "v"))
    part = lambda k, kind: F.try_variant_get("v", f"$.{k}", kind)
    own = own.where(F.upper("entry").startswith("LORA_") & F.schema_of_variant("v").startswith("OBJECT"))
    own = own.where(part("on", "variant").isNotNull() & part("strength", "variant").isNotNull() & (F.schema_of_variant(part("lora", "variant")) == "STRING"))
    own = own.select("file_id", "node_id", "entry", part("on", "boolean").alias("on"), part("lora", "string").alias("lora"), part("strength", "double").alias("strength"), part("strengthTwo", "double").alias("strength_two"))
    number = [F.coalesce(F.regexp_extract("entry", r"(\d+)$", 1).try_cast("int"), F.lit(0)), F.col("entry")]
    if order is not None:
        own = own.join(order, ["file_id", "node_id"], "left")
        number = [F.array_position("fields", F.col("entry")), *number]
    place = F.row_number().over(Window.partitionBy("file_id", "node_id").orderBy(*number)) - 1
    return own.where(~F.col("lora").isin("", "None")).withColumn("place", place).select("file_id", "node_id", "entry", "place", "on", "lora", "strength", "strength_two")


def switched_off(entries: DataFrame, plan: DataFrame) -> DataFrame:
    """(file_id, node_id, entry, lora): entries that are off, of nodes that stay."""
    return entries.where(~F.col("on")).join(plan, ["file_id", "node_id"], "left_anti").select("file_id", "node_id", "entry", "lora")


def clean_prompt(prompts: DataFrame, plan: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(file_id, prompt_json) without the planned nodes and, of the others, the entries(file_id, node_id, entry)."""
    gone = plan.groupBy("file_id").agg(F.collect_set("node_id").alias("gone"))
    held = prompts.select("file_id", "prompt_json").join(gone, "file_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    left = F.map_filter(F.from_json("prompt_json", "map<string,variant>"), lambda k, v: ~F.array_contains("gone", k))
    if entries is None:
        return held.select("file_id", F.when(F.size("gone") == 0, F.col("prompt_json")).otherwise(F.to_json(left)).alias("prompt_json"))
    off = entries.groupBy("file_id").agg(F.collect_set(F.concat_ws("\0", "node_id", "entry")).alias("off"))
    held = held.join(off, "file_id", "left").withColumn("off", F.coalesce("off", F.array().cast("array<string>")))
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    inputs = lambda k, v: F.map_filter(F.try_variant_get(v, "$.inputs", "map<string,variant>"), lambda e, _: ~F.array_contains("off", F.concat_ws("\0", k, e)))
    named = lambda k: F.exists("off", lambda x: x.startswith(F.concat(k, F.lit("\0"))))
    trimmed = lambda k, v: F.when(named(k), F.to_variant_object(F.transform_values(fields(v), lambda f, x: F.when(f == "inputs", F.to_variant_object(inputs(k, v))).otherwise(x)))).otherwise(v)
    some = (F.size("gone") > 0) | (F.size("off") > 0)
    return held.select("file_id", F.when(some, F.to_json(F.transform_values(left, trimmed))).otherwise(F.col("prompt_json")).alias("prompt_json"))


def clean_workflow(workflows: DataFrame, plan: DataFrame) -> DataFrame:
    """(file_id, workflow_json) of workflows(file_id, workflow_json), the interface's document, without the planned
    nodes(file_id, node_id, class_type) that it holds as the same class, their links (as arrays or objects), and what
    names those links: inputs, outputs, link extensions and reroutes."""
    gone = plan.groupBy("file_id").agg(F.collect_set(F.concat_ws("\0", "node_id", "class_type")).alias("gone"))
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    items = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda v, *paths: F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths))
    w = workflows.join(gone, "file_id").withColumn("w", F.from_json("workflow_json", "map<string,variant>"))
    w = w.withColumn("nodes", items(F.try_element_at("w", F.lit("nodes")))).withColumn("links", items(F.try_element_at("w", F.lit("links"))))
    out = F.transform(F.filter("nodes", lambda n: F.array_contains("gone", F.concat_ws("\0", text(n, "$.id"), text(n, "$.type")))), lambda n: text(n, "$.id"))
    w = w.withColumn("out", out).where(F.size("out") > 0)
    ends = lambda x: F.arrays_overlap("out", F.array_compact(F.array(text(x, "$[1]", "$.origin_id"), text(x, "$[3]", "$.target_id"))))
    w = w.withColumn("cut", F.transform(F.filter("links", ends), lambda x: text(x, "$[0]", "$.id")))
    cut = lambda v: F.coalesce(F.array_contains("cut", F.try_variant_get(v, "$", "string")), F.lit(False))
    none = F.parse_json(F.lit("null"))
    stay = lambda v: F.filter(items(v), lambda x: ~cut(x))
    input_ = lambda i: F.to_variant_object(F.transform_values(fields(i), lambda k, v: F.when((k == "link") & cut(v), none).otherwise(v)))
    output = lambda o: F.to_variant_object(F.transform_values(fields(o), lambda k, v: F.when((k == "links") & (F.schema_of_variant(v) != "VOID"), F.to_variant_object(stay(v))).otherwise(v)))
    part = lambda k, v: F.when(k == "inputs", F.to_variant_object(F.transform(items(v), input_))).when(k == "outputs", F.to_variant_object(F.transform(items(v), output))).otherwise(v)
    node = lambda n: F.to_variant_object(F.transform_values(fields(n), part))
    nodes = F.transform(F.filter("nodes", lambda n: ~F.coalesce(F.array_contains("out", text(n, "$.id")), F.lit(False))), node)
    links = F.filter("links", lambda x: ~F.coalesce(F.array_contains("cut", text(x, "$[0]", "$.id")), F.lit(False)))
    named = lambda v: F.filter(items(v), lambda x: ~F.coalesce(F.array_contains("cut", text(x, "$.id")), F.lit(False)))
    route = lambda r: F.to_variant_object(F.transform_values(fields(r), lambda k, v: F.when(k == "linkIds", F.to_variant_object(stay(v))).otherwise(v)))
    more = lambda k, v: F.when(k == "linkExtensions", F.to_variant_object(named(v))).when(k == "reroutes", F.to_variant_object(F.transform(items(v), route))).otherwise(v)
    new = lambda k, v: F.when(k == "nodes", F.to_variant_object(F.col("__nodes"))).when(k == "links", F.to_variant_object(F.col("__links"))).when((k == "extra") & F.schema_of_variant(v).startswith("OBJECT"), F.to_variant_object(F.transform_values(fields(v), more))).otherwise(v)
    done = w.withColumn("__nodes", nodes).withColumn("__links", links).select("file_id", F.to_json(F.transform_values("w", new)).alias("__new"))
    return workflows.join(done, "file_id", "left").select("file_id", F.coalesce("__new", "workflow_json").alias("workflow_json"))


def unregistered(nodes: DataFrame) -> DataFrame:
    """(class_type, files): classes without a role that are no output."""
    return nodes.where(role_of().isNull() & ~F.col("class_type").isin(list(OUTPUT_CLASSES))).groupBy("class_type").agg(F.count_distinct("file_id").alias("files"))


def _slots(nodes: DataFrame, edges: DataFrame, inactive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links past switches, and (file_id, node_id, generator, i, input): the parts of text nodes; 99 is the delimiter."""
    links = resolve_switches(edges, nodes, edges, inactive).select("file_id", F.col("dst").alias("node_id"), "input", "past", F.lit(True).alias("linked"))
    own = nodes.where(role_of().isin("string_source", "string_pass", "text_generator")).select("file_id", "node_id", "class_type", (role_of() == "text_generator").alias("generator"))
    parts = F.create_map(*[x for c, ns in NAME_INPUTS.items() for x in (F.lit(c), F.array(*map(F.lit, ns)))])
    slots = own.select("file_id", "node_id", "generator", F.posexplode(parts[F.col("class_type")]).alias("i", "input"))
    return links, slots.unionByName(own.where("class_type = 'StringConcatenate'").select("file_id", "node_id", "generator", F.lit(99).alias("i"), F.lit("delimiter").alias("input")))


def _texts(nodes: DataFrame, edges: DataFrame, literals: DataFrame, inactive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links past switches, and (file_id, t): a file's text nodes, each with its parts in order (i): a literal or the
    node that a link comes from."""
    links, slots = _slots(nodes, edges, inactive)
    held = literals.select("file_id", "node_id", "input", "str", F.lit(True).alias("written"))
    have = slots.join(held, ["file_id", "node_id", "input"], "left").join(links, ["file_id", "node_id", "input"], "left")
    lit = F.when((F.col("i") == 99) & F.col("written").isNull() & F.col("linked").isNull(), "").otherwise(F.col("str"))
    one = have.groupBy("file_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("i", lit.alias("lit"), "past"))).alias("p"), F.max("generator").alias("generator"))
    return links, one.groupBy("file_id").agg(F.collect_list(F.struct("node_id", "p", "generator")).alias("t"))


def resolve_strings(inputs: DataFrame, nodes: DataFrame, edges: DataFrame, literals: DataFrame, inactive: DataFrame, depth: int = 8) -> DataFrame:
    """(file_id, node_id, input, text): what text inputs hold, through switches, passing nodes, text generators and
    concatenation; null where it is not known. inputs(file_id, node_id, input). Each round of a fold over a file's text
    nodes knows one hop more; what is more than `depth` nodes away stays unknown."""
    links, texts = _texts(nodes, edges, literals, inactive)
    known = texts.select("file_id", _known(depth).alias("known"))
    have = inputs.join(literals.where("str is not null").select("file_id", "node_id", "input", "str"), ["file_id", "node_id", "input"], "left").join(links.drop("linked"), ["file_id", "node_id", "input"], "left").join(known, "file_id", "left")
    return have.select(*inputs.columns, F.coalesce("str", F.try_element_at("known", F.col("past"))).alias("text"))


def _known(depth: int, t: Column | str = "t") -> Column:
    """node -> text of the text nodes t(node_id, p(i, lit, past)) of a row, as far as it is known."""
    value = lambda known, x: F.coalesce(x["lit"], F.try_element_at(known, x["past"]))
    sep = lambda known, n: F.coalesce(value(known, F.get(F.filter(n["p"], lambda x: x["i"] == 99), 0)), F.lit(""))
    joined = lambda known, n: F.call_function("array_join", F.transform(F.filter(n["p"], lambda x: x["i"] < 99), lambda x: value(known, x)), sep(known, n))
    text = lambda known, n: F.when(~F.exists(n["p"], lambda x: value(known, x).isNull()), joined(known, n))
    step = lambda known, _: F.map_from_entries(F.filter(F.transform(t, lambda n: F.struct(n["node_id"].alias("key"), text(known, n).alias("value"))), lambda e: e["value"].isNotNull()))
    # nothing is left to do once all are known
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.create_map().cast("map<string,string>"), lambda known, i: F.when(F.size(known) == F.size(t), known).otherwise(step(known, i)))


def text_plans(inputs: DataFrame, nodes: DataFrame, edges: DataFrame, inactive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What resolve_strings() needs to know of graphs, without their literals: inputs(file_id, node_id, input) with `past`,
    the node that a link comes from, and (file_id, t): the text nodes with their parts p(i, input, past, linked)."""
    links, slots = _slots(nodes, edges, inactive)
    have = slots.join(links, ["file_id", "node_id", "input"], "left")
    one = have.groupBy("file_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("i", "input", "past", F.col("linked").isNotNull().alias("linked")))).alias("p"), F.max("generator").alias("generator"))
    return inputs.join(links.drop("linked"), ["file_id", "node_id", "input"], "left"), one.groupBy("file_id").agg(F.collect_list(F.struct("node_id", "p", "generator")).alias("t"))


def known_texts(t: str, lits: str, depth: int = 8) -> Column:
    """node -> text for a row with the text nodes t of text_plans() and its own literals lits(node_id, input, str)."""
    own = lambda n, x: F.filter(F.col(lits), lambda l: (l["node_id"] == n["node_id"]) & (l["input"] == x["input"]))
    lit = lambda n, x: F.when((x["i"] == 99) & (F.size(own(n, x)) == 0) & ~x["linked"], "").otherwise(F.get(own(n, x), 0)["str"])
    part = lambda n: lambda x: F.struct(x["i"].alias("i"), lit(n, x).alias("lit"), x["past"].alias("past"))
    filled = F.transform(F.col(t), lambda n: F.struct(n["node_id"].alias("node_id"), F.transform(n["p"], part(n)).alias("p")))
    # named by a lambda, so that the literals are looked up once
    return F.transform(F.array(filled), lambda x: _known(depth, x))[0]


def text_generators(past: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, node_id, input, generator): the text generators that a text input's value comes through, of text_plans()."""
    pairs = F.flatten(F.transform("t", lambda n: F.transform(F.filter(n["p"], lambda x: x["past"].isNotNull()), lambda x: F.struct(n["node_id"].alias("dst"), x["past"].alias("src")))))
    base = texts.select("file_id", pairs.alias("e"), F.transform(F.filter("t", lambda n: n["generator"]), lambda n: n["node_id"]).alias("g")).where(F.size("g") > 0)
    fed = _mapped(base.select("file_id", F.inline("e")))
    per = base.select("file_id", "g").join(fed, "file_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast(LINKS)))
    met = past.where("past is not null").join(per, "file_id").withColumn("roots", F.array("past"))
    return met.select("file_id", "node_id", "input", F.explode(F.array_intersect(_upstream("m", "roots"), "g")).alias("generator"))

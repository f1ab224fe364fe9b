"""Extraction: graphs to normalised rows (stages, model chains, LoRA uses, prompts, generations)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprynt.functions import scalars as S
from imprynt.operators import graph as G
from imprynt.sources.tables import few, sized, written

# Warning codes by the stage that writes them.
EXTRACTION_CODES = ("UNSUPPORTED_SUBGRAPH", "NO_OUTPUT_NODE", "MULTIPLE_OUTPUT_BRANCHES", "GRAPH_CYCLE", "NO_SAMPLER", "UNKNOWN_MODEL_PATCH", "MODEL_CHAIN_BROKEN", "UNUSED_LORA", "MULTIPLE_PROMPT_SOURCES", "HEURISTIC_PROMPT", "PROMPT_UNRESOLVED", "GENERATED_PROMPT")
READ_CODES = ("TRUNCATED", "METADATA_KEY_MISMATCH", "UNSUPPORTED_FORMAT", "THUMBNAIL_FAILED", "TIMESTAMP_SUSPECT")
INFORMATIONAL = ("UNUSED_LORA", "UNKNOWN_MODEL_PATCH", "NO_SAMPLER", "GENERATED_PROMPT")


@dataclass(frozen=True)
class Rule:
    """One condition of a family: all of its given keys must match."""

    family: str
    unet: str | None = None
    ckpt: str | None = None
    clip_type: str | None = None
    node_class: str | None = None


# Model families, the first rule that matches wins.
FAMILY_RULES = (
    Rule("qwen-image-2.1", unet=r"(?i)qwen[_-]?image[_-]?2\.1"), Rule("qwen-image-2.1", node_class="^TextEncodeQwenImage21$"),
    Rule("qwen-image", unet=r"(?i)qwen[_-]?image"), Rule("qwen-image", clip_type="qwen_image"),
    Rule("krea-2", clip_type="krea2"), Rule("krea-2", unet=r"(?i)krea[_-]?2"), Rule("krea-2-api", node_class="^Krea2ImageNode$"),
    Rule("flux1-krea", unet="(?i)krea"), Rule("flux", unet="(?i)flux"), Rule("flux", clip_type="flux"), Rule("ideogram", node_class="(?i)^ideogram"),
)


def _like(regex: str):
    return lambda x: x.rlike(regex)


def match_family(loader_kind: Column, loader_name: Column, clip_type: Column, classes: Column, rules: tuple[Rule, ...] = FAMILY_RULES) -> Column:
    """The family of the first rule that holds, else null; classes is an array of class names."""
    out = None
    for r in rules:
        c = F.lit(True)
        c = c & (loader_kind == "unet") & loader_name.rlike(r.unet) if r.unet else c
        c = c & (loader_kind == "ckpt") & loader_name.rlike(r.ckpt) if r.ckpt else c
        c = c & (clip_type == r.clip_type) if r.clip_type else c
        c = c & F.exists(classes, _like(r.node_class)) if r.node_class else c
        out = F.when(F.coalesce(c, F.lit(False)), r.family) if out is None else out.when(F.coalesce(c, F.lit(False)), r.family)
    return out


def sampler_stages(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """(file_id, stage_index, node_id, class_type): samplers in graph order, 0 is the primary one; order(file_id, node_id, rank)."""
    s = nodes.where(G.role_of() == "sampler").join(order.where("rank >= 0"), ["file_id", "node_id"])
    return s.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("rank", "node_id")) - 1).alias("stage_index"), "node_id", "class_type")


#: Settings: the inputs that hold one, of which kind, and the input of a sampler behind which it may be instead.
SETTINGS = (("seed", ("seed", "noise_seed"), "num", "noise"), ("steps", ("steps",), "num", "sigmas"), ("cfg", ("cfg", "cfg_conds"), "num", "guider"), ("denoise", ("denoise",), "num", "sigmas"), ("sampler_name", ("sampler_name",), "str", "sampler"), ("scheduler", ("scheduler",), "str", "sigmas"))


def _settings(literals: DataFrame) -> DataFrame:
    """(file_id, node_id, a column for each of SETTINGS) by one grouping."""
    every = [i for _, inputs, _, _ in SETTINGS for i in inputs]
    return literals.where(F.col("input").isin(every)).groupBy("file_id", "node_id").agg(*(F.min(F.when(F.col("input").isin(*inputs), F.col(kind))).alias(name) for name, inputs, kind, _ in SETTINGS))


def stage_settings(stages: DataFrame, nodes: DataFrame, edges: DataFrame, literals: DataFrame) -> DataFrame:
    """stages with seed, steps, cfg, sampler_name, scheduler, denoise: the sampler's own input, else that of the
    noise, guider, sampler or sigmas node linked to it; an unknown source of the last two gives its class name."""
    sat = edges.where(F.col("input").isin("noise", "guider", "sampler", "sigmas")).select("file_id", F.col("dst").alias("node_id"), F.col("input").alias("__via"), F.col("src").alias("__src"))
    sat = sized(written(sat, "satellites"))
    behind = few(written(sat.select("file_id", F.col("__src").alias("node_id")).distinct(), "behind"))
    far = _settings(literals.join(behind, ["file_id", "node_id"], "left_semi")).withColumnRenamed("node_id", "__src")
    kinds = nodes.join(behind, ["file_id", "node_id"], "left_semi").select("file_id", F.col("node_id").alias("__src"), F.col("class_type").alias("__class"))
    named = F.when(~F.col("__class").isin("KSamplerSelect", "BasicScheduler"), F.col("__class"))
    value = lambda name: F.coalesce(name, named) if name in ("sampler_name", "scheduler") else F.col(name)
    far = sat.join(far, ["file_id", "__src"], "left").join(kinds, ["file_id", "__src"], "left").groupBy("file_id", "node_id").agg(*(F.min(F.when(F.col("__via") == via, value(name))).alias(f"__{name}") for name, _, _, via in SETTINGS))
    out = stages.join(_settings(literals), ["file_id", "node_id"], "left").join(far, ["file_id", "node_id"], "left")
    return out.select(*stages.columns, *(F.coalesce(name, f"__{name}").alias(name) for name, *_ in SETTINGS))


def model_chain(stages: DataFrame, nodes: DataFrame, edges: DataFrame, inactive: DataFrame) -> DataFrame:
    """(file_id, stage_index, node_id, class_type, role, depth): the nodes a sampler's model comes through, nearest
    first; a sampler without a model of its own has its guider's."""
    own = edges.where("input = 'model'").select("file_id", F.col("dst").alias("node_id"), F.lit(True).alias("own")).distinct()
    guider = edges.where("input = 'guider'").groupBy("file_id", F.col("dst").alias("node_id")).agg(F.min("src").alias("guider"))
    starts = stages.join(own, ["file_id", "node_id"], "left").join(guider, ["file_id", "node_id"], "left").select("file_id", "stage_index", F.when(F.col("own").isNull(), F.coalesce("guider", "node_id")).otherwise(F.col("node_id")).alias("start"))
    chain = G.follow_input(starts.select("file_id", "start").distinct(), nodes, edges, inactive, "model")
    named = chain.join(nodes.select("file_id", "node_id", "class_type", G.role_of().alias("role")), ["file_id", "node_id"])
    return named.join(starts, ["file_id", "start"]).select("file_id", "stage_index", "node_id", "class_type", "role", "depth")


def chain_summary(chain: DataFrame, literals: DataFrame) -> DataFrame:
    """(file_id, stage_index, loader, base_model, loader_kind, shift, broken): the loader at the end, the shift of the
    patch nearest the sampler."""
    shift = literals.where("input = 'shift'").select("file_id", "node_id", F.col("num").alias("shift"))
    name = literals.where("input in ('unet_name', 'ckpt_name')").select("file_id", "node_id", F.col("str").alias("model"), F.when(F.col("input") == "unet_name", "unet").otherwise("ckpt").alias("kind"))
    full = chain.join(shift, ["file_id", "node_id"], "left").join(name, ["file_id", "node_id"], "left")
    out = full.groupBy("file_id", "stage_index").agg(F.max(F.when(F.col("role") == "model_loader", F.struct("depth", "node_id", "model", "kind"))).alias("l"), F.min(F.when(F.col("shift").isNotNull(), F.struct("depth", "shift"))).alias("s"))
    return out.select("file_id", "stage_index", F.col("l.node_id").alias("loader"), S.model_stem(F.col("l.model")).alias("base_model"), F.col("l.kind").alias("loader_kind"), F.col("s.shift").alias("shift"), F.col("l").isNull().alias("broken"))


def lora_uses(chain: DataFrame, nodes: DataFrame, literals: DataFrame, entries: DataFrame | None = None, same: DataFrame | None = None) -> DataFrame:
    """(file_id, stage_index, node_id, entry, position, name, base_name, step, strength_model, strength_clip, enabled,
    reachable): one row for each plain LoRA node and each entry of a power loader (G.power_entries), in each stage on
    whose chain it is; enabled ones are numbered from the loader outward, then in the order of the entries. Nodes on no
    chain have no stage and position. With same, see G.equal_graphs(), chain and nodes are those of the files that stand
    for others."""
    on = chain.where("role = 'lora'").select("file_id", "stage_index", "node_id", "depth")
    loras = nodes.where(G.role_of() == "lora").select("file_id", "node_id", F.col("class_type").startswith("Power").alias("power"))
    every = loras.join(on, ["file_id", "node_id"], "left")
    every = every if same is None else G.spread(every, same)
    field = lambda n, kind: F.max(F.when(F.col("input") == n, F.col(kind)))
    fields = literals.where("input in ('lora_name', 'strength_model', 'strength_clip')").groupBy("file_id", "node_id").agg(field("lora_name", "str").alias("raw"), field("strength_model", "num").alias("strength_model"), field("strength_clip", "num").alias("strength_clip"))
    plain = every.where("not power").join(fields, ["file_id", "node_id"], "left")
    both = plain.select("file_id", "stage_index", "node_id", "depth", F.lit("").alias("entry"), F.lit(0).alias("place"), "raw", "strength_model", "strength_clip", F.lit(True).alias("enabled")).where("raw is not null and raw <> ''")
    if entries is not None:
        # a loader with one strength uses it for both
        two = entries.select("file_id", "node_id", "entry", "place", F.col("lora").alias("raw"), F.col("strength").alias("strength_model"), F.coalesce("strength_two", "strength").alias("strength_clip"), F.col("on").alias("enabled"))
        both = both.unionByName(every.drop("power").join(two, ["file_id", "node_id"]))
    order = Window.partitionBy("file_id", "stage_index", "enabled").orderBy(F.desc("depth"), "node_id", "place")
    both = both.withColumn("position", F.when(F.col("enabled") & F.col("depth").isNotNull(), F.row_number().over(order) - 1))
    x = S.lora_base_step(S.model_stem("raw"))
    return both.select("file_id", "stage_index", "node_id", "entry", "position", S.model_stem("raw").alias("name"), x["base"].alias("base_name"), x["step"].alias("step"), "strength_model", "strength_clip", "enabled", F.col("stage_index").isNotNull().alias("reachable"))


# Text inputs of the encoders by output slot, the first with text wins; the least length of a guessed prompt.
TEXT_SLOTS = {"CLIPTextEncode": {0: ("text",)}, "CLIPTextEncodeFlux": {0: ("t5xxl", "clip_l")}, "TextEncodeQwenImage21": {0: ("prompt",), 1: ("negative_prompt",)}, "TextEncodeQwenImageEdit": {0: ("prompt",)}, "TextEncodeQwenImageEditPlus": {0: ("prompt",)}}
HEURISTIC_MIN_CHARS = 20
SIDE_INPUTS = {"positive": ("positive", "conditioning", "cond1", "cond2"), "negative": ("negative",)}
VISIT = "array<struct<src:string,slot:bigint>>"


def conditioning_walk(stages: DataFrame, nodes: DataFrame, edges: DataFrame, literals: DataFrame, inactive: DataFrame, side: str) -> DataFrame:
    """(file_id, stage_index, i, node_id, slot, kind): the nodes that a stage's conditioning comes from, in the order of
    a walk from the sampler (or its guider) that goes into each input, by name, before the next. kind: `encoder`,
    `zero`, `pass`; `guess` for a node of no known role with a long text of its own; `through` and `unknown` for others,
    with and without conditioning inputs to follow; `open` for a switch that chooses at run time."""
    links = sized(written(G.resolve_switches(edges, nodes, edges, inactive).select("file_id", "dst", "input", F.coalesce("past", "src").alias("src"), F.when(F.col("past").isNull(), -1).otherwise(F.col("past_slot")).alias("slot")), "links"))
    long_ = literals.where(F.length("str") >= HEURISTIC_MIN_CHARS).select("file_id", "node_id", F.lit(True).alias("long")).distinct()
    role = G.role_of()
    kinds = nodes.join(long_, ["file_id", "node_id"], "left").select("file_id", "node_id", F.when(role == "text_encoder", "encoder").when(role == "conditioning_zero", "zero").when(role == "conditioning_pass", "pass").when(F.col("long"), "guess").otherwise("through").alias("kind"))
    # the slot of a link matters at an encoder only: other nodes are visited once
    links = links.join(kinds.select("file_id", F.col("node_id").alias("src"), F.col("kind").alias("of")), ["file_id", "src"]).withColumn("slot", F.when((F.col("slot") < 0) | (F.col("of") == "encoder"), F.col("slot")).otherwise(F.lit(0)))
    inner = links.join(kinds.select("file_id", F.col("node_id").alias("dst"), "kind"), ["file_id", "dst"]).where(((F.col("kind") == "pass") & F.col("input").startswith("conditioning")) | ((F.col("kind") == "through") & F.col("input").contains("cond")))
    steps = lambda d, *keys: d.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("input", "src", "slot"))), lambda x: F.struct(x["src"].alias("src"), x["slot"].alias("slot"))).alias("to"))
    ways = steps(inner, "file_id", "dst").groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("dst", "to"))).alias("m"))
    direct = links.where(F.col("input") == side).join(stages.select("file_id", "stage_index", F.col("node_id").alias("dst")), ["file_id", "dst"])
    guided = edges.where("input = 'guider'").select("file_id", F.col("dst").alias("node_id"), F.col("src").alias("dst")).join(stages.select("file_id", "stage_index", "node_id"), ["file_id", "node_id"]).drop("node_id")
    guided = links.where(F.col("input").isin(*SIDE_INPUTS[side])).join(guided, ["file_id", "dst"]).join(direct.select("file_id", "stage_index").distinct(), ["file_id", "stage_index"], "left_anti")
    roots = steps(direct.unionByName(guided), "file_id", "stage_index").join(ways, "file_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast(f"map<string,{VISIT}>")))
    none = F.array().cast(VISIT)
    first = lambda s: F.get(s["stack"], 0)
    rest = lambda s: F.filter(s["stack"], lambda x, i: i > 0)
    onward = lambda s: F.when(first(s)["slot"] < 0, none).otherwise(F.coalesce(F.try_element_at("m", first(s)["src"]), none))
    state = lambda stack, out: F.struct(stack.alias("stack"), out.alias("out"))
    step = lambda s, _: F.when(F.size(s["stack"]) == 0, s).when(F.array_contains(s["out"], first(s)), state(rest(s), s["out"])).otherwise(state(F.concat(onward(s), rest(s)), F.concat(s["out"], F.array(first(s)))))
    rounds = F.size("to") + F.size(F.flatten(F.map_values("m")))  # each link leads somewhere once
    walked = roots.select("file_id", "stage_index", F.posexplode(F.aggregate(F.sequence(F.lit(1), rounds), state(F.col("to").cast(VISIT), none), step, lambda s: s["out"])).alias("i", "v")).select("file_id", "stage_index", "i", F.col("v.src").alias("node_id"), F.col("v.slot").alias("slot"))
    follows = inner.select("file_id", F.col("dst").alias("node_id"), F.lit(True).alias("follows")).distinct()
    named = walked.join(kinds, ["file_id", "node_id"]).join(follows, ["file_id", "node_id"], "left")
    kind = F.when(F.col("slot") < 0, "open").when((F.col("kind") == "through") & F.col("follows").isNull(), "unknown").otherwise(F.col("kind"))
    return named.select("file_id", "stage_index", "i", "node_id", "slot", kind.alias("kind"))


#: The inputs that hold texts, of encoders and of the nodes that make texts.
TEXT_INPUTS = sorted({f for slots in TEXT_SLOTS.values() for fs in slots.values() for f in fs} | {f for c, fs in G.NAME_INPUTS.items() if c in (*G.ROLES["string_source"], *G.ROLES["string_pass"], *G.ROLES["text_generator"]) for f in fs} | {"delimiter"})


def long_texts(literals: DataFrame) -> DataFrame:
    """(file_id, node_id): nodes with a text long enough to be taken for a prompt."""
    return literals.where(F.length("str") >= HEURISTIC_MIN_CHARS).select("file_id", "node_id").distinct()


def trace_prompts(stages: DataFrame, nodes: DataFrame, edges: DataFrame, literals: DataFrame, inactive: DataFrame, side: str, order: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(file_id, stage_index, prompt, encoders, guidance, encoder_guidance, warnings): the texts that a stage's
    conditioning comes from, not the empty ones, in graph order (order: topo_order()), joined by an empty line. Texts
    that are all empty, or a zeroed branch, give the empty prompt; no text gives null. guidance is that of the guidance
    node nearest the sampler; warnings are array<struct<code, node_id>>.

    The ways are those of graphs, the texts those of files. With same(file_id, same), see G.equal_graphs(), told apart by
    long_texts() too, the graphs, stages and order are of the files that stand for others; literals are all files'."""
    alike = stages.select("file_id", F.col("file_id").alias("same")).distinct() if same is None else same
    own = literals if same is None else G.standing(literals, same)
    # tables of their own: what follows reads the walk several times
    walk = sized(written(conditioning_walk(stages, nodes, edges, own, inactive, side), f"walk_{side}"))
    rank = order.where("rank >= 0").select("file_id", "node_id", "rank")
    every = nodes.sparkSession.createDataFrame([(c, s, i, f) for c, slots in TEXT_SLOTS.items() for s, fields in slots.items() for i, f in enumerate(fields)], "class_type string, slot long, place int, input string")
    met = walk.where("kind = 'encoder'").join(nodes.select("file_id", "node_id", "class_type"), ["file_id", "node_id"])
    slots = met.join(F.broadcast(every), ["class_type", "slot"], "left")
    asked = sized(written(slots.where("input is not null").select("file_id", "node_id", "input").distinct(), "asked"))
    past, texts = (written(x, "texts") for x in G.text_plans(asked, nodes, edges, inactive))
    fields = slots.where("input is not null").join(past, ["file_id", "node_id", "input"], "left").groupBy("file_id", "stage_index", "i", "node_id").agg(F.collect_list(F.struct("place", "input", "past")).alias("fields"))
    made = G.text_generators(past, texts).groupBy("file_id", "node_id").agg(F.collect_set("generator").alias("generators"))
    rows = walk.join(fields, ["file_id", "stage_index", "i", "node_id"], "left").join(rank, ["file_id", "node_id"], "left").join(made, ["file_id", "node_id"], "left").join(nodes.select("file_id", "node_id", "class_type"), ["file_id", "node_id"])
    items = rows.groupBy("file_id", "stage_index").agg(F.collect_list(F.struct("i", "node_id", "kind", "class_type", "rank", "fields", "generators")).alias("items"))
    plan = items.groupBy("file_id").agg(F.collect_list(F.struct("stage_index", "items")).alias("stages")).join(texts, "file_id", "left")
    plan = written(plan.withColumnRenamed("file_id", "same"), "plan")

    # the literals of a file that its texts and guidance may come from, beside the plan of its graph
    want = F.col("input").isin(TEXT_INPUTS) | ((F.col("input") == "guidance") & F.col("num").isNotNull())
    if walk.where("kind = 'guess'").head(1):
        want = want | (F.length("str") >= HEURISTIC_MIN_CHARS)
    held = literals.where(want).select("file_id", "node_id", "input", "str", "num")
    linked = written(edges.where("input = 'guidance'").join(nodes.where(G.role_of() == "primitive").select("file_id", F.col("node_id").alias("src")), ["file_id", "src"]).select("file_id", F.col("dst").alias("node_id"), "src"), "linked")
    if linked.head(1):
        level = G.spread(linked, alike)
        one = literals.where("num is not null").select("file_id", F.col("node_id").alias("src"), "num").join(level.select("file_id", "src").distinct(), ["file_id", "src"], "left_semi")
        one = one.groupBy("file_id", "src").agg(F.count("*").alias("n"), F.first("num").alias("num")).where("n = 1")
        held = held.unionByName(level.join(one, ["file_id", "src"]).select("file_id", "node_id", F.lit("guidance").alias("input"), F.lit(None).cast("string").alias("str"), "num"))
    lits = held.groupBy("file_id").agg(F.collect_list(F.struct("node_id", "input", "str", "num")).alias("lits"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    # most of the work, though the rows are small: the number of partitions is set, so that they are not put together
    dealt = alike.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id")
    files = dealt.join(few(plan), "same").join(lits, "file_id", "left").select("file_id", "stages", F.coalesce("t", none("struct<node_id:string,p:array<struct<i:int,input:string,past:string,linked:boolean>>,generator:boolean>")).alias("t"), F.coalesce("lits", none("struct<node_id:string,input:string,str:string,num:double>")).alias("lits"))
    each = files.withColumn("known", G.known_texts("t", "lits")).select("file_id", "lits", "known", F.inline("stages"))
    at = lambda n, more: F.filter(F.col("lits"), lambda l: (l["node_id"] == n) & more(l))
    # the first field with text, else the first that resolved
    field = lambda x: lambda f: F.struct(f["place"].alias("place"), F.coalesce(F.get(at(x["node_id"], lambda l: (l["input"] == f["input"]) & l["str"].isNotNull()), 0)["str"], F.try_element_at("known", f["past"])).alias("text"))
    told = lambda x: F.transform(F.filter(F.transform(x["fields"], field(x)), lambda f: f["text"].isNotNull()), lambda f: F.struct((F.trim(f["text"]) == "").alias("blank"), f["place"].alias("place"), f["text"].alias("text")))
    guess = lambda x: F.array_min(F.transform(at(x["node_id"], lambda l: F.length(l["str"]) >= HEURISTIC_MIN_CHARS), lambda l: F.struct((-F.length(l["str"])).alias("l"), l["input"].alias("input"), l["str"].alias("str"))))["str"]
    text = lambda x: F.when(x["kind"] == "encoder", F.array_min(told(x))["text"]).when(x["kind"] == "guess", guess(x))
    level = lambda x: F.array_min(F.transform(at(x["node_id"], lambda l: (l["input"] == "guidance") & l["num"].isNotNull()), lambda l: l["num"]))
    each = each.select("file_id", "stage_index", F.transform("items", lambda x: F.struct(*(x[c].alias(c) for c in ("i", "node_id", "kind", "class_type", "rank", "generators")), text(x).alias("text"), level(x).alias("g"))).alias("x"))

    of = lambda keep, value: F.transform(F.filter("x", keep), value)
    parts = lambda *names: lambda x: F.struct(*(x[n].alias(n) for n in names))
    encoder = lambda x: x["kind"] == "encoder"
    full = lambda x: x["text"].isNotNull() & (F.trim(x["text"]) != "")
    near = lambda kind, c: F.array_min(of(lambda x: (x["kind"] == kind) & (x["class_type"] == c) & x["g"].isNotNull(), parts("i", "g")))["g"]
    said = lambda code, node: F.struct(code.alias("code"), node.alias("node_id"))
    code = lambda x: F.when(x["kind"] == "guess", "HEURISTIC_PROMPT").when(x["kind"].isin("open", "unknown") | (encoder(x) & x["text"].isNull()), "PROMPT_UNRESOLVED")
    each = each.select(
        "file_id",
        "stage_index",
        F.array_sort(of(full, parts("rank", "i", "text"))).alias("t"),
        F.array_sort(of(encoder, parts("rank", "i", "node_id"))).alias("e"),
        F.exists("x", lambda x: x["text"].isNotNull() | (x["kind"] == "zero")).alias("any"),
        near("pass", "FluxGuidance").alias("guidance"),
        near("encoder", "CLIPTextEncodeFlux").alias("encoder_guidance"),
        F.array_distinct(F.concat(of(lambda x: code(x).isNotNull(), lambda x: said(code(x), x["node_id"])), F.flatten(of(lambda x: encoder(x) & x["generators"].isNotNull(), lambda x: F.transform(x["generators"], lambda g: said(F.lit("GENERATED_PROMPT"), g)))))).alias("w"),
    )
    several = F.when(F.size("t") > 1, F.array(F.struct(F.lit("MULTIPLE_PROMPT_SOURCES").alias("code"), F.lit(None).cast("string").alias("node_id")))).otherwise(none("struct<code:string,node_id:string>"))
    prompt = F.when(F.col("any"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"))
    return each.select("file_id", "stage_index", prompt.alias("prompt"), F.transform("e", lambda x: x["node_id"]).alias("encoders"), "guidance", "encoder_guidance", F.array_sort(F.concat("w", several)).alias("warnings"))


def guidance(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(file_id, stage_index, guidance) of two trace_prompts(): guidance nodes before encoders that have the input, the
    positive side before the negative."""
    two = positive.select("file_id", "stage_index", F.col("guidance").alias("p"), F.col("encoder_guidance").alias("pe")).join(negative.select("file_id", "stage_index", F.col("guidance").alias("n"), F.col("encoder_guidance").alias("ne")), ["file_id", "stage_index"], "full_outer")
    return two.select("file_id", "stage_index", F.coalesce("p", "n", "pe", "ne").alias("guidance")).where("guidance is not null")


def text_encoders(traces: DataFrame, nodes: DataFrame, edges: DataFrame, literals: DataFrame, inactive: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(file_id, stage_index, text_encoder, clip_type): the clip loaders behind the encoders, distinct stems joined by " + ".
    With same, see trace_prompts(), nodes and edges are those of the files that stand for others."""
    enc = (traces if same is None else G.standing(traces, same)).select("file_id", "stage_index", F.explode("encoders").alias("start"))
    clip = G.follow_input(enc.select("file_id", "start").distinct(), nodes, edges, inactive, "clip").join(nodes.where(G.role_of() == "clip_loader").select("file_id", "node_id"), ["file_id", "node_id"], "left_semi")
    ways = enc.join(clip, ["file_id", "start"]).groupBy("file_id", "stage_index").agg(F.collect_set(F.struct("start", "node_id")).alias("ways"))
    ways = ways if same is None else G.spread(ways, same)
    held = literals.where("input in ('clip_name', 'clip_name1', 'clip_name2', 'clip_name3', 'type')").groupBy("file_id").agg(F.collect_list(F.struct("node_id", "input", "str", S.model_stem("str").alias("stem"))).alias("lits"))
    at = lambda n, kind: F.filter(F.col("lits"), lambda l: (l["node_id"] == n) & ((l["input"] == "type") if kind else (l["input"] != "type")))
    names = F.flatten(F.transform("ways", lambda w: F.transform(at(w["node_id"], False), lambda l: F.struct(w["start"].alias("start"), l["input"].alias("input"), l["stem"].alias("stem")))))
    kinds = F.flatten(F.transform(F.filter("ways", lambda w: F.size(at(w["node_id"], False)) > 0), lambda w: F.transform(at(w["node_id"], True), lambda l: l["str"])))
    out = ways.join(held, "file_id").select("file_id", "stage_index", F.array_sort(names).alias("n"), F.array_min(kinds).alias("clip_type")).where(F.size("n") > 0)
    return out.select("file_id", "stage_index", F.array_join(F.array_distinct(F.transform("n", lambda x: x["stem"])), " + ").alias("text_encoder"), "clip_type")


def vae(outputs: DataFrame, nodes: DataFrame, edges: DataFrame, literals: DataFrame) -> DataFrame:
    """(file_id, vae): that of the decoder nearest an output, else of any loader."""
    decode = G.nearest_role(edges, nodes, outputs.select("file_id", F.col("node_id").alias("start")), "vae_decode").select("file_id", F.col("node_id").alias("dst"))
    near = decode.join(edges.where("input = 'vae'"), ["file_id", "dst"]).select("file_id", F.col("src").alias("node_id"), F.lit(0).alias("p"))
    every = nodes.where(G.role_of() == "vae_loader").select("file_id", "node_id", F.lit(1).alias("p"))
    name = literals.where("input = 'vae_name'").select("file_id", "node_id", S.model_stem("str").alias("vae"))
    return near.unionByName(every).join(name, ["file_id", "node_id"]).groupBy("file_id").agg(F.min_by("vae", F.struct("p", "node_id")).alias("vae"))


def latent_source(stages: DataFrame, nodes: DataFrame, edges: DataFrame, literals: DataFrame, inactive: DataFrame) -> DataFrame:
    """(file_id, latent_source, batch_size) of the primary stage."""
    first = stages.where("stage_index = 0").select("file_id", F.col("node_id").alias("dst"))
    past = G.resolve_switches(edges.where("input = 'latent_image'"), nodes, edges, inactive).join(first, ["file_id", "dst"], "left_semi").select("file_id", F.col("past").alias("node_id"))
    size = literals.where("input = 'batch_size'").select("file_id", "node_id", F.col("num").cast("bigint").alias("batch_size"))
    return past.join(nodes, ["file_id", "node_id"]).join(size, ["file_id", "node_id"], "left").select("file_id", F.col("class_type").alias("latent_source"), "batch_size")


def input_images(nodes: DataFrame, literals: DataFrame) -> DataFrame:
    """(file_id, node_id, filename, sha256): image inputs; the digest only where it is one."""
    one = nodes.where(G.role_of() == "image_input").select("file_id", "node_id").join(literals.where("input in ('image', 'sha256')"), ["file_id", "node_id"])
    return one.groupBy("file_id", "node_id").agg(F.max(F.when(F.col("input") == "image", F.col("str"))).alias("filename"), F.max(F.when((F.col("input") == "sha256") & F.col("str").rlike("^[0-9a-fA-F]{64}$"), F.lower("str"))).alias("sha256"))


def collapse_adjacent(df: DataFrame, partition: list[str], order: str, column: str) -> DataFrame:
    """df without rows whose column equals that of the row before."""
    before = F.lag(column).over(Window.partitionBy(*partition).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*partition).orderBy(order)) == 1
    return df.withColumn("__keep", first | ~before.eqNullSafe(F.col(column))).where("__keep").drop("__keep")


def pipeline_family(stages: DataFrame) -> DataFrame:
    """(file_id, model_family): known families of the stages in order, neighbouring repeats once, joined by " + "."""
    once = collapse_adjacent(stages.where("family is not null"), ["file_id"], "stage_index", "family")
    return once.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage_index", "family"))), lambda x: x["family"]), " + ").alias("model_family"))


def generator_prompt(nodes: DataFrame, edges: DataFrame, literals: DataFrame, inactive: DataFrame) -> DataFrame:
    """(file_id, prompt): of the nodes that make the image themselves, in files without a sampler."""
    own = nodes.join(nodes.where(G.role_of() == "sampler"), "file_id", "left_anti").where(G.role_of() == "generator").select("file_id", "node_id", F.lit("prompt").alias("input"))
    return G.resolve_strings(own, nodes, edges, literals, inactive).where("text is not null").groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "\n\n").alias("prompt"))


def lora_stack_key(loras: DataFrame, decimals: int = 2) -> DataFrame:
    """(file_id, stage_index, lora_stack_key): name@strength in order of position; loras(..., enabled, reachable)."""
    one = F.concat(F.col("name"), F.lit("@"), F.coalesce(F.format_string(f"%.{decimals}f", F.bround("strength_model", decimals)), F.lit("?")))
    used = loras.where("reachable and enabled").groupBy("file_id", "stage_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", one.alias("k")))), lambda x: x["k"]), " + ").alias("k"))
    return used.withColumnRenamed("k", "lora_stack_key")


def generation_key(graph_map: Column) -> Column:
    """16 digits over a graph's canonical form: entries of a map<string,string> in key order."""
    entries = F.array_sort(F.map_entries(graph_map))
    return F.substring(F.md5(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("\x1f"), e["value"])), "\x1e")), 1, 16)


def canonical_graphs(prompts: DataFrame) -> DataFrame:
    """(file_id, generation_key) of prompts(file_id, prompt_json): over the whole graph, literals and all. A parsed
    document keeps the fields of an object in the order of their names, so written again it is canonical."""
    return prompts.select("file_id", F.substring(F.md5(F.to_json(F.try_parse_json("prompt_json"))), 1, 16).alias("generation_key"))


def stage_prompts(traces: DataFrame) -> DataFrame:
    """(file_id, stage_prompts): prompts of later stages that differ from the first's, not blank, each once in order."""
    first = traces.where("stage_index = 0").select("file_id", F.col("prompt").alias("base"))
    later = traces.where("stage_index > 0").join(first, "file_id", "left").where("trim(prompt) <> '' and not (prompt <=> base)")
    once = later.groupBy("file_id", "prompt").agg(F.min("stage_index").alias("i"))
    return once.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "prompt"))), lambda x: x["prompt"]), "\n\n").alias("stage_prompts"))


def generations(settings: DataFrame, chains: DataFrame, positive: DataFrame, negative: DataFrame, encoders: DataFrame, vaes: DataFrame, latents: DataFrame, stacks: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each file, from its primary stage."""
    key = ["file_id", "stage_index"]
    classes = nodes.groupBy("file_id").agg(F.collect_set("class_type").alias("classes"))
    count = settings.groupBy("file_id").agg(F.count("*").alias("stage_count"))
    out = settings.where("stage_index = 0").join(chains, key, "left").join(positive.select(*key, F.col("prompt").alias("positive_prompt")), key, "left").join(negative.select(*key, F.col("prompt").alias("negative_prompt")), key, "left")
    out = out.join(encoders, key, "left").join(stacks, key, "left").join(vaes, "file_id", "left").join(latents, "file_id", "left").join(classes, "file_id").join(count, "file_id")
    family = match_family(F.col("loader_kind"), F.col("base_model"), F.col("clip_type"), F.col("classes"))
    return out.select("file_id", family.alias("model_family"), "base_model", "text_encoder", "clip_type", "vae", "seed", "steps", "cfg", "sampler_name", "scheduler", "denoise", "shift", "stage_count", "latent_source", "batch_size", "positive_prompt", "negative_prompt", F.coalesce("lora_stack_key", F.lit("(none)")).alias("lora_stack_key"))


def extraction_errors(edges: DataFrame) -> DataFrame:
    """(file_id, code, node_id, message): files whose graph cannot be ordered; the others go on."""
    return G.cyclic(edges).select("file_id", F.lit("GRAPH_CYCLE").alias("code"), F.lit(None).cast("string").alias("node_id"), F.concat(F.lit("cycle among "), F.col("stuck")).alias("message"))


def collect_warnings(*parts: DataFrame) -> DataFrame:
    """(file_id, code, node_id, message) of all parts, each once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()


def _warned(rows: DataFrame, code: str, message: Column | str, node: Column | None = None) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select("file_id", F.lit(code).alias("code"), (F.lit(None).cast("string") if node is None else node).alias("node_id"), text.alias("message"))


def unused_lora_warnings(uses: DataFrame) -> DataFrame:
    """One for each LoRA node on no stage's chain."""
    return _warned(uses.where("not reachable").select("file_id", "node_id").distinct(), "UNUSED_LORA", "LoRA loaded but not connected to any sampler", F.col("node_id"))


def graph_warnings(nodes: DataFrame, edges: DataFrame, stages: DataFrame) -> DataFrame:
    """(file_id, code, node_id, message): graphs without an output, with outputs of different samplers, without a sampler."""
    files, roots = nodes.select("file_id").distinct(), G.graph_roots(nodes, edges)
    outputs = roots.where("kind = 'output'")
    bare = files.join(outputs, "file_id", "left_anti")
    near = G.nearest_by_output(nodes, edges, outputs)
    parts = [_warned(bare, "NO_OUTPUT_NODE", "no output node found; samplers used as roots"), _warned(G.multiple_branches(near).where("multi"), "MULTIPLE_OUTPUT_BRANCHES", "output nodes lead back to different samplers"), _warned(files.join(stages, "file_id", "left_anti"), "NO_SAMPLER", "no reachable sampler node")]
    return collect_warnings(*parts)


def chain_warnings(stages: DataFrame, chain: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, code, node_id, message): nodes of no known role that pass a model on; chains that end before a loader."""
    on = edges.where("input = 'model'").select("file_id", F.col("dst").alias("node_id")).distinct()
    known = F.coalesce(F.col("role").isin("lora", "model_patch", "model_loader", "switch"), F.lit(False))
    patches = chain.where(~known).join(on, ["file_id", "node_id"], "left_semi")
    ends = chain.groupBy("file_id", "stage_index").agg(F.bool_or(F.coalesce(F.col("role") == "model_loader", F.lit(False))).alias("whole"), F.max_by("node_id", "depth").alias("last"))
    broken = stages.select("file_id", "stage_index", "node_id").join(ends, ["file_id", "stage_index"], "left").where("not coalesce(whole, false)")
    return collect_warnings(_warned(patches, "UNKNOWN_MODEL_PATCH", F.concat("class_type", F.lit(" passes the model on")), F.col("node_id")), _warned(broken, "MODEL_CHAIN_BROKEN", "model chain ends before a model loader", F.coalesce("last", "node_id")))


#: What the codes of prompt texts mean.
PROMPT_MESSAGES = {
    "PROMPT_UNRESOLVED": "no text was found behind the prompt input",
    "MULTIPLE_PROMPT_SOURCES": "texts of several encoders are joined",
    "HEURISTIC_PROMPT": "the node is of no known class; its text was taken for the prompt",
    "GENERATED_PROMPT": "a text generator wrote part of the prompt at run time",
}


def prompt_warnings(*traces: DataFrame) -> DataFrame:
    """(file_id, code, node_id, message) of trace_prompts()."""
    said = F.create_map(*[F.lit(x) for kv in PROMPT_MESSAGES.items() for x in kv])
    rows = [t.select("file_id", F.explode("warnings").alias("w")).select("file_id", "w.code", "w.node_id", F.coalesce(F.try_element_at(said, F.col("w.code")), F.lit("")).alias("message")) for t in traces]
    return collect_warnings(*rows)


def inspect_documents(files: DataFrame, gens: DataFrame, nodes: DataFrame, warnings: DataFrame) -> DataFrame:
    """(file_id, document): one file as JSON: facts, extraction, nodes in order, warnings."""
    n = nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "class_type"))).alias("nodes"))
    w = warnings.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("code", "node_id"))).alias("warnings"))
    facts = files.select(F.col("id").alias("file_id"), F.struct(*[c for c in files.columns if c != "id"]).alias("file"))
    g = gens.select("file_id", F.struct(*[c for c in gens.columns if c != "file_id"]).alias("extraction"))
    return facts.join(g, "file_id", "left").join(n, "file_id", "left").join(w, "file_id", "left").select("file_id", F.to_json(F.struct("file", "extraction", "nodes", "warnings")).alias("document"))

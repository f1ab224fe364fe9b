"""Cases with known answers for the library's own operators."""

from pyspark.sql import functions as F

from imprynt.functions import scalars as S
from imprynt.functions import text as X
from imprynt.operators import compare, graph, scope, stats
from imprynt.sources import files
from imprynt.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numeric_profile(spark):
    df = spark.createDataFrame([("g", v) for v in (20.0, 20.0, 30.0, 30.0, 30.0, None, float("nan"))], "group string, v double")
    r = stats.numeric_stats(df, ["v"]).first()
    assert (r["n"], r["n_missing"], r["median"], round(r["std"], 3)) == (5, 2, 30.0, 5.477)
    m = stats.modes(df, ["v"]).first()
    assert m["mode"] == [30.0] and m["share"] == 0.6 and not m["tied"]


def test_burst_of_copies(spark):
    rows = spark.createDataFrame([(i, i * 100, f"k{i}") for i in range(30)] + [(99, 10**6, "k")], "id long, t long, key string")
    got = stats.burst_clusters(rows, 2000, 10).collect()
    assert [(r["files"], r["distinct"], r["start"], r["end"]) for r in got] == [(30, 30, 0, 2900)]


def test_bursts_do_not_depend_on_blocks(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 100_000, f"k{i % 40}") for i in range(2000)], "id long, t long, key string")
    many = sorted(map(tuple, stats.burst_clusters(rows, 300, 7, 1000).collect()))
    assert many == sorted(map(tuple, stats.burst_clusters(rows, 300, 7, 10**9).collect())) and many


def test_resolve_counts(spark):
    rows = spark.createDataFrame([(1, "a", True, "f"), (2, "a", True, "f"), (3, "", True, "f"), (4, "", True, None), (5, "b", False, None)], "id long, content_hash string, has_generation boolean, model_family string")
    kept, info = scope.resolve(rows)
    assert tuple(info.first()) == (5, 1, 1, 3) and {r["id"] for r in kept.collect()} == {1, 3, 4}


def test_scalars(spark):
    assert one(spark, S.model_stem(F.lit("a\\b/c.SafeTensors"))) == "c"
    assert tuple(one(spark, S.lora_base_step(F.lit("foo_000004956")))) == ("foo", 4956)
    assert tuple(one(spark, S.aspect(F.lit(1920), F.lit(1080)))) == (1.778, "16:9")
    assert one(spark, S.prompt_ws(F.lit(" a\r\n\tb  c "))) == "a\n b c"
    assert [tuple(r) for r in one(spark, S.lora_tags(F.lit("<lora:a> <lora:b:0.5:0.7> <lyco:c:te=0.2:unet=0.9>")))] == [("a", 1.0, 1.0), ("b", 0.7, 0.5), ("c", 0.9, 0.2)]
    assert str(one(spark, S.seed_number(F.lit("18446744073709551615")))) == "18446744073709551615" and one(spark, S.seed_number(F.lit("x"))) is None


def test_prompt_text(spark):
    assert one(spark, X.normalize_prompt(F.lit("A ((red:1.2) fox:1.1) <lora:x:1> \\(so\\)"))) == "a red fox  (so)"
    assert one(spark, X.sentences(F.lit("one. two!\n\nthree; four 1.5"))) == ["one", "two", "three", "four 1.5"]
    assert one(spark, X.tokens(F.lit("it's 東京都 a-b"))) == ["it's", "東京", "京都", "a-b"]
    df = spark.createDataFrame([(1, "the red fox, 12 34, a fox of the snow")], "k int, s string")
    got = {(r["kind"], r["term"]) for r in X.units(df, "s", ["k"]).collect()}
    assert ("phrase", "red fox") in got and ("phrase", "fox of the snow") in got and ("2g", "red fox") in got
    assert not any(t in ("12", "12 34", "the red") for _, t in got)
    wide = X.nfkc(spark.createDataFrame([(1, "ｆｏｘ"), (2, "fox"), (3, None)], "k int, s string"), "s")
    assert {r["k"]: r["s"] for r in wide.collect()} == {1: "fox", 2: "fox", 3: None}


def graph_tables(spark, edges, classes):
    e = spark.createDataFrame([(1, d, i, s) for d, i, s in edges], "file_id long, dst string, input string, src string")
    return spark.createDataFrame([(1, n, c) for n, c in classes.items()], "file_id long, node_id string, class_type string"), e


def test_graph_walks_end_on_cycles(spark):
    n, e = graph_tables(spark, [("9", "images", "3"), ("3", "model", "2"), ("2", "model", "1"), ("1", "model", "2"), ("7", "model", "1")], {"9": "SaveImage", "3": "KSampler", "2": "LoraLoader", "1": "UNETLoader", "7": "LoraLoader"})
    roots = graph.graph_roots(n, e)
    got = graph.reachable(e, roots)
    assert {r["node_id"] for r in got.collect()} == {"9", "3", "2", "1"}
    assert graph.cyclic(e).first()["stuck"] == "1,2,3,7,9" or "1" in graph.cyclic(e).first()["stuck"]
    assert graph.topo_order(e, got).first()["error"] == "1,2,3,9"
    assert [r["node_id"] for r in graph.cleanup_plan(n, e, got).collect()] == ["7"]


def test_soft_switch_falls_back(spark):
    n, e = graph_tables(spark, [("5", "on_false", "1"), ("6", "model", "5")], {"5": "ComfySoftSwitchNode", "1": "UNETLoader", "6": "KSampler"})
    lit = spark.createDataFrame([(1, "5", "switch", None, None, True)], "file_id long, node_id string, input string, str string, num double, bool boolean")
    assert [r["input"] for r in graph.inactive_inputs(n, e, lit).collect()] == ["on_true"]


def test_word_diff(spark):
    df = spark.createDataFrame([("a b c d", "a x c d")], "a string, b string")
    ops = [(o["op"], o["a"], o["b"]) for o in compare.word_diff(df, "a", "b").first()["ops"]]
    assert ops == [("same", "a ", "a "), ("removed", "b", ""), ("added", "", "x"), ("same", " c d", " c d")]
    assert [o["op"] for o in compare.word_diff(df, "a", "b", 0).first()["ops"]] == ["same", "removed", "added", "same"]


def test_image_texts(spark):
    import struct
    import zlib

    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 640, 480) + b"\x08\x02\0\0\0") + chunk(b"tEXt", b"a\0one") + chunk(b"zTXt", b"a\0\0" + zlib.compress(b"two")) + chunk(b"iTXt", "b\0\0\0\0\0drei ö".encode()) + b"\0\0\1\0tEXtcut"
    jpeg = b"\xff\xd8\xff\xfe" + struct.pack(">H", 9) + b"comment" + b"\xff\xd9"
    df = spark.createDataFrame([("p", bytearray(png)), ("j", bytearray(jpeg)), ("x", None)], "file_id string, content binary")
    got = {(r["file_id"], r["key"]): r["text"] for r in files.extract_texts(df).collect()}
    assert got == {("p", "a"): "one", ("p", "a#2"): "two", ("p", "b"): "drei ö", ("p", None): None, ("j", "Comment"): "comment"}
    assert [tuple(r) for r in files.with_image_header(df).select("format", "width", "height").collect()] == [("png", 640, 480), ("jpeg", None, None), (None, None, None)]


def test_blob_kinds(spark):
    node = '{"class_type": "KSampler", "inputs": {"cfg": NaN}}'
    rows = [("1", "prompt", f'{{"1": {node}}}'), ("2", "workflow", f'{{"1": {node}}}'), ("3", "workflow", '{"nodes": [], "links": []}'), ("4", "parameters", "fox\nSteps: 20, Sampler: x"), ("5", "x", "plain"), ("6", "x", '{"a": 1}')]
    got = {r["file_id"]: (r["kind"], r["mismatch"]) for r in files.classify_blobs(spark.createDataFrame(rows, "file_id string, key string, text string")).collect()}
    assert got == {"1": ("api_prompt", False), "2": ("api_prompt", True), "3": ("workflow", False), "4": ("a1111", False), "5": ("text", False), "6": ("json", False)}


def test_scan_and_watch(spark, tmp_path):
    for name in ("a/x.png", "a/y.txt", "b/z.JPG"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"123")
    assert {(r["rel_path"], r["size"]) for r in files.scan_library(spark, str(tmp_path)).collect()} == {("a/x.png", 3), ("b/z.JPG", 3)}
    run = watch.watch_source(spark, str(tmp_path)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("seen").count() == 2


def test_stream_of_batches_equals_one_batch(spark, tmp_path):
    schema = "id long, seq long, value string"
    rows = [(i % 10, i, f"v{i}") for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = watch.watch_table(spark, str(tmp_path / "in"), schema, 1)
    run = watch.index_stream(source, str(tmp_path / "catalog"), "id", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["id"]: r["value"] for r in spark.read.parquet(str(tmp_path / "catalog" / "v4")).collect()}
    assert got.keys() == set(range(10)) and set(got.values()) <= {r[2] for r in rows}


def test_page_after_continues_a_page(spark):
    df = spark.createDataFrame([(i, f"p{i}", None if i == 3 else i % 4) for i in range(12)], "id long, rel_path string, steps int")
    from imprynt.operators import listing

    first = listing.page(df, "steps", True, 0, 5).orderBy("place").collect()
    rest = listing.page_after(df, "steps", True, first[-1]["steps"], first[-1]["id"], 50).collect()
    assert [r["id"] for r in first] + [r["id"] for r in rest] == [11, 7, 10, 6, 2, 9, 5, 1, 8, 4, 0]


def test_levels_and_cycles_of_large_graphs_once_for_each_graph(spark):
    """20,000 links in seconds; files with the same graph are one call."""
    import time

    from imprynt.operators import graph

    n = 10_000
    links = [(1, str(i + 1), str(i)) for i in range(n - 1)] + [(1, str(i + 2), str(i)) for i in range(n - 2)]
    edges = spark.createDataFrame(links, "file_id long, dst string, src string")
    nodes = spark.range(n).selectExpr("1L as file_id", "string(id) as node_id")
    began = time.time()
    levels = {r["node_id"]: r["level"] for r in graph.levels(edges, nodes).collect()}
    assert levels == {str(i): i for i in range(n)} and graph.cyclic(edges).count() == 0
    ring = edges.unionByName(spark.createDataFrame([(1, "5000", "9999")], "file_id long, dst string, src string"))
    assert len(graph.cyclic(ring).first()["stuck"].split(",")) == n - 5000
    assert graph.levels(ring, nodes).where("level is null").count() == n - 5000
    assert time.time() - began < 60
    many = spark.range(300).selectExpr("id as file_id", "explode(array(struct('b' as dst, 'a' as src), struct('c' as dst, string(if(id % 3 = 0, 'a', 'b')) as src))) as x").select("file_id", "x.*")
    graphs = graph._graphs(many, None)
    assert graph.ordered_once(graphs).count() == 2
    each = {(r["file_id"], r["node_id"]): r["level"] for r in graph.levels(many, many.selectExpr("file_id", "explode(array('a', 'b', 'c')) as node_id")).collect()}
    assert len(each) == 900 and {each[i, "c"] for i in range(0, 300, 3)} == {1} and {each[i, "c"] for i in range(1, 300, 3)} == {2}


def test_quantiles_of_heavy_tails_and_odd_values(spark):
    """Split until small: no task orders more than `largest` values, and the result is exact."""
    import numpy as np

    from imprynt.operators import stats

    rnd = np.random.default_rng(3)
    groups = {"tail": rnd.pareto(1.1, 20_000) + 1, "both": np.concatenate([-(rnd.pareto(0.5, 4000)), rnd.pareto(0.3, 4001)]), "tiny": np.concatenate([rnd.random(500) * 1e-300, [1e300, -1e300]]), "near": 1e15 + rnd.integers(0, 3000, 3000), "one": np.array([2.5]), "same": np.full(50, -7.0)}
    values = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), (None, 1.0), (None, 2.0)], "g string, v double")
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    for largest, cells in ((stats.LARGEST_CELL, stats.CELLS), (40, 16)):
        got = {r["g"]: r["q"] for r in stats.quantiles(values, ["g"], "v", shares, largest, cells).collect()}
        assert set(got) == {*groups, None} and got[None] == [1.0, 1.25, 1.5, 1.75, 2.0]
        for g, xs in groups.items():
            xs = np.sort(xs)
            at = [q * (len(xs) - 1) for q in shares]
            want = [xs[int(r)] + (xs[min(int(r) + 1, len(xs) - 1)] - xs[int(r)]) * (r - int(r)) for r in at]
            assert np.allclose(got[g], want, rtol=1e-12, atol=0), g


def test_difflib_clusters_are_those_of_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    from imprynt.operators import prompts as T

    rnd = random.Random(2)
    words = "a red fox in the snow under an old oak by night".split()
    texts = [" ".join(rnd.sample(words, 6)) + "." for _ in range(25)] + ["A quick Fox jumps over it.", "a quick fox jumped over it."] + ["x" * 250 + " tail one.", "x" * 250 + " tail two."]
    frames = T.build_frames(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "file_id long, positive_prompt string, negative_prompt string"))
    weighted = frames.texts.selectExpr("'g' as group", "key", "1L as w")
    got = {}
    for r in T.sentence_clusters(frames, weighted, 0.7, top=100, metric="difflib").collect():
        got.setdefault(r["cluster"], set()).add(r["sentence"])
    own = sorted({r["sentence"] for r in frames.sentences.collect()})
    top = {s: s for s in own}
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if SequenceMatcher(None, a.casefold(), b.casefold()).ratio() >= 0.7:
                x, y = top[a], top[b]
                top = {k: min(x, y) if v in (x, y) else v for k, v in top.items()}
    want = {}
    for s, t in top.items():
        want.setdefault(t, set()).add(s)
    assert got == {k: v for k, v in want.items() if len(v) > 1}


def test_entries_follow_the_document(spark):
    from imprynt.operators import graph

    entry = '{"on": true, "lora": "x", "strength": 1}'
    text = '{"1": {"inputs": {"lora_b": %s, "z": 1, "Lora_a": %s, "lora_10": %s, "lora_9": %s}, "class_type": "Power Lora Loader (rgthree)"}, "2": {"class_type": "KSampler"}}' % (entry, entry, entry, entry)
    prompts = spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "file_id long, prompt_json string")
    rows = graph.power_entries(graph.graph_nodes(prompts), graph.field_order(prompts)).orderBy("place").collect()
    assert [r["entry"] for r in rows] == ["lora_b", "Lora_a", "lora_10", "lora_9"]
    assert [r["entry"] for r in graph.power_entries(graph.graph_nodes(prompts)).orderBy("place").collect()] == ["Lora_a", "lora_b", "lora_9", "lora_10"]


def test_coarse_differences_are_told(spark):
    df = spark.createDataFrame([("x a b c y", "x d e f y"), ("same", "same"), (None, "z")], "a string, b string")
    assert [r["coarse"] for r in compare.word_diff(df, "a", "b", 4).collect()] == [True, False, False]
    assert not any(r["coarse"] for r in compare.word_diff(df, "a", "b").collect())


def test_units_of_a_prompt_stay_in_its_row(spark):
    from imprynt.operators import prompts as T

    texts = ["the red fox. a red fox, snow; 12 34.", "The red  fox. a red fox, snow; 12 34.", "snow. red fox"]
    frames = T.build_frames(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "file_id long, positive_prompt string, negative_prompt string"))
    weighted = frames.texts.selectExpr("'g' as group", "key", "2L as w")
    counts = T.unit_counts(frames, weighted)
    by_sentence = frames.units.select("key", "kind", "term").distinct().join(weighted, "key").groupBy("group", "kind", "term").sum("w")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, by_sentence.collect()))
    assert "keys=[key" not in counts._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    snow = T.unit_counts(frames, weighted, spark.createDataFrame([("g", "a red fox, snow")], "group string, sentence string"))
    assert {r["term"]: r["df"] for r in snow.where("kind = '1g'").collect()}["snow"] == 2 and counts.where("kind = '1g' and term = 'snow'").first()["df"] == 6


def test_frames_are_written_when_asked_for(spark, sf):
    from imprynt.plans.q_text import keyed
    from imprynt.sources.tables import _STAGED

    names = lambda: {k[3] for k in _STAGED if str(k[3]).startswith("frames_")}
    before = names()
    keyed(spark, sf)
    assert "frames_units" not in names() and names() - before <= {"frames_files"}

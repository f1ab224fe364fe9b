"""Graph and comparison operators on shapes that the benchmark tables do not have, against plain versions."""

import random

from imprynt.operators import compare
from imprynt.operators import extraction as E
from imprynt.operators import graph as G

NODE, EDGE, LITERAL = "file_id long, node_id string, class_type string", "file_id long, dst string, input string, src string, slot long", "file_id long, node_id string, input string, str string, num double, bool boolean"


def tables(spark, nodes, edges, literals):
    return spark.createDataFrame([(1, n, c) for n, c in nodes], NODE), spark.createDataFrame([(1, *e) for e in edges], EDGE), spark.createDataFrame([(1, *x) for x in literals], LITERAL)


def none(spark):
    return spark.createDataFrame([], "file_id long, node_id string, input string")


def test_texts_are_followed_for_eight_nodes(spark):
    chain = [(f"p{i}", "PreviewAny") for i in range(9)]
    links = [(f"p{i}", "source", f"p{i + 1}", 0) for i in range(7)] + [("e", "text", "p0", 0), ("far", "text", "q", 0), ("q", "source", "p0", 0)]
    n, e, l = tables(spark, [*chain, ("q", "PreviewAny"), ("e", "CLIPTextEncode"), ("far", "CLIPTextEncode")], links, [("p7", "source", "deep", None, None)])
    want = spark.createDataFrame([(1, "e", "text"), (1, "far", "text")], "file_id long, node_id string, input string")
    assert {r["node_id"]: r["text"] for r in G.resolve_strings(want, n, e, l, none(spark)).collect()} == {"e": "deep", "far": None}


def test_guidance_slots_and_switches_along_conditioning(spark):
    nodes = [("k", "KSampler"), ("c", "ConditioningCombine"), ("g", "FluxGuidance"), ("h", "FluxGuidance"), ("q", "TextEncodeQwenImage21"), ("w", "ComfySwitchNode"), ("x", "ComfySwitchNode"), ("s", "SaveImage")]
    links = [("k", "positive", "c", 0), ("c", "conditioning_1", "g", 0), ("c", "conditioning_2", "h", 0), ("g", "conditioning", "w", 0), ("h", "conditioning", "q", 0), ("w", "on_true", "q", 1), ("w", "on_false", "q", 0), ("k", "negative", "x", 0), ("x", "on_true", "q", 0), ("x", "on_false", "q", 1), ("s", "images", "k", 0)]
    n, e, l = tables(spark, nodes, links, [("g", "guidance", None, 2.0, None), ("h", "guidance", None, 9.0, None), ("q", "prompt", "yes", None, None), ("q", "negative_prompt", "no", None, None), ("w", "switch", None, None, True)])
    off = G.inactive_inputs(n, e, l)
    order = G.topo_order(e, G.reachable(e, G.graph_roots(n, e), off))
    stages = E.sampler_stages(n, order)
    pos, neg = (E.trace_prompts(stages, n, e, l, off, side, order) for side in ("positive", "negative"))
    p, q = pos.first(), neg.first()
    assert p["prompt"].split("\n\n") == ["no", "yes"] and p["guidance"] == 2.0 and p["encoders"] == ["q", "q"]
    assert [w["code"] for w in p["warnings"]] == ["MULTIPLE_PROMPT_SOURCES"] and q["prompt"] is None and [tuple(w) for w in q["warnings"]] == [("PROMPT_UNRESOLVED", "x")]
    assert E.guidance(pos, neg).first()["guidance"] == 2.0


def test_walks_end_on_cycles_and_long_chains(spark):
    nodes = [(str(i), "X") for i in range(60)] + [("s", "SaveImage")]
    links = [(str(i), "a", str(i + 1), 0) for i in range(59)] + [("59", "b", "0", 0), ("s", "images", "0", 0)]
    n, e, _ = tables(spark, nodes, links, [])
    assert G.reachable(e, G.graph_roots(n, e)).count() == 61 and G.cyclic(e).first()["stuck"].count(",") == 60
    assert G.topo_order(e, G.reachable(e, G.graph_roots(n, e))).first()["rank"] == -1


def test_word_differences_are_longest_common_subsequences():
    rnd = random.Random(3)

    def longest(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = (" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(9))) for _ in range(2))
        ops = compare.diff_runs(a, b, 10**6)
        assert "".join(o["a"] for o in ops) == a and "".join(o["b"] for o in ops) == b
        assert all(x["op"] != y["op"] for x, y in zip(ops, ops[1:], strict=False))
        words = lambda t: [w if w.strip() else " " for w in compare.regex.findall(compare.TOKENS, t)]
        assert sum(len(words(o["a"])) for o in ops if o["op"] == "same") == longest(words(a), words(b))
    assert compare.diff_runs("a  b", "a\nb", 9) == [{"op": "same", "a": "a  b", "b": "a\nb"}]
    assert [o["op"] for o in compare.diff_runs("x a b c y", "x d e f y", 4)] == ["same", "removed", "added", "same"]

"""Results that once went through one task or the driver."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from imprynt.operators import stats
from imprynt.plans.fixtures import view
from imprynt.sources import tables
from imprynt.sources.tables import BROADCAST_ROWS, staged


def test_streams_end_in_files(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    live, users = (entry.queries()[n](spark, sf) for n in ("st04_live_counts", "st06_dedupe_stream"))
    assert live.inputFiles() and users.inputFiles()
    assert sum(r["count"] for r in live.collect()) == events.count()
    assert sorted(r[0] for r in users.collect()) == sorted(r[0] for r in events.select("user_id").distinct().collect())


def test_bursts_sort_times_within_blocks_only(spark):
    rows = spark.range(4000).selectExpr("id", "id * 37 % 9000 + cast(id / 1000 as long) * 30000 as t", "id % 50 as key")
    one, many = (stats.burst_clusters(rows, 300, 7, block) for block in (10**9, 700))
    assert "windowspecdefinition(t#" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect())) and many.count() > 1


def test_many_rows_in_small_files_are_not_broadcast(spark, sf):
    made = lambda n: staged(spark, sf, f"of_{n}", lambda: spark.range(n).selectExpr("id div 20 as file_id", "'8' as node_id"))
    files = spark.range(50).selectExpr("id as file_id")
    plan = lambda n: files.join(made(n), "file_id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(2 * BROADCAST_ROWS) and "Broadcast" in plan(100)


def test_prompts_are_put_together_by_one_shuffle(spark, sf):
    from imprynt.plans.q_graph import _api_json

    plan = _api_json(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_views_do_not_broadcast_what_they_group(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 1000)
    plan = lambda: view(spark, sf, "v_edges")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan() and "SortMergeJoin" in plan()
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 10**9)
    assert "BroadcastHashJoin" in plan()


def test_cleanup_joins_by_file(spark, sf):
    made = entry.queries()["g13_switched_off"](spark, sf)
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    both = [x for x in plan if "Join" in x and x.count("file_id#") > 1 and x.count("node_id#") > 1]
    assert len(both) == 1, both  # entries without those of planned nodes; all else is joined by file


def test_texts_are_taken_apart_once(spark, sf):
    from imprynt.operators import prompts as T
    from imprynt.plans import q_text

    of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert of(T.prompt_files(view(spark, sf, "v_prompts"))).count("md5(") == 1
    texts = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as key", "text")
    assert of(T.split_texts(texts)).count("array_distinct(") == 2  # of texts to be put in form NFKC, and of others
    assert of(entry.queries()["f12_tokens"](spark, sf)).count("regexp_extract_all(") == 1
    f = q_text.frames(spark, sf)
    made = T.sentence_clusters(f, q_text.weighted(spark, sf), metric="difflib")
    assert not [p for p in made.inputFiles() if "frames_split" in p]  # the candidates are a table of their own


def test_only_texts_that_form_nfkc_changes_are_odd(spark):
    import unicodedata

    from imprynt.functions.text import ODD

    every = [*range(0x200), 0x1100, 0x2028, 0x3042, 0xAC00, 0xFB01, 0xFF41, 0x1D400, 0x1F600, 0x10FFFF]
    told = spark.createDataFrame([(c, "ab" + chr(c)) for c in every], "c int, t string").select("c", F.col("t").rlike(ODD).alias("odd")).collect()
    kept = {r["c"] for r in told if not r["odd"]}
    assert len(kept) == 160 + 186 and max(kept) < 0x180 and all(unicodedata.normalize("NFKC", chr(c)) == chr(c) for c in kept)


def test_prompt_keys_of_white_space(spark):
    from imprynt.functions import scalars as S

    rows = [("",), (" \t\r\n\x0b\f ",), (None,), ("\ta\t b  c\r\rd \r\n e\t",), ("\u00a0",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(S.prompt_ws("t"), S.prompt_key("t").isNull()).collect()]
    assert got == [("", True), ("", True), (None, True), ("a b c\n\nd \n e", False), ("\u00a0", False)]


def test_keyed_files_hold_empty_and_missing_prompts(spark, sf, tmp_path):
    import os

    import duckdb

    from imprynt.functions import scalars as S

    for name in os.listdir(sf):
        if name != "documents.parquet":
            os.symlink(f"{sf}/{name}", tmp_path / name)
    # empty, missing, in no group, twice under one id, without an id
    odd = "(-1, '', 'en'), (-2, ' ' || chr(10), 'en'), (-4, null, 'en'), (-5, null, null), (-7, '', null), (-8, 'one text', 'de'), (-8, 'another', 'de'), (-8, 'another', 'de'), (null, 'no id', 'de')"
    con = duckdb.connect()
    con.execute(f"copy (from '{sf}/documents.parquet' union all select i, t, l, 'web', length(t) from (values {odd}) v(i, t, l)) to '{tmp_path}/documents.parquet'")
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet'")
    for name in ("j02_with_keys", "j05_keyed_files", "t08_group_sizes"):
        got, want = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
        assert sorted(map(str, map(tuple, got.select(want.columns).collect()))) == sorted(map(str, want.fetchall())), name
    assert spark.range(1).select(S.prompt_key(F.lit(" ")).isNull()).first()[0]  # as a property of one text it is null still


def test_equal_graphs_are_worked_out_once(spark, sf):
    from imprynt.operators import graph as G
    from imprynt.plans import q_graph

    nodes = [(f, n, c) for f in (1, 2, 3, 4, 5) for n, c in (("a", "KSampler"), ("b", "VAEDecode"))] + [(5, "b", "VAEDecode"), (6, "a", None), (6, "b", "VAEDecode")]
    edges = [(1, "b", "samples", "a"), (3, "b", "samples", "a"), (2, "b", "samples", "b"), (4, "b", "sample", "sa"), (5, "b", "samples", "a"), (6, "b", "samples", "a")]
    n, e = spark.createDataFrame(nodes, "file_id long, node_id string, class_type string"), spark.createDataFrame(edges, "file_id long, dst string, input string, src string")
    same = G.equal_graphs(G.graph_digests(n, e))
    assert {r["file_id"]: r["same"] for r in same.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6}
    few = G.standing(n, same)
    assert sorted({r["file_id"] for r in few.collect()}) == [1, 2, 4, 5, 6]
    assert sorted(map(tuple, G.spread(few, same).collect()), key=str) == sorted(nodes, key=str)
    # two texts of files and three of switches: six graphs, whatever the files
    assert q_graph.rich_standing(spark, sf)[0].select("file_id").distinct().count() == 6


def test_texts_of_files_go_with_the_graph_that_stands_for_them(spark):
    from imprynt.operators import extraction as E
    from imprynt.operators import graph as G

    graph = [("1", "CLIPTextEncodeFlux"), ("2", "PrimitiveString"), ("3", "StringConcatenate"), ("4", "KSampler"), ("5", "MysteryNode"), ("6", "PrimitiveFloat")]
    links = [("1", "t5xxl", "3"), ("3", "string_a", "2"), ("4", "positive", "1"), ("4", "negative", "5"), ("1", "guidance", "6")]
    lits = [("1", "clip_l", "other {}", None), ("2", "value", "a{}", None), ("3", "string_b", "b{}", None), ("5", "words", "the long text of file {}", None), ("5", "more", "the longest text of file {}", None), ("6", "value", None, 1.5)]
    files = range(8)
    n = spark.createDataFrame([(f, *x) for f in files for x in graph], "file_id long, node_id string, class_type string")
    e = spark.createDataFrame([(f, *x) for f in files for x in links], "file_id long, dst string, input string, src string")
    # a blank part, an unknown delimiter, a text too short to be taken, none at all
    said = lambda f, i, t: t and (" " if f == 1 and i in ("value", "string_b") else "short" if f == 2 and i in ("words", "more") else t.format(f))
    rows = [(f, k, i, said(f, i, t), None if f == 5 and v else v) for f in files for k, i, t, v in lits if f != 4] + [(3, "3", "delimiter", None, 1.0), (6, "6", "value2", None, 2.0)]
    l = spark.createDataFrame([(*r, None) for r in rows], "file_id long, node_id string, input string, str string, num double, bool boolean")
    off = spark.createDataFrame([], "file_id long, node_id string, input string")
    same = G.equal_graphs(G.graph_digests(n, e), G.digests(E.long_texts(l), "node_id"))
    assert 1 < same.select("same").distinct().count() < 4
    rank = G.topo_order(e, n.select("file_id", "node_id"))
    stages = E.sampler_stages(n, rank)
    got = {}
    for side in ("positive", "negative"):
        one = [G.standing(x, same) for x in (stages, n, e)]
        traced = E.trace_prompts(*one, l, off, side, G.standing(rank, same), same).collect()
        assert sorted(traced, key=str) == sorted(E.trace_prompts(stages, n, e, l, off, side, rank).collect(), key=str) and len(traced) == len(files)
        got[side] = {r["file_id"]: (r["prompt"], r["encoder_guidance"]) for r in traced}
    assert got["positive"] == {0: ("a0b0", 1.5), 1: ("other 1", 1.5), 2: ("a2b2", 1.5), 3: ("other 3", 1.5), 4: (None, None), 5: ("a5b5", None), 6: ("a6b6", None), 7: ("a7b7", 1.5)}
    assert {f: p for f, (p, _) in got["negative"].items()} == {f: None if f in (2, 4) else f"the longest text of file {f}" for f in files}


def test_power_prompts_are_dealt_out(spark, sf):
    from imprynt.plans.q_graph import power_prompts

    assert power_prompts(spark, sf).rdd.getNumPartitions() > 1

"""Cases that an operator once answered only in part."""

import random

import corpus_pipeline
from imprynt.llm import secrets


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_every_secret_of_a_word_is_found(spark):
    rnd = random.Random(2)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    hexes, key, gh = (lambda: pick("0123456789abcdef", 18)), (lambda: "AKIA" + pick("ABCDEFGH234567", 16)), "ghp_" + pick("abcdEFGH123", 36)
    one, two, three, four = key(), key(), key(), hexes()
    cases = [
        ("login password=S3cr3tPw9 now", {"S3cr3tPw9"}),
        ("login password: S3cr3tPw8 now", {"S3cr3tPw8"}),
        ("login token:S3cr3tPw7 now", {"S3cr3tPw7"}),
        ("login password=correcthorse now", {"correcthorse"}),
        ('x {"key":"%s","env":"prod"} y' % one, {one}),
        (f"get /a?api_key={four}&v=1 now", {four}),
        (f"user {gh};user here", {gh}),
        (f"both {two},{three} here", {two, three}),
        (f"again {two},{two} here", {two}),
        ("the token: the thing", set()),
    ]
    texts = [t for t, _ in cases] + [f"some words password={hexes()} and more" for _ in range(40)] + [f"a key {key()} here" for _ in range(40)]
    texts += [f"write to person.{i}name@mail{i}.example.com for more" for i in range(40)] + ["see https://www.page1.example.org/index2 there"] * 20
    found = secrets.scan(docs(spark, texts)).collect()
    for i, (text, want) in enumerate(cases):
        assert want <= {r["value"] for r in found if r["doc_id"] == i and r["is_secret"]}, text
    twice = [r for r in found if r["doc_id"] == 8]
    assert len(twice) == 2 and len({(r["pos"], r["run"]) for r in twice}) == 2


def test_clean_rows_with_null_or_repeated_ids_stay(spark, tmp_path):
    rnd = random.Random(5)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    a, b, c, d, e, item = *(text(80) for _ in range(5)), text(30)
    dirty = f"{text(40)} {item} {text(20)}"
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, a), (None, b), (7, c), (7, d), (8, c), (9, e), (9, e), (None, e), (None, dirty)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    by = lambda out: sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(None, a), (None, b), (7, c), (7, d), (9, e)]
    near = corpus_pipeline.near_dedup(spark, frame, str(tmp_path))
    assert by(near) == sorted([*want, (None, dirty)], key=str) and near.columns == frame.columns
    assert by(corpus_pipeline.decontamination(spark, near, str(tmp_path))) == sorted(want, key=str)


def test_leaders_of_a_group_of_many_unlike_texts(spark):
    """Texts of the same words in other orders: one proposed group, few of them alike. Batches of 5 settle it in rounds."""
    from imprynt.llm import simhash

    rnd = random.Random(9)
    words, texts = [f"w{i}" for i in range(60)], []
    for _ in range(40):
        rnd.shuffle(words)
        texts.append(" ".join(words))
        if rnd.random() < 0.4:
            texts.append(" ".join([*words[1:], "x"]))
    texts += [texts[0], "", None, " "]
    rnd.shuffle(texts)
    sets, want = [simhash.shingles(t, 5) for t in texts], []
    for i, a in enumerate(sets):
        like = lambda b, a=a: len(a & b) >= 0.8 * len(a | b)
        want.append(next((j for j in range(i) if want[j] == j and like(sets[j])), i))
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, place long, text string")
    for batch in (simhash.BATCH, 5):
        assert {r["id"]: r["leader"] for r in simhash.similar_groups(frame, batch=batch).collect()} == dict(enumerate(want))


def test_no_feature_reads_the_words_that_label(spark):
    """The same findings beside other names of secrets, or none: every feature stays the same."""
    rnd = random.Random(4)
    values = ["".join(rnd.choice("abcdef0123456789") for _ in range(20)) for _ in range(12)]
    frame = lambda name: docs(spark, [f"here the {name}={v} then" if name else f"here the {v} then" for v in values])
    words = secrets.dictionary(docs(spark, ["here the then " * 5]))
    told = []
    for name in ("password", "token", "api_key", "x"):
        rows, names = secrets.features(secrets.proven(secrets.findings(frame(name))), words)
        rows = {r["value"].split("=")[-1]: [r[n] for n in names] for r in rows.collect() if len(r["value"].split("=")[-1]) == 20}
        told.append({k: v for k, v in rows.items() if k in values})
    assert told[0].keys() == set(values) and told[0] == told[1] == told[2]
    judged_ = secrets.proven(secrets.findings(frame("password")))
    assert {r["label"] for r in judged_.collect()} == {1}


def test_trees_are_those_of_the_forest(spark):
    """The CASE expressions give the chance that the fitted forest gives."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    rnd = random.Random(7)
    rows = [(rnd.random(), rnd.choice([0.0, 1.0, 2.0]), float(rnd.random() < 0.4)) for _ in range(400)]
    frame = spark.createDataFrame([(a, b, c if rnd.random() < 0.2 else float(a + b > 1.4)) for a, b, c in rows], "a double, b double, label double")
    made = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(frame)
    forest = RandomForestClassifier(numTrees=5, maxDepth=4, seed=1).fit(made)
    total = sum((F.expr(secrets._tree(t._java_obj.rootNode(), ["a", "b"])) for t in forest.trees), F.lit(0.0)) / 5
    both = forest.transform(made).select(total.alias("own"), "probability").collect()
    assert all(abs(r["own"] - r["probability"][1]) < 1e-9 for r in both)


def test_hostile_markup_takes_linear_time(spark):
    import time

    from imprynt.llm import warc

    pages = ["<a " * 350_000, "<nav><main " * 90_000, "<html <title " * 80_000, "<title><title " * 70_000, "<p>one</p><a href='x'>two</a>", "<head><body " * 90_000, "</script " * 110_000, "<!-- " * 200_000]
    frame = spark.createDataFrame(list(enumerate(["u"] * len(pages))), "page_id long, url string").join(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), "page_id")
    warc.derivatives(warc.responses(frame.where("page_id = 4")), ["page_id"]).collect()
    began = time.time()
    rows = warc.derivatives(warc.responses(frame), ["page_id"]).select("page_id", "type", "block").collect()
    assert time.time() - began < 30 and len(rows) == 2 * len(pages)
    assert {r["block"] for r in rows if r["page_id"] == 4 and r["type"] == "conversion"} == {"one\ntwo"}


def test_languages_are_those_of_the_nearest_centroid_by_brute_force(spark, sf):
    import math
    from collections import Counter

    from imprynt.llm import langid

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(120)
    train = rows.where("doc_id % 3 > 0 and lang is not null").select("text", "lang")
    model = langid.fit(train)

    def cells(text):
        b = [int(langid.FOLD[c]) for c in (text or "").encode()]
        codes = [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]
        return Counter((c * 2654435761 & 0xFFFFFFFF) >> (33 - langid.DIM.bit_length()) for c in codes if c != 0x202020)

    texts = [r["text"] for r in train.collect()]
    df = Counter(c for t in texts for c in cells(t))
    assert all(abs(model.idf[c] - (math.log((1 + len(texts)) / (1 + df[c])) + 1)) < 1e-4 for c in range(langid.DIM))
    assert set(model.langs) == {r["lang"] for r in train.distinct().collect()} and max(Counter(model.langs).values()) <= langid.CLUSTERS
    told = {r["doc_id"]: r for r in langid.predict(rows, model, ["doc_id"]).collect()}
    assert len(told) == rows.count()
    for r in rows.collect():
        v = {c: math.log1p(n) * float(model.idf[c]) for c, n in cells(r["text"]).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        near = [sum(x * float(m[c]) for c, x in v.items()) / size for m in model.centroids]
        own = told[r["doc_id"]]
        if any(c.isalpha() for c in r["text"] or ""):
            assert abs(own["score"] - min(1.0, max(0.0, max(near)))) < 1e-3
            assert max(n for n, name in zip(near, model.langs, strict=True) if name == own["lang_pred"]) > max(near) - 1e-4
        else:
            assert (own["lang_pred"], own["score"]) == ("und", 0.0)

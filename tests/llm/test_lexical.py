"""Odd sketches, the document FP-tree and phrase counting against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from imprynt.llm import collocations, fptree, oddsketch


def documents(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- op11


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def components(texts, share=85):
    sets, top = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                x, y = top[i], top[j]
                top = [min(x, y) if t in (x, y) else t for t in top]
    return top, sets


def near_texts(rnd, n):
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    out = ["", None, " \t ", "one", "One", "two words", "two  words", "İ x", "i̇ x"]
    for _ in range(n):
        base = [word() for _ in range(rnd.choice([3, 30, 200]))]
        for _ in range(rnd.choice([1, 2, 8])):
            own = list(base)
            for _ in range(rnd.choice([0, 1, len(base) // 40, len(base) // 20])):
                own[rnd.randrange(len(own))] = word()
            out.append(" ".join(own).upper() if rnd.random() < 0.2 else " ".join(own))
    rnd.shuffle(out)
    return out


def test_links_of_odd_sketches_are_those_of_brute_force(spark):
    texts = near_texts(random.Random(3), 40)
    top, sets = components(texts)
    rows = {r["doc_id"]: r for r in oddsketch.near_duplicates(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in rows.items()} == {i: (len(sets[i]), top[i], top[i] == i) for i in rows}


def test_large_buckets_keep_links_that_go_round_their_leader(spark):
    """Chains of texts, each like the next but not like the first, in buckets that count as large."""
    rnd = random.Random(8)
    texts = []
    for _ in range(3):
        now = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        for _ in range(25):
            texts.append(" ".join(now))
            now = list(now)
            now[rnd.randrange(len(now))] = f"w{rnd.randrange(10**6)}"
            now[rnd.randrange(len(now))] = f"w{rnd.randrange(10**6)}"
    order = list(range(len(texts)))
    rnd.shuffle(order)
    texts = [texts[i] for i in order]
    top, _ = components(texts)
    rows = oddsketch.near_duplicates(documents(spark, texts), small=2, block=7).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(top)) and len(set(top)) < len(texts) / 3


def test_odd_sketches_estimate_how_many_samples_differ():
    rnd = np.random.default_rng(1)
    for share in (1.0, 0.95, 0.85):
        counts = []
        for _ in range(60):
            both = rnd.integers(0, 1 << 63, 1000, np.uint64)
            a, b = both.copy(), both.copy()
            alone = round(1000 * (1 - share) / (1 + share))
            b[:alone] = rnd.integers(0, 1 << 63, alone, np.uint64)
            sk = oddsketch.sketches(np.stack([oddsketch.samples(a), oddsketch.samples(b)]))
            counts.append(int(np.bitwise_count(sk[0] ^ sk[1]).sum()))
        mean = 128 * (1 - math.exp(-4 * oddsketch.SAMPLES * (1 - share) / oddsketch.BITS))
        assert abs(np.mean(counts) - mean) <= 4 and max(counts) <= oddsketch.MOST


def test_ids_that_repeat_or_are_missing(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(7, a), (7, b), (3, b), (None, a), (None, "alone here now then"), (None, ""), (5, ""), (5, ""), (7, a)]
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got], key=str) == sorted([(7, 48, 7, True), (7, 48, 3, False), (3, 48, 3, True), (None, 48, 7, False), (None, 2, None, True), (None, 0, None, True), (5, 0, 5, True), (5, 0, 5, True), (7, 48, 7, True)], key=str)


# ---- op12


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def ranking(texts, items, top=10):
    docs = [Counter(terms(t)) for t in texts]
    n = [sum(d.values()) for d in docs]
    documents_, length, df = sum(x > 0 for x in n), sum(n), Counter(t for d in docs for t in d)
    out = []
    for item, text in items:
        scores = []
        for i, d in enumerate(docs):
            if n[i]:
                m = 25 + (75 * n[i] * documents_) // length
                score = sum(math.floor(1000 * math.log((2 * documents_ + 2) / (2 * df[t] + 1))) * (10**9 * d[t] // (1000 * d[t] + 8 * m)) for t in terms(text) if t in d)
                scores += [(-score, i)] if score > 0 else []
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def test_ranking_is_that_of_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["the", "of", "Ünd", "größe", f"w{int(rnd.paretovariate(0.6)) % 400}", "x1,y2"])
    texts = [" ".join(word() for _ in range(rnd.choice([0, 3, 20, 150]))) for _ in range(300)] + [None, "", "THE the the", "the the the"]
    texts += texts[5:25] * 4
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 4, 30])))) for i in range(25)] + [(90, None), (91, "..."), (92, "nowhere"), (93, "the the of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (fptree.BLOCK, 300):
        got = fptree.ranked(documents(spark, texts), bench, block=block).collect()
        assert sorted(map(tuple, got)) == ranking(texts, items)


def test_tree_bounds_hold_and_share_paths():
    rnd = np.random.default_rng(2)
    size = rnd.integers(1, 12, 500)
    term = np.concatenate([rnd.choice(30, s, replace=False, p=np.arange(30, 0, -1) / 465) for s in size])
    tf, m = rnd.integers(1, 9, len(term)), rnd.integers(25, 300, len(size))
    offsets = np.append(0, np.cumsum(size))
    tree = fptree.Tree(m, offsets, term, tf, np.arange(30), leaf=4)
    assert sorted(tree.order) == list(range(500)) and len(tree.lo) < len(term)
    weight = np.zeros(30, np.int64)
    weight[[1, 5, 9, 20]] = [3, 100, 40, 900]
    bound = tree.bounds({int(t): int(weight[t]) for t in np.flatnonzero(weight)})
    for node in range(len(tree.lo)):
        assert tree.scores(node, weight).max(initial=0) <= bound[node]
        assert not tree.children[node] or (tree.lo[node], tree.hi[node]) == (tree.lo[tree.children[node][0]], tree.hi[tree.children[node][-1]])
    whole = {int(d): int(s) for node in range(len(tree.lo)) if not tree.children[node] for d, s in zip(tree.order[tree.lo[node] : tree.hi[node]], tree.scores(node, weight), strict=True)}
    exact = {d: sum(int(weight[t]) * (10**9 * int(f) // (1000 * int(f) + 8 * int(m[d]))) for t, f in zip(term[offsets[d] : offsets[d + 1]], tf[offsets[d] : offsets[d + 1]], strict=True)) for d in range(500)}
    assert whole == exact


def test_a_text_in_pieces_has_the_same_terms(spark, monkeypatch):
    monkeypatch.setattr(fptree, "TEXTS", 64)
    texts = ["alpha beta " * 40 + "gamma", "x" * 500 + " beta", "beta"]
    items = [(0, "alpha beta gamma"), (1, "x" * 500)]
    got = fptree.ranked(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == ranking(texts, items)


# ---- op13


def mined(texts, langs, least, top, share=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in zip(texts, langs, strict=True):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in kept.items():
            if len(p) == 2 and any(100 * b >= share * a for q, b in kept.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_phrases_are_those_of_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["the", "The", "of", "a", "é", f"w{int(rnd.paretovariate(0.9)) % 60}"])
    texts = ["".join(word() + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rnd.choice([0, 5, 200]))) for _ in range(60)] + [None, "", ".,;"]
    texts += ["hot pair " + f"u{i}" for i in range(300)]
    langs = [rnd.choice(["en", "de", None]) for _ in texts]
    want = mined(texts, langs, 4, 150)
    docs = documents(spark, texts, langs)
    for block, group in ((collocations.BLOCK, collocations.GROUP), (700, 40)):  # the second: pairs and leads that are dealt out
        got = collocations.collocations(docs, least=4, top=150, block=block, group=group).collect()
        assert sorted(map(tuple, got)) == want


def test_equal_partitions_are_counts():
    rnd = np.random.default_rng(0)
    keys = np.minimum(rnd.zipf(1.5, (3, 4000)), 50).astype(np.int32)
    weights = rnd.integers(1, 4, 4000)
    counts = Counter()
    for *word, w in zip(*keys, weights, strict=True):
        for d in range(3):
            counts[d, *map(int, word[: d + 1])] += int(w)
    for least in ((1, 1, 1), (12, 12, 12), (1, 1, 9)):
        depth, at, total = collocations.equal_parts(keys, weights, least)
        assert {(int(d), *map(int, keys[: d + 1, p])): int(t) for d, p, t in zip(depth, at, total, strict=True)} == {k: c for k, c in counts.items() if c >= least[k[0]]}
    assert [len(x) for x in collocations.equal_parts(keys[:, :0], weights[:0], (1, 1, 1))] == [0, 0, 0]


def test_suffixes_without_room_for_one_number():
    lead, two, three = (np.array(x) for x in ([1, 0, 1, 1], [2, 9, 2, 2], [3, 9, 3, 4]))
    packed, apart = collocations.merged(lead, two, three, (2, 10)), collocations.merged(lead, two, three, (1 << 40, 1 << 30))
    assert all((a == b).all() for a, b in zip(packed, apart, strict=True))


def test_words_of_pieces_cut_from_a_long_text():
    from imprynt.llm import words

    text = "aa bb. cc dd, ee\n" * 20 + "last"
    whole = [w for body, at, _ in words.blocks(pa.array([None, text, "", "x"]), collocations.KIND, 1 << 30, words.END) for w in words.words(body, at, collocations.KIND)[0].to_pylist()]
    parts = list(words.blocks(pa.array([None, text, "", "x"]), collocations.KIND, 50, words.END))
    assert len(parts) > 5 and [w for body, at, _ in parts for w in words.words(body, at, collocations.KIND)[0].to_pylist()] == whole
    assert {int(r) for _, _, rows in parts for r in rows} == {0, 1, 2, 3}

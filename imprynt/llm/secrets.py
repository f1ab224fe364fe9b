"""Operator 7, secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of [A-Za-z0-9+/_.@:-] anywhere in a word (a colon after a name such as token
ends a run): one of 12 or more characters with a digit, the last one of a word with a digit, one of
a key's form, or, of any length and with or without digits, one to which a name such as password=
or token: assigns. A word gives a row for each. The forest's features:

- length, shares of character classes, distinct characters, longest run of letters;
- character transitions: the mean surprise, in bits, of each character after the one before it, by a
  bigram model over the words of the corpus (letters folded, one class of digits, one of signs);
- dictionary coverage: the share of characters in letter runs that are words of the corpus; the
  dictionary is every bare word that occurs OFTEN times or more in all documents;
- neighbouring words: how common those at its sides are, and their evidence, the log-odds of a
  labelled finding beside such a word being a secret (from the other half of the labelled findings
  where the finding is itself labelled);
- the path (`source`): its depth, and signs of tests or documentation.

It is trained on labelled findings - any table with findings()' columns and `label` - and then
written out as one CASE expression for each tree, so scoring is a projection. Everything here is
DataFrame functions. Findings meet the dictionary, the transitions (at most 28 x 28 rows) and the
evidence by joins.

The query has no table of hand-labelled findings, so its labels are those that a finding's own form
proves (proven(): key prefixes and assignments, not of plain words after a space, against e-mail
addresses, addresses and numbers with a valid check digit). The names that prove an assignment are
taken out of every feature: the neighbouring words are those next to a finding that name no secret. At most FIT labelled findings, those with the least hash, are used for training; one in
HELD_OUT of all labelled is kept aside for measure(); all findings are scored.

Null and empty texts have no findings. Repeated rows give their findings again; ties between equal
findings are harmless, as they have equal features. A very long text is one row's work, in an array
of its words. Other columns play no part. Where the labels do not have both classes, there is
nothing to learn and every candidate stays, with probability null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imprynt.llm.common import table, written

NAME = "op7_secret_scan"
FIT, TREES, DEPTH, SEED, CUT, HELD_OUT = 20_000, 20, 6, 7, 0.5, 5
LONG, PROVEN, OFTEN = 12, 6, 3
# Words that name a secret, words that name a placeholder.
NAMES = "password passwd passphrase pwd secret token apikey api_key access_key private_key auth bearer credential"
PLACEHOLDERS = "example sample dummy test changeme placeholder your xxxx redacted"


def _any_of(words: str) -> str:
    return "(?i)(?:" + "|".join(sorted(words.split(), key=lambda w: (-len(w), w))) + ")"


NAMED = _any_of(NAMES) + r"[\\\"'`]*\s*[=:]{1,2}>?"
ASSIGNED = NAMED + r"\s*[\\\"'`]*$"
RUN = f"(?:[A-Za-z0-9+/_.@-]|(?<!{_any_of(NAMES)}):)+=*"
KEY = "^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk-[A-Za-z0-9]{20,}$"
KEY_STARTS = "AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-"


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, path, pos, run, value, before, prev2, prev, next): each candidate of docs(doc_id, text, source); pos
    counts words from 0, run the runs of its word; before is what stands before it from the second last run on."""
    words = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), F.split("text", r"\s+").alias("words"))
    near = lambda i, d: F.coalesce(F.get("words", i + d), F.lit(""))
    worth = lambda w, i: ((F.length(w) >= LONG) & w.rlike("[0-9]")) | w.rlike(KEY_STARTS) | F.concat_ws(" ", near(i, -2), near(i, -1), w).rlike(NAMED)
    some = F.transform("words", lambda w, i: F.when(worth(w, i), F.struct(i.alias("pos"), w.alias("word"), near(i, -2).alias("prev2"), near(i, -1).alias("prev"), near(i, 1).alias("next"))))
    rows = words.select("doc_id", "path", F.explode(F.filter(some, lambda x: x.isNotNull())).alias("c")).select("doc_id", "path", "c.*")
    rows = rows.withColumn("runs", F.regexp_extract_all("word", F.lit(RUN), F.lit(0))).withColumn("gaps", F.split("word", RUN))
    part = lambda name, i: F.coalesce(F.get(name, i), F.lit(""))
    last = (F.size("runs") - 1).alias("last")
    each = F.transform("runs", lambda v, i: F.struct(i.alias("run"), v.alias("value"), F.concat(part("gaps", i - 2), part("runs", i - 2), part("gaps", i - 1), part("runs", i - 1), part("gaps", i)).alias("before")))
    rows = rows.select("doc_id", "path", "pos", "prev2", "prev", "next", last, F.col("word").rlike("[0-9]").alias("digits"), F.explode(each).alias("c"))
    rows = rows.select("doc_id", "path", "pos", "c.run", "c.value", "c.before", "prev2", "prev", "next", "last", "digits")
    v = F.col("value")
    shaped = (F.length(v) >= LONG) & (v.rlike("[0-9]") | (F.col("digits") & (F.col("run") == F.col("last"))))
    rows = rows.where(v.rlike("[A-Za-z0-9]") & (shaped | v.rlike(KEY) | F.concat_ws(" ", "prev2", "prev", "before").rlike(ASSIGNED)))
    return rows.drop("last", "digits")


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of a-z alone, three letters or more, that occur OFTEN times or more in docs(text)."""
    words = docs.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where(F.col("word").rlike("^[a-z]{3,16}$"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


def _classes(text: Column) -> Column:
    """text with its letters folded, digits as 0 and signs as -."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[^a-z0]", "-")


def _pairs(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))


def transitions(words: DataFrame) -> DataFrame:
    """(pair, surprise): bits of the second character after the first, over words(word, n), each character once more
    than it was seen; at most 28 x 28 rows."""
    seen = words.select(F.explode(_pairs(F.col("word"))).alias("pair"), "n").where(F.length("pair") == 2).groupBy("pair").agg(F.sum("n").alias("n"))
    signs = [chr(c) for c in range(97, 123)] + ["0", "-"]
    every = words.sparkSession.createDataFrame([(a + b,) for a in signs for b in signs], "pair string").join(seen, "pair", "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    total = every.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("all"))
    return every.join(total, F.substring("pair", 1, 1) == F.col("first")).select("pair", (-F.log2(F.col("n") / F.col("all"))).alias("surprise"))


def _side(text: Column) -> Column:
    """The last letter run of what stands on that side, lower-cased."""
    return F.lower(F.regexp_extract(text, "([A-Za-z]+)[^A-Za-z]*$", 1))


def _unnamed(found: DataFrame) -> DataFrame:
    """found with `__prev`, `__next` and `__beside`: the nearest word on each side, and the words around, of those that
    name no secret. The names are what proven() labels by, so no feature may see them."""
    plain = lambda words: F.filter(words, lambda w: (w != "") & ~w.rlike(_any_of(NAMES)))
    before = plain(F.array("before", "prev", "prev2"))
    return found.withColumns({"__prev": F.coalesce(F.get(plain(F.array("prev", "prev2")), 0), F.lit("")), "__next": F.coalesce(F.get(plain(F.array("next")), 0), F.lit("")), "__beside": F.concat(before, plain(F.array("next")))})


def features(found: DataFrame, words: DataFrame, evidence_from: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """found, written, with the forest's columns, and their names; words: dictionary(). evidence_from: labelled
    findings (word sides and label) of which the evidence of neighbouring words is taken; default found's own."""
    v = F.col("value")
    n = F.length(v)
    kept = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / n
    flag = lambda c: c.cast("double")
    columns = {
        "f_length": n.cast("double"),
        "f_digits": kept("[^0-9]"),
        "f_upper": kept("[^A-Z]"),
        "f_lower": kept("[^a-z]"),
        "f_signs": kept("[A-Za-z0-9]"),
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "f_letter_run": F.array_max(F.transform(F.split(v, "[^A-Za-z]"), lambda x: F.length(x))) / n,
        "f_prev_length": F.length("__prev").cast("double"),
        "f_next_length": F.length("__next").cast("double"),
        "f_path_test": flag(F.col("path").rlike(r"(?i)test|example|spec|doc|fixture")),
        "f_path_depth": F.size(F.split("path", "/")).cast("double"),
    }
    fold = F.when(F.col("label").isNull(), 2).otherwise(F.pmod(F.xxhash64("value", "doc_id"), F.lit(2)).cast("int"))
    own = written(_unnamed(found).withColumns(columns).withColumn("__id", F.monotonically_increasing_id()).withColumn("__fold", fold), "findings")

    # letter runs of three or more, and the words at the sides, meet the dictionary in one join
    runs = F.transform(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: F.struct(w.alias("word"), F.lit("run").alias("kind")))
    sides = [F.struct(_side(F.col(f"__{c}")).alias("word"), F.lit(c).alias("kind")) for c in ("prev", "next")]
    asked = own.select("__id", F.explode(F.concat(runs, F.array(*sides))).alias("w")).select("__id", "w.word", "w.kind")
    known = asked.join(words, "word").groupBy("__id")
    side = lambda c: F.log1p(F.coalesce(F.max(F.when(F.col("kind") == c, F.col("n"))), F.lit(0)))
    known = known.agg(F.sum(F.when(F.col("kind") == "run", F.length("word")).otherwise(0)).alias("__covered"), side("prev").alias("f_prev_known"), side("next").alias("f_next_known"))

    # beyond 28 x 28 rows there are none: small by construction
    steps = own.select("__id", F.explode(_pairs(_classes(v))).alias("pair")).join(F.broadcast(transitions(words)), "pair")
    surprise = steps.groupBy("__id").agg(F.avg("surprise").alias("f_transitions"))

    said = F.array_distinct(F.transform("__beside", _side))
    told = own.select("__fold", "label", "__beside") if evidence_from is None else _unnamed(evidence_from).select(F.lit(3).alias("__fold"), "label", "__beside")
    folds = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda g: g != F.col("__fold"))
    counts = told.where("label is not null").select("label", F.explode(said).alias("word"), folds.alias("folds")).select("label", "word", F.explode("folds").alias("__fold")).where("word <> ''")
    odds = counts.groupBy("word", "__fold").agg(F.log((F.sum("label") + 0.5) / (F.count("*") - F.sum("label") + 0.5)).alias("odds"))
    beside = own.select("__id", "__fold", F.explode(said).alias("word")).join(odds, ["word", "__fold"])
    evidence = beside.groupBy("__id").agg(F.sum("odds").alias("f_evidence"))

    out = own.join(known, "__id", "left").join(surprise, "__id", "left").join(evidence, "__id", "left")
    out = out.withColumn("f_dictionary", F.coalesce("__covered", F.lit(0)) / n).fillna(0.0, ["f_prev_known", "f_next_known", "f_transitions", "f_evidence"])
    return out.drop("__covered", "__fold", "__id", "__prev", "__next", "__beside"), [*columns, "f_prev_known", "f_next_known", "f_transitions", "f_evidence", "f_dictionary"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise((d.try_cast("int") * 2) % 10 + F.floor(d.try_cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def proven(found: DataFrame) -> DataFrame:
    """found with `label`: 1 or 0 where a finding's own form proves it, else null."""
    v, left = F.col("value"), F.concat_ws(" ", "prev2", "prev", "before")
    key = v.rlike(KEY)
    # a plain word after a space, as in "token: the", proves nothing
    formed = (F.length(v) >= PROVEN) & (v.rlike("[^A-Za-z]") | F.col("before").rlike("[=:]"))
    named = left.rlike(ASSIGNED) & formed & ~v.rlike(_any_of(PLACEHOLDERS))
    plain = v.rlike("^[^@]+@[^@]+[.][a-z]+$|://") | (v.rlike("^[0-9]{13,19}$") & luhn(v))
    return found.withColumn("label", F.when(key | named, 1).when(plain, 0))


def _tree(node, names: list[str]) -> str:
    """A tree of the fitted forest as SQL: the chance of class 1."""
    if node.numDescendants() == 0:
        stats = list(node.impurityStats().stats())
        return f"{stats[1] / max(sum(stats), 1e-12):.12f}"
    split = node.split()
    return f"CASE WHEN {names[split.featureIndex()]} <= {split.threshold()!r} THEN {_tree(node.leftChild(), names)} ELSE {_tree(node.rightChild(), names)} END"


def _aside() -> Column:
    return F.pmod(F.xxhash64(F.lit(3), "doc_id", "pos", "value"), F.lit(HELD_OUT)) == 0


def train(labelled: DataFrame, names: list[str], fit: int = FIT) -> Column | None:
    """The forest's chance of a secret as a column over `names`; None without both classes."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = labelled.where(F.col("label").isNotNull() & ~_aside()).orderBy(F.xxhash64("doc_id", "pos", "value"), "doc_id", "pos", "run").limit(fit)
    sample = written(sample.select(F.col("label").cast("double").alias("label"), *names), "findings_fit")
    if sample.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(sample).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows)
    total = None
    for t in forest.trees:
        one = F.expr(_tree(t._java_obj.rootNode(), names))
        total = one if total is None else total + one
    return total / len(forest.trees)


def judged(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """findings() of docs with label (null: none), the features and probability (null: nothing to learn from)."""
    words = written(dictionary(docs), "dictionary")
    found = findings(docs)
    if labelled is None:
        rows, names = features(proven(found), words)
        training = rows = written(rows, "findings_features")
    else:
        rows, names = features(found.withColumn("label", F.lit(None).cast("int")), words, labelled)
        training = features(labelled, words)[0]
    chance = train(training, names)
    return rows.withColumn("probability", F.lit(None).cast("double") if chance is None else F.round(chance, 9))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, run, value, before, probability, is_secret: every candidate of docs(doc_id, text, source), judged.
    labelled: findings() rows with `label`; without it, those of docs that proven() labels."""
    secret = F.coalesce(F.col("probability") >= CUT, F.lit(True))
    return judged(docs, labelled).select("doc_id", "pos", "run", "value", "before", "probability", secret.alias("is_secret"))


def measure(docs: DataFrame) -> dict[str, float]:
    """Precision and recall over the labelled findings that were kept aside, and how many of each class there are."""
    own = judged(docs).where(F.col("label").isNotNull() & _aside())
    yes, hit = F.col("label") == 1, F.col("probability") >= CUT
    n = own.agg(F.count_if(yes & hit).alias("both"), F.count_if(yes).alias("secrets"), F.count_if(hit).alias("told"), F.count("*").alias("all")).first()
    return {"precision": n["both"] / max(n["told"], 1), "recall": n["both"] / max(n["secrets"], 1), "secrets": n["secrets"], "others": n["all"] - n["secrets"]}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "pos", "run", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")

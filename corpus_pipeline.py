"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written and read again as the next one's docs. All but the last return the columns of documents,
whatever they are; n_chars follows the text where a stage changes it.

Rows that a stage drops: documents that the quality classifier rejects (null and empty texts among
them); documents of which line dedup leaves nothing; documents whose 5-word shingles overlap by 0.8
or more with those of a kept document of smaller doc_id (null last; of equal rows one stays);
documents that hold a benchmark passage.
Rows are told apart by doc_id and text, so texts that share a doc_id, or have none, are judged alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprynt.llm import decontaminate, lines, packing, quality, simhash
from imprynt.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    kept = judged.where("keep").select(F.col("doc_id").alias("__kept"), F.col("h").alias("__kept_hash")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")) & (F.xxhash64("text") == F.col("__kept_hash")), "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(docs, "__removed").where((F.col("__removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __key, which equal (doc_id, text) share: a repeated or null doc_id names several texts."""
    return docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.col("doc_id").isNull(), F.col("text").isNull()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    id_ = F.col("doc_id").cast("long")
    # the first of a group by doc_id (null last), then by key
    place = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.col("__key").alias("key"))
    near = simhash.similar_groups(rows.select(F.col("__key").alias("id"), place.alias("place"), "text"))
    first = near.where("id = leader").select(F.col("id").alias("__key")).distinct()
    twice = near.groupBy("id").count().where("count > 1").limit(1).count()
    kept = rows.join(first, "__key", "left_semi")
    return (kept.dropDuplicates(["__key"]) if twice else kept).drop("__key")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    found = decontaminate.contaminated(rows.select(F.col("__key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__key")).distinct()
    return rows.join(found, "__key", "left_anti").drop("__key")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(written(packing.pieces(docs), "pieces"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the model, the fingerprints, the alignment and the packing; tests hold the run against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.  Between stages the
rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, near_dedup, packing, pii, quality
from gridloom.llm.shared import discard, in_small_batches, saved, small, steps


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules or the isolation forest reject.  The forest
    is fitted on the labelled rows among ``docs``.

    Null or empty text has no words, so it goes; a null id or null in another
    column changes nothing; repeated rows are judged alike; very long texts are
    read whole; without labels the base rules alone decide.
    """
    verdict = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept_documents(docs, verdict)


def _hash(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the least id, or of
    the least hash among several of that id or if none has an id.

    A document is a row's id and text, so rows of one id and different texts are
    documents of their own and none is lost.  Of rows of one id and text that
    with the least hash of its columns stays.  Rows without words (null and
    empty text) have no copies, but repeated ones are one row all the same.
    What goes is broadcast if it is little; else the join shuffles.
    """
    names = []
    for name in ("_document", "_row", "_again"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    key, row, again = names
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    keyed = docs.withColumn(key, _hash(0, doc_id, text.isNull(), text))
    with steps() as keep:
        seed = 1
        while True:  # two documents of one key get others
            every = keyed.select(key, doc_id.alias("id"), _hash(-1, text.isNull(), text).alias("check"), F.xxhash64(*docs.columns).alias(row))
            every = saved(every.groupBy(key, "id", "check").agg(F.min(row).alias(row), F.count("*").alias("c")), "near-documents")
            clash = saved(every.groupBy(key).count().filter("count > 1").select(key, F.lit(True).alias(again)), "near-clashes")
            if clash.isEmpty():
                break
            keyed = keyed.join(small(keep(clash)), key, "left").withColumn(key, F.when(F.col(again), _hash(seed, doc_id, text.isNull(), text)).otherwise(F.col(key))).drop(again)
            seed += 1
        told = near_dedup.near_duplicates(keyed, id_col=key).select(F.col("doc_id").alias(key), "component_id").distinct()
        told = saved(every.join(told, key), "near-copies")
        first = told.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", key)).alias("first"))
        gone = keep(saved(told.select(key).join(first.select(f"first.{key}"), key, "left_anti"), "near-copies-gone"))
        repeated = keep(saved(told.filter("c > 1").select(key, row).join(gone, key, "left_anti"), "near-copies-again"))
    left = keyed.join(small(gone), key, "left_anti")
    if not repeated.isEmpty():
        one = small(repeated)
        alike = left.withColumn(row, F.xxhash64(*docs.columns)).join(one, [key, row], "left_semi").dropDuplicates([key])  # these are equal
        left = left.join(one.select(key), key, "left_anti").unionByName(alike.drop(row))
    return left.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Each row is judged by its own text, whatever its id; null and empty texts
    stay; very long ones are read whole; an empty benchmark drops nothing.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; ``n_chars`` follows.

    Every row stays; null text stays null (and its ``n_chars`` becomes null);
    very long texts are read whole.
    """
    in_small_batches(spark)
    out = docs.withColumn("text", pii.redacted(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' byte-level tokens into training sequences: one row
    for each piece of a document.

    Null or empty text is the one token that ends a document; null ids and
    repeated rows are packed as any others; very long texts are cut into pieces.
    """
    return packing.pack(packing.byte_tokens(docs.select("doc_id", "text")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The forest, the tagger and the packing have no SQL form; tests compare
#: run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote goes when the next one
    has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with steps() as keep:
            after = keep(saved(stage(spark, docs, sf_dir), f"stage-{name}"))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from ``documents``: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage is one operator over all that its predecessor kept. All but the last
return the columns of ``documents``. Where a stage goes by id, rows without an id and
rows that share one are told apart by a key made of their contents, larger than
any id, so they are judged as all others; rows that are equal in all columns are
one document. A null text is empty. The stages' results are deterministic but for
the last digits of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlake.llm.decontam import leaked_items
from raterlake.llm.neardup import near_duplicates
from raterlake.llm.packing import pack
from raterlake.llm.quality import score_quality
from raterlake.llm.repeats import remove_repeats
from raterlake.llm.store import BROADCAST_IDS, keep_ids, settle

#: SQL can't express the classifier, the packing and the components together; the tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts (score of 0.5 or more)."""
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*docs.columns)


#: Keys from here on are not ids.
OWN_KEYS = 1 << 62


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its documents apart: the id where it is one row's alone, else OWN_KEYS and a hash of all columns. Also that column's name. Of rows that are equal in all columns and have no id of their own one is left."""
    key = "key"
    while key in docs.columns or f"{key}_id" in docs.columns:
        key += "_"
    several = settle(docs.groupBy(F.col("doc_id").alias(f"{key}_id")).count().where(f"count > 1 or {key}_id is null").select(f"{key}_id"))
    if several.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    named = several.where(f"{key}_id is not null")
    few = named.count() <= BROADCAST_IDS
    marked = docs.join(F.broadcast(named) if few else named, F.col("doc_id") == F.col(f"{key}_id"), "left")
    alone = F.col(f"{key}_id").isNull() & F.col("doc_id").isNotNull()
    contents = F.xxhash64(F.to_json(F.struct(*docs.columns)), F.lit(0))
    own = F.shiftrightunsigned(contents, 2).bitwiseOR(F.lit(OWN_KEYS))
    rows = marked.withColumn(key, F.when(alone, F.col("doc_id").cast("long")).otherwise(own)).drop(f"{key}_id")
    return rows.where(F.col(key) < OWN_KEYS).unionByName(rows.where(F.col(key) >= OWN_KEYS).dropDuplicates([key])), key


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    rows, key = keyed(docs)
    kept = settle(near_duplicates(rows, id_col=key, shingle=5, percent=80).where("kept").select(key).distinct())
    return keep_ids(rows, kept, "left_semi", key).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document with a smaller id has; those of which nothing is left go."""
    rows, key = keyed(docs)
    cut = remove_repeats(rows, length=50, unit="words", id_col=key)
    text = F.when(F.col("n_removed") > 0, F.decode("kept_bytes", "UTF-8")).otherwise(F.col("text"))
    out = cut.withColumn("text", text).where(r"n_removed = 0 or text rlike '\\S'")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (four fifths of an item's five-word shingles)."""
    rows, key = keyed(docs)
    leaks = settle(leaked_items(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).select(key).distinct())
    return keep_ids(rows, leaks, "left_anti", key).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048."""
    return pack(docs, window=2048)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality, near-duplicates, contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads as its docs, with the
columns of ``documents``; the last returns packed pieces. A stage's decisions take effect:
rejected documents go, all but one document of a near-duplicate group go, contaminated ones go,
secrets are replaced in the texts. Columns that a stage needs for itself may stand in the
input, in any case: they are put aside under another name meanwhile.

Defined cases: a null text is scored, scanned and packed as the empty one, and stays null between
stages; a null doc_id passes every filter that has no ground to reject it, as it names no document;
of rows that repeat a doc_id one stays after near-duplicates (the one whose text has the least
hash); of a near-duplicate group the least doc_id stays, so there are no ties; very long texts
are read whole; an empty table passes all stages and gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, near_dup, packing, quality, secrets
from ledgerline.llm.common import cut, table, tune


def _beside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs, those called as in ``names`` put aside meanwhile."""
    aside = {n: f"aside_{k}_{n}" for k, n in enumerate(docs.columns) if n.lower() in names}
    done = work(docs.withColumnsRenamed(aside))
    return done.select(*(F.col(aside.get(n, n)).alias(n) for n in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    model = quality.train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), table(spark, sf_dir, "labels"), ~quality.held_out())
    return _beside(docs, ("score",), lambda d: quality.score(d, model).where(F.col("score") >= quality.THRESHOLD))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Rows that repeat a doc_id are one document. Only such rows are grouped, most tables have none.
    again = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    again = cut(spark, again)
    if again.isEmpty():
        return kept
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64("text")).alias("row"))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark")
    names = ("n_words", "spans", "items", "near_items", "n_hit", "n_items", "items_sha256", "contaminated")
    return _beside(docs, names, lambda d: decontaminate.judge(decontaminate.match(d, bench)).where("not contaminated"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)

    def work(d: DataFrame) -> DataFrame:
        done = secrets.cleaned(d)
        if "n_chars" not in d.columns:
            return done
        size = F.when(F.col("found"), F.length("text").cast(d.schema["n_chars"].dataType))
        return done.withColumn("n_chars", size.otherwise(F.col("n_chars")))

    return _beside(docs, ("found",), work)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Two of the stages are learned or recursive, and tokens have no SQL form. Instead the stages after
#: the learned one are compared with a plain Python version (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(spark, docs)
    return docs

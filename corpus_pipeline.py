"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as
Parquet to the shared folder and reads again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import curriculum, decontaminate, lsh_forest, nbsvm, token_files
from tallyspark.llm.queries import table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Naive Bayes support vector model, trained on ``labels``, does not reject.

    A null or empty text has the score of a text without features. Equal rows stay or go
    together; no documents, or no labels that teach, give a defined model (see ``nbsvm``). All columns come through, whatever their names.
    """
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"))
    own = {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    return nbsvm.score(rows, model).where("predicted = 1").select(*[F.col(x).alias(c) for c, x in own.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (similarity of 0.8 or more on 5-word shingles).

    It is the one with the least doc_id, null ids last, then with the least hash of doc_id
    and text; of rows with equal doc_id and text, the least by all columns that have an order. Rows that
    share a doc_id are separate documents. Those without words (null or empty texts) are in no group and stay.
    All columns come through, whatever their names; an empty table gives no rows.
    """
    path = token_files.shared_path(spark, "dropped")
    near = lsh_forest.near_duplicates(docs, percent=80).where("component IS NOT NULL")
    rows = near.groupBy("component", "row_key").agg(F.first("doc_id").alias("doc_id"), F.count("component").alias("copies"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first"))
    rows = rows.join(first, "component").select("row_key", "copies", (F.col("row_key") == F.col("first.row_key")).alias("stays"))
    rows.where("NOT stays OR copies > 1").select("row_key", "stays").write.parquet(path)
    dropped = spark.read.parquet(path)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ordered = [F.col(f"`{c}`") for c, t in docs.dtypes if not any(x in t for x in ("map<", "variant", "interval"))]
    keyed = docs.select(F.struct(*columns).alias("doc_"), F.struct(*ordered).alias("order_"), F.xxhash64("doc_id", "text").alias("row_key"))  # as lsh_forest's row_key
    single = keyed.join(dropped, "row_key", "left_anti").select("doc_.*")
    copies = keyed.join(dropped.where("stays"), "row_key").groupBy("row_key").agg(F.min_by("doc_", "order_").alias("doc_"))
    return single.unionAll(copies.select("doc_.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark`` (0.8 or more of its shingles).

    Null and empty texts, and items without words, contain nothing; equal rows stay or go
    together; all columns come through, whatever their names; an empty table gives no rows.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), threshold=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order.

    A null source is a source of its own; texts without words are not taken; of equal rows as
    many are taken as the target needs; all columns come through; an empty table gives no rows.
    """
    return curriculum.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' places, sizes and checksums in the token files, read back from them.

    A null text has the end id alone; null ids come first; rows with one doc_id follow each other; no documents, no files.
    """
    path = token_files.shared_path(spark, "token-files")
    token_files.write(docs, path, tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path).drop("ids")


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_files", tokens),
]

#: No SQL: a fitted classifier and a tokenizer take part. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = token_files.shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
